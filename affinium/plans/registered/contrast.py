"""Registered queries: mini-batch weights, contrastive loss, fusion and training."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinium import fixed
from affinium.functions import text as tx
from affinium.functions import vectors as vec
from affinium.operators import contrastive as con
from affinium.operators import ordering
from affinium.operators.fusion import FusionModel, embed, train_fusion
from affinium.operators.network import FusionNetwork
from affinium.operators.textvec import BatchTextEncoder, HashedTextEncoder, Md5TextEncoder, PrecomputedEncoder, TfidfTextEncoder
from affinium.plans.registered import register
from affinium.plans.registered import sql as q
from affinium.plans.registered.encode import encoded
from affinium.session import fresh_path, materialise
from affinium.sources import tables as tb
from affinium.sources.features import FeatureStore


def batched(spark, folder):
    return ordering.assign_batches(tb.labelled_vectors(spark, folder))


def batched_catalog(spark, folder):
    catalog = materialise(tb.catalog(spark, folder), "catalog")
    return ordering.assign_batches(catalog.select("row_id", "genres"))


CATALOG_BATCHES = f"""{q.CATALOG},
numbered as (
  select row_id, genres, (row_number() over (order by md5('42:0:' || row_id), row_id) - 1) // 64 batch_id,
         count(*) over () n from catalog),
kept as (select * from numbered where batch_id < n // 64),
weights as (
  select a.batch_id, a.row_id, b.row_id other_id, len(list_intersect(a.genres, b.genres)) shared,
         len(list_distinct(list_concat(a.genres, b.genres))) united
  from kept a join kept b on a.batch_id = b.batch_id and a.row_id <> b.row_id)"""


@register("jn6_batch_weights", f"""with {CATALOG_BATCHES},
s as (select row_id, count(*) n_positive, list_sort(list(other_id)) positives from weights where shared > 0 group by 1)
select batch_id, row_id, coalesce(n_positive, 0) n_positive, coalesce(positives, []::bigint[]) positives
from kept left join s using (row_id)""")
def jn6(spark, folder):
    rows = con.batch_weights(batched_catalog(spark, folder))
    others = F.array_sort(F.transform("positives", lambda p: p["row_id"]))
    return rows.select("batch_id", "row_id", F.size("positives").cast("long").alias("n_positive"),
                       others.alias("positives"))


@register("jn6_jaccard_weights", f"""with {CATALOG_BATCHES}
select batch_id, row_id, round(sum(shared / greatest(united, 1)), 6) weight from weights group by 1, 2""")
def jn6_jaccard(spark, folder):
    rows = con.batch_weights(batched_catalog(spark, folder), jaccard=True)
    total = F.aggregate("positives", F.lit(0.0), lambda s, p: s + p["weight"])
    return rows.select("batch_id", "row_id", F.round(total, 6).alias("weight"))


@register("agg9_batch_losses", f"with {q.PAIRS} select batch_id, n_items, n_valid, round(loss, 6) loss from losses")
def agg9(spark, folder):
    return con.batch_losses(batched(spark, folder)).withColumn("loss", F.round("loss", 6))


@register("agg10_epoch_loss", f"with {q.PAIRS} select round(sum(loss * n_items) / sum(n_items), 6) loss, "
          "count(*) n_batches from losses")
def agg10(spark, folder):
    total = con.epoch_loss(con.batch_losses(batched(spark, folder)))
    return total.withColumn("loss", F.round("loss", 6))


@register("flt7_valid_anchors", f"with {q.PAIRS} select batch_id, n_valid from losses where n_valid > 0")
def flt7(spark, folder):
    return con.batch_losses(batched(spark, folder)).filter("n_valid > 0").select("batch_id", "n_valid")


def keep_sql(at: int) -> str:
    name = fixed.MODALITIES[at]
    return f"(('0x' || substring(md5('42:5:{name}:' || vec_id), 1, 8))::bigint / 4294967296 >= 0.3)::int::double"


@register("ml4_modality_dropout", "select vec_id row_id, ["
          + ", ".join(keep_sql(at) for at in range(len(fixed.MODALITIES))) + "] keep from embeddings")
def ml4(spark, folder):
    items = tb.vectors(spark, folder).select("row_id")
    return con.keep_flags(items, fixed.MODALITY_DROPOUT, fixed.SEED, epoch=5)


# --- text encoders --------------------------------------------------------


@register("ml1_precomputed_vectors", f"""with {q.INDEX}
select row_id, list_transform(embedding, lambda x: round(x, 5)) text from indexed""")
def ml1_precomputed(spark, folder):
    encoder = PrecomputedEncoder(tb.table(spark, folder, "embeddings"), "vec_id", "embedding", 64,
                                 drop_absent=True)
    items = encoder.transform(tb.catalog(spark, folder), "description", "text")
    return items.select("row_id", F.transform("text", lambda x: F.round(x.cast("double"), 5)).alias("text"))


@register("ml1_md5_terms", f"""
with b as (select doc_id, list_transform(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'),
  lambda x: x <> ''), lambda x: ('0x' || substr(md5(x), 1, 8))::bigint % 64) b from documents),
c as (select doc_id, list_transform(range(64), lambda i: len(list_filter(b, lambda y: y = i))) c from b),
n as (select *, greatest(sqrt(list_sum(list_transform(c, lambda x: x * x))), 1) n from c)
select doc_id row_id, list_transform(c, lambda x: round((x / n)::float::double, 6)) text from n""")
def ml1_md5(spark, folder):
    items = Md5TextEncoder(64).transform(tb.text_catalog(spark, folder), "description", "text")
    return items.select("row_id", F.transform("text", lambda x: F.round(x.cast("double"), 6)).alias("text"))


@register("ml1_hashed_terms")
def ml1_hashed(spark, folder):
    return HashedTextEncoder(64).transform(tb.text_catalog(spark, folder), "description", "text").select("row_id", "text")


@register("ml1_tfidf")
def ml1_tfidf(spark, folder):
    items = tb.text_catalog(spark, folder)
    return TfidfTextEncoder.fit(items, "description", 64).transform(items, "description", "text").select("row_id", "text")


def letter_model():
    """Toy model for the plug-in path: letter and digit shares of a text."""
    import numpy as np

    def encode(texts):
        return np.array([[len(t), sum(c == "e" for c in t), sum(c == " " for c in t)] for t in texts], float)

    return encode


@register("ml1_plug_in_encoder", """select doc_id row_id, [length(text)::float, (length(text) - length(replace(text, 'e', '')))::float,
    (length(text) - length(replace(text, ' ', '')))::float] text from documents""")
def ml1_plug_in(spark, folder):
    encoder = BatchTextEncoder("letters", 3, letter_model)
    return encoder.transform(tb.text_catalog(spark, folder), "description", "text").select("row_id", "text")


@register("snk5_feature_store", """select md5('hashed-terms-64' || chr(0) || text) text_key, count(*) n_items
    from documents group by 1""")
def snk5(spark, folder):
    """Stored keys after two fills, counted per item; the second fill finds every text."""
    store = FeatureStore(spark, fresh_path(spark, "features"))
    encoder = HashedTextEncoder(64)
    items = tb.text_catalog(spark, folder)
    store.fill(items, encoder)
    if not store.misses(items, encoder).isEmpty():
        raise RuntimeError("a stored text was missed")
    keyed = items.select(tx.text_key(encoder.name, F.col("description")).alias("text_key"))
    return keyed.join(store.read(encoder.name), "text_key").groupBy("text_key").agg(F.count("*").alias("n_items"))


# --- fusion ---------------------------------------------------------------


def fusion_inputs(spark, folder):
    items = HashedTextEncoder(64).transform(encoded(spark, folder), "description", "text")
    return materialise(items, "inputs")


def vocab_sizes(inputs) -> dict[str, int]:
    """Sizes read off the encoded indexes."""
    row = inputs.agg(
        F.max(F.array_max("genre_idx")).alias("genres"), F.max(F.array_max("cast_idx")).alias("cast"),
        F.max("director_idx").alias("director"), F.max("writer_idx").alias("writer"),
    ).first()
    return {name: row[name] + 1 for name in ("genres", "director", "writer", "cast")}


@register("ml2_fused_vectors", f"with {q.CATALOG} select row_id, 32 dim, 1::double length, 1::double text_length from catalog")
def ml2(spark, folder):
    """Fused vectors, full and text-only; the twin checks rows, dimension and unit length."""
    inputs = fusion_inputs(spark, folder)
    model = FusionModel.create(64, vocab_sizes(inputs), 32)
    full = embed(inputs, model).select("row_id", "embedding")
    text = embed(inputs, model, tuple(fixed.MODALITIES)).select("row_id", F.col("embedding").alias("text_only"))
    return full.join(text, "row_id").select(
        "row_id", F.size("embedding").alias("dim"), F.round(vec.norm(F.col("embedding")), 5).alias("length"),
        F.round(vec.norm(F.col("text_only")), 5).alias("text_length"),
    )


# A small network whose every weight follows from its block, row and column, so that SQL can say it.
NETWORK = {"hidden": 3, "embed_dim": 2, "id_dim": 2}
BLOCKS = ["text", "text_out", *fixed.MODALITIES, "director_proj", "writer_proj", "fuse", "fuse_out"]
BIAS_ROW = 99


def letter_shares():
    """Toy text model: length, letters e and spaces, as exact fractions."""
    import numpy as np

    def encode(texts):
        return np.array([[len(t), t.count("e"), t.count(" ")] for t in texts], float) / 4096

    return encode


def weight(block: str, row: int, column: int) -> float:
    return ((row * 7 + column * 3 + BLOCKS.index(block)) % 11 - 5) / 16


def ruled_network(sizes: dict[str, int]) -> FusionNetwork:
    net = FusionNetwork.create(3, sizes, **NETWORK)
    for name, block in net.weights.items():
        block[...] = [[weight(name, i, j) for j in range(block.shape[1])] for i in range(len(block))]
    for name, bias in net.bias.items():
        bias[...] = [weight(name, BIAS_ROW, j) for j in range(len(bias))]
    return net


def network_sql() -> str:
    """The same network over the encoded inputs, layer by layer."""
    embed, hidden, id_dim = NETWORK["embed_dim"], NETWORK["hidden"], NETWORK["id_dim"]

    def cell(block: str, row: str, column: int) -> str:
        return f"(((({row}) * 7 + {column * 3 + BLOCKS.index(block)}) % 11 - 5) / 16.0::double)"

    def dense(block: str, entries: list[str], width: int) -> list[str]:
        return [" + ".join([f"{e} * {weight(block, i, j)}::double" for i, e in enumerate(entries)] + [f"{weight(block, BIAS_ROW, j)}::double"])
                for j in range(width)]

    text = [f"greatest({e}, 0)" for e in dense("text", ["x[1]", "x[2]", "x[3]"], hidden)]
    parts = dense("text_out", [f"t[{i + 1}]" for i in range(hidden)], embed)
    for name in fixed.MODALITIES:
        if name in ("genres", "cast"):
            parts += [f"coalesce(list_sum(list_transform({name}_idx, lambda i: {cell(name, 'i', j)})), 0) + {weight(name, BIAS_ROW, j)}::double"
                      for j in range(embed)]
        elif name in ("director", "writer"):
            parts += dense(f"{name}_proj", [cell(name, f"{name}_idx", r) for r in range(id_dim)], embed)
        else:
            parts += dense(name, [f"{name}_n"], embed)
    fused = [f"greatest({e}, 0)" for e in dense("fuse", [f"p[{i + 1}]" for i in range(len(parts))], hidden)]
    out = dense("fuse_out", [f"h[{i + 1}]" for i in range(hidden)], embed)
    return f"""with {q.VOCAB},
g as (select row_id, list(distinct idx::int) genres_idx
      from (select row_id, unnest(genres) as value from labelled) join genre_vocab using (value) group by 1),
c as (select row_id, list(distinct idx::int) cast_idx
      from (select row_id, unnest("cast") as value from labelled) join cast_vocab using (value) group by 1),
inputs as (
  select l.row_id, coalesce(genres_idx, []::int[]) genres_idx, coalesce(cast_idx, []::int[]) cast_idx,
    coalesce(d.idx, 0) director_idx, coalesce(w.idx, 0) writer_idx,
    [length(description) / 4096::double, (length(description) - length(replace(description, 'e', ''))) / 4096::double,
     (length(description) - length(replace(description, ' ', ''))) / 4096::double] x,
    least(greatest((coalesce("year", (year_min + year_max) / 2) - year_min) / greatest(year_max - year_min, 1), 0), 1) year_n,
    (coalesce(rating, rating_mean) - rating_mean) / greatest(rating_std, 1e-6) rating_n,
    (coalesce(duration, duration_mean) - duration_mean) / greatest(duration_std, 1e-6) duration_n,
    (ln(1 + coalesce(votes, 0)) - votes_log_mean) / greatest(votes_log_std, 1e-6) votes_n
  from labelled l left join g using (row_id) left join c using (row_id)
  left join director_vocab d on l.director = d.value left join writer_vocab w on l.writer = w.value, stats),
one as (select *, [{", ".join(text)}] t from inputs),
two as (select row_id, [{", ".join(parts)}] p from one),
three as (select row_id, [{", ".join(fused)}] h from two),
four as (select row_id, [{", ".join(out)}] u from three)
select row_id, list_transform(u, lambda v: round((v / greatest(sqrt(list_inner_product(u, u)), 1e-12))::float::double, 4)) embedding from four"""


@register("ml2_network_vectors", network_sql())
def ml2_network(spark, folder):
    """The network with hidden layers on fixed weights; the twin compares its values."""
    encoder = BatchTextEncoder("letter-shares", 3, letter_shares)
    inputs = materialise(encoder.transform(encoded(spark, folder), "description", "text"), "inputs")
    found = embed(inputs, ruled_network(vocab_sizes(inputs)))
    return found.select("row_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("embedding"))


@register("ml3_training_history")
def ml3(spark, folder):
    inputs = fusion_inputs(spark, folder)
    model = FusionModel.create(64, vocab_sizes(inputs), 32)
    _, history = train_fusion(
        inputs.filter("split = 'train'"), inputs.filter("split = 'val'"), model, epochs=3
    )
    return spark.createDataFrame(history, "epoch long, train_loss double, val_loss double")
