"""Registered queries: the commands end to end, over the whole catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinium.operators import collecting
from affinium.operators.textvec import HashedTextEncoder, Md5TextEncoder
from affinium.plans import runs
from affinium.plans.registered import register
from affinium.plans.registered import sql as q
from affinium.plans.registered.gather import KNOWN, english_titles, landed_films
from affinium.session import fresh_path, materialise
from affinium.sources import landed as ld
from affinium.sources import tables as tb
from affinium.sources.store import Run

TEXT = HashedTextEncoder(64)
_trained: dict[tuple[str, str, int], str] = {}


def trained(spark, folder, epochs=2) -> str:
    """A trained and indexed run over the folder's catalog, once per session."""
    key = (spark.sparkContext.applicationId, folder, epochs)
    if key not in _trained:
        path = fresh_path(spark, "run")
        runs.train(spark, tb.catalog(spark, folder), path, TEXT, epochs=epochs, embed_dim=32)
        runs.build_index(spark, path, encoder=TEXT)
        _trained[key] = path
    return _trained[key]


@register("run_train", f"""with {q.VOCAB} select 'table' "data", 64::bigint text_dim, 32::bigint embed_dim,
    count(*) n_genres, (select count(*) + 1 from director_vocab) n_directors,
    (select count(*) + 1 from writer_vocab) n_writers, (select count(*) from cast_vocab) n_cast from genre_vocab""")
def run_train(spark, folder):
    config = Run(spark, trained(spark, folder)).config_frame()
    return config.select("data", "text_dim", "embed_dim", "n_genres", "n_directors", "n_writers", "n_cast")


@register("run_evaluate")
def run_evaluate(spark, folder):
    return runs.evaluate(spark, trained(spark, folder), TEXT).drop("run")


@register("run_index", f"with {q.CATALOG} select row_id, title, \"year\", genres, 32 dim from catalog")
def run_index(spark, folder):
    index = Run(spark, trained(spark, folder)).index()
    return index.select("row_id", "title", "year", "genres", F.size("embedding").alias("dim"))


@register("run_similar")
def run_similar(spark, folder):
    return runs.similar(spark, trained(spark, folder), "ring", 10)


@register("run_search")
def run_search(spark, folder):
    return runs.search(spark, trained(spark, folder), "the thing on the other hand", 10, TEXT)


@register("top2_free_text_search")
def top2(spark, folder):
    """Every message as a free-text query; turns are below 2**32, so the numbers differ."""
    number = F.shiftleft("conv_id", 32).bitwiseOR(F.col("turn")).alias("q_id")
    texts = tb.messages(spark, folder).select(number, F.col("text").alias("description"))
    return runs.search_many(spark, trained(spark, folder), texts, 10, TEXT)


@register("run_baseline", f"""
with t as (select doc_id, text from documents union all select -1, 'the thing on the other hand'),
b as (select doc_id, list_transform(list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'),
  lambda x: x <> ''), lambda x: ('0x' || substr(md5(x), 1, 8))::bigint % 64) b from t),
c as (select doc_id, list_transform(range(64), lambda i: len(list_filter(b, lambda y: y = i))) c from b),
n as (select *, greatest(sqrt(list_sum(list_transform(c, lambda x: x * x))), 1) n from c),
v as (select doc_id, list_transform(c, lambda x: (x / n)::float::double) v from n)
select doc_id row_id, 'doc ' || doc_id title,
       round(list_cosine_similarity(v, (select v from v where doc_id = -1)), 9) score
from v where doc_id >= 0 order by score desc, row_id limit 5""")
def run_baseline(spark, folder):
    items = tb.text_catalog(spark, folder).withColumn("title", F.concat(F.lit("doc "), F.col("row_id")))
    found = runs.baseline(items, "the thing on the other hand", 5, Md5TextEncoder(64))
    return found.select("row_id", "title", "score")


@register("run_compare")
def run_compare(spark, folder):
    paths = [trained(spark, folder, epochs) for epochs in (2, 1)]
    for path in paths:
        runs.evaluate(spark, path, TEXT)
    tables = runs.compare(spark, paths, ["ring", "gizmo", "not in any catalog"], 5)
    return tables["overlap"].select("query", "n_shared", "shared_of_k", "jaccard")


@register("run_map", f"""with {q.CATALOG}
select row_id, coalesce(nullif(trim(genres[1]), ''), 'Unknown') category
from catalog order by md5('0:' || row_id), row_id limit 300""")
def run_map(spark, folder):
    return runs.map_index(spark, trained(spark, folder)).select("row_id", "category")


@register("run_collect", f"""with {KNOWN},
fresh as (
  select * from films where lower(requested) not in (from known) and lower("Title") not in (from known)
  qualify row_number() over (partition by lower("Title") order by seq) = 1)
select "Title", "Year", "Genre", "Description" from fresh where "Description" not in ('N/A', '')
qualify row_number() over (partition by "Title", "Year" order by seq) = 1""")
def run_collect(spark, folder):
    landed = materialise(landed_films(spark, folder), "landed")
    known = collecting.known_titles(english_titles(spark, folder))
    target = fresh_path(spark, "collected")
    records = ld.film_records(landed)
    if runs.collect(landed, records, known, target, kind="parquet"):
        return spark.read.parquet(target)
    # Nothing is left, so nothing was written.
    return spark.createDataFrame([], records.drop("seq", "requested").schema)
