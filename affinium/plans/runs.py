"""The commands: train, evaluate, index, similar, search, baseline, compare, map, collect."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinium import fixed
from affinium.functions import vectors as vec
from affinium.operators import collecting, comparison, topk
from affinium.operators.encoding import encode, fit_encoder
from affinium.operators.fusion import FusionModel, embed, embed_text, train_fusion
from affinium.operators.lookup import check_dimension, check_index, find_item, match_title_table
from affinium.operators.metrics import metrics_at_k
from affinium.operators.network import FusionNetwork
from affinium.operators.ordering import split_catalog
from affinium.operators.projection import embedding_map, result_map
from affinium.operators.relevance import mark_hits, relevant_counts
from affinium.operators.textvec import HashedTextEncoder, Md5TextEncoder, PrecomputedEncoder, TextEncoder, TfidfTextEncoder
from affinium.session import fresh_path, materialise, scope, tidy
from affinium.sources.catalog import load_catalog
from affinium.sources.features import FeatureStore
from affinium.sources.store import Run, append_snapshot, write_records

VARIANTS = ("baseline", "trained_text_only", "trained")


def with_text(df: DataFrame, encoder: TextEncoder, store_path: str) -> DataFrame:
    """Add the `text` vector; encoders that compute go through the feature store."""
    if isinstance(encoder, PrecomputedEncoder):
        return encoder.transform(df, "description", "text")
    return FeatureStore(df.sparkSession, store_path).features(df, encoder)


def bound_encoder(folder: Run, encoder: TextEncoder | None) -> TextEncoder:
    """The text encoder a run was trained with.

    Hashed, md5 and tf-idf encoders are rebuilt from the run; any other must be
    passed, and one with another name is refused.
    """
    name, dim = folder.config()["text_model"], folder.config()["text_dim"]
    if encoder is None:
        if name == HashedTextEncoder(dim).name:
            return HashedTextEncoder(dim)
        if name == Md5TextEncoder(dim).name:
            return Md5TextEncoder(dim)
        if name.startswith("tfidf-"):
            encoder = TfidfTextEncoder(folder.text_weights())
        else:
            raise ValueError(f"run '{folder.path}' uses the text model {name!r}: pass its encoder")
    if (encoder.name, encoder.dim) != (name, dim):
        raise ValueError(f"run '{folder.path}' uses the text model {name!r} ({dim}), not {encoder.name!r}")
    return encoder


@tidy
def train(
    spark: SparkSession,
    data: str | DataFrame,
    run: str,
    encoder: TextEncoder | None = None,
    epochs: int = fixed.EPOCHS,
    embed_dim: int = fixed.EMBED_DIM,
    batch_size: int = fixed.BATCH_SIZE,
    lr: float = fixed.LEARNING_RATE,
    temperature: float = fixed.TEMPERATURE,
    modality_dropout: float = fixed.MODALITY_DROPOUT,
    jaccard: bool = False,
    seed: int = fixed.SEED,
    rounds: int | None = None,
    patience: int = fixed.PATIENCE,
    decay: float = fixed.WEIGHT_DECAY,
    cap: int = fixed.VOCABULARY_CAP,
    hidden: int = fixed.HIDDEN,
    workers: int | None = None,
) -> list[tuple[int, float, float]]:
    """Ingest, split, fit, encode, train; leaves a complete run folder.

    The model is the fusion network; with `hidden` 0 the linear fusion.
    """
    encoder = encoder or HashedTextEncoder()
    folder = Run(spark, run)
    # The catalog is written before the split reads it three times.
    catalog = load_catalog(spark, data) if isinstance(data, str) else data
    catalog = materialise(catalog, "catalog")
    folder.save_splits(split_catalog(catalog, seed))
    folder.save_encoder(fit_encoder(folder.split("train"), cap))
    state = folder.encoder()
    sizes = state.sizes()

    def inputs(name: str) -> DataFrame:
        items = with_text(folder.split(name), encoder, f"{run}/features")
        return materialise(encode(items, state), f"inputs-{name}")

    if hidden:
        start = FusionNetwork.create(encoder.dim, sizes, embed_dim, seed, hidden)
    else:
        start = FusionModel.create(encoder.dim, sizes, embed_dim, seed)
    model, history = train_fusion(
        inputs("train"), inputs("val"), start, epochs, batch_size, lr, temperature,
        modality_dropout, jaccard, seed, patience, rounds, decay=decay, workers=workers,
    )
    folder.save_model(model)
    if isinstance(encoder, TfidfTextEncoder):
        folder.save_text_weights(encoder.weights)
    folder.save_config(
        {
            "data": data if isinstance(data, str) else "table",
            "text_model": encoder.name, "finetune_text": False, "text_dim": encoder.dim,
            "epochs": epochs, "embed_dim": embed_dim, "hidden_dim": hidden, "batch_size": batch_size, "lr": lr,
            "temperature": temperature, "modality_dropout": modality_dropout, "jaccard": jaccard,
            "seed": seed, "n_genres": sizes["genres"], "n_directors": sizes["director"],
            "n_writers": sizes["writer"], "n_cast": sizes["cast"], "use_cast": sizes["cast"] > 0,
        }
    )
    return history


def evaluate_variants(variants: dict[str, DataFrame], items: DataFrame,
                      ks: tuple[int, ...] = fixed.METRIC_CUTOFFS) -> DataFrame:
    """Rank each embedding set against itself: `(variant, metric, value)`."""
    relevant = relevant_counts(items)
    rankings = []
    for name, vectors in variants.items():
        queries = vectors.select(F.col("row_id").alias("q_id"), "embedding")
        ranked = topk.rank_catalog(queries, vectors, max(ks))
        rankings.append(ranked.withColumn("variant", F.lit(name)))
    hits = mark_hits(reduce(DataFrame.unionByName, rankings), items)
    return metrics_at_k(hits, relevant, ks, by=["variant"])


@tidy
def evaluate(spark: SparkSession, run: str, encoder: TextEncoder | None = None,
             base_encoder: TextEncoder | None = None) -> DataFrame:
    """Score baseline, text-only and full embeddings on the saved test split."""
    folder = Run(spark, run)
    encoder = bound_encoder(folder, encoder)
    model, test = folder.model(), folder.split("test")
    inputs = materialise(encode(with_text(test, encoder, f"{run}/features"), folder.encoder()), "inputs-test")
    base = inputs
    if base_encoder is not None:
        base = with_text(test, base_encoder, f"{run}/features")
    variants = {
        "baseline": base.select("row_id", vec.unit(F.col("text")).alias("embedding")),
        "trained_text_only": embed(inputs, model, tuple(fixed.MODALITIES)).select("row_id", "embedding"),
        "trained": embed(inputs, model).select("row_id", "embedding"),
    }
    folder.save_evaluation(evaluate_variants(variants, test))
    return folder.evaluation()


@tidy
def build_index(spark: SparkSession, run: str, data: str | DataFrame | None = None,
                encoder: TextEncoder | None = None) -> DataFrame:
    """Embed the whole catalog once; without `data` the run's own catalog is used."""
    folder = Run(spark, run)
    encoder = bound_encoder(folder, encoder)
    config = folder.config()
    if data is None:
        catalog = folder.splits().drop("split")
    else:
        catalog = materialise(load_catalog(spark, data) if isinstance(data, str) else data, "catalog")
    inputs = encode(with_text(catalog, encoder, f"{run}/features"), folder.encoder())
    folder.save_index(embed(inputs, folder.model()).select(*catalog.columns, "embedding"))
    check_index(folder.index(), catalog, config["embed_dim"])
    return folder.index()


def similar(spark: SparkSession, run: str, title: str, k: int = 10) -> DataFrame:
    """Items most similar to a known title."""
    folder = Run(spark, run)
    index = folder.index()
    check_dimension(folder.index_info(), folder.config()["embed_dim"])
    return topk.present(topk.similar_to_row(index, find_item(index, title), k))


def similar_titles(index: DataFrame, titles: DataFrame, k: int = 10) -> DataFrame:
    """Items most similar to each of a table of titles `(query)`: `(query, row_id, score, rank)`.

    Titles are matched as by `similar`; unknown ones have no rows.
    """
    matched = materialise(match_title_table(index, titles), "matched-titles")
    known = matched.select("row_id").distinct()
    queries = index.join(known, "row_id", "left_semi").select(F.col("row_id").alias("q_id"), "embedding")
    ranked = topk.rank_catalog(materialise(queries, "title-vectors"), index, k)
    return matched.withColumnRenamed("row_id", "q_id").join(ranked, "q_id").drop("q_id")


def similar_many(spark: SparkSession, run: str, titles: DataFrame, k: int = 10) -> DataFrame:
    """`similar` for a table of titles over a run's index."""
    folder = Run(spark, run)
    check_dimension(folder.index_info(), folder.config()["embed_dim"])
    return similar_titles(folder.index(), titles, k)


def search(spark: SparkSession, run: str, text: str, k: int = 10, encoder: TextEncoder | None = None) -> DataFrame:
    """Items matching a free text: text-only query against full embeddings."""
    folder = Run(spark, run)
    encoder = bound_encoder(folder, encoder)
    index = folder.index()
    check_dimension(folder.index_info(), folder.config()["embed_dim"])
    query = spark.createDataFrame([(text,)], "description string")
    encoded = embed_text(encoder.transform(query, "description", "text"), folder.model())
    vector = topk.query_vector(encoded.first()["embedding"])
    return topk.present(topk.top_k(topk.scores(index, vector), k))


def search_many(spark: SparkSession, run: str, texts: DataFrame, k: int = 10,
                encoder: TextEncoder | None = None) -> DataFrame:
    """Free-text search for a table of queries `(q_id, description)`."""
    folder = Run(spark, run)
    encoder = bound_encoder(folder, encoder)
    check_dimension(folder.index_info(), folder.config()["embed_dim"])
    encoded = embed_text(encoder.transform(texts, "description", "text"), folder.model())
    queries = materialise(encoded.select("q_id", "embedding"), "queries")
    return topk.rank_catalog(queries, folder.index(), k, exclude_self=False)


def baseline(items: DataFrame, text: str, k: int = 3, encoder: TextEncoder | None = None,
             store_path: str | None = None) -> DataFrame:
    """Plain text similarity without training: true cosine, adds `score`."""
    encoder = encoder or HashedTextEncoder()
    spark = items.sparkSession
    query = encoder.transform(spark.createDataFrame([(text,)], "description string"), "description", "text")
    vector = topk.query_vector(query.first()["text"])
    featured = with_text(items, encoder, store_path or fresh_path(spark, "features"))
    scored = featured.withColumn("score", F.round(vec.cosine(F.col("text"), vector), topk.SCORE_DIGITS))
    return topk.top_k(scored, k)


def baseline_map(items: DataFrame, text: str, k: int = 3, encoder: TextEncoder | None = None) -> DataFrame:
    """Plot table of a baseline query and its result."""
    encoder = encoder or HashedTextEncoder()
    spark = items.sparkSession
    query = encoder.transform(spark.createDataFrame([(text,)], "description string"), "description", "text")
    return result_map(query.first()["text"], baseline(items, text, k, encoder))


def compare(spark: SparkSession, runs: list[str], queries: list[str] | None = None, k: int = 5) -> dict[str, DataFrame]:
    """Settings, comparability, metrics and top-k overlap of two or more runs."""
    folders = [Run(spark, path) for path in runs]
    configs = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [folder.config_frame() for folder in folders]
    )
    evaluations = reduce(DataFrame.unionByName, [folder.evaluation() for folder in folders])
    names = [folder.path for folder in folders]
    out = {
        "settings": comparison.settings_table(configs, fixed.COMPARED_SETTINGS, names),
        "comparable": comparison.same_test_split(configs),
        "metrics": comparison.side_by_side(evaluations, ["variant", "metric"], names).orderBy("variant", "metric"),
    }
    tops = []
    for title in queries or []:
        for at, folder in enumerate(folders):
            try:
                found = similar(spark, folder.path, title, k)
            except (KeyError, FileNotFoundError):
                continue
            tops.append(found.select(F.lit(at).alias("run_at"), F.lit(folder.path).alias("run"),
                                     F.lit(title).alias("query"), "title", "score"))
    if tops:
        out["tops"] = reduce(DataFrame.unionByName, tops)
        out["overlap"] = comparison.top_overlap(out["tops"], k)
    return out


def map_index(spark: SparkSession, run: str, n: int = 300, seed: int = 0) -> DataFrame:
    """Three-dimensional plot table of the stored embeddings."""
    folder = Run(spark, run)
    index = folder.index()
    check_dimension(folder.index_info(), folder.config()["embed_dim"], at_least=3)
    return embedding_map(index, n, seed)


def collect(requests: DataFrame, records: DataFrame, known: DataFrame, target: str,
            snapshots: str | None = None, kind: str = "csv") -> bool:
    """Keep unknown records, clean and write them; False when nothing is left.

    `records(seq, requested, Title, ...)` are parsed responses to `requests`.
    """
    with scope(requests.sparkSession):
        wanted = records.join(requests.select("requested").distinct(), "requested", "left_semi")
        fresh = collecting.new_records(wanted, known).drop("requested")
        if snapshots:
            append_snapshot(fresh, snapshots)
        return write_records(collecting.clean_records(fresh).drop("seq"), target, kind)
