"""Fit vocabularies and statistics on the training split, then encode items."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinium import fixed
from affinium.operators.ordering import sorted_index
from affinium.session import materialise


@dataclass
class EncoderState:
    """Fitted state: `vocab(field, value, idx)` and a one-row `stats` table."""

    vocab: DataFrame
    stats: DataFrame

    def save(self, path: str) -> None:
        self.vocab.write.mode("overwrite").partitionBy("field").parquet(f"{path}/vocab")
        self.stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EncoderState:
        vocab = spark.read.parquet(f"{path}/vocab").select("field", "value", "idx")
        return cls(vocab, spark.read.parquet(f"{path}/stats"))

    def sizes(self) -> dict[str, int]:
        """Vocabulary sizes; director and writer count the unknown index 0."""
        counts = {row["field"]: row["n"] for row in self.size_table().collect()}
        return {field: counts[field] for field in ("genres", "director", "writer", "cast")}

    def size_table(self) -> DataFrame:
        fields = self.vocab.sparkSession.createDataFrame(
            [("genres", 0), ("director", 1), ("writer", 1), ("cast", 0)], "field string, spare long"
        )
        counted = self.vocab.groupBy("field").agg(F.count("*").alias("n"))
        return fields.join(counted, "field", "left").select(
            "field", (F.coalesce("n", F.lit(0)) + F.col("spare")).alias("n")
        )


def genre_vocabulary(items: DataFrame) -> DataFrame:
    """Sorted distinct categories, 0-based. The items are read once."""
    values = materialise(items.select(F.explode("genres").alias("value")).distinct(), "genres")
    return sorted_index(values, "value").select("value", "idx")


def frequent_vocabulary(values: DataFrame, first_index: int, cap: int = fixed.VOCABULARY_CAP) -> DataFrame:
    """The `cap` most frequent values, by count then value.

    The final numbering sees at most `cap` rows.
    """
    return _most_frequent(values.groupBy("value").agg(F.count("*").alias("n")), first_index, cap)


def _most_frequent(counted: DataFrame, first_index: int, cap: int) -> DataFrame:
    top = counted.orderBy(F.desc("n"), "value").limit(cap)
    position = F.row_number().over(Window.orderBy(F.desc("n"), "value"))
    return top.select("value", (position + (first_index - 1)).cast("long").alias("idx"))


def people_vocabulary(items: DataFrame, column: str, cap: int = fixed.VOCABULARY_CAP) -> DataFrame:
    """Directors or writers: index 0 is the unknown person."""
    named = items.filter(F.col(column) != fixed.MISSING)
    return frequent_vocabulary(named.select(F.col(column).alias("value")), 1, cap)


def cast_vocabulary(items: DataFrame, cap: int = fixed.VOCABULARY_CAP) -> DataFrame:
    return frequent_vocabulary(items.select(F.explode("cast").alias("value")), 0, cap)


def fit_stats(items: DataFrame) -> DataFrame:
    """One row of ranges, means and sample deviations, with defaults for empty
    columns and for columns without spread. A single pass over the data."""

    def or_default(value: Column, name: str) -> Column:
        return F.coalesce(value, F.lit(fixed.DEFAULT_STATS[name])).alias(name)

    def spread(value: Column, name: str) -> Column:
        return or_default(F.nullif(F.stddev_samp(value), F.lit(0.0)), name)

    year, rating, duration = F.col("year"), F.col("rating"), F.col("duration")
    log_votes = F.log1p("votes")
    return items.agg(
        or_default(F.min(year), "year_min"),
        or_default(F.max(year), "year_max"),
        or_default(F.avg(rating), "rating_mean"),
        spread(rating, "rating_std"),
        or_default(F.avg(duration), "duration_mean"),
        spread(duration, "duration_std"),
        or_default(F.avg(log_votes), "votes_log_mean"),
        spread(log_votes, "votes_log_std"),
    )


def fit_encoder(train: DataFrame, cap: int = fixed.VOCABULARY_CAP) -> EncoderState:
    """All vocabularies from one pass of counts over (field, value), the statistics from another."""

    def entry(field: str, value: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), value.alias("value"))

    people = [F.when(F.col(f) != fixed.MISSING, entry(f, F.col(f))) for f in ("director", "writer")]

    def entries(field: str) -> Column:
        return F.transform(F.coalesce(field, F.array().cast("array<string>")), lambda value: entry(field, value))

    named = F.array_compact(F.array(*people))
    values = train.select(F.inline(F.concat(entries("genres"), entries("cast"), named)))
    counts = materialise(values.groupBy("field", "value").agg(F.count("*").alias("n")), "values")

    def of(field: str) -> DataFrame:
        return counts.filter(F.col("field") == field).select("value", "n")

    parts = {
        "genres": sorted_index(of("genres").select("value"), "value").select("value", "idx"),
        "director": _most_frequent(of("director"), 1, cap),
        "writer": _most_frequent(of("writer"), 1, cap),
        "cast": _most_frequent(of("cast"), 0, cap),
    }
    vocab = None
    for field, part in parts.items():
        tagged = part.select(F.lit(field).alias("field"), "value", "idx")
        vocab = tagged if vocab is None else vocab.unionByName(tagged)
    return EncoderState(vocab, fit_stats(train))


def _list_indexes(df: DataFrame, vocab: DataFrame, targets: dict[str, str]) -> DataFrame:
    """Sorted distinct vocabulary indexes of list columns; unknowns are ignored, a null list is empty.

    All fields go through one explode, one join and one aggregate per row.
    """

    def entries_of(field: str) -> Column:
        return F.transform(
            F.array_distinct(F.coalesce(field, F.array().cast("array<string>"))),
            lambda value: F.struct(F.lit(field).alias("field"), value.alias("value")),
        )

    entries = df.select("row_id", F.inline(F.concat(*[entries_of(field) for field in targets])))
    known = vocab.select(F.col("field").cast("string").alias("field"), "value", F.col("idx").cast("int").alias("idx"))
    found = entries.join(known, ["field", "value"]).groupBy("row_id").agg(
        F.sort_array(F.collect_list(F.struct("field", "idx"))).alias("_found")
    )

    def indexes(field: str) -> Column:
        own = F.transform(F.filter("_found", lambda e: e["field"] == field), lambda e: e["idx"])
        return F.coalesce(own, F.array().cast("array<int>"))

    joined = df.join(found, "row_id", "left")
    return joined.withColumns({target: indexes(field) for field, target in targets.items()}).drop("_found")


def encode_people(df: DataFrame, column: str, target: str, vocab: DataFrame) -> DataFrame:
    """Value to vocabulary index, unknown to 0. The vocabulary is capped, so it is broadcast."""
    known = vocab.select(F.col("value").alias(column), F.col("idx").cast("int").alias(target))
    joined = df.join(F.broadcast(known), column, "left")
    return joined.withColumn(target, F.coalesce(target, F.lit(0)))


def scaled_year(stats: Column) -> Column:
    low, high = stats["year_min"], stats["year_max"]
    year = F.coalesce(F.col("year"), (low + high) / 2)
    place = (year - low) / F.greatest(high - low, F.lit(1.0))
    return F.least(F.greatest(place, F.lit(0.0)), F.lit(1.0))


def z_score(value: Column, mean: Column, std: Column) -> Column:
    return (value - mean) / F.greatest(std, F.lit(fixed.STD_FLOOR))


def encode(df: DataFrame, state: EncoderState) -> DataFrame:
    """Add the encoded metadata of every item, sparse for list-valued fields.

    Missing years fall to the middle of the range, missing ratings and
    durations to the mean, missing votes to zero votes.
    """

    def vocab(field: str) -> DataFrame:
        return state.vocab.filter(F.col("field") == field)

    out = _list_indexes(df, state.vocab, {"genres": "genre_idx", "cast": "cast_idx"})
    out = encode_people(out, "director", "director_idx", vocab("director"))
    out = encode_people(out, "writer", "writer_idx", vocab("writer"))
    names = list(fixed.DEFAULT_STATS)
    out = out.withColumn("_stats", state.stats.select(F.struct(*names).alias("stats")).scalar())
    stats = F.col("_stats")
    rating = F.coalesce(F.col("rating"), stats["rating_mean"])
    duration = F.coalesce(F.col("duration"), stats["duration_mean"])
    votes = F.log1p(F.coalesce(F.col("votes"), F.lit(0.0)))
    return out.select(
        *df.columns,
        "genre_idx",
        "cast_idx",
        "director_idx",
        "writer_idx",
        scaled_year(stats).alias("year_n"),
        z_score(rating, stats["rating_mean"], stats["rating_std"]).alias("rating_n"),
        z_score(duration, stats["duration_mean"], stats["duration_std"]).alias("duration_n"),
        z_score(votes, stats["votes_log_mean"], stats["votes_log_std"]).alias("votes_n"),
    )
