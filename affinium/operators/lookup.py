"""Title lookup and index checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from affinium.session import materialise

# Letters of the grams by which titles are found inside, and pairs of query and title that one group compares.
GRAM = 3
PAIRS = 1_000_000


def match_titles(index: DataFrame, titles: list[str]) -> DataFrame:
    """Best match per requested title: `(query, row_id)`.

    A case-insensitive exact match beats a literal substring match; among
    equals the lowest `row_id` wins. The requested titles are plan constants,
    so one scan of `(row_id, title)` answers all of them, reduced map-side.
    """
    wanted = F.array(*[F.lit(title) for title in titles])
    name = F.lower("title")

    def match_class(query):
        return F.when(name == F.lower(query), 0).when(F.contains(name, F.lower(query)), 1)

    matches = F.filter(
        F.transform(wanted, lambda q: F.struct(q.alias("query"), match_class(q).alias("class"))),
        lambda match: match["class"].isNotNull(),
    )
    best = F.min(F.struct("class", "row_id"))
    return (
        index.select("row_id", F.inline(matches))
        .groupBy("query")
        .agg(best.alias("best"))
        .select("query", F.col("best.row_id").alias("row_id"))
    )


def _grams(text: str, sizes: range):
    """Array of the different substrings of the given lengths."""
    places = lambda size: F.sequence(F.lit(1), F.length(text) - (size - 1))
    of = lambda size: F.when(
        F.length(text) >= size, F.transform(places(size), lambda at: F.substr(F.col(text), at, F.lit(size)))
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(size) for size in sizes]))


def match_title_table(index: DataFrame, queries: DataFrame) -> DataFrame:
    """Best match for a table of titles `(query)`: `(query, row_id)`, by the rule of `match_titles`.

    Exact matches are a join. Every gram of up to three letters knows the
    lowest row whose title holds it, which answers queries that short. A
    longer query is looked up in the posting list of its rarest trigram, the
    list is cut down to the titles that hold its other trigrams too, and what
    is left is verified. Equal titles are one entry. Neither titles nor
    queries become plan constants, and no query meets the whole catalog.
    Null queries and queries without a match have no row, repeated ones one.
    """
    names = index.where("title is not null").groupBy(F.lower("title").alias("name")).agg(F.min("row_id").alias("row_id"))
    names = materialise(names, "titles")
    asked = queries.select("query").where("query is not null").distinct().withColumn("text", F.lower("query"))
    asked = materialise(asked, "queries")
    wanted = asked.select("text").distinct()
    exact = wanted.join(names, wanted["text"] == names["name"]).select("text", "row_id")
    exact = materialise(exact, "exact-titles")
    rest = wanted.join(exact, "text", "left_anti")

    known = names.select("row_id", "name", F.explode(_grams("name", range(1, GRAM + 1))).alias("gram"))
    grams = known.groupBy("gram").agg(F.min("row_id").alias("row_id"), F.count("*").alias("titles"))
    grams = materialise(grams, "title-grams")
    short = rest.where((F.length("text") <= GRAM) & (F.length("text") > 0)).join(grams, F.col("text") == F.col("gram"))
    everything = rest.where("text = ''").withColumn("row_id", names.agg(F.min("row_id")).scalar()).where("row_id is not null")

    long = rest.where(F.length("text") > GRAM).withColumn("grams", _grams("text", range(GRAM, GRAM + 1)))
    parts = long.select("text", "grams", F.explode("grams").alias("gram")).join(grams.select("gram", "titles"), "gram", "left")
    # A gram that no title holds comes first as the rarest and finds nothing.
    rarest = parts.groupBy("text").agg(F.min(F.struct(F.coalesce("titles", F.lit(0)), "gram"))["gram"].alias("gram"), F.first("grams").alias("grams"))
    rarest = materialise(rarest, "rarest-grams")
    # A list is split so that a group compares at most so many pairs; each part meets the gram's queries.
    needed = rarest.groupBy("gram").agg(F.count("*").alias("queries")).join(grams.select("gram", "titles"), "gram")
    pieces = F.least(F.ceil(F.col("titles") * F.col("queries") / PAIRS), F.col("titles")).cast("int")
    needed = materialise(needed.select("gram", pieces.alias("pieces")), "needed-grams")
    postings = known.where(F.length("gram") == GRAM).select("gram", "row_id", "name").join(needed, "gram")
    postings = postings.withColumn("piece", F.pmod(F.xxhash64("row_id"), F.col("pieces")).cast("int")).drop("pieces")
    asks = rarest.join(needed, "gram").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    found = postings.join(asks, ["gram", "piece"])
    inside = found.where(F.size(F.array_except("grams", _grams("name", range(GRAM, GRAM + 1)))) == 0)
    inside = inside.where(F.contains("name", "text")).groupBy("text").agg(F.min("row_id").alias("row_id"))

    best = exact.unionByName(short.select("text", "row_id")).unionByName(everything.select("text", "row_id")).unionByName(inside)
    return asked.join(best, "text").select("query", "row_id")


def find_item(index: DataFrame, title: str) -> Row:
    """The index row of a title; unknown titles raise `KeyError`."""
    found = match_titles(index, [title]).first()
    if found is None:
        raise KeyError(f"unknown title: {title!r}")
    return index.filter(F.col("row_id") == found["row_id"]).first()


def index_report(index: DataFrame, catalog: DataFrame, embed_dim: int) -> DataFrame:
    """One row of counts that tell whether an index still fits its catalog."""
    sizes = index.agg(
        F.count("*").alias("index_rows"),
        F.count_if(F.size("embedding") != embed_dim).alias("wrong_dim"),
    ).select(F.struct("index_rows", "wrong_dim").alias("s"))
    absent = catalog.join(index.select("row_id"), "row_id", "left_anti").agg(F.count("*"))
    counted = catalog.agg(F.count("*").alias("catalog_rows"))
    return counted.select(
        "catalog_rows",
        sizes.scalar()["index_rows"].alias("index_rows"),
        sizes.scalar()["wrong_dim"].alias("wrong_dim"),
        absent.scalar().alias("not_indexed"),
    )


def check_index(index: DataFrame, catalog: DataFrame, embed_dim: int) -> None:
    """Raise when an index does not cover its catalog in the model's dimension.

    Runs over all rows, so it belongs to the build, not to each query.
    """
    report = index_report(index, catalog, embed_dim).first().asDict()
    if report["wrong_dim"] or report["not_indexed"] or report["index_rows"] != report["catalog_rows"]:
        raise RuntimeError(f"stale index, rebuild it (dimension {embed_dim}): {report}")


def check_dimension(info: dict, embed_dim: int, at_least: int = 1) -> None:
    """Guard of every query, from what the build counted: all dimensions and a minimum size."""
    dims = {info["least_dim"], info["most_dim"]}
    if info["n_rows"] and dims != {embed_dim}:
        raise RuntimeError(f"stale index, rebuild it: dimensions {sorted(dims)}, the run uses {embed_dim}")
    if info["n_rows"] < at_least:
        raise RuntimeError(f"need at least {at_least} items, the index has {info['n_rows']}")
