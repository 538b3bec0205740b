"""Side-by-side tables of two or more runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def side_by_side(long_table: DataFrame, keys: list[str], runs: list[str], value: str = "value") -> DataFrame:
    """One column per run; the runs are given, so the pivot needs no extra pass."""
    return long_table.groupBy(*keys).pivot("run", runs).agg(F.first(value))


def settings_rows(configs: DataFrame, settings: list[str]) -> DataFrame:
    """Run configs `(run, <settings...>)` to `(run, setting, value)`, whatever runs there are; absent settings show `-`."""
    shown = [
        F.struct(
            F.lit(name).alias("setting"),
            F.coalesce(F.col(name).cast("string"), F.lit("-")).alias("value")
            if name in configs.columns
            else F.lit("-").alias("value"),
        )
        for name in settings
    ]
    return configs.select("run", F.inline(F.array(*shown)))


def column_names(runs: list[str | None], taken: list[str]) -> list[str]:
    """A column name per run: its own, or all numbered where some are empty, taken or differ only in case (or by null)."""
    names = ["null" if run is None else run for run in runs]
    if "" in names or len({name.lower() for name in names + taken}) < len(names + taken):
        return [f"{at}:{name}" for at, name in enumerate(names, 1)]
    return names


def settings_table(configs: DataFrame, settings: list[str], runs: list[str] | None = None) -> DataFrame:
    """The same as setting × run, for the given runs or else for all that the configs hold, the null run too.

    As each run has each setting, its place in the order of runs is its column: a pivot on all runs would compare
    every value with every run.
    """
    rows = settings_rows(configs, settings)
    if runs is not None:
        return side_by_side(rows, ["setting"], runs)
    found = [row["run"] for row in configs.select("run").distinct().orderBy("run").collect()]
    cells = rows.groupBy("setting", "run").agg(F.first("value").alias("value"))
    lined = cells.groupBy("setting").agg(F.sort_array(F.collect_list(F.struct("run", "value"))).alias("cells"))
    values = lined.select("setting", F.col("cells.value").alias("values"))
    named = enumerate(column_names(found, ["setting"]))
    return values.select("setting", *(F.col("values")[at].alias(name) for at, name in named))


def same_test_split(configs: DataFrame) -> DataFrame:
    """One flag: do all runs share data and seed, so that metrics compare?"""
    pair = F.struct(F.coalesce(F.col("data").cast("string"), F.lit("-")),
                    F.coalesce(F.col("seed").cast("string"), F.lit("-")))
    return configs.agg((F.countDistinct(pair) == 1).alias("comparable"))


def top_overlap(tops: DataFrame, k: int) -> DataFrame:
    """Shared titles of each pair of runs per query.

    `tops(run_at, run, query, title)` holds at most k titles per run and query;
    duplicates collapse. Two empty sets have a Jaccard of 0.
    """
    sets = tops.groupBy("query", "run_at", "run").agg(F.collect_set("title").alias("titles"))
    a = sets.select("query", F.col("run_at").alias("at_a"), F.col("run").alias("run_a"),
                    F.col("titles").alias("titles_a"))
    b = sets.select("query", F.col("run_at").alias("at_b"), F.col("run").alias("run_b"),
                    F.col("titles").alias("titles_b"))
    shared = F.size(F.array_intersect("titles_a", "titles_b"))
    union = F.greatest(F.size(F.array_union("titles_a", "titles_b")), F.lit(1))
    return a.join(b, "query").filter("at_a < at_b").select(
        "query", "run_a", "run_b",
        shared.cast("long").alias("n_shared"),
        (shared / F.lit(k)).alias("shared_of_k"),
        (shared / union).alias("jaccard"),
    )
