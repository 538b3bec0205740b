"""Incremental collection: which requested records are new."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinium import fixed
from affinium.operators.dedupe import first_per_key
from affinium.operators.skew import join_totals
from affinium.session import materialise


def known_titles(*tables: DataFrame) -> DataFrame:
    """Lower-cased distinct titles of results and ignore lists: `(known)`."""
    return reduce(DataFrame.unionByName, [_lowered(t) for t in tables]).distinct()


def _lowered(titles: DataFrame) -> DataFrame:
    return titles.select(F.lower(F.col(titles.columns[0])).alias("known"))


def without_known(df: DataFrame, title: str, known: DataFrame) -> DataFrame:
    """Rows whose title is not known yet, ignoring case."""
    return df.join(known, F.lower(title) == F.col("known"), "left_anti")


def failed_titles(requests: DataFrame, records: DataFrame) -> DataFrame:
    """Requested titles that brought no record."""
    return requests.join(records.select("requested"), "requested", "left_anti")


def new_records(records: DataFrame, known: DataFrame) -> DataFrame:
    """Records to add, as if the requests `(seq, requested, Title, ...)` ran one by one.

    A request is skipped when its own or its canonical title is known, and an
    accepted record makes both titles known to later requests. Rows that are
    first for all their titles are settled at once; only rows in conflict with
    them are looked at again, so one or two rounds are the rule.
    """
    # A repeat of the same two titles can never win over its first occurrence.
    titles = F.array_distinct(F.array(F.lower("requested"), F.lower("Title")))
    firsts = first_per_key(
        records.withColumns({"_r": F.lower("requested"), "_t": F.lower("Title")}), ["_r", "_t"], ["seq"]
    )
    open_rows = materialise(firsts.drop("_r", "_t"), "requests")
    # Only known titles that are asked for matter; a small batch is broadcast to find them.
    asked = open_rows.select(F.explode(titles).alias("known")).distinct()
    known = materialise(known.join(asked, "known", "left_semi"), "known")
    open_rows = materialise(without_known(without_known(open_rows, "requested", known), "Title", known), "requests")
    settled = None
    while not open_rows.isEmpty():
        claimed = open_rows.select("seq", F.explode(titles).alias("title"))
        first = claimed.groupBy("title").agg(F.min("seq").alias("first"), F.count("*").alias("n_claims"))
        late = join_totals(claimed, first, "title", "n_claims", "seq").filter("seq > first").select("seq")
        accepted = materialise(open_rows.join(late, "seq", "left_anti"), "accepted")
        settled = accepted if settled is None else settled.unionByName(accepted)
        taken = accepted.select(F.explode(titles).alias("known"))
        rest = without_known(without_known(open_rows, "requested", taken), "Title", taken)
        open_rows = materialise(rest, "requests")
    return open_rows if settled is None else settled


def clean_records(records: DataFrame, order: str = "seq") -> DataFrame:
    """`N/A` and blanks to null, incomplete rows out, first row per (Title, Year)."""
    fields = [name for name in records.columns if name != order]

    def blank_to_null(name: str):
        value = F.col(f"`{name}`")
        return F.when(~value.isin("", fixed.NOT_AVAILABLE), value).alias(name)

    complete = records.select(order, *[blank_to_null(name) for name in fields]).na.drop("any", subset=fields)
    return first_per_key(complete, ["Title", "Year"], [order])
