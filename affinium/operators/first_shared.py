"""Overlap counts of sets by their first shared value.

Values are numbered by falling frequency, and a pair of sets counts at the
first value that both hold. A set's total is then the weight of all sets at
each of its values, less the weight of those that share an earlier value too.
For the latter a set is sent to each of its values with the values before it,
so work and shuffle follow the sets and their widths, not their pairs; the
values that most sets hold come first and have little before them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinium.operators.arrow import ragged
from affinium.operators.skew import join_totals
from affinium.operators.wide_sets import BLOCK_SETS, SETS_AT_ONCE, Postings, _weigh
from affinium.session import materialise

ASKS, HELD = 1, 2


def number_values(sets: DataFrame) -> DataFrame:
    """`(value, code, n_sets, total, wide_total)`: dense codes by falling number of sets, and the weights at each value."""
    entries = sets.select(F.explode("members").alias("value"), "weight", "wide")
    totals = entries.groupBy("value").agg(
        F.count("*").alias("n_sets"), F.sum("weight").alias("total"), F.sum(F.when(F.col("wide"), F.col("weight")).otherwise(0)).alias("wide_total")
    )
    ordered = totals.orderBy(F.desc("n_sets"), "value").withColumn("_at", F.monotonically_increasing_id())
    ordered = materialise(ordered, "values").withColumn("_part", F.shiftright("_at", 33))
    # A row per partition of the sorted values.
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()
    ends = np.cumsum([row["n"] for row in sizes])
    offsets = [(row["_part"], int(end - row["n"])) for row, end in zip(sizes, ends, strict=True)]
    offsets = sets.sparkSession.createDataFrame(offsets, "_part long, _before long")
    code = (F.col("_at") - F.shiftleft("_part", 33) + F.col("_before")).cast("int").alias("code")
    return ordered.join(F.broadcast(offsets), "_part").select("value", code, "n_sets", "total", "wide_total")


def _met_earlier(group: pa.Table) -> pa.Table:
    """`(set_id, n)` for the asking sets at one value: less the weight of sets with an earlier value in common."""
    schema = pa.schema([("set_id", pa.int64()), ("n", pa.int64())])
    role = group["role"].to_numpy()
    asking, held = np.flatnonzero(role & ASKS), np.flatnonzero(role & HELD)
    if not len(asking) or not len(held):
        return schema.empty_table()
    rows, earlier = ragged(group["before"])
    known, codes = np.unique(earlier, return_inverse=True)
    place = np.full(group.num_rows, -1)
    place[held] = np.arange(len(held))
    of_held = place[rows] >= 0
    postings = Postings(place[rows[of_held]].astype(np.int32), codes[of_held], len(held), len(known))
    wide = group["wide"].to_numpy(zero_copy_only=False)
    weights = group["weight"].to_numpy()[held]
    found = np.zeros(len(asking), dtype=np.int64)
    starts = np.searchsorted(rows, np.arange(group.num_rows + 1))
    # A wide set counts all sets, another one only the wide.
    for kind, counted in ((True, weights), (False, np.where(wide[held], weights, 0))):
        own = np.flatnonzero(wide[asking] == kind)
        for start in range(0, len(own), SETS_AT_ONCE):
            part = own[start : start + SETS_AT_ONCE]
            lows, lengths = starts[asking[part]], starts[asking[part] + 1] - starts[asking[part]]
            ends = np.cumsum(lengths)
            places = np.arange(lengths.sum()) + np.repeat(lows - (ends - lengths), lengths)
            united = postings.unite(np.repeat(np.arange(len(part)), lengths), codes[places], len(part))
            found[part] = _weigh(united, counted, postings)
    return pa.table([group["set_id"].take(pa.array(asking)), pa.array(-found)], schema=schema)


def first_shared_weights(sets: DataFrame, block_sets: int = BLOCK_SETS) -> DataFrame:
    """`(set_id, n)` partial sums of the weight of sets that share a value with each set, where one of the two is wide.

    `sets(set_id, members, weight, wide)` has distinct, non-null members and
    unique ids; read from a stored table. A wide set counts itself. The sets
    at one value meet in blocks of block_sets.
    """
    numbered = number_values(sets)
    asked = sets.select("set_id", F.explode("members").alias("value"))
    entries = join_totals(asked, numbered, "value", "n_sets", "set_id")
    coded = entries.groupBy("set_id").agg(
        F.array_sort(F.collect_list("code")).alias("codes"), F.sum("total").alias("total"), F.sum("wide_total").alias("wide_total")
    )
    coded = materialise(coded.join(sets.select("set_id", "weight", "wide").hint("merge"), "set_id"), "coded-sets")
    at_values = coded.select("set_id", F.when(F.col("wide"), F.col("total")).otherwise(F.col("wide_total")).alias("n"))
    blocks = F.ceil(F.col("n_sets") / block_sets).cast("int")
    hot = numbered.filter(F.col("n_sets") > block_sets).select("code", blocks.alias("blocks"))
    before = F.slice("codes", F.lit(1), F.col("_pos"))
    placed = coded.select("set_id", "weight", "wide", "codes", F.posexplode("codes").alias("_pos", "code")).filter("_pos > 0")
    placed = placed.select("set_id", "weight", "wide", "code", before.alias("before")).join(F.broadcast(hot), "code", "left")
    n_blocks = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("set_id"), n_blocks).cast("int")

    def cells(at):
        """Its own block against one other: the set asks there, and is held against that other's sets."""
        both = F.array(F.struct((own * n_blocks + own).alias("cell"), F.lit(ASKS | HELD).alias("role")))
        apart = F.array(F.struct((own * n_blocks + at).alias("cell"), F.lit(ASKS).alias("role")),
                        F.struct((at * n_blocks + own).alias("cell"), F.lit(HELD).alias("role")))
        return F.when(at == own, both).otherwise(apart)

    copies = F.flatten(F.transform(F.sequence(F.lit(0), n_blocks - 1), cells))
    spread = placed.select("code", "set_id", "weight", "wide", "before", F.inline(copies))
    less = spread.groupBy("code", "cell").applyInArrow(_met_earlier, "set_id long, n long")
    return at_values.unionByName(less)
