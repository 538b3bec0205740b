"""Audit of how sources diverge in their terms, language by language.

Copies of a text weigh in the result and cost nothing: a task first collapses
the equal texts of a stretch of its rows, a shuffle by (language, text) then
brings together what is left of each text, with its multiplicity in every
source, and a different text is cut into terms once. Its term counts are
added to each of its sources, times the multiplicity there, and the sum of
its multiplicities to the document frequency of its terms. Sums are formed
inside tasks before they are shuffled.

Distances between sources are evaluated sparsely. All terms that a source
does not have get one probability there, so sums run over the terms of either
source, and those of neither follow from their number. Sources of a language
are cut into blocks, terms too; a task gets two blocks of sources in one
block of terms and gives back a number per pair of sources.

All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinium.llm.common import small_slices
from affinium.llm.registry import query, table
from affinium.session import materialise

# Fixed values of the audit: what is no letter, smoothing, scale, least document frequency, ranks of terms.
NOT_LETTERS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SMOOTHING, SCALE = 5, 1_000_000_000
LEAST_DOCUMENTS, TOP_TERMS = 30, 50
# Text bytes collapsed at once, sums a task holds, and sources and terms of a block on average.
COLLAPSE_BYTES = 16 << 20
HELD_SUMS = 1 << 19
SOURCES, TERMS = 64, 4096

COLLAPSED = "lang string, digest binary, text string, source array<string>, n array<long>"
COUNTED = "lang string, source string, term string, n long, docs long"
CELL = ["lang", "cell", "low", "high"]


def _changes(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Where a row's keys differ from those of the row before; the first row counts."""
    out = np.zeros(len(rows), bool)
    out[:1] = True
    for key in keys:
        column = rows.column(key)
        out[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy()
    return out


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per different (language, text) of each stretch, with its sources and how often it occurs there."""
    for part in small_slices(batches, "text", COLLAPSE_BYTES):
        if not part.num_rows:
            continue
        rows = pa.Table.from_batches([part]).append_column("at", pa.array(np.arange(len(part))))
        met = rows.group_by(["lang", "digest", "source"]).aggregate([("at", "min"), ("at", "count")])
        met = met.sort_by([("lang", "ascending"), ("digest", "ascending")]).combine_chunks()
        starts = np.flatnonzero(_changes(met, ["lang", "digest"]))
        offsets = pa.array(np.r_[starts, len(met)].astype(np.int32))
        first = met.take(pa.array(starts))

        def nested(name: str) -> pa.Array:
            return pa.ListArray.from_arrays(offsets, met.column(name).chunk(0))

        texts = part.column("text").take(first.column("at_min").combine_chunks())
        out = [first.column("lang"), first.column("digest"), texts, nested("source"), nested("at_count")]
        yield from pa.table(out, names=["lang", "digest", "text", "source", "n"]).to_batches()


def _terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of the text, term) of every term; A-Z are lower-cased."""
    whole = texts.cast(pa.large_string()).take(pa.array(np.arange(len(texts))))
    split = pc.split_pattern_regex(pc.ascii_lower(whole), pattern=NOT_LETTERS)
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    terms = split.flatten()
    full = pc.not_equal(terms, "")
    return np.repeat(np.arange(len(texts)), counts)[full.to_numpy(zero_copy_only=False)], terms.filter(full)


def _sums(parts: list[pa.Table]) -> pa.Table:
    added = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return added.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])


def _weighted(part: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents by (language, source, term) over a slice of collapsed rows."""
    fresh = _changes(pa.Table.from_batches([part]), ["lang", "digest"])
    text_of = np.cumsum(fresh) - 1
    owners, terms = _terms(part.column("text").filter(pa.array(fresh)))
    encoded = terms.dictionary_encode()
    size = max(1, len(encoded.dictionary))
    cells, counts = np.unique(owners * size + encoded.indices.to_numpy(), return_counts=True)
    # One entry per (row, source); it takes the terms of its text, which follow one another.
    lists = part.column("source")
    row = np.repeat(np.arange(len(part)), pc.list_value_length(lists).to_numpy())
    n = part.column("n").flatten().to_numpy()
    starts = np.searchsorted(cells // size, np.arange(fresh.sum() + 1))
    length = np.diff(starts)[text_of[row]]
    entry = np.repeat(np.arange(len(row)), length)
    cell = np.arange(len(entry)) - np.repeat(np.cumsum(length) - length, length) + starts[text_of[row]][entry]
    lang = part.column("lang").take(pa.array(row[entry]))
    source = lists.flatten().take(pa.array(entry))
    term = encoded.dictionary.take(pa.array(cells[cell] % size)).cast(pa.string())
    found = [lang, source, term, pa.array(counts[cell] * n[entry]), pa.array(n[entry])]
    return _sums([pa.table(found, names=["lang", "source", "term", "n", "docs"])])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (language, text) to sums, which are passed on when a task holds many.

    A text that goes on in the next slice is cut into terms there once more;
    sums add up all the same.
    """
    held: list[pa.Table] = []
    for part in small_slices(batches, "text"):
        if not part.num_rows:
            continue
        held.append(_weighted(part))
        if sum(map(len, held)) > HELD_SUMS:
            held = [_sums(held)]
            if len(held[0]) > HELD_SUMS // 2:
                yield from held.pop().combine_chunks().to_batches(max_chunksize=1 << 16)
    if held:
        yield from _sums(held).combine_chunks().to_batches(max_chunksize=1 << 16)


def _apart(cell: pa.Table) -> pa.Table:
    """Sums of absolute differences over the terms of either source, and their number, per pair of sources.

    A row without a term introduces a source with the probability of terms
    it does not have.
    """
    known = pc.is_valid(cell.column("term"))
    heads, entries = cell.filter(pc.invert(known)), cell.filter(known)
    names, side, rest = heads.column("source").to_pylist(), heads.column("side").to_numpy(), heads.column("p").to_numpy()
    at = {name: i for i, name in enumerate(names)}
    owner = np.array([at[s] for s in entries.column("source").to_pylist()], np.int64)
    terms = entries.column("term").combine_chunks().dictionary_encode()
    order = np.argsort(owner, kind="stable")
    owner, term, p = owner[order], terms.indices.to_numpy()[order], entries.column("p").to_numpy()[order]
    bounds = np.searchsorted(owner, np.arange(len(names) + 1))
    one_block = cell.column("low")[0].as_py() == cell.column("high")[0].as_py()
    out = []
    for i in np.flatnonzero(side == 0):
        others = np.flatnonzero(np.arange(len(names)) > i) if one_block else np.flatnonzero(side == 1)
        if not len(others):
            continue
        own = slice(bounds[i], bounds[i + 1])
        has = np.zeros(len(terms.dictionary), bool)
        has[term[own]] = True
        mine = np.full(len(has), rest[i], np.int64)
        mine[term[own]] = p[own]

        def per_source(values: np.ndarray) -> np.ndarray:
            total = np.r_[0, np.cumsum(values, dtype=np.int64)]
            return (total[bounds[1:]] - total[bounds[:-1]])[others]

        both = has[term]
        theirs = per_source(np.abs(p - mine[term]))
        shared = per_source(np.where(both, np.abs(mine[term] - rest[owner]), 0))
        alone = np.array([np.abs(p[own] - r).sum() for r in rest[others]], np.int64) - shared
        met = bounds[i + 1] - bounds[i] + np.diff(bounds)[others] - per_source(both.astype(np.int64))
        out += [(names[i], names[j], int(f), int(m)) for j, f, m in zip(others, theirs + alone, met)]
    lang = cell.column("lang")[0].as_py()
    left, right, apart, met = zip(*out) if out else ([], [], [], [])
    return pa.table(
        [
            pa.array([lang] * len(out), pa.string()), pa.array(left, pa.string()), pa.array(right, pa.string()),
            pa.array(apart, pa.int64()), pa.array(met, pa.int64()),
        ],
        names=["lang", "source", "item", "apart", "met"],
    )


def term_counts(rows: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows (lang, source, term, n, docs): occurrences of the term there, and documents with it.

    Null texts, languages and sources are read as empty ones, texts whole.
    All rows of a (lang, term) are in one partition.
    """
    read = rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    named = read.where("text <> ''").withColumn("digest", F.unhex(F.sha2("text", 256)))
    collapsed = named.mapInArrow(_collapse, COLLAPSED).repartition("lang", "digest").sortWithinPartitions("lang", "digest")
    # Tasks have added up what they hold, so a combine before this shuffle would find little.
    sums = collapsed.mapInArrow(_count, COUNTED).repartition("lang", "term")
    return sums.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str) -> Column:
    """Smoothed and scaled share of a term, exact for any count; `terms` is the number of kept terms."""
    wide = f"cast({count} as decimal(19,0)) + {SMOOTHING}"
    return F.expr(f"1 + ({wide}) * {SCALE} div ({total} + {SMOOTHING} * terms)").cast("long")


def _cells(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """Sources and their terms' shares, copied to the cells where their block of sources meets another."""
    heads = groups.select("lang", "source", "blocks", "cells", F.lit(None).cast("string").alias("term"), F.col("rest").alias("p"))
    heads = heads.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    entries = shares.select("lang", "source", "blocks", "cells", "term", "p")
    entries = entries.withColumn("cell", F.pmod(F.xxhash64("term"), F.col("cells")).cast("int"))
    met = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(
            F.least("mine", j).alias("low"), F.greatest("mine", j).alias("high"), (F.col("mine") > j).cast("int").alias("side")
        ),
    )
    placed = heads.unionByName(entries).withColumn("mine", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    return placed.select("lang", "cell", "source", "term", "p", F.inline(met))


def audit_sources(
    rows: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
    least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS,
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank).

    Part `pair` holds the distance of every (lang, source) to each other
    source of the language, part `term` the terms that stand out most in it.
    Null texts, languages and sources count as empty ones, and every
    occurring group gets its pairs, terms or not; copies and repeated rows
    count as often as they occur. Ties rank by the item. An empty table, or a
    language with one source, gives no pairs. Other columns are ignored.
    """
    of_term = Window.partitionBy("lang", "term")
    counted = term_counts(rows, text, lang, source)
    counted = counted.withColumn("lang_docs", F.sum("docs").over(of_term)).withColumn("lang_n", F.sum("n").over(of_term))
    kept = counted.where(F.col("lang_docs") >= least).select("lang", "source", "term", "n", "lang_n")
    kept = materialise(kept, "audit-kept")
    frequent = kept.select("lang", "term").distinct()
    groups = rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)).cast("long"))
    langs = frequent.groupBy("lang").agg(F.count("*").alias("terms"))
    whole = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("sources"))
    whole = whole.join(langs, "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0)).cast("long"))
    groups = groups.join(whole, "lang").where("terms > 0 or sources > 1")
    groups = groups.select(
        "lang", "source", "total", "lang_total", "terms",
        F.when(F.col("terms") > 0, _share("0", "total")).otherwise(0).cast("long").alias("rest"),
        F.ceil(F.col("sources") / SOURCES).cast("int").alias("blocks"),
        F.greatest(F.ceil(F.col("terms") / TERMS), F.lit(1)).cast("int").alias("cells"),
    )
    groups = materialise(groups, "audit-groups")
    shares = kept.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total"))

    cells = _cells(groups, shares).groupBy(*CELL).applyInArrow(
        _apart, "lang string, source string, item string, apart long, met long"
    )
    sums = cells.groupBy("lang", "source", "item").agg(F.sum("apart").alias("apart"), F.sum("met").alias("met"))
    left = groups.select("lang", "source", "terms", "rest")
    right = groups.select("lang", F.col("source").alias("item"), F.col("rest").alias("item_rest"))
    neither = (F.col("terms") - F.col("met")) * F.abs(F.col("rest") - F.col("item_rest"))
    pairs = sums.join(left, ["lang", "source"]).join(right, ["lang", "item"]).withColumn("value", F.col("apart") + neither)
    pairs = pairs.withColumn("way", F.explode(F.array(F.lit(0), F.lit(1))))
    pairs = pairs.select(
        "lang", F.when(F.col("way") == 0, F.col("source")).otherwise(F.col("item")).alias("source"), F.lit("pair").alias("part"),
        F.when(F.col("way") == 0, F.col("item")).otherwise(F.col("source")).alias("item"), "value",
    )
    above = shares.withColumn("value", F.col("p") - _share("lang_n", "lang_total"))
    above = above.where("value > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    best_first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(best_first))
    return ranked.unionByName(above.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= top))


@query(
    "op11_source_divergence",
    f"""with d as (select coalesce(lang, '') lang, coalesce(source, '') source, row_number() over () r,
      regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') terms from documents),
    w as (select lang, source, r, unnest(terms) term from d),
    kept as (select lang, term from (select lang, r, term from w group by all) group by lang, term having count(*) >= {LEAST_DOCUMENTS}),
    v as (select lang, count(*) v from kept group by lang),
    c as (select lang, source, term, count(*) c from w join kept using (lang, term) group by all),
    n as (select lang, source, sum(c) n from c group by all),
    g as (select lang, source, coalesce(n, 0) n, coalesce(v, 0) v from (select distinct lang, source from d)
      left join n using (lang, source) left join v using (lang)),
    p as (select g.lang, g.source, term, coalesce(c, 0) c,
      1 + ({SCALE}::hugeint * (coalesce(c, 0) + {SMOOTHING})) // (n + {SMOOTHING} * v) p
      from g join kept using (lang) left join c using (lang, source, term)),
    q as (select lang, term, 1 + ({SCALE}::hugeint * (sum(c) + {SMOOTHING})) // (any_value(ln) + {SMOOTHING} * any_value(v)) q
      from p join (select lang, sum(n) ln, any_value(v) v from g group by lang) using (lang) group by lang, term),
    apart as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) f from p a join p b using (lang, term)
      where a.source <> b.source group by all),
    pairs as (select a.lang, a.source, 'pair' part, b.source item, coalesce(f, 0)::bigint "value"
      from g a join g b on a.lang = b.lang and a.source <> b.source
      left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source),
    tops as (select lang, source, 'term' part, term item, (p - q)::bigint "value" from p join q using (lang, term) where c > 0 and p > q),
    ranked as (select *, row_number() over (partition by lang, source, part order by "value" desc, item)::integer "rank"
      from (select * from pairs union all select * from tops))
    select * from ranked where part = 'pair' or "rank" <= {TOP_TERMS}""",
)
def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return audit_sources(table(spark, folder, "documents").select("text", "lang", "source"))
