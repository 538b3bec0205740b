"""Secret scans with DataFrame functions only.

Three patterns give the base spans. Beside them, candidate strings are
scanned by a sliding window whose Shannon entropy is kept up to date by
counts: a character that enters or leaves changes the sum of c * log2(c)
by the difference of two table entries. Windows that reach the threshold of
the candidate's character class become one more span, unless an allow-list
pattern matches the candidate.

Positions come from splitting at the pattern: the pieces between matches
and the matches themselves alternate, so their lengths add up to starts and
ends in code points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinium.llm.registry import query, table

# Fixed patterns of the base spans, in order of kind.
ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
    r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex", "entropy"]
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24

# Candidates of the entropy scan, its window and the bits that make a window suspicious, by character class.
WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
THRESHOLDS = [
    ("hex", r"^[0-9a-f]+$|^[0-9A-F]+$", 2.95),
    ("mixed", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])", 3.75),
    ("one case and digits", r"^(?=.*[0-9])(?=.*[A-Za-z])", 3.65),
]
# Candidates that look random but are not secret.
ALLOWED = [
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9/_=+-]+$",
    r"^[A-Za-z/_=+-]+$",
    r"(?i)example|placeholder|changeme",
]
# Characters of a candidate that one slide covers; longer ones are cut, with WINDOW - 1 in common.
STRETCH = 200
# c * log2(c) for every count a window can hold, and how much one more adds.
C_LOG_C = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]
ONE_MORE = [b - a for a, b in zip(C_LOG_C, C_LOG_C[1:])]

SPAN = "array<struct<start:int,kind:int,end:int>>"


def _located(text: Column, pattern: str) -> Column:
    """Array of (start, match) for all matches, from left to right."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,match:string>>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["piece"])
        return F.struct(
            (begin + F.length(pair["match"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(begin.alias("start"), pair["match"].alias("match")))).alias("out"),
        )

    pairs = F.zip_with(
        F.slice(pieces, F.lit(1), F.size(found)), found,
        lambda piece, match: F.struct(piece.alias("piece"), match.alias("match")),
    )
    return F.aggregate(pairs, start, step)["out"]


def _spans(text: Column, kind: int, pattern: str, gate: str, keep) -> Column:
    """Spans of one kind; only texts that pass the gate pattern are searched."""
    located = F.transform(
        F.filter(_located(text, pattern), lambda m: keep(m["match"])),
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["match"])).alias("end")
        ),
    )
    return F.when(text.rlike(gate), located).otherwise(F.array().cast(SPAN))


def _hot_windows(match: Column) -> Column:
    """(first, last) start of the windows of a candidate that reach its threshold; -1 if none does.

    Long candidates are cut into stretches, so that work grows with their
    length.
    """
    limit = F.lit(None).cast("double")
    for _, pattern, bits in reversed(THRESHOLDS):
        limit = F.when(match.rlike(pattern), F.lit(bits)).otherwise(limit)
    # Entropy = log2(W) - S / W, so a window is hot when S is at most this. An array of one binds it: what a lambda
    # uses as an expression would be evaluated again for every window.
    most = F.array((math.log2(WINDOW) - limit) * WINDOW + F.lit(1e-9))
    parts = F.regexp_extract_all(match, F.lit(rf".{{1,{STRETCH}}}"), F.lit(0))
    none = F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def over_stretches(parts: Column, most: Column) -> Column:
        heads = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.substr(p, F.lit(1), F.lit(WINDOW - 1)))
        # The head of the next part completes the windows that begin in this one.
        stretches = F.zip_with(parts, heads, lambda part, head: F.concat(part, F.coalesce(head, F.lit(""))))
        found = F.transform(stretches, lambda stretch, i: F.struct((i * STRETCH).alias("at"), _hot_in_stretch(stretch, most).alias("hot")))
        return F.aggregate(
            F.filter(found, lambda s: s["hot"]["first"] >= 0),
            none,
            lambda acc, s: F.struct(
                F.when(acc["first"] < 0, s["at"] + s["hot"]["first"]).otherwise(acc["first"]).alias("first"),
                (s["at"] + s["hot"]["last"]).alias("last"),
            ),
        )

    bound = F.transform(most, lambda m: F.when(m.isNull(), none).otherwise(
        F.element_at(F.transform(F.array(parts), lambda p: over_stretches(p, m)), 1)
    ))
    return F.element_at(bound, 1)


def _hot_in_stretch(match: Column, most: Column) -> Column:
    """The same for one stretch; none in a stretch shorter than a window."""
    adds = lambda count: F.element_at(F.array(*[F.lit(v) for v in ONE_MORE]), count + 1)

    def first_sum(acc: Column, i: Column) -> Column:
        head = F.substr(match, F.lit(1), i - 1)
        return acc + adds(i - 1 - F.length(F.replace(head, F.substr(match, i, F.lit(1)), F.lit(""))))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(WINDOW)), F.lit(0.0), first_sum)
    begin = F.struct(
        total.alias("sum"),
        F.when(total <= most, 0).otherwise(-1).alias("first"),
        F.when(total <= most, 0).otherwise(-1).alias("last"),
    )

    def slide(acc: Column, i: Column) -> Column:
        # i is the place, from 0, where the window now starts.
        shared = F.substr(match, i + 1, F.lit(WINDOW - 1))
        count = lambda at: WINDOW - 1 - F.length(F.replace(shared, F.substr(match, at, F.lit(1)), F.lit("")))
        now = F.array(acc["sum"] - adds(count(i)) + adds(count(i + WINDOW)))
        return F.element_at(
            F.transform(
                now,
                lambda now: F.struct(
                    now.alias("sum"),
                    F.when((now <= most) & (acc["first"] < 0), i).otherwise(acc["first"]).alias("first"),
                    F.when(now <= most, i).otherwise(acc["last"]).alias("last"),
                ),
            ),
            1,
        )

    places = F.when(F.length(match) > WINDOW, F.sequence(F.lit(1), F.length(match) - WINDOW))
    places = F.coalesce(places, F.array().cast("array<int>"))
    none = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))
    return F.when(F.length(match) < WINDOW, none).otherwise(F.aggregate(places, begin, slide))


def _entropy_spans(text: Column) -> Column:
    allowed = lambda m: m.rlike("|".join(f"(?:{p})" for p in ALLOWED))
    candidates = F.filter(_located(text, CANDIDATE), lambda m: ~allowed(m["match"]))
    scanned = F.transform(
        candidates, lambda m: F.struct(m["start"].alias("start"), _hot_windows(m["match"]).alias("hot"))
    )
    spans = F.transform(
        F.filter(scanned, lambda s: s["hot"]["first"] >= 0),
        lambda s: F.struct(
            (s["start"] + s["hot"]["first"]).alias("start"),
            F.lit(3).alias("kind"),
            (s["start"] + s["hot"]["last"] + WINDOW).alias("end"),
        ),
    )
    return F.when(text.rlike(CANDIDATE), spans).otherwise(F.array().cast(SPAN))


def scan_secrets(documents: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Rows with `spans`, an array of (start, kind, end) sorted by start, then kind; kind indexes KINDS.

    A null text is empty and has no spans. Rows, repeated ones too, stay as
    they are; a column called spans is replaced unless a prefix is given.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    assign = _spans(body, 0, ASSIGN, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LENGTH)
    access = _spans(body, 1, ACCESS, rf"AKIA[A-Z0-9]{{{ACCESS_LENGTH - 4},}}", lambda m: F.length(m) >= ACCESS_LENGTH)
    # Longer runs hold all that count, so shorter ones need not be located.
    long_hex = rf"[0-9a-f]{{{HEX_LENGTH},}}"
    hexes = _spans(body, 2, long_hex, long_hex, lambda m: F.length(m) >= HEX_LENGTH)
    spans = F.array_sort(F.concat(assign, access, hexes, _entropy_spans(body)))
    return documents.withColumn(f"{prefix}spans", spans)


def redact(documents: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """Texts with every stretch covered by spans replaced by a mark; a null text stays null."""
    scanned = scan_secrets(documents, text, "_secret_")
    body = F.col(text)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, span: Column) -> Column:
        fresh = span["start"] >= acc["at"]
        kept = F.array(F.substr(body, acc["at"] + 1, span["start"] - acc["at"]), F.lit(mark))
        return F.struct(
            F.greatest(acc["at"], span["end"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], kept)).otherwise(acc["out"]).alias("out"),
        )

    done = F.aggregate(F.col("_secret_spans"), empty, step)
    rebuilt = F.concat(F.array_join(done["out"], ""), F.substr(body, done["at"] + 1, F.length(body)))
    clean = F.when(F.size("_secret_spans") > 0, rebuilt).otherwise(body)
    return scanned.withColumn(text, clean).drop("_secret_spans")


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ","
    )


def _sql_spans(kind: int, pattern: str, keep: str) -> str:
    """DuckDB: located matches of one pattern."""
    return f"""
  select doc_id, {kind} as kind, start, start + len(m) as "end", m from (
    select doc_id, m,
           sum(len(piece) + len(m)) over (partition by doc_id, row order by i) - len(m) as start
    from (select doc_id, row, unnest(range(1, len(f) + 1)) as i, unnest(f) as m, unnest(p[1:len(f)]) as piece
          from (select doc_id, row, regexp_extract_all(body, '{pattern}') as f,
                       string_split_regex(body, '{pattern}') as p from d)))
  where {keep}"""


def _sql() -> str:
    assign = ASSIGN.replace("'", "''")
    classes = " ".join(
        f"when {test} then {bits}"
        for test, bits in [
            ("regexp_matches(m, '^[0-9a-f]+$|^[0-9A-F]+$')", THRESHOLDS[0][2]),
            ("regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Z]') and regexp_matches(m, '[a-z]')",
             THRESHOLDS[1][2]),
            ("regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Za-z]')", THRESHOLDS[2][2]),
        ]
    )
    allowed = " or ".join(f"regexp_matches(m, '{p}')" for p in ALLOWED)
    names = f"[{', '.join(repr(k) for k in KINDS)}]"
    return f"""
with d as (select doc_id, coalesce(text, '') as body, row_number() over () as row from documents),
assign as ({_sql_spans(0, assign, f"len(regexp_extract(m, '{assign}', 2)) >= {ASSIGN_LENGTH}")}),
access as ({_sql_spans(1, ACCESS, f"len(m) >= {ACCESS_LENGTH}")}),
hex as ({_sql_spans(2, HEX, f"len(m) >= {HEX_LENGTH}")}),
candidate as (select *, case {classes} end as bits
              from ({_sql_spans(3, CANDIDATE, "true")}) where not ({allowed})),
windows as (select doc_id, start, m, bits, unnest(range(0, len(m) - {WINDOW} + 1)) as w
            from candidate where bits is not null),
scored as (select doc_id, start, w, bits,
                  list_entropy(string_split(substr(m, cast(w as integer) + 1, {WINDOW}), '')) as h from windows),
entropy as (select doc_id, 3 as kind, start + min(w) as start, start + max(w) + {WINDOW} as "end"
            from scored where h >= bits - 1e-10 group by doc_id, start),
spans as (select doc_id, kind, start, "end" from assign union all select doc_id, kind, start, "end" from access
          union all select doc_id, kind, start, "end" from hex
          union all select doc_id, kind, start, "end" from entropy),
per as (
  select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access,
         count(*) filter (kind = 2) as n_hex,
         string_agg({names}[kind + 1] || ':' || cast(start as bigint) || ':' || cast("end" as bigint), ','
                    order by start, kind) filter (kind < 3) as base,
         string_agg({names}[kind + 1] || ':' || cast(start as bigint) || ':' || cast("end" as bigint), ','
                    order by start, kind) as spans
  from spans group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents left join per using (doc_id)
"""


@query("op7_secret_scan", _sql())
def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    scanned = scan_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = _joined(F.filter("spans", lambda s: s["kind"] < 3))
    return scanned.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
