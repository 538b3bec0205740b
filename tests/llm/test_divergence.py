"""Source divergence: brute force over dense shares, with copies, nulls, ties, several blocks and a small task memory."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from affinium.llm import divergence
from affinium.llm.divergence import LEAST_DOCUMENTS, audit_sources, term_counts


def plain(rows, least=LEAST_DOCUMENTS, top=50):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=str.encode)

        def shares(found):
            total = sum(found[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (found[t] + 5) // total for t in kept}

        own = {s: shares(counts[lang, s]) for s in sources}
        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(abs(own[s][t] - own[o][t]) for t in kept)) for o in sources - {s}]
            tops = [(t, own[s][t] - whole[t]) for t in kept if counts[lang, s][t] and own[s][t] > whole[t]]
            for part, found, limit in (("pair", pairs, len(pairs)), ("term", tops, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:limit])]
    return sorted(out)


def made(n=3000, sources=9, seed=5):
    rng = np.random.default_rng(seed)
    words = ["Tag", "tag", "TAG", "Ünter", "ünter", "mot", "été", "x", "日本", "a1b", "d'or", "long-term", *(f"w{chr(97 + i)}" for i in range(26))]
    rows = []
    for _ in range(n):
        lang, source = ["en", "de", None, ""][min(3, rng.geometric(0.6) - 1)], [None, *(f"s{i}" for i in range(sources))][min(sources, rng.geometric(0.3) - 1)]
        text = " ".join(rng.choice(words, rng.integers(1, 6))) if rng.random() < 0.9 else [None, "", "123 .,!"][rng.integers(3)]
        rows.append((lang, source, text))
    rows += [("en", "s0", "hot copy Tag")] * 1500 + [("en", f"s{i}", "hot copy Tag") for i in range(4)] * 20
    return rows + [("fr", "only", "rare words"), ("it", "a", "rare"), ("it", "b", None), ("it", "c", "")]


def found(df, **options):
    return sorted(map(tuple, audit_sources(df, **options).collect()))


@pytest.fixture(scope="module")
def rows():
    return made()


@pytest.fixture(scope="module")
def want(rows):
    return plain(rows)


def test_brute_force(spark, rows, want):
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert found(df) == want
    assert {r[0] for r in want} == {"en", "de", "", "it"} and {r[2] for r in want if r[0] == "it"} == {"pair"}


def test_blocks_and_small_slices(spark, rows, want, monkeypatch):
    for name, value in (("SOURCES", 2), ("TERMS", 4), ("COLLAPSE_BYTES", 512), ("HELD_SUMS", 20)):
        monkeypatch.setattr(divergence, name, value)
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    assert found(df) == want


def test_counts_add_up(spark):
    rows = [("en", "a", "One two one")] * 50 + [("en", "b", "one")] * 7 + [("de", "a", "one")]
    got = {tuple(r[:3]): r[3:] for r in term_counts(spark.createDataFrame(rows, "lang string, source string, text string")).collect()}
    assert got == {
        ("en", "a", "one"): (100, 50), ("en", "a", "two"): (50, 50), ("en", "b", "one"): (7, 7), ("de", "a", "one"): (1, 1),
    }


def test_copies_are_collapsed_before_the_shuffle(spark):
    rows = [(f"l{i % 2}", f"s{i % 3}", "the same long text " * 50) for i in range(600)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1)
    named = df.selectExpr("lang", "source", "text", "unhex(sha2(text, 256)) digest").select("lang", "source", "text", "digest")
    collapsed = named.mapInArrow(divergence._collapse, divergence.COLLAPSED).collect()
    assert len(collapsed) == 2 and sum(sum(r.n) for r in collapsed) == 600


def test_empty_and_long_texts_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert audit_sources(empty).collect() == []
    rows = [("en", f"s{i % 2}", "Wort " * (50_000 if i == 3 else 1 + i % 2) + ("extra " if i % 2 else "")) for i in range(80)]
    rows = [(*r, "x", 1, "y") for r in rows]
    df = spark.createDataFrame(rows, "lang string, source string, text string, term string, n int, digest string")
    assert found(df) == plain([r[:3] for r in rows])
    assert found(df.select("lang", "source", "text"), least=41, top=1) == plain([r[:3] for r in rows], 41, 1)
    null = spark.createDataFrame([(None, None, None)] * 3, "lang string, source string, text string")
    assert found(null) == []


def test_exact_at_any_size(spark):
    df = spark.createDataFrame([(4 * 10**12 + 7, 9 * 10**15 + 1, 10**6)], "n long, total long, terms long")
    n, total, terms = df.first()
    assert df.select(divergence._share("n", "total")).first()[0] == 1 + 10**9 * (n + 5) // (total + 5 * terms)
