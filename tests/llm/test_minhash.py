"""MinHash near-duplicates against all pairs."""

import random
import re

import pytest

from affinium.llm.minhash import drop_near_duplicates, near_duplicates
from affinium.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, percent):
    """Rows are nodes; returns (key, n, component, kept) sorted."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    by_shingle = {}
    for i, s in enumerate(sets):
        if rows[i][0] is not None:
            for x in s:
                by_shingle.setdefault(x, []).append(i)
    seen = set()
    for found in by_shingle.values():
        for a in range(len(found)):
            for b in range(a):
                pair = (found[b], found[a])
                if pair not in seen:
                    seen.add(pair)
                    s, t = sets[pair[0]], sets[pair[1]]
                    if 100 * len(s & t) >= percent * len(s | t):
                        root[find(pair[0])] = find(pair[1])
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    out = []
    for i, (key, _) in enumerate(rows):
        component = least.get(find(i)) if key is not None and sets[i] else key
        out.append((key, len(sets[i]), component, key == component))
    return sorted(out, key=str)


def test_query(spark, tables):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    got = QUERIES["op1_minhash_near_dedup"](spark, tables)
    assert got.columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 4, 80)


@pytest.fixture(scope="module")
def family():
    """A large family of copies of one text with a few words changed, some chains, odd rows."""
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((1000 - i, " ".join(words)))
    chain = [rng.choice(vocabulary) for _ in range(100)]
    for i in range(40):
        chain = chain[2:] + [rng.choice(vocabulary) for _ in range(2)]
        rows.append((2000 + (i * 7) % 40, " ".join(chain)))
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one"), (7, "two one"),
             (8, "x " * 300), (9, "x x x x x"), (None, rows[0][1]), (10, rows[0][1]), (10, rows[0][1]),
             (11, "alpha beta gamma delta epsilon"), (11, "one two"), (12, "Ä b c d e f"), (13, "ä b c d e f")]
    return rows


@pytest.mark.parametrize(("size", "percent"), [(4, 80), (5, 80), (3, 90)])
def test_family(spark, family, size, percent):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in family], "doc_id long, text string, key string, class int")
    got = near_duplicates(df, size=size, percent=percent).collect()
    assert sorted(map(tuple, got), key=str) == brute(family, size, percent)


def test_kept_rows_keep_their_columns(spark):
    df = spark.createDataFrame(
        [(1, "a b c d e f g", "p", 9), (2, "a b c d e f g", "q", 8), (3, None, None, None), (None, "a b", "r", 7)],
        "doc_id long, text string, component_id string, a int",
    )
    got = drop_near_duplicates(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(1, "a b c d e f g", "p", 9), (3, None, None, None), (None, "a b", "r", 7)], key=str
    )


def test_one_row_of_each_component_stays(spark):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "a b c d e f g"), (5, "a b c d e f g"), (5, "h i j k l m n"), (5, "h i j k l m n"),
            (7, near), (7, near + " x"), (7, near), (9, near + " y"),
            (3, None), (3, None), (4, ""), (4, ""), (None, near), (None, near)]
    df = spark.createDataFrame([(k, t, "p", 1) for k, t in rows], "doc_id long, text string, id string, code int")
    got = drop_near_duplicates(df)
    assert got.columns == df.columns
    stay = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    sevens = [r for r in stay if r[0] == 7]
    assert len(sevens) == 1 and sevens[0][1] in (near, near + " x")
    assert [r for r in stay if r[0] != 7] == sorted(
        [(1, "a b c d e f g"), (5, "h i j k l m n"), (3, None), (3, None), (4, ""), (4, ""), (None, near), (None, near)],
        key=str,
    )


@pytest.mark.parametrize("block", [4096, 16])
def test_repeats_are_compared_once(spark, family, block, monkeypatch):
    """A table united with itself links alike and meets as many pairs; keys cut into blocks give the same."""
    from affinium.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", block)
    compared = []
    real = minhash.materialise

    def counting(df, name, *rest):
        out = real(df, name, *rest)
        if name in ("minhash-texts", "minhash-star"):
            compared.append((name, out.count()))
        return out

    monkeypatch.setattr(minhash, "materialise", counting)
    counts = []
    for times in (1, 30):
        rows = [(k, t) for k, t in family for _ in range(times)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = near_duplicates(df, size=4).distinct().collect()
        assert sorted(map(tuple, got), key=str) == sorted(set(brute(family, 4, 80)), key=str)
        counts.append(list(compared))
        compared.clear()
    assert counts[0] == counts[1]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).collect() == []
    assert drop_near_duplicates(df).collect() == []
