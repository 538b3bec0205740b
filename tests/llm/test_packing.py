"""Packing: a full and gapless layout, ids that give back the texts, and few sequences."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from affinium.llm.packing import END_ID, Plan, default_vocabulary, open_tokenizer, pack, sequences
from affinium.llm.queries import QUERIES


def layout(plan):
    """Sequences as lists of (offset, length), and all ranks per length."""
    bins, ranks = defaultdict(list), defaultdict(list)
    for size, low, high, first, offset, per in plan.runs:
        for rank in range(low, high):
            bins[first + (rank - low) // per].append((offset + (rank - low) % per * size, size))
            ranks[size].append(rank)
    return bins, ranks


def best_fit(counts, capacity):
    """Plain best-fit decreasing; the number of sequences."""
    rooms = Counter()
    used = 0
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            room = min((r for r, n in rooms.items() if n and r >= size), default=None)
            if room is None:
                used, room = used + 1, capacity
            else:
                rooms[room] -= 1
            rooms[room - size] += 1
    return used


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice([50, 200, 1024])
    sizes = [rng.randint(1, capacity) for _ in range(rng.choice([1, 5, 200]))]
    counts = Counter(rng.choice(sizes) for _ in range(rng.choice([1, 30, 3000])))
    plan = Plan(counts, capacity, rng.choice([3, 20, 100]))
    bins, ranks = layout(plan)
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in counts.items()}
    assert sorted(bins) == list(range(plan.sequences))
    for pieces in bins.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= capacity
    bound = -(-sum(s * n for s, n in counts.items()) // capacity)
    assert plan.sequences >= bound
    # Linear grouping loses at most what a group is rounded up by, best-fit nothing to speak of.
    assert plan.sequences <= 1.15 * best_fit(counts, capacity) + 2


def test_many_pieces_fill_their_sequences():
    rng = np.random.default_rng(1)
    counts = Counter(rng.lognormal(6, 0.8, 200_000).clip(1, 1024).astype(int).tolist())
    plan = Plan(counts)
    bound = -(-sum(s * n for s, n in counts.items()) // 1024)
    assert plan.sequences <= max(1.015 * bound, sum(n for s, n in counts.items() if s > 512))


def test_query(spark, tables):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    tokenizer.encode_special_tokens = True
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    pieces = QUERIES["op5_best_fit_packing"](spark, tables).collect()
    by_document, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_document[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_document.keys() == texts.keys()
    for key, found in by_document.items():
        ids = [*tokenizer.encode(texts[key], add_special_tokens=False).ids, END_ID]
        at = 0
        for n, r in enumerate(sorted(found, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at)
            assert n == 0 or r.length == 1024
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


def test_round_trip(spark):
    rows = [(1, "Hello world, hello! " * 40), (2, None), (3, ""), (None, "a"), (4, "é漢 <|endoftext|>"), (4, "again")]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, length int, ids int")
    got = sequences(pack(df, capacity=32, keep_ids=True)).collect()
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(len(r.ids) for r in got) >= total - 8 and all(len(r.ids) <= 32 for r in got)
    assert sum(r.ids.count(END_ID) for r in got) == len(rows)
    assert sorted({k for r in got for k in r["keys"]}, key=str) == [1, 2, 3, 4, None]


MARKED = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|>  y<|endoftext|><|endoftext|>", "<|endoftext|", "é漢\n<|endoftext|>\n",
          "Hello world <|endoftext|> " * 30]


def plain_call():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_a_plain_call():
    """Also of texts that hold the added token, and of arbitrary text around it."""
    want, got = plain_call(), open_tokenizer(default_vocabulary())
    rng = random.Random(3)
    parts = ["<|endoftext|>", "<|endoftext|", "endoftext|>", " ", "  ", "\n", "\t\u00a0", "don't", "été", "漢字", "42", "\u0301", "🙂", "..."]
    for text in [*MARKED, "", *("".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(3000))]:
        assert got(text) == want(text), text


def test_pieces_of_texts_with_the_added_token(spark):
    want = plain_call()
    df = spark.createDataFrame(list(enumerate(MARKED)), "doc_id long, text string")
    found = defaultdict(list)
    for r in pack(df, capacity=32, keep_ids=True).collect():
        found[r.doc_id].append(r)
    for key, text in enumerate(MARKED):
        pieces = sorted(found[key], key=lambda r: r.piece)
        assert [i for r in pieces for i in r.ids] == [*want(text), END_ID]
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in pieces)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "\t" * 1_500_000 + "end", "word" + " " * 1_200_000 + "é <|endoftext|> x"])
def test_long_white_space(text):
    """Runs beyond what the fast matcher can hold give the ids of a plain call."""
    assert open_tokenizer(default_vocabulary())(text) == plain_call()(text)
