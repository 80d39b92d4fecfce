import bisect
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from tabprep.llm import packing
from tabprep.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


TEXTS = [
    "", " ", "Hello, World! It's 'S don't we'll", "Éléphant ÀB çà über Straße ſ ʃ", "x y z \u0085 q", "İstanbul I", "a<|endoftext|> b",
    "日本語 текст ΑΣ", "é combining", "½ ² 12 ª º µ _ __ -- €5", "word" * 400, "tab\tnew\nline\x0b\x0c\r.", "\x01\x1c a\x1fb", "'''s 're're 'veve",
]


def test_ids_are_the_tokenizers(tokenizer):
    encode = packing.encoder(tokenizer_path())
    for text in TEXTS:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert encode(text) == struct.pack(f"<{len(ids)}I", *ids), text


def test_ids_of_every_plain_character(tokenizer):
    encode = packing.encoder(tokenizer_path())
    for code in range(1, 0x250):
        for text in (chr(code), f"a{chr(code)}b", f"1{chr(code)} '{chr(code)}s"):
            ids = tokenizer.encode(text, add_special_tokens=False).ids
            assert encode(text) == struct.pack(f"<{len(ids)}I", *ids), (code, text)


def test_ids_of_another_file():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer, encode = Tokenizer.from_file(path), packing.encoder(path)
    assert packing.splits_here(tokenizer_path()) and not packing.splits_here(path)
    for text in TEXTS:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert encode(text) == struct.pack(f"<{len(ids)}I", *ids), text


def item_by_item(lengths, capacity):
    bins, used = [], 0
    for length in sorted(lengths, reverse=True):
        i = bisect.bisect_left(bins, length)
        rest = bins.pop(i) if i < len(bins) else capacity
        used += rest == capacity
        bisect.insort(bins, rest - length)
    return used


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 200))
    lengths = rng.integers(1, capacity + 1, int(rng.integers(1, 800))).tolist()
    plan = packing.best_fit_decreasing(dict(Counter(lengths)), capacity)
    bins, items = {}, Counter()
    for length, rank, number, first, each, offset in plan:
        assert rank == items[length]
        items[length] += number
        for k in range(number):
            bins.setdefault(first + k // each, []).append((offset + k % each * length, length))
    assert items == Counter(lengths)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == item_by_item(lengths, capacity)


def test_tightest_fit():
    tree = packing.TightestFit(10)
    assert tree.tightest(1) is None
    tree.add(4, 2)
    tree.add(10, 1)
    assert [tree.tightest(k) for k in (1, 4, 5, 10)] == [4, 4, 10, 10]
    tree.add(10, -1)
    assert tree.tightest(5) is None


def test_pack(spark, tokenizer):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(1, TEXTS[1], 1), (None, None, 2), (50, "a b c " * 40, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)
    found = packing.pack(docs, tokenizer_path(), capacity=32).collect()
    expected = []
    for key, text, _ in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        expected += [(key, k, at, len(ids[at : at + 32]), zlib.crc32(ids[at : at + 32].tobytes())) for k, at in enumerate(range(0, len(ids), 32))]
    none_last = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:5] for r in found), key=none_last) == sorted(expected, key=none_last)
    places = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 32
    assert len(places) == item_by_item([r["length"] for r in found], 32)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0
