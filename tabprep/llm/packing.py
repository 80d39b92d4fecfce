"""Best-fit-decreasing packing of token sequences."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import quoted
from .ranks import hash_key, running
from .scratch import Scratch

#: Letters and other numbers below U+0180, where lower-casing and normal form need no context and stay below (U+0130 left out).
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ſ"
NUMBERS = "0-9²³¹¼-¾"
PLAIN = re.compile(f"[\t-\r -~¡-įı-ſ]*")
#: The normalizer, split rule and merging of the files whose texts can be split here.
NORMALIZERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})
SPLIT_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZERS = (
    {"type": "Split", "pattern": {"Regex": SPLIT_RULE}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
)
#: That split rule within the plain characters.
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")
#: Parts of texts whose ids each worker process remembers, and how long they may be.
CACHE_ENTRIES, CACHE_CHARS = 500_000, 64
_encoders: dict[str, Callable[[str], bytes]] = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


def splits_here(path: str) -> bool:
    """Whether the file lower-cases and splits as :func:`encoder` does for plain texts, and adds nothing afterwards."""
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    steps = lambda part, name: tuple((given.get(part) or {}).get(name, ()))
    same = steps("normalizer", "normalizers") == NORMALIZERS and steps("pre_tokenizer", "pretokenizers") == PRE_TOKENIZERS
    whole = not any(given.get(x) for x in ("truncation", "padding")) and not given["model"].get("dropout")
    return same and whole and given["model"]["type"] == "BPE"


def encoder(path: str) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian unsigned 32-bit integers, as the file's tokenizer gives them.

    Where the file has the known normalizer and split rule, texts of plain Latin
    characters are lower-cased and split here, its merges give each part's ids,
    and a process remembers those of short parts.  Any other text, one with a
    special token's string, and all texts of other files go to the tokenizer as a
    whole.
    """
    if path in _encoders:
        return _encoders[path]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    here = splits_here(path)
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    letters = dict(enumerate(byte_letters()))
    merge = tok.model.tokenize
    pack = lambda ids: struct.pack(f"<{len(ids)}I", *ids)

    class Parts(dict):
        def __missing__(self, part: str) -> bytes:
            ids = pack([t.id for t in merge(part.encode().decode("latin-1").translate(letters))])
            if len(part) <= CACHE_CHARS and len(self) < CACHE_ENTRIES:
                self[part] = ids
            return ids

    parts = Parts()

    def encode(text: str) -> bytes:
        if not here or not PLAIN.fullmatch(text) or any(s in text for s in special):
            return pack(tok.encode(text, add_special_tokens=False).ids)
        return b"".join(map(parts.__getitem__, SPLIT.findall(text.lower())))

    _encoders[path] = encode
    return encode


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32; longer documents are cut every ``capacity`` ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), struct.pack("<I", end_id)
        step = 4 * capacity
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                key, ids = key.as_py(), encode(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for col, value in zip(out, (key, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    given = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    return given.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


class TightestFit:
    """A segment tree over remaining capacities 0 to ``capacity``: which hold open bins, and the least that is large enough."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity).bit_length()
        self.open = [0] * (2 * self.leaves)

    def add(self, remaining: int, bins: int) -> None:
        """Counts ``bins`` more (or fewer) open bins of this remaining capacity."""
        at = remaining + self.leaves
        while at:
            self.open[at] += bins
            at //= 2

    def tightest(self, need: int) -> int | None:
        """The least remaining capacity of ``need`` or more that an open bin has."""
        at = need + self.leaves
        if self.open[at]:
            return need
        while at > 1 and (at % 2 or not self.open[at + 1]):
            at //= 2
        if at <= 1:
            return None
        at += 1
        while at < self.leaves:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Packs ``counts[length]`` items of each length; rows (length, first rank, items, first bin, items a bin, offset).

    Items of one length are interchangeable, so runs of equal bins take equal
    items together: the plan is that of best-fit decreasing item by item, but its
    size and time depend on the number of lengths, not of items.  A row says that
    the items of this length from ``first rank`` on go to the bins from ``first
    bin`` on, so many a bin, from ``offset`` on in each.
    """
    tree, runs, plan, bins = TightestFit(capacity), [deque() for _ in range(capacity + 1)], [], 0

    def put(remaining: int, first: int, number: int) -> None:
        runs[remaining].append((first, number))
        tree.add(remaining, number)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, each = capacity, capacity // length
                first, number, bins = bins, -(-left // each), bins - (-left // each)
            else:
                each = remaining // length
                first, number = runs[remaining].popleft()
                tree.add(remaining, -number)
            full = min(number, left // each)
            if full:
                plan.append((length, rank, full * each, first, each, capacity - remaining))
                put(remaining - each * length, first, full)
                rank, left, first, number = rank + full * each, left - full * each, first + full, number - full
            if number and left:
                plan.append((length, rank, left, first, left, capacity - remaining))
                put(remaining - left * length, first, 1)
                left, first, number = 0, first + 1, number - 1
            if number:
                runs[remaining].appendleft((first, number))
                tree.add(remaining, number)
    return plan


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 0,
    seed: int = 23,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Documents are tokenized where they lie.  Only the counts of the piece lengths
    (``capacity`` numbers at most, whatever the input) reach the driver, which
    packs them best-fit decreasing; the plan, bounded likewise, is sent to the
    tasks, and each piece finds its sequence and offset by its rank among the
    pieces of its length.

    A null text counts as empty: its only id is ``end_id``.  Repeated rows are
    packed one by one.  An empty table gives no rows.  Ids must be whole numbers; a
    long text is cut into pieces, and pieces of one length are interchangeable, so
    ties change no sequence's fill.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    pieces = token_pieces(docs, tokenizer, capacity, end_id, doc_id, text)
    pieces = scratch.keep(pieces.withColumn("key", hash_key(seed, F.col("doc_id"), F.col("piece"), F.col("ids_crc32"))))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = np.array(best_fit_decreasing(counts, capacity), np.int64).reshape(-1, 6)
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    sent = spark.sparkContext.broadcast(plan[order])
    ranked = running(pieces, ["length"], "key", ["doc_id", "piece", "ids_crc32"], rows=sum(counts.values()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sent.value
        # a length's ranks start where the earlier lengths' end, so one search finds length and rank together
        ends = np.cumsum(rows[:, 2])
        lengths, firsts = np.unique(rows[:, 0], return_index=True)
        shift = dict(zip(lengths.tolist(), (ends - rows[:, 2])[firsts].tolist(), strict=True))
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            base = np.array([shift[x] for x in length.tolist()], np.int64)
            hit = rows[np.searchsorted(ends, base + rank, "right")].reshape(-1, 6)
            nth = rank - hit[:, 1]
            found = [hit[:, 3] + nth // hit[:, 4], hit[:, 5] + nth % hit[:, 4] * length]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, found)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
