"""Document fingerprints from locally consistent parsing: deterministic coin tossing and hierarchical phrase names."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import quoted
from .substring_dedup import STEP, mixed

#: Phrases of this level and above make a fingerprint, which has so many bins of two bytes.
FIRST_LEVEL, BINS = 2, 64
#: Code points parsed together, phrases named together, and rows and parts of the order of documents.
BLOCK, NAMED, ROWS_IN_PART, PARTS = 1 << 17, 1 << 18, 16_384, 20_000
#: Rounds of coin tossing that bring labels of 64 bits below 6.
ROUNDS = 4
#: Repetitions from which runs are alike.
LONG_RUN = 2047


def without_runs(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each maximal run of a repeated symbol as one symbol named after it and its length (from LONG_RUN on alike); ``first``
    marks where texts begin."""
    new = np.empty(len(symbols), bool)
    new[0] = True
    np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
    new |= first
    at = np.flatnonzero(new)
    if len(at) == len(symbols):
        return symbols, first
    out, ends = symbols[at], np.append(at[1:], len(symbols))
    run = np.flatnonzero(ends - at > 1)
    length = np.minimum((ends - at)[run], LONG_RUN).astype(symbols.dtype)
    # code points leave the upper bits of 32 free
    out[run] = out[run] + (length << 21) if symbols.dtype == np.uint32 else mixed(out[run] + length * STEP)
    return out, first[at]


def coin_labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6, different for neighbours: which is the lowest bit in which a symbol differs from the one before, and
    its value there, over and over.  A text's first symbol differs in bit 0 from an imagined one."""
    x, starts = symbols, np.flatnonzero(first)
    for _ in range(ROUNDS):
        one = x.dtype.type(1)
        differ = np.empty_like(x)
        np.bitwise_xor(x[1:], x[:-1], out=differ[1:])
        differ[starts] = one
        bit = np.bitwise_count((differ & (~differ + one)) - one)
        # equal neighbours are left by a clash of names alone
        bit = np.minimum(bit, x.dtype.itemsize * 8 - 1)
        x = 2 * bit + ((x >> bit.astype(x.dtype, copy=False)) & one).astype(np.uint8)
    return x


@cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number modulo 2 ** 64, and their inverses."""
    with np.errstate(over="ignore"):
        inverse = np.uint64(pow(int(STEP), -1, 1 << 64))
        return np.cumprod(np.full(NAMED, STEP)), np.cumprod(np.full(NAMED, inverse))


def named(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A name for each phrase, from its symbols in order: the same wherever it stands."""
    power, inverse = powers()
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        # phrases are much shorter than what is left at the end
        to = int(np.searchsorted(starts, starts[at] + NAMED - 64))
        own = starts[at:to] - starts[at]
        part = symbols[starts[at] : starts[to] if to < len(starts) else len(symbols)].astype(np.uint64)
        part += STEP
        part *= power[: len(part)]
        out[at:to] = mixed(np.add.reduceat(part, own) * inverse[own])
        at = to
    return out


def phrases(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the next level: phrases begin at texts' starts and where a label is above both neighbours'.

    A label follows from the four symbols before, so equal stretches are cut alike
    but for a few symbols at their ends, and phrases have two to eleven symbols.
    """
    symbols, first = without_runs(symbols, first)
    label = coin_labels(symbols, first)
    peak = first.copy()
    peak[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~first[2:]
    starts = np.flatnonzero(peak)
    return named(symbols, starts), first[starts]


def prints(texts: list[str], first_level: int = FIRST_LEVEL, bins: int = BINS) -> np.ndarray:
    """A row of ``bins`` numbers of 16 bits for each text: of the phrases of ``first_level`` and above that fall into a bin
    by their names, the least one's remaining bits, never 0; 0: none.  A text that is one phrase before has that one."""
    least = np.full((len(texts), bins), ~np.uint64(0))
    empty = np.uint64(~np.uint64(0))
    some = [i for i, t in enumerate(texts) if t]
    body = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc, lengths = np.array(some, np.int64), np.array([len(texts[i]) for i in some], np.int64)
    first = np.zeros(len(body), bool)
    first[np.cumsum(lengths) - lengths] = True
    symbols, level = body, 0
    with np.errstate(over="ignore"):
        while len(symbols):
            symbols, first = phrases(symbols, first)
            level += 1
            starts = np.flatnonzero(first)
            count = np.diff(np.r_[starts, len(symbols)])
            whole = count == 1
            told = np.repeat((level >= first_level) | whole, count)
            seen = mixed(symbols[told] + STEP)
            at = np.repeat(doc, count)[told] * bins + (seen % np.uint64(bins)).astype(np.int64)
            np.minimum.at(least.reshape(-1), at, seen // np.uint64(bins))
            goes_on = np.repeat(~whole, count)
            symbols, first, doc = symbols[goes_on], first[goes_on], doc[~whole]
    return np.where(least == empty, 0, least % np.uint64(65535) + np.uint64(1)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of phrases that texts have in common, as their fingerprints tell: equal bins among those that either fills."""
    filled = ((a != 0) | (b != 0)).sum(axis=1)
    return np.where(filled == 0, 1.0, ((a == b) & (a != 0)).sum(axis=1) / np.maximum(filled, 1))


def digits(found: np.ndarray) -> list[str]:
    """Each fingerprint as hexadecimal digits, four a bin."""
    return [row.tobytes().hex() for row in found.astype(">u2")]


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", first_level: int = FIRST_LEVEL, bins: int = BINS) -> DataFrame:
    """Rows (doc_id, n_chars, fingerprint), one per input row, without a shuffle.

    Equal texts have equal fingerprints; texts that share passages share the
    phrases inside them, wherever the passages stand.  Null texts are empty.  Ids
    may be of any type and null.  A text takes some 30 bytes a code point while it
    is parsed.  Repeated rows are rows; an empty table gives none.
    """

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(range(b.num_rows), b.column(0), (t.as_py() for t in b.column(1)), strict=True))
        for held in by_size(rows, lambda row: len(row[2])):
            texts = [t for *_, t in held]
            ids = pa.array([i.as_py() for _, i, _ in held], pa.string())
            yield pa.RecordBatch.from_arrays([ids, pa.array(map(len, texts), pa.int64()), pa.array(digits(prints(texts, first_level, bins)))], ["id", "n_chars", "fingerprint"])

    kind = docs.schema[doc_id].dataType
    given = docs.select(F.col(quoted(doc_id)).cast("string").alias("id"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    found = given.mapInArrow(per_task, "id string, n_chars long, fingerprint string")
    return found.select(F.col("id").cast(kind).alias("doc_id"), "n_chars", "fingerprint")


def by_size(rows: Iterator[tuple], size: Callable[[tuple], int], most: int = BLOCK) -> Iterator[list[tuple]]:
    """Lists of successive rows of about ``most`` code points together."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row) + 64
        if total >= most:
            yield held
            held, total = [], 0
    if held:
        yield held


def part_of(key: Column, firsts: list[tuple[int, int]]) -> Column:
    """How many of ``firsts``, ascending pairs, lie at or below ``key``, by halving."""
    steps = [1 << k for k in reversed(range(len(firsts).bit_length()))]
    given = F.array(*[F.struct(F.lit(a).cast("long").alias("down"), F.lit(b).cast("long").alias("hash")) for a, b in firsts])

    def step(found: Column, more: Column) -> Column:
        return F.when((found + more <= len(firsts)) & (F.get(given, found + more - 1) <= key), found + more).otherwise(found)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def in_descending_order(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows (doc_id, text, part, again) so dealt and sorted that in a part each document is followed by the next one of the
    whole table in descending order, and after the last one by the first.

    A part's first document is sent to the part before as well, at its end and
    marked ``again``.  Equal ids are in the order of their texts' hashes, null ids
    come last.  The driver learns each part's first key; only keys are shuffled to
    find these, and then the texts once.
    """
    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    number = F.col(quoted(doc_id)).cast("long")
    key = F.struct(F.bitwise_not(F.coalesce(number, F.lit(-(1 << 63)))).alias("down"), F.xxhash64(body).alias("hash"))
    spark = docs.sparkSession
    rows = docs.count()
    parts = min(PARTS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_IN_PART)))
    keys = docs.select(key.alias("key")).select("key.down", "key.hash")
    ranges = keys.repartitionByRange(parts, "down", "hash").groupBy(F.spark_partition_id().alias("at")).agg(F.min(F.struct("down", "hash")).alias("first"))
    firsts = sorted(tuple(r["first"]) for r in ranges.collect())
    if not firsts:
        firsts = [(0, 0)]
    placed = docs.select(number.alias("doc_id"), body.alias("text"), key.alias("key")).withColumn("part", part_of(F.col("key"), firsts) - 1)
    begins = F.array(*[F.struct(F.lit(a).cast("long").alias("down"), F.lit(b).cast("long").alias("hash")) for a, b in firsts])
    own = F.struct(F.col("part"), F.lit(False).alias("again"))
    sent = F.struct(F.pmod(F.col("part") - 1, F.lit(len(firsts))).alias("part"), F.lit(True).alias("again"))
    copies = F.when(F.get(begins, F.col("part")) == F.col("key"), F.array(own, sent)).otherwise(F.array(own))
    dealt = placed.select("doc_id", "text", "key", F.inline(copies))
    return dealt.repartitionById(len(firsts), F.col("part")).sortWithinPartitions("part", "again", "key").select("doc_id", "text", "part", "again")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, other: str) -> str:
    """``text`` with its second half, the shorter if they differ, replaced by as many first code points of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def edit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (row for b in batches for row in zip(b.column(0).to_pylist(), (t.as_py() for t in b.column(1)), b.column(2).to_pylist(), strict=True))
    last: list[tuple] = []
    for held in by_size(rows, lambda row: len(row[1])):
        held = last + held
        last = held[-1:]
        pairs = [i for i in range(len(held) - 1) if not held[i][2]]
        if not pairs:
            continue
        texts = [t for _, t, _ in held]
        changed = [edited(texts[i], texts[i + 1]) for i in pairs]
        own, new = prints(texts), prints(changed)
        mine = own[pairs]
        columns = [
            pa.array([held[i][0] for i in pairs], pa.int64()),
            pa.array([len(texts[i]) for i in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
            pa.array(digits(mine)),
            pa.array(digits(new)),
            pa.array(likeness(mine, new)),
            pa.array(likeness(mine, own[np.array(pairs) + 1])),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A document's edited text has its second half replaced by the beginning of the
    next document in descending order of whole-number ids, the first after the
    last; a single document follows itself.  Equal ids are in the order of their
    texts' hashes, null ids come last, repeated rows follow each other.  Null texts
    are empty; two empty texts are alike (1), an empty and another one not (0).
    Fingerprints are those of :func:`fingerprints`.  An empty table gives no rows.
    """
    ordered = in_descending_order(docs, doc_id, text)
    return ordered.select("doc_id", "text", "again").mapInArrow(edit_task, EDITED)
