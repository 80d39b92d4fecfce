"""Removal of repeated passages by level-wise doubling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import quoted
from .scratch import Scratch

#: Words of a window, and of a run at the first level at most.
WINDOW, FIRST = 35, 18
#: Runs that a task combines before they are shuffled.
BLOCK = 1 << 20
#: Odd multipliers of the rolling hashes and of the mixing step.
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def levels(window: int, first: int = FIRST) -> list[int]:
    """Run lengths of the levels: each is twice the one before, or one less, and the last is ``window``."""
    out = [window]
    while out[0] > first:
        out.insert(0, -(-out[0] // 2))
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    for factor in MIX:
        x = x * factor
        x = x ^ (x >> np.uint64(29))
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words, built by doubling shorter runs."""
    with np.errstate(over="ignore"):
        total, done, power, run, size = None, 0, np.uint64(1), words, 1
        step = STEP
        while True:
            if length & size:
                # the next `size` words stand behind the `done` words so far
                n = len(words) - (done + size) + 1
                total = run[:n] if total is None else total[:n] + power * run[done : done + n]
                done, power = done + size, power * step
            if done == length:
                return mixed(total)
            run = run[: len(run) - size] + step * run[size:]
            size, step = 2 * size, step * step


def least_in_reach(hashes: np.ndarray, reach: int) -> np.ndarray:
    """For each i the place of the least of ``hashes[i : i + reach]``, the first of equals."""
    n = len(hashes) - reach + 1
    best, width = np.arange(len(hashes)), 1
    while width < reach:
        ahead = min(width, reach - width)
        a, b = best[: len(best) - ahead], best[ahead:]
        best = np.where(hashes[b] < hashes[a], b, a)
        width += ahead
    return best[:n]


def chosen(words: np.ndarray, window: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``length`` words, and for each window the place of the run that stands for it.

    That is the run of least hash inside the window, so equal windows choose runs
    of equal words, and neighbouring windows mostly the same run.
    """
    hashes = window_hashes(words, length)
    return hashes, least_in_reach(hashes, window - length + 1)


def covered(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which words lie in a window that starts at one of ``starts``."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def candidate_runs(words: np.ndarray, window: int, length: int, before: int | None, places: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``length`` words, and the places of those that stand for a window still in question.

    ``places`` are the runs of ``before`` words found repeated; None: all windows are in question.
    """
    hashes, choice = chosen(words, window, length)
    if places is not None:
        _, earlier = chosen(words, window, before)
        choice = choice[np.isin(earlier, places)]
    return hashes, np.unique(choice)


def combined(hashes: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with two hashes each: the first row of each pair of values, whether there are more, and the other rows."""
    order = np.lexsort((others, hashes))
    same = (hashes[order][1:] == hashes[order][:-1]) & (others[order][1:] == others[order][:-1])
    new = np.r_[True, ~same]
    return order[new], np.r_[same, False][new], order[~new]


def repeated(rows: DataFrame) -> DataFrame:
    """Rows (k1, k2, places): of each text the places of runs that occur again, from the rows of :func:`candidates`.

    Rows meet by hash.  As each block of a task has sent a hash once at most, a
    hash has no more rows than there are blocks, however often it occurs.
    """
    met = rows.repartition("hash").withColumn("total", F.sum("n").over(Window.partitionBy("hash", "other")))
    found = met.where(F.col("places").isNotNull() | (F.col("total") > 1))
    return found.groupBy("k1", "k2").agg(F.flatten(F.collect_list(F.coalesce("places", F.array("place")))).alias("places"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, first: int = FIRST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by spaces).

    A window is ``window`` words of one document that follow each other.  Each
    level looks at one length, about twice the one before.  A window is
    represented by the run of that length inside it whose hash is least; runs that
    occur once end their windows' candidacy, the others are extended to twice the
    length, until at last whole windows are compared.  So from level to level only
    what was repeated at half the length moves, as hashes and places.  The last
    level and the removal read one and the same shuffle of the texts.

    Null texts have no words.  Repeated rows are texts like any other, so each
    makes the other's windows repeated.  Texts shorter than a window stay whole.
    Two hashes of a window, of 64 and 32 bits, must agree for it to count as repeated;
    both come from one 64-bit hash a word.  Ids must be whole numbers.  An empty
    table gives no rows; a text of any length is read whole, in memory.
    """
    body = F.coalesce(F.col(quoted(text)), F.lit("")).cast("binary")
    keys = {"k1": F.coalesce(F.col(quoted(doc_id)).cast("long"), F.lit(-1)), "k2": F.xxhash64(F.coalesce(F.col(quoted(text)), F.lit("")))}
    given = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), body.alias("text"), *[c.alias(n) for n, c in keys.items()])
    texts = given.repartition("k1", "k2")
    scratch, lengths = Scratch(docs.sparkSession, "repeats"), levels(window, first)
    found: DataFrame | None = None
    before: int | None = None
    for length in lengths[:-1]:
        found = scratch.keep(repeated(candidates(given if found is None else texts, found, window, before, length)))
        before = length
    found = repeated(candidates(given if found is None else texts, found, window, before, window))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for key, text, places in zip(*(batch.column(k) for k in ("doc_id", "text", "places")), strict=True):
                key, words = key.as_py(), text.as_py().split()
                gone = covered(len(words), np.unique(places.values.to_numpy()), window) if places.is_valid else None
                kept = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                joined = b" ".join(kept)
                row = (key, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined)
                for col, value in zip(out, row, strict=True):
                    col.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    joined = texts.join(found.hint("shuffle_hash"), ["k1", "k2"], "left").select("doc_id", "text", "places")
    out = joined.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")
    return out.withColumn("kept", F.col("kept").cast("string"))


def candidates(texts: DataFrame, found: DataFrame | None, window: int, before: int | None, length: int) -> DataFrame:
    """Rows (k1, k2, place, places, hash, other, n): the runs of ``length`` words that stand for a window still in question.

    Runs are combined in blocks of about BLOCK: of equal ones in a block, the
    first has n = 2 and the places of the others, known to be repeated, come in
    rows of n = 0, one for each text.
    """

    def block(held: list[tuple]) -> pa.RecordBatch:
        size = [len(x[2]) for x in held]
        k1, k2 = (np.repeat(np.array([x[k] for x in held], np.int64), size) for k in (0, 1))
        place, hashes, others = (np.concatenate([x[k] for x in held]) for k in (2, 3, 4))
        first, more, rest = combined(hashes, others)
        first, more = first[np.argsort(first)], more[np.argsort(first)]
        rest = np.sort(rest)
        cut = np.flatnonzero(np.r_[True, (k1[rest][1:] != k1[rest][:-1]) | (k2[rest][1:] != k2[rest][:-1])]) if len(rest) else rest
        head = rest[cut]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[np.zeros(len(first), np.int32), cut, len(rest)].astype(np.int32)), pa.array(place[rest]), mask=pa.array(np.arange(len(first) + len(head)) < len(first)))
        columns = {
            "k1": np.r_[k1[first], k1[head]],
            "k2": np.r_[k2[first], k2[head]],
            "place": np.r_[place[first], place[head]],
            "places": lists,
            "hash": np.r_[hashes[first], mixed(hashes[head] ^ k2[head].view(np.uint64))].view(np.int64),
            "other": np.r_[others[first], others[head]].view(np.int32),
            "n": np.r_[1 + more.astype(np.int32), np.zeros(len(head), np.int32)].astype(np.int32),
        }
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            k1, k2, bodies = batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text")
            known = batch.column("places") if before else [None] * len(bodies)
            for a, b, text, places in zip(k1, k2, bodies, known, strict=True):
                words = text.as_py().split()
                if len(words) < window:
                    continue
                single = word_hashes(words)
                hashes, at = candidate_runs(single, window, length, before, None if before is None else places.values.to_numpy())
                other = (window_hashes(mixed(single ^ STEP), length)[at] >> np.uint64(32)).astype(np.uint32)
                held.append((a, b, at.astype(np.int32), hashes[at], other))
                rows += len(at)
                if rows >= BLOCK:
                    yield block(held)
                    held, rows = [], 0
        if held:
            yield block(held)

    # all columns of texts stay, so that the last level and the removal read one and the same shuffle
    given = texts if found is None else texts.join(found.hint("shuffle_hash"), ["k1", "k2"])
    return given.mapInArrow(runs, "k1 long, k2 long, place int, places array<int>, hash long, other int, n int")
