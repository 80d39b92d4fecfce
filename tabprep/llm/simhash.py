"""SimHash near-dedup with a Gray-ordered hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import quoted
from .components import components
from .exact_dedup import keep_rows
from .ranks import attach
from .scratch import Scratch

#: Fingerprints link at so many differing bits at most; the index cuts a group's free bits into one block more.
MOST_BITS = 3
#: Entries under a node of the index; node pairs looked at together; fingerprints in one index at most.
FAN, BATCH, MOST_IN_GROUP = 8, 1 << 17, 1 << 18
#: Shingles whose bits are counted together.
SHINGLES = 1 << 16


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a UTF-8 text's word shingles, letters A-Z lower-cased, repeats included; no words: 0."""
    import xxhash

    parts = text.lower().split()
    if not parts:
        return 0
    digest, joined = xxhash.xxh64_intdigest, b" ".join(parts)
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(size)
    width = min(words, len(parts))
    first, last = (ends - size)[: len(parts) - width + 1].tolist(), (ends - 1)[width - 1 :].tolist()
    total = np.zeros(64, np.int64)
    for at in range(0, len(first), SHINGLES):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(first[at : at + SHINGLES], last[at : at + SHINGLES], strict=True)], "<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(first), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """Rows (doc_id, fp, text_sha256); fp is the fingerprint as a signed long.  A null text has no words."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), batch.column(2)], ["doc_id", "fp", "text_sha256"])

    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    given = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), body.cast("binary").alias("text"), F.sha2(body, 256).alias("text_sha256"))
    return given.mapInArrow(per_batch, "doc_id long, fp long, text_sha256 string")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The rank of each 64-bit number in the binary-reflected Gray sequence."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Several groups of fingerprints, each in Gray order, under nodes that hold what their entries share.

    A node stands for FAN neighbours of its group.  Its pattern holds the bits on
    which all fingerprints below agree, its mask says which bits these are; the
    differing bits of two nodes' patterns under both masks are differences that
    every pair below has, and they accumulate on the way down as masks widen.
    """

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        order = np.lexsort((gray_rank(fp), group))
        self.order, fp, group = order, fp[order], group[order]
        starts = np.r_[0, np.flatnonzero(group[1:] != group[:-1]) + 1]
        place = np.arange(len(fp)) - np.repeat(starts, np.diff(np.r_[starts, len(fp)]))
        everything = np.full(len(fp), ~np.uint64(0))
        self.bits, self.mask, self.first, self.last = [fp], [everything], [np.arange(len(fp))], [np.arange(1, len(fp) + 1)]
        self.child: list[np.ndarray] = []
        while True:
            place = place // FAN
            new = np.r_[True, (group[1:] != group[:-1]) | (place[1:] != place[:-1])]
            at = np.flatnonzero(new)
            bits, mask = self.bits[-1], self.mask[-1]
            low, high = np.bitwise_and.reduceat(bits, at), np.bitwise_or.reduceat(bits | ~mask, at)
            known = np.bitwise_and.reduceat(mask, at) & ~(low ^ high)
            self.bits.append(low & known)
            self.mask.append(known)
            self.child.append(np.r_[at, len(bits)])
            self.first.append(self.first[-1][at])
            self.last.append(self.last[-1][np.r_[at[1:] - 1, len(bits) - 1]])
            group, place = group[at], place[at]
            if not place.any():
                return

    def roots(self, most: int = MOST_BITS) -> np.ndarray:
        """For each entry (in Gray order) the first entry of its component among those linked at ``most`` bits."""
        parent = np.arange(len(self.bits[0]))

        def unite(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal parent
            while len(i):
                a, b = parent[i], parent[j]
                apart = a != b
                i, j, a, b = i[apart], j[apart], a[apart], b[apart]
                np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
                while (up := parent[parent]).tobytes() != parent.tobytes():
                    parent = up

        def settled(level: int) -> np.ndarray:
            """The component in which a node lies as a whole, or -1."""
            start = self.first[level]
            low, high = np.minimum.reduceat(parent, start), np.maximum.reduceat(parent, start)
            return np.where(low == high, low, -1)

        top = len(self.child)
        every = np.arange(len(self.bits[top]))
        todo = [(top, every[i : i + BATCH], every[i : i + BATCH]) for i in range(0, len(every), BATCH)]
        while todo:
            level, a, b = todo.pop()
            both = self.mask[level][a] & self.mask[level][b]
            differ = np.bitwise_count((self.bits[level][a] ^ self.bits[level][b]) & both).astype(np.int64)
            near = differ <= most
            sure = near & (differ + 64 - np.bitwise_count(both) <= most)
            if sure.any():
                # all pairs below link: chain the entries of both nodes
                for x in (a[sure], b[sure]):
                    n = self.last[level][x] - self.first[level][x]
                    i = np.repeat(self.first[level][x], n)
                    unite(i + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n), i)
                unite(self.first[level][a[sure]], self.first[level][b[sure]])
            rest = near & ~sure
            a, b = a[rest], b[rest]
            if not level or not len(a):
                continue
            whole = settled(level)
            open_ = (whole[a] < 0) | (whole[a] != whole[b])
            a, b = a[open_], b[open_]
            child = self.child[level - 1]
            na, nb = child[a + 1] - child[a], child[b + 1] - child[b]
            pairs = na * nb
            which = np.repeat(np.arange(len(a)), pairs)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            i, j = child[a][which] + nth // nb[which], child[b][which] + nth % nb[which]
            once = (i <= j) if level > 1 else (i < j)
            i, j = i[once], j[once]
            todo += [(level - 1, i[k : k + BATCH], j[k : k + BATCH]) for k in range(0, len(i), BATCH)]
        return parent


def block_masks(free: int, blocks: int = MOST_BITS + 1) -> list[int]:
    """The set bits of ``free`` in so many runs of nearly equal size."""
    places = [k for k in range(63, -1, -1) if free >> k & 1]
    cuts = [len(places) * k // blocks for k in range(blocks + 1)]
    return [sum(1 << k for k in places[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(distinct: DataFrame, scratch: Scratch, most_in_group: int = MOST_IN_GROUP) -> DataFrame:
    """Edges (a, b) between fingerprints (column fp, each once) that connect all pairs of MOST_BITS differing bits or fewer.

    Two such fingerprints agree on one of MOST_BITS + 1 blocks of bits, so each
    is dealt once by each block's value.  A group that is still too large for one
    index is dealt again by blocks of its other bits.  Within a group the index
    finds the components, and a node's edge to its component's first is all that
    leaves the task.
    """

    def per_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def links() -> pa.RecordBatch:
            mask, value, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            new = np.r_[True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])]
            index = GrayIndex(np.cumsum(new), fp.view(np.uint64))
            sorted_fp, root = fp[index.order], index.roots()
            linked = root != np.arange(len(root))
            return pa.RecordBatch.from_arrays([pa.array(sorted_fp[linked]), pa.array(sorted_fp[root[linked]])], ["a", "b"])

        # the rows come sorted by group; whole groups are indexed together, about most_in_group rows at a time
        rows = 0
        for batch in batches:
            mask, value, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(fp):
                continue
            if rows >= most_in_group:
                starts = np.flatnonzero(np.r_[(mask[0], value[0]) != (held[-1][0][-1], held[-1][1][-1]), (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])])
                if len(starts):
                    cut = starts[0]
                    held.append((mask[:cut], value[:cut], fp[:cut]))
                    yield links()
                    held, rows, mask, value, fp = [], 0, mask[cut:], value[cut:], fp[cut:]
            held.append((mask, value, fp))
            rows += len(fp)
        if held:
            yield links()

    def dealt(rows: DataFrame, masks: list[int]) -> DataFrame:
        each = rows.withColumn("mask", F.explode(F.array(*[F.lit(signed(m)) for m in masks])))
        return each.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")

    everything = (1 << 64) - 1
    done, todo = [], [(0, dealt(distinct, block_masks(everything)))]
    while todo:
        _, keyed = todo.pop()
        large = scratch.keep(keyed.groupBy("mask", "value").count().where(F.col("count") > most_in_group).select("mask", "value"))
        masks = [r["mask"] for r in large.select("mask").distinct().collect()]
        if not masks:
            done.append(keyed)
            continue
        done.append(keyed.join(large, ["mask", "value"], "left_anti"))
        for mask in masks:
            own = keyed.join(large.where(F.col("mask") == mask), ["mask", "value"], "left_semi").select("fp")
            fixed = mask & everything
            deeper = [fixed | m for m in block_masks(everything & ~fixed) if m]
            todo.append((0, dealt(own, deeper)))
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    grouped = rows.repartition("mask", "value").sortWithinPartitions("mask", "value")
    return grouped.mapInArrow(per_partition, "a long, b long")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_in_group: int = MOST_IN_GROUP) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id, text_sha256.

    component_id is the smallest doc_id that links of MOST_BITS differing bits or
    fewer reach.  Null texts and texts without words have fingerprint zero, linked
    like any other.  Null ids are passed over in the minimum; repeated rows are
    linked to each other.  An empty table gives no rows.  Ids must be whole numbers;
    a text's shingles are counted SHINGLES at a time, however long it is.  Bits set
    in just half of the hashes are 0.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs, doc_id, text))
    distinct = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    roots = components(near_links(distinct.select("fp"), scratch, most_in_group), scratch)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = scratch.keep(rooted)
    whole = scratch.keep(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")))
    named = scratch.keep(attach(rooted, whole, "root", "members", F.col("fp")).select("fp", "copies", "component_id"))
    found = attach(prints, named, "fp", "copies", F.xxhash64("doc_id", "text_sha256"))
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id", "text_sha256")


def hex_digits(fp: Column) -> Column:
    """A signed long's 64 bits as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of each component of :func:`near_groups`, each once; all columns stay."""
    found = near_groups(docs, doc_id, text)
    return keep_rows(docs, found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), doc_id, text)
