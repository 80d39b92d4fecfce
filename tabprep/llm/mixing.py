"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import quoted, row_fields, row_struct
from .ranks import KEY_BITS, hash_key, meet, running
from .scratch import Scratch
from .sharding import stratum

#: The parts of a text that count as words.
WORD = r"[^\x20\x09-\x0D]+"
#: Words that a block of a source has on average at most, what a row counts besides its words there, and the most bits of a
#: block's number.
BLOCK_WORDS, ROW_WORDS, BLOCK_BITS = 4096, 16, 30
#: Branches of the tree that the driver splits; below each, a task splits the sources.
BRANCHES = 1024
#: The library sampler's limit on a population; from there on the same law is drawn in steps, the last FEW draws one by one.
POPULATION, FEW = 500_000_000, 32
STRATA = ["no_source", "source_name"]


def in_order(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """The sources with ``place``, their number in code-point order from 0, null last, without one task that sees all."""
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    dealt = scratch.keep(sources.repartitionByRange(*STRATA).sortWithinPartitions(*STRATA).withColumn("_at", F.monotonically_increasing_id()))
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).collect()  # a row for each partition
    first, total = {}, 0
    for row in sorted(sizes):
        first[row["_part"]], total = total, total + row["_n"]
    starts = F.create_map(*[F.lit(x) for item in first.items() for x in item]) if first else F.create_map(F.lit(0).cast("long"), F.lit(0))
    return dealt.withColumn("place", (F.element_at(starts, part) + within).cast("long")).drop("_at")


def with_targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Adds ``target``: ``share`` of all sizes by ``weight``; a target stops at ``most`` times its size and its excess is reshared.

    Each pass over the table closes the sources that the level reached so far
    fills, so the driver holds three sums, not the sources.
    """
    full = F.col("source_size") * F.lit(float(most))
    closed, level = -1, None
    while True:
        filled = F.lit(False) if level is None else full < F.col("weight") * F.lit(level)
        n, taken, weight, total = sources.agg(
            F.count_if(filled), F.coalesce(F.sum(F.when(filled, full)), F.lit(0.0)), F.coalesce(F.sum(F.when(~filled, F.col("weight"))), F.lit(0.0)), F.coalesce(F.sum("source_size"), F.lit(0))
        ).first()
        left = share * total - taken
        if n == closed or not weight:
            break
        closed, level = n, left / weight
    shared = F.col("weight") * F.lit(float(left)) / F.lit(float(weight or 1))
    return sources.withColumn("target", F.when(filled, full).otherwise(shared))


def drawn_from(rng: np.random.Generator, good: int, bad: int, number: int) -> int:
    """How many of ``number`` draws without replacement are good: the hypergeometric law at any size.

    A large population is first drawn from item by item at equal chances, which
    gives a uniform set of nearly the right size; what it lacks is drawn from the
    rest, what it has too much is drawn from it again.  Each step leaves about
    the square root of the draws before it.
    """
    if good + bad < POPULATION:
        return int(rng.hypergeometric(good, bad, number)) if number else 0
    if number <= FEW:
        met = 0
        for k in range(number):
            met += int(rng.integers(good + bad - k)) < good - met
        return met
    chance = number / (good + bad)
    x, y = int(rng.binomial(good, chance)), int(rng.binomial(bad, chance))
    if x + y > number:
        return x - drawn_from(rng, x, y, x + y - number)
    return x + drawn_from(rng, good - x, bad - y, number - x - y)


def split_quotas(blocks: list[int], of_shard: list[int], rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source for each shard (shards x sources), by halving the shards again and again.

    Each half draws its blocks without replacement from its parent's, source by
    source, so the quotas are exact: they add up to ``blocks`` for a source and
    to ``of_shard`` for a shard.
    """
    out = np.zeros((len(of_shard), len(blocks)), np.int64)

    def split(first: int, last: int, own: list[int]) -> None:
        if last - first == 1:
            out[first] = own
            return
        mid = (first + last) // 2
        left, open_, here = sum(of_shard[first:mid]), sum(own), []
        for n in own:
            here.append(drawn_from(rng, n, open_ - n, left))
            left, open_ = left - here[-1], open_ - n
        split(first, mid, here)
        split(mid, last, [n - m for n, m in zip(own, here, strict=True)])

    if blocks:
        split(0, len(of_shard), blocks)
    return out


def with_quotas(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """Adds ``cuts``, the running sums of a source's quotas over the shards, to rows with ``draws``, a source's number of blocks.

    The driver splits the totals of BRANCHES branches at most among the shards,
    and a task the part of a branch among its sources; a multivariate
    hypergeometric law splits that way.
    """
    dealt = sources.withColumn("branch", F.pmod(F.xxhash64(F.lit(seed), *STRATA), F.lit(BRANCHES)).cast("int"))
    branches = sorted(tuple(r) for r in dealt.groupBy("branch").agg(F.sum("draws")).collect())
    totals = [n for _, n in branches]
    of_shard = [sum(totals) // shards + (k < sum(totals) % shards) for k in range(shards)]
    parts = split_quotas(totals, of_shard, np.random.Generator(np.random.PCG64(seed)))
    of_branch = {b: parts[:, i].tolist() for i, (b, _) in enumerate(branches)}

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(STRATA)
        branch = int(rows["branch"].iloc[0])
        quotas = split_quotas(rows["draws"].tolist(), of_branch[branch], np.random.Generator(np.random.PCG64([seed, branch])))
        return rows[STRATA].assign(cuts=list(np.cumsum(quotas, axis=0).T))

    cuts = dealt.select(*STRATA, "draws", "branch").groupBy("branch").applyInPandas(split, "no_source boolean, source_name string, cuts array<long>")
    return sources.join(cuts, STRATA)


def permuted(block: str, seed: int, turn: int) -> str:
    """SQL of the place of ``block`` in a seeded permutation of 2 ** bits blocks, another one for each source and turn.

    Multiplying by an odd number, adding, and folding high bits onto low ones can
    each be undone, so the result is a permutation; rounds of them mix the bits.
    """
    mask, x = "(shiftleft(1L, bits) - 1)", block
    for k in range(3):
        key = f"xxhash64({seed}, {turn}, {k}, no_source, source_name)"
        x = f"(({x} * ((({key}) & {mask}) | 1) + (shiftrightunsigned({key}, 32) & {mask})) & {mask})"
        x = f"({x} ^ shiftrightunsigned({x}, bits div 2 + 1))"
    return x


def drawn() -> list[str]:
    """SQL of the shards that a row's block goes to at the first and the second draw, null where it is not drawn, from its source's columns."""
    found = []
    for turn in (0, 1):
        inside = f"place{turn} < upto{turn} OR (place{turn} = upto{turn} AND key < cut{turn})"
        number = f"place{turn}" + (" + draws0" if turn else "")
        found.append(f"CASE WHEN {inside} THEN size(filter(cuts, c -> c <= {number})) END AS shard{turn}")
    return found


def source_plan(slim: DataFrame, scratch: Scratch, weights: tuple[float, ...], share: float, most: float, shards: int, seed: int) -> DataFrame:
    """One row per source: its size and target, which of its permuted blocks are drawn, and the cuts between the shards' draws.

    A source's blocks are the stretches of its rows' seeded hash.  Each turn (the
    second for repeats) draws the source's blocks by a permutation of its own
    until their words reach what the turn needs: all blocks before ``upto``, and
    of block ``upto`` the rows below ``cut``.
    """
    sources = slim.groupBy(*STRATA).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    known = with_targets(in_order(sources, scratch).withColumn("weight", weight), share, most)
    # whole powers of two, so that a permutation of the blocks is one of bits
    bits = f"CAST(least({BLOCK_BITS}, greatest(0, ceil(log2((source_size + {ROW_WORDS}D * source_rows) / {BLOCK_WORDS})))) AS INT) AS bits"
    needs = ["least(target, source_size) AS need0", "greatest(0D, target - source_size) AS need1"]
    known = scratch.keep(known.selectExpr(*STRATA, "source_size", "target", bits, *needs))
    rows = meet(slim, known.select(*STRATA, "bits"), STRATA, ["key"]).selectExpr("*", f"shiftright(key, {KEY_BITS} - bits) AS block")
    blocks = scratch.keep(rows.groupBy(*STRATA, "bits", "block").agg(F.sum("size").alias("words")))
    for turn in (0, 1):
        at = blocks.selectExpr("*", f"{permuted('block', seed, turn)} AS place").selectExpr("*", f"shiftleft(place, {KEY_BITS} - bits) AS at")
        at = meet(running(at, STRATA, "at", ["block"], "words"), known.select(*STRATA, f"need{turn}"), STRATA, ["block"])
        # the block in which the need ends; none if all blocks or no words are needed
        edge = at.where(f"before < need{turn} AND before + words > need{turn}").select(*STRATA, "block", F.col("place").alias("upto"), (F.col(f"need{turn}") - F.col("before")).alias("open"))
        edge = scratch.keep(edge)
        inside = meet(rows, edge, [*STRATA, "block"], ["key"]).groupBy(*STRATA, "upto", "open", "key").agg(F.sum("size").alias("size"))
        upto = "sum(size) OVER (PARTITION BY no_source, source_name ORDER BY key)"
        inside = inside.selectExpr("*", f"{upto} - size / 2 >= open AS beyond")
        cuts = inside.groupBy(*STRATA).agg(F.first("upto").alias(f"upto{turn}"), F.coalesce(F.min(F.when(F.col("beyond"), F.col("key"))), F.lit(1 << KEY_BITS)).alias(f"cut{turn}"))
        known = known.join(cuts, STRATA, "left")
        # without such a block all are drawn, or none
        whole = f"coalesce(upto{turn}, CASE WHEN need{turn} > 0 THEN shiftleft(1L, bits) ELSE 0 END) AS upto{turn}"
        known = known.selectExpr(*[c for c in known.columns if c not in (f"upto{turn}", f"cut{turn}")], whole, f"coalesce(cut{turn}, 0) AS cut{turn}")
    known = known.selectExpr("*", "upto0 + CAST(cut0 > 0 AS INT) AS draws0", "upto0 + CAST(cut0 > 0 AS INT) + upto1 + CAST(cut1 > 0 AS INT) AS draws")
    return scratch.keep(with_quotas(scratch.keep(known), shards, seed).drop("need0", "need1", "draws"))


def row_key(seed: int, doc_id: Column, body: Column) -> Column:
    return hash_key(seed, doc_id, F.xxhash64(body))


def with_draws(rows: DataFrame, known: DataFrame, seed: int) -> DataFrame:
    """Adds the sources' columns, and ``shards``: those that the row goes to, with a place for each of its copies."""
    t = meet(rows, known, STRATA, ["key"]).selectExpr("*", f"shiftright(key, {KEY_BITS} - bits) AS block")
    t = t.selectExpr("*", *[f"{permuted('block', seed, turn)} AS place{turn}" for turn in (0, 1)]).selectExpr("*", *drawn())
    return t.withColumn("shards", F.array_compact(F.array("shard0", "shard1")))


def planned(docs: DataFrame, weights: tuple[float, ...], share: float, most: float, shards: int, seed: int, doc_id: str, text: str, source: str) -> tuple[DataFrame, DataFrame]:
    """A slim row for each of ``docs``, kept, and the plan of the sources."""
    scratch = Scratch(docs.sparkSession, "mix")
    body, ident = F.coalesce(F.col(quoted(text)), F.lit("")), F.col(quoted(doc_id)).cast("long")
    size = F.regexp_count(body, F.lit(WORD)).cast("long")
    slim = docs.select(ident.alias("doc_id"), size.alias("size"), row_key(seed, ident, body).alias("key"), *[c.alias(n) for n, c in stratum(source).items()])
    slim = scratch.keep(slim)
    return slim, source_plan(slim, scratch, weights, share, most, shards, seed)


def mix_plan(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    shards: int = 8,
    seed: int = 29,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies, shards (of each copy).

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    ``share`` of all sizes up to ``most`` (2 at most) times their own.  A source's
    rows lie in blocks by a seeded hash of id and text.  Whole blocks are drawn
    in a seeded permutation, and again in another one for repeats, until the
    target is reached; of the last block come the rows up to the target, a row if
    more than half of it lies below.  The tree splits the numbers of blocks of
    all sources among the output shards; a shard takes the next blocks of each
    source's permutation, as many as its quota.

    The driver holds a few sums and BRANCHES totals.  A null text has size 0; a
    null source is a source; very long texts count whole.  Rows with the same
    doc_id and text are drawn together.  A source of no words has target 0, and
    none of its rows is drawn.  An empty table gives no rows.  Ids must be whole
    numbers.  Equal inputs give equal results, however they are partitioned.
    """
    slim, known = planned(docs, weights, share, most, shards, seed, doc_id, text, source)
    out = with_draws(slim, known, seed).withColumn("copies", F.size("shards"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "shards")


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    shards: int = 8,
    seed: int = 29,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """The mixture's rows, each as often as :func:`mix_plan` draws it, with the columns of ``docs``, whatever their names.

    Rows of a shard lie together, in several partitions that follow each other if
    it is large, in the order of a seeded hash; small shards share a partition.
    A row's draws follow from its own values and its source's plan, so the texts
    are shuffled once, to their shards.
    """
    _, known = planned(docs, weights, share, most, shards, seed, doc_id, text, source)
    ident, body = F.col(quoted(doc_id)).cast("long"), F.coalesce(F.col(quoted(text)), F.lit(""))
    # a row is one value here, so its columns can't clash with its source's
    rows = docs.select(row_struct(docs).alias("row"), row_key(seed, ident, body).alias("key"), *[c.alias(n) for n, c in stratum(source).items()])
    each = with_draws(rows, known, seed).select("row", "key", F.posexplode("shards").alias("copy", "shard"))
    dealt = each.withColumn("order", F.xxhash64(F.lit(seed), "key", "copy", "shard")).repartitionByRange("shard", "order")
    return dealt.sortWithinPartitions("shard", "order").select(*row_fields(docs, "row"))
