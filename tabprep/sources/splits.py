"""Delimited text read by many tasks: a file is cut by bytes, and records whose quotes cross a cut are put together."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .staging import shared_folder

#: Letters of a quoted cell's part in one split at most, where the split begins inside it; rows that a task gives back together.
LONGEST, ROWS = 1 << 24, 4096
#: A limit that no block reaches.
WHOLE = 1 << 62
#: Blocks of a table that are broadcast.
BROADCAST_BLOCKS = 500_000

#: What tasks give back.  Kind ``record``: a whole record; ``bad``: one with too many fields; ``head``: the end of a record that
#: began in an earlier block; ``tail``: a record's part up to the block's end; ``edge``: one row a block.  ``tag`` says for which
#: beginning of the block it holds: ``o`` outside quotes, ``i`` inside, ``b`` both.
PIECES = pa.schema(
    [("file", pa.int64()), ("start", pa.int64()), ("path", pa.string()), ("kind", pa.string()), ("tag", pa.string()), ("seq", pa.int64())]
    + [("separators", pa.int64()), ("record", pa.string())]
    + [("length", pa.int64()), ("ends_outside", pa.bool_()), ("ends_inside", pa.bool_()), ("cut_short", pa.bool_())]
)


def scanned(line: str, inside: bool, sep: str) -> tuple[int, bool]:
    """How many separators outside quotes a line has, and whether it ends inside quotes.

    A quote opens a cell only as its first letter; two of them inside stand for
    one.  A single one ends the quotes, whatever follows it up to the separator.
    """
    if '"' not in line:
        return (0, True) if inside else (line.count(sep), False)
    at, found = 0, 0
    while True:
        if inside:
            while (at := line.find('"', at)) >= 0 and line.startswith('"', at + 1):
                at += 2
            if at < 0:
                return found, True
            inside = False
            at += 1
        elif line.startswith('"', at):
            inside = True
            at += 1
            continue
        at = line.find(sep, at)
        if at < 0:
            return found, False
        found += 1
        at += len(sep)


class Track:
    """The records of a block under one assumption of how it begins."""

    def __init__(self, inside: bool, longest: int):
        self.inside, self.head, self.lost, self.longest = inside, inside, False, longest
        self.parts: list[str] = []
        self.size = self.separators = self.seq = 0

    def take(self, line: str, sep: str) -> tuple[str, int] | None:
        """The record that the line ends and its separators, if it ends one."""
        if not self.parts and not self.head and not line:
            return None
        more, self.inside = scanned(line, self.inside, sep)
        self.separators += more
        if not self.lost:
            self.parts.append(line)
        if self.head:
            # only the assumption that the block begins inside quotes makes such heads, and it is wrong for nearly all
            self.size += len(line) + 1
            if self.size > self.longest:
                self.parts, self.lost = [], True
        if self.inside:
            return None
        out = ("\n".join(self.parts), self.separators)
        self.parts, self.separators = [], 0
        return out


class Block:
    """Cuts a block's lines under both assumptions until they agree."""

    def __init__(self, file: int, start: int, length: int, path: str | None, sep: str, fields: int, limit: int | None, count_bad: bool, longest: int):
        self.at = {"file": file, "start": start, "path": path}
        self.length, self.sep, self.fields, self.limit, self.count_bad = length, sep, fields, limit, count_bad
        self.outside, self.inside = Track(False, longest), Track(True, longest) if start else None
        self.good, self.cut_short, self.agreed = 0, False, start == 0

    def rows(self, track: Track, tag: str, found: tuple[str, int] | None) -> Iterator[dict]:
        if found is None:
            return
        record, separators = found
        if track.head:
            yield self.at | {"kind": "head", "tag": tag, "seq": -1, "separators": separators, "record": None if track.lost else record}
            track.head = track.lost = False
            return
        bad = separators >= self.fields
        self.good += tag != "i" and (self.count_bad or not bad)
        yield self.at | {"kind": "bad" if bad else "record", "tag": tag, "seq": track.seq, "separators": separators, "record": record}
        track.seq += 1

    def line(self, line: str) -> Iterator[dict]:
        line = line.removesuffix("\r")
        tag = "b" if self.agreed else "o"
        found = self.outside.take(line, self.sep)
        yield from self.rows(self.outside, tag, found)
        if not self.agreed:
            yield from self.rows(self.inside, "i", self.inside.take(line, self.sep))
            # from here on both have the same records, which are numbered from the larger number, so numbers keep their order
            if not self.outside.inside and not self.inside.inside:
                self.agreed = True
                self.outside.seq = max(self.outside.seq, self.inside.seq)
        # the header is one of the first block's records
        if self.limit is not None and self.good > self.limit:
            self.cut_short = True

    def end(self) -> Iterator[dict]:
        tracks = [(self.outside, "b" if self.agreed else "o")] + ([] if self.agreed else [(self.inside, "i")])
        for track, tag in tracks:
            if track.inside and not self.cut_short:
                text = None if track.lost else "\n".join(track.parts)
                yield self.at | {"kind": "head" if track.head else "tail", "tag": tag, "seq": -1 if track.head else track.seq, "separators": track.separators, "record": text}
        ends = self.outside.inside if self.agreed else self.inside.inside
        yield self.at | {"kind": "edge", "tag": "b", "seq": -1, "length": self.length, "ends_outside": self.outside.inside, "ends_inside": ends, "cut_short": self.cut_short}


def cutter(sep: str, fields: int, limit: int | None, count_bad: bool, one_file: bool, longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task's side: its blocks' lines, in order, to rows of PIECES."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        block = None
        for batch in batches:
            if not batch.num_rows:
                continue
            *keys, sizes, paths = (batch.column(k).to_pylist() for k in range(1, 6))
            for line, *key, size, path in zip(batch.column(0).to_pylist(), *keys, sizes, paths, strict=True):
                if block is None or (block.at["file"], block.at["start"]) != (key[0], key[1]):
                    if block:
                        yield from block.end()
                    block = Block(*key, path, sep, fields, limit, count_bad, longest)
                    if not key[1]:
                        line = line.removeprefix("﻿")
                if not block.cut_short:
                    yield from block.line(line)
                elif one_file or key[1] + key[2] < size:
                    # a split that isn't its file's last fills a task, and so does each one of a single file
                    yield from block.end()
                    return
        if block:
            yield from block.end()

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for piece in pieces(batches):
            held.append(piece)
            if len(held) == ROWS:
                yield pa.RecordBatch.from_pylist(held, PIECES)
                held = []
        yield pa.RecordBatch.from_pylist(held, PIECES)

    return per_task


def with_beginnings(edges: DataFrame) -> DataFrame:
    """``edges`` with ``inside``, whether a block begins inside quotes, and ``from_inside``, whether it ends so.

    A block keeps the state, turns it over or sets it.  So the state behind a block
    is what the last block set that sets it, turned over as often as blocks since
    then do; a file begins outside quotes.
    """
    order = Window.partitionBy("file").orderBy("start")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    ends = [F.col(c).cast("int") for c in ("ends_outside", "ends_inside")]
    turns = edges.withColumn("turns", F.sum(((ends[0] == 1) & (ends[1] == 0)).cast("int")).over(upto) % 2)
    sets = F.when(ends[0] == ends[1], (ends[0] + F.col("turns")) % 2)
    known = turns.withColumn("set", F.coalesce(F.last(sets, ignorenulls=True).over(upto), F.lit(0)))
    known = known.withColumn("from_inside", (F.col("set") + F.col("turns")) % 2 == 1)
    return known.withColumn("inside", F.lag("from_inside", 1, False).over(order)).drop("turns", "set")


def parts_in_place(pieces: DataFrame, blocks: DataFrame) -> DataFrame:
    """``pieces`` that hold as their blocks really begin, of ``blocks`` (file, start, inside)."""
    inside = blocks.where("inside").select("file", "start")
    n = inside.count()
    if not n:
        return pieces.where("tag <> 'i'")
    inside = F.broadcast(inside) if n <= BROADCAST_BLOCKS else inside
    return pieces.where("tag <> 'i'").join(inside, ["file", "start"], "left_anti").unionByName(
        pieces.where("tag <> 'o'").join(inside, ["file", "start"], "left_semi")
    )


def crossing_records(pieces: DataFrame, blocks: DataFrame, fields: int) -> DataFrame:
    """The records that cross cuts, at the place where they begin, from the heads and tails that hold."""
    parts = parts_in_place(pieces.where("kind IN ('head', 'tail')"), blocks).select("file", "path", "start", "kind", "seq", "separators", "record")
    order = Window.partitionBy("file").orderBy("start", "seq")
    # a block has a head first and a tail last
    grouped = parts.withColumn("nth", F.sum((F.col("kind") == "tail").cast("int")).over(order))
    whole = grouped.groupBy("file", "nth").agg(
        F.min("path").alias("path"),
        F.min("start").alias("start"),
        F.max("seq").alias("seq"),
        F.sum("separators").alias("separators"),
        F.sort_array(F.collect_list(F.struct("start", "seq", "record"))).alias("parts"),
    )
    lost = F.exists("parts", lambda p: p["record"].isNull())
    told = F.when(lost, F.raise_error(F.lit(f"a quoted cell has more than {LONGEST} letters in one split"))).otherwise(F.array_join(F.transform("parts", lambda p: p["record"]), "\n"))
    kind = F.when(F.col("separators") >= fields, "bad").otherwise("record")
    return whole.select("file", "path", "start", kind.alias("kind"), F.lit("b").alias("tag"), "seq", "separators", told.alias("record"))


class Staged:
    """Delimited text cut into records and written once as Parquet, cells apart."""

    def __init__(self, spark: SparkSession, files: str | list[str], names: list[str], sep: str, folder: str | None, limit: int | None, count_bad: bool, with_path: bool = False):
        self.names, self.count_bad = names, count_bad
        self.path = f"{shared_folder(spark, folder)}/records-{uuid.uuid4().hex}"
        meta = F.col("_metadata")
        path = meta["file_path"] if with_path or limit is not None else F.lit(None).cast("string")
        at = [F.xxhash64(meta["file_path"]).alias("file"), meta["file_block_start"].alias("start"), meta["file_block_length"].alias("length"), meta["file_size"].alias("size")]
        lines = spark.read.text(files, lineSep="\n").select("value", *at, path.alias("path"))
        cut = lines.mapInArrow(cutter(sep, len(names), limit, count_bad, not isinstance(files, str) and len(files) == 1, LONGEST), from_arrow_schema(PIECES))
        # cells stand beside one another, so a later read takes the columns that it needs
        whole = F.col("kind") == "record"
        cells = self.cells(F.when(whole, F.col("record")), sep).alias("cells")
        self.pieces = self.written(cut.select(*[F.when(~whole, F.col(c)).alias(c) if c == "record" else c for c in cut.columns], cells), "pieces")
        edges = self.pieces.where("kind = 'edge'").select("file", "path", "start", "length", "ends_outside", "ends_inside", "cut_short")
        self.blocks = self.written(with_beginnings(edges), "blocks")
        crossing = crossing_records(self.pieces, self.blocks, len(names))
        self.crossing = self.written(crossing.select(*crossing.columns, self.cells(F.col("record"), sep).alias("cells")), "crossing")

    def written(self, table: DataFrame, name: str) -> DataFrame:
        table.write.parquet(f"{self.path}/{name}")
        return table.sparkSession.read.schema(table.schema).parquet(f"{self.path}/{name}")

    def cells(self, record: Column, sep: str) -> Column:
        kind = ", ".join(f"f{i} string" for i in range(len(self.names)))
        options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
        return F.from_csv(record, F.lit(kind), options)

    def records(self) -> DataFrame:
        """All records but the headers: the first one of each file."""
        columns = ["file", "path", "start", "kind", "seq", "record", "cells"]
        whole = parts_in_place(self.pieces.where("kind IN ('record', 'bad')"), self.blocks).select(*columns)
        every = whole.unionByName(self.crossing.select(*columns))
        firsts = every.groupBy("file").agg(F.min(F.struct("start", "seq")).alias("first")).select("file", "first.*")
        # nearly every header is the first record of its file's first block
        late = firsts.where("start > 0 OR seq > 0")
        kept = every.where("NOT (start = 0 AND seq = 0)")
        return kept if late.isEmpty() else kept.join(late, ["file", "start", "seq"], "left_anti")

    def first(self, n: int) -> DataFrame | None:
        """The first n records in the order of files and places; None if blocks that were cut short don't suffice."""
        every = self.records() if self.count_bad else self.records().where("kind = 'record'")
        counts = every.groupBy("path", "file", "start").agg(F.count(F.lit(1)).alias("n"))
        known = self.blocks.select("path", "file", "start", "cut_short", "length").join(counts.drop("path"), ["file", "start"], "left").fillna(0, ["n"])
        # one row a split: the running sum needs no more than one task
        order = Window.orderBy("path", "start")
        upto = known.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        upto = upto.withColumn("gap", F.col("start") != F.coalesce(F.lag(F.col("start") + F.col("length")).over(Window.partitionBy("file").orderBy("start")), F.lit(0)))
        needed = upto.where(F.col("before") < n)
        state = needed.agg(F.bool_or(F.col("gap") | (F.col("cut_short") & (F.col("before") + F.col("n") < n))), F.max(F.struct("before", "path", "file", "start", "n"))).first()
        if state[0]:
            return None
        if state[1] is None:
            return every.limit(0)
        last = state[1]
        at_end = (F.col("file") == last["file"]) & (F.col("start") == last["start"])
        ranked = every.where(at_end).withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy("seq")))
        before = every.where(~at_end).join(F.broadcast(needed.select("file", "start")) if needed.count() <= BROADCAST_BLOCKS else needed.select("file", "start"), ["file", "start"], "left_semi")
        return before.unionByName(ranked.where(F.col("rank") <= n - last["before"]).drop("rank").select(*before.columns))


def records(spark: SparkSession, path: str, names: list[str], sep: str, limit: int | None, bad_lines: str, folder: str | None, with_path: bool = False) -> DataFrame:
    """Rows (cells, kind, record, and path if asked for or limited) of the records below ``path``, the first ``limit`` of them in the order of file names and
    places in the files.  With ``bad_lines="skip"`` records with too many fields are left out and don't count."""
    count_bad = bad_lines == "error"
    if limit is None:
        found = Staged(spark, path, names, sep, folder, None, count_bad, with_path).records()
        return found if count_bad else found.where("kind = 'record'")
    files, look_at = sorted(unquote(f) for f in spark.read.text(path).inputFiles()), 1
    while True:
        found = Staged(spark, files[:look_at], names, sep, folder, limit, count_bad).first(limit)
        if found is None:
            # a block that was cut short begins inside quotes, or a task stopped before its last block
            found = Staged(spark, files[:look_at], names, sep, folder, WHOLE, count_bad).first(limit)
        if look_at >= len(files) or found.count() >= limit:
            return found
        look_at *= 8
