"""The prefix trie of conversations, from their globally sorted turn arrays."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .columns import quoted
from .ranks import meet
from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Fixed values of the rebuilt conversations: which one lends its head, and how many turns at most, exclusive.
EVERY, HEADS = 20, 4
#: Rows that a task gives back together.
ROWS = 4096

RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turn_arrays(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, turns): each conversation's turns in order, as structs of a name and the number of words.

    The name is half a SHA-256 of role and text, so texts aren't shuffled.  Turns
    of one number come in the order of their names, null numbers first; rows
    without conv_id are left out.
    """
    role, text = (F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) for c in (role, text))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    name = F.unhex(F.substring(F.sha2(whole, 256), 1, 32))
    one = F.struct(F.col(quoted(turn)).alias("turn"), name.alias("name"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    given = conversations.where(F.col(quoted(conv_id)).isNotNull()).select(F.col(quoted(conv_id)).cast("long").alias("conv_id"), one.alias("one"))
    ordered = given.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["name"].alias("name"), t["words"].alias("words"))).alias("turns"))


def with_lent_heads(arrays: DataFrame, every: int = EVERY, heads: int = HEADS) -> DataFrame:
    """``arrays`` with each conversation's first h turns replaced by those of the conversation whose id is the multiple of
    ``every`` at or below its own (all if it has fewer, none if there is none); h is its id's CRC-32 modulo ``heads``."""
    base, h = F.col("conv_id") - F.pmod("conv_id", F.lit(every)), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    lent = arrays.where(F.pmod("conv_id", F.lit(every)) == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    met = arrays.withColumn("base", base).join(lent, "base", "left").withColumn("h", h)
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return met.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


class Ids:
    """The SHA-256 of ids joined by commas, given bit by bit."""

    def __init__(self) -> None:
        self.sha, self.join = hashlib.sha256(), b""

    def extend(self, ids: Iterable[int]) -> None:
        if more := ",".join(map(str, ids)).encode():
            self.sha.update(self.join + more)
            self.join = b","

    def digest(self) -> str:
        return self.sha.hexdigest()


class Node:
    """An open node: its last turn, and what is known of its members and closed children."""

    __slots__ = ("name", "words", "key", "shared", "n_convs", "least", "n_children", "n_leaves", "saved", "ends", "rows", "done")

    def __init__(self, name: bytes, words: int, key: str = "", shared: bool = False):
        self.name, self.words, self.key, self.shared = name, words, key, shared
        self.n_convs = self.n_children = self.n_leaves = self.saved = 0
        self.least: int | None = None
        self.ends: array[int] | Ids = array("q")
        self.rows: list[dict] = []
        self.done = False

    def add(self, n_convs: int, least: int | None, n_children: int, n_leaves: int, saved: int) -> None:
        self.n_convs += n_convs
        if least is not None:
            self.least = least if self.least is None else min(self.least, least)
        self.n_children += n_children
        self.n_leaves += n_leaves
        self.saved += saved

    def close(self, depth: int, above: Node | None) -> dict:
        """The finished node's figures, counted in the node above as well."""
        leaves, saved = self.n_leaves or 1, self.saved + (self.n_convs - 1) * self.words
        if above:
            above.add(self.n_convs, self.least, 1, leaves, saved)
        return {"depth": depth, "conv_id": self.least, "n_convs": self.n_convs, "n_children": self.n_children, "n_leaves": leaves, "saved_tokens": saved}


def key_below(key: str, name: bytes) -> str:
    """The key of the node that ``name`` leads to from the node of ``key``."""
    return hashlib.sha256(key.encode() + name).hexdigest()[:32]


ROOT = key_below("", b"")


def shared_length(a: list[bytes], b: list[bytes]) -> int:
    n = min(len(a), len(b))
    return n if a[:n] == b[:n] else next(i for i in range(n) if a[i] != b[i])


def swept(rows: Iterable[tuple[list[bytes], list[int], int]], task: int) -> Iterator[dict]:
    """The nodes of a task's conversations, sorted by (names, conv_id), from the common prefixes of neighbours and a stack.

    Nodes on the way to the first or to the last conversation may go on in other
    tasks; they come as kind ``spine``, to be stitched: those of the first way
    (side 0), ``done`` if they have ended here, and those still open at the end
    (side 1).  All others are whole: ``known`` with their parent's id, or ``open``
    with the key of the spine node above.
    """
    stack: list[Node] = []
    before: list[bytes] = []

    def spine(node: Node, depth: int, done: bool) -> dict:
        side = 0 if node.shared else 1
        figures = {"n_convs": node.n_convs, "conv_id": node.least, "n_children": node.n_children, "n_leaves": node.n_leaves, "saved_tokens": node.saved}
        return {"kind": "spine", "task": task, "side": side, "depth": depth, "name": node.name, "words": node.words, "done": done, "ids": node.ends.tolist(), **figures}

    def closed() -> Iterator[dict]:
        """Takes the top node off the stack."""
        node, depth = stack.pop(), len(stack)
        if node.shared:
            yield spine(node, depth, True)
            return
        above = stack[-1]
        ends = Ids()
        ends.extend(node.ends)
        row = node.close(depth, above) | {"ends_sha256": ends.digest()}
        for child in node.rows:
            yield child | {"kind": "known", "parent_conv_id": node.least}
        if above.shared:
            yield row | {"kind": "open", "parent": above.key}
        else:
            above.rows.append(row)

    for names, words, conv_id in rows:
        if stack:
            shared = shared_length(before, names)
            while len(stack) - 1 > shared:
                yield from closed()
            stack += [Node(n, w) for n, w in zip(names[shared:], words[shared:], strict=True)]
        else:
            stack.append(Node(b"", 0, ROOT, True))
            for n, w in zip(names, words, strict=True):
                stack.append(Node(n, w, key_below(stack[-1].key, n), True))
        stack[-1].ends.append(conv_id)
        stack[-1].add(1, conv_id, 0, 0, 0)
        before = names
    for depth, node in enumerate(stack):
        if not node.shared:
            node.key = key_below(stack[depth - 1].key, node.name)
        yield spine(node, depth, False)
        for child in node.rows:
            yield child | {"kind": "open", "parent": node.key}


def stitched(records: Iterable[dict]) -> Iterator[dict]:
    """The nodes that tasks share, from their spine records in the order of (task, side, depth).

    The stack left open by the tasks before meets the way to a task's first
    conversation: nodes on both are merged, those left behind are closed.
    """
    stack: list[Node] = []
    task, on_the_way, side = None, True, 0

    def closed() -> dict:
        node, depth = stack.pop(), len(stack)
        row = node.close(depth, stack[-1] if stack else None)
        return row | {"key": node.key, "parent": stack[-1].key if stack else "", "ends_sha256": node.ends.digest()}

    def settle() -> Iterator[dict]:
        while stack and stack[-1].done:
            yield closed()

    for r in records:
        depth = r["depth"]
        if r["task"] != task or r["side"] != side:
            yield from settle()
            task, side, on_the_way = r["task"], r["side"], True
        if side or not (on_the_way and depth < len(stack) and stack[depth].name == r["name"]):
            on_the_way = False
            while len(stack) > depth:
                yield closed()
            stack.append(Node(r["name"], r["words"], key_below(stack[-1].key if stack else "", r["name"])))
            stack[-1].ends = Ids()
        node = stack[depth]
        node.done = r["done"]
        node.ends.extend(r["ids"])
        node.add(r["n_convs"], r["conv_id"], r["n_children"], r["n_leaves"], r["saved_tokens"])
    while stack:
        yield closed()


FIGURES = [(c, pa.int64()) for c in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [("ends_sha256", pa.string())]
#: Nodes as tasks give them back; ``parent`` and ``key`` name nodes that several tasks share.
SWEPT = pa.schema(
    [("kind", pa.string()), *FIGURES, ("parent_conv_id", pa.int64()), ("parent", pa.string()), ("task", pa.int32()), ("side", pa.int32())]
    + [("name", pa.binary()), ("words", pa.int64()), ("done", pa.bool_()), ("ids", pa.list_(pa.int64()))]
)
STITCHED = pa.schema([("key", pa.string()), ("parent", pa.string()), *FIGURES])


def in_batches(rows: Iterable[dict], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while held := list(islice(rows, ROWS)):
        yield pa.RecordBatch.from_pylist(held, kind)


def sweep_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return in_batches(swept(rows, TaskContext.get().partitionId()), SWEPT)


def stitch_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return in_batches(stitched(r for b in batches for r in b.to_pylist()), STITCHED)


def prefix_trie(arrays: DataFrame) -> DataFrame:
    """One row per node of the trie of ``arrays`` (conv_id, turns): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of first turns; its members start with it, and
    conv_id is the smallest of them.  ``saved_tokens`` sums the words that a tree
    of turns need not repeat, over the node's subtree.  ``ends_sha256`` is the
    SHA-256 of the ids, ascending and joined by commas, of the members that end
    there.

    Conversations are range-sorted by their turns' names and then by id, so
    equal ones need not lie in one task.  A task keeps its stack, the nodes whose
    parent is open, and 8 bytes a conversation that ends at an open node.  What
    tasks share, two ways from the root to a conversation each, is stitched in
    the tasks' order by one task that holds one stack; ids of equal conversations
    pass through it in a stream, as their SHA-256 must read them in order.

    One conversation's names (16 bytes a turn) must fit into a task's memory.
    An empty table gives no rows, not even a root.
    """
    scratch = Scratch(arrays.sparkSession, "trie")
    flat = arrays.select(F.transform("turns", lambda t: t["name"]).alias("names"), F.transform("turns", lambda t: t["words"]).alias("words"), "conv_id")
    # written once, as range sorting reads its input twice
    flat = scratch.keep(flat)
    ordered = flat.repartitionByRange("names", "conv_id").sortWithinPartitions("names", "conv_id")
    nodes = scratch.keep(ordered.mapInArrow(sweep_task, from_arrow_schema(SWEPT)))
    shared = nodes.where("kind = 'spine'").repartition(1).sortWithinPartitions("task", "side", "depth")
    spine = scratch.keep(shared.mapInArrow(stitch_task, from_arrow_schema(STITCHED)))
    above = scratch.keep(spine.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    known = nodes.where("kind = 'known'").select(*RESULT)
    open_ = meet(nodes.where("kind = 'open'").drop("parent_conv_id"), above, ["parent"], ["conv_id", "depth"]).select(*RESULT)
    return known.unionByName(open_).unionByName(meet(spine, above, ["parent"], ["key"], "left").select(*RESULT))


def conversation_trie(conversations: DataFrame, lend: bool = False, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The :func:`prefix_trie` of a table with a row a turn; null roles and texts count as empty.

    ``lend`` rebuilds the conversations first, see :func:`with_lent_heads`.
    Repeated rows are turns of their own; other columns don't matter.
    """
    arrays = turn_arrays(conversations, conv_id, turn, role, text)
    if lend:
        arrays = with_lent_heads(Scratch(conversations.sparkSession, "turns").keep(arrays))
    return prefix_trie(arrays)
