"""Exact dedup through content-defined chunk recipes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import free_names, own_columns, quoted
from .ranks import attach
from .scratch import Scratch

#: A chunk ends after a sentence or line end, from MIN_CHUNK code points on; at MAX_CHUNK it ends anyway.
MIN_CHUNK, MAX_CHUNK = 512, 8192
#: Keys of eight bytes that are broadcast to find the rows in doubt.
SHORT_KEYS = 1_000_000


def chunk_pattern(smallest: int = MIN_CHUNK, largest: int = MAX_CHUNK) -> str:
    """The regular expression whose successive matches are a text's chunks; together they are the whole text."""
    return rf"(?s).{{{smallest},{largest - 1}}}?[.!?\n]|.{{1,{largest}}}"


def exact_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    smallest: int = MIN_CHUNK,
    largest: int = MAX_CHUNK,
    id_bits: int = 64,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are cut into content-defined chunks.  Each distinct chunk moves once,
    after map-side deduplication, to verify that its 64-bit identifier belongs to
    it alone; where it doesn't, the chunks that share it get an ordinal each, so
    (identifier, ordinal) stands for exactly one chunk.  Texts are equal if and
    only if their ordered identifier lists are, so from there on only those lists
    are shuffled.

    Null texts count as empty; all empty texts are one group.  Of a group, the
    row with the largest doc_id stays (null ids are below all others); of
    repeated rows with that doc_id, one.  An empty table gives an empty result.  Ids
    must be whole numbers; a long text has a long list of identifiers, in memory.
    ``id_bits`` shortens the identifiers to provoke collisions in tests.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    chunks = F.regexp_extract_all(body, F.lit(chunk_pattern(smallest, largest)), F.lit(0))
    ident = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - id_bits) if id_bits < 64 else F.xxhash64(c)
    pieces = docs.select(F.explode(chunks).alias("chunk")).select(ident(F.col("chunk")).alias("id"), "chunk").distinct()
    shared = pieces.groupBy("id").count().where("count > 1").select("id")
    recipes = docs.select(
        F.col(quoted(doc_id)).cast("long").alias("doc_id"),
        F.transform(chunks, ident).alias("recipe"),
        F.sha2(body, 256).alias("text_sha256"),
    )
    clashes = scratch.keep(shared)
    if clashes.isEmpty():
        recipes = recipes.withColumn("ordinals", F.lit(""))
    else:
        order = Window.partitionBy("id").orderBy("chunk")
        numbered = pieces.join(clashes, "id").withColumn("ordinal", F.row_number().over(order))
        placed = docs.select(F.sha2(body, 256).alias("text_sha256"), F.xxhash64(body).alias("_h"), F.posexplode(chunks).alias("pos", "chunk"))
        placed = placed.withColumn("id", ident(F.col("chunk"))).join(numbered, ["id", "chunk"])
        one = placed.select("text_sha256", "pos", "ordinal").distinct().groupBy("text_sha256")
        lists = one.agg(F.to_json(F.array_sort(F.collect_list(F.struct("pos", "ordinal")))).alias("ordinals"))
        recipes = recipes.join(lists, "text_sha256", "left").fillna("", ["ordinals"])
    recipes = scratch.keep(recipes.withColumn("group", F.xxhash64("recipe", "ordinals")))
    same = ["recipe", "ordinals"]
    groups = recipes.groupBy("group", *same).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    found = attach(recipes, scratch.keep(groups), "group", "group_size", F.col("doc_id"), same)
    repeated = Window.partitionBy("doc_id", "text_sha256").orderBy("group_size")
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(repeated) == 1)).alias("kept"),
        "text_sha256",
        F.size("recipe").alias("n_chunks"),
    )


def row_key(doc_id: Column, sha: Column) -> Column:
    """What tells rows apart by id and text hash, without nulls; a null id is none of the others."""
    return F.struct(F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("none"), sha.alias("sha"))


def keep_rows(docs: DataFrame, judged: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = SHORT_KEYS) -> DataFrame:
    """The rows of ``docs`` whose id and text hash are marked ``kept`` in ``judged``, each once.

    ``judged`` has a row (doc_id, text_sha256, kept) for each row of ``docs``.
    Rows in doubt are those whose 64-bit key is that of a row which goes, or of
    another row.  If these keys are ``most`` at most, they are broadcast, all
    other rows pass where they lie, and only rows in doubt are shuffled, to be
    compared by their whole keys; beyond that all rows are.  All columns of
    ``docs`` stay as they are, whatever their names.
    """
    whole, short = free_names(docs, "row_key", "short_key")
    marks = judged.select(row_key(F.col("doc_id"), F.col("text_sha256")).alias(whole), "kept")
    marks = marks.groupBy(F.xxhash64(whole).alias(short), whole).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    marks = Scratch(docs.sparkSession, "rows").keep(marks)
    doubt = marks.groupBy(short).agg(F.max((~F.col("kept") | (F.col("n") > 1))).alias("doubt")).where("doubt").select(short)
    sha = F.sha2(F.coalesce(F.col(quoted(text)), F.lit("")), 256)
    keyed = docs.withColumn(whole, row_key(F.col(quoted(doc_id)).cast("long"), sha))
    keyed = keyed.withColumn(short, F.xxhash64(whole))
    settled = None
    if doubt.count() <= most:
        settled = keyed.join(F.broadcast(doubt), short, "left_anti")
        keyed = keyed.join(F.broadcast(doubt), short, "left_semi")
    if not marks.where("kept AND n > 1").isEmpty():
        keyed = keyed.dropDuplicates([short, whole])
    met = keyed.join(marks.where("kept").select(short, whole).hint("shuffle_hash"), [short, whole], "left_semi")
    met = met.select(*own_columns(docs))
    return met if settled is None else settled.select(*own_columns(docs)).union(met)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that :func:`exact_groups` drops; all columns stay, whatever their names."""
    return keep_rows(docs, exact_groups(docs, doc_id, text), doc_id, text)
