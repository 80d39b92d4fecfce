"""Groups of spelling variants: letter-parity masks in three bands find the words one edit apart."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import quoted
from .scratch import Scratch

#: Fixed values of the result's definition: runs of letters, how runs are thinned, and which words count.
RUN = "[A-Za-zÀ-ÿ]+"
ONE_IN, LEAST_LENGTH, LEAST_COUNT, TIMES = 97, 5, 3, 2
#: Bits of a mask and its bands; pieces of a word outside of which the letters of two near words agree.
BITS, BANDS, PIECES = 96, 3, 3
#: Letters looked at together, and distinct words that a task holds before it sends their counts.
BLOCK, HELD = 1 << 20, 200_000


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """``text`` in stretches of about ``size`` that end where no run of letters goes on."""
    end_of_run, at = re.compile("[^A-Za-zÀ-ÿ]"), 0
    while at < len(text):
        found = end_of_run.search(text, at + size)
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def thinned(word: str, prefix: int, one_in: int = ONE_IN) -> str:
    """``word`` without one code point if the CRC-32 that goes on from ``prefix`` with it is a multiple of ``one_in``."""
    h = zlib.crc32(word.encode(), prefix)
    if h % one_in:
        return word
    cut = h % len(word)
    return word[:cut] + word[cut + 1 :]


def words_of(text: str, doc_id: object) -> Iterator[tuple[str, int]]:
    """The runs of letters of a text, thinned, with counts; a run may come several times."""
    runs, prefix = re.compile(RUN), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for block in blocks(text):
        # bytes.lower() changes A-Z alone
        for run, n in Counter(runs.findall(block.encode().lower().decode())).items():
            yield thinned(run, prefix), n


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """Rows (word, n): the thinned runs of letters of all texts that are long and frequent enough.

    Tasks count words before they are shuffled, and send a word once for every
    HELD distinct ones, so a frequent word isn't hot.
    """

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in words_of(body.as_py(), key):
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield sent()
                    held.clear()
        yield sent()

    given = docs.where(F.col(quoted(text)).isNotNull()).select(F.col(quoted(doc_id)).cast("string").alias("doc_id"), F.col(quoted(text)).alias("text"))
    counted = given.mapInArrow(per_task, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def band_masks(word: Column) -> list[Column]:
    """Per band a number with the parities of its letters; each letter has one of BITS bits, dealt over the bands in turn.

    An inserted or deleted letter flips one bit and a replaced one two at most,
    so words one edit apart agree on a band.
    """
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    return [F.aggregate(letters, F.lit(0).cast("long"), flipped(band)) for band in range(BANDS)]


def flipped(band: int) -> Callable[[Column, Column], Column]:
    """A band's mask with a letter's bit turned over, if that bit is in the band."""

    def flip(mask: Column, letter: Column) -> Column:
        bit = F.pmod(F.ascii(letter), F.lit(BITS))
        here = F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(bit / BANDS).cast("int"))
        return F.when(bit % BANDS == band, mask.bitwiseXOR(here)).otherwise(mask)

    return flip


def outside(word: Column, shorter: Column, piece: Column) -> Column:
    """The letters of a word outside a piece, cut for a length of ``shorter``: those before it, counted from the start, and
    those behind it, counted from the end."""
    first, last = F.floor(shorter * piece / PIECES).cast("int"), F.floor(shorter * (piece + 1) / PIECES).cast("int")
    behind = shorter - last
    return F.concat_ws("\n", F.substring(word, F.lit(1), first), F.substring(word, F.length(word) - behind + 1, behind))


def near_pairs(words: DataFrame) -> DataFrame:
    """Rows (a, b, n_a, n_b): each pair of ``words`` (word, n) that differ by one inserted, deleted or replaced code point.

    Words meet where they agree on a band of their masks and their lengths differ
    by one at most.  As few letters are frequent, such a group may have a large
    part of all words; so it is dealt over PIECES pieces of a word: the edit lies
    in one of them, and the letters outside it agree.  The edit distance verifies
    what meets, and a pair counts at the first band and piece at which it meets.
    """
    masked = words.withColumns({f"m{k}": m for k, m in enumerate(band_masks(F.col("word")))}).withColumn("length", F.length("word"))

    def dealt(shorter: Column) -> DataFrame:
        keyed = masked.withColumn("shorter", shorter).withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
        keyed = keyed.withColumn("rest", outside(F.col("word"), F.col("shorter"), F.col("piece")))
        bands = F.array(*[F.struct(F.lit(k).alias("band"), F.col(f"m{k}").alias("mask")) for k in range(BANDS)])
        return keyed.select("word", "n", "m0", "m1", "length", "shorter", "piece", "rest", F.inline(bands))

    left = dealt(F.col("length"))
    right = left.unionByName(dealt(F.col("length") - 1))
    a, b = left.alias("a"), right.alias("b")
    once = (F.col("b.length") > F.col("a.length")) | (F.col("a.word") < F.col("b.word"))
    for name in ("band", "mask", "shorter", "piece", "rest"):
        once &= F.col(f"a.{name}") == F.col(f"b.{name}")
    met = a.join(b, once).where(F.levenshtein("a.word", "b.word", 1) == 1)
    before = F.lit(False)
    for k in range(BANDS - 1):
        before |= (F.col("a.band") > k) & (F.col(f"a.m{k}") == F.col(f"b.m{k}"))
    for k in range(PIECES - 1):
        rest = [outside(F.col(f"{side}.word"), F.col("a.shorter"), F.lit(k)) for side in "ab"]
        before |= (F.col("a.piece") > k) & (rest[0] == rest[1])
    met = met.where(~before)
    return met.select(F.col("a.word").alias("a"), F.col("b.word").alias("b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))


def last_forms(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (word, root) for the rows (word, form) of ``forms``, which have no circles: the last form on the way from a word.

    Every round doubles the steps that a word has followed.
    """
    now = scratch.keep(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        found = scratch.keep(longer)
        now = found.select("word", "root")
        if found.where("moved").isEmpty():
            return now


def spelling_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are the maximal runs of Latin letters of the texts, A-Z lower-cased; one
    run in ONE_IN (by id and run) loses a code point first.  Words of
    ``least_length`` code points and ``least_count`` occurrences or more are
    compared.  Near words differ by one inserted, deleted or replaced code point;
    a word's form is its most frequent near word (the first in code-point order of
    equals), if that occurs ``times`` as often or more.  ``root`` follows forms to
    the last.

    Null texts have no words; a null id counts as an empty one.  Ids may be of any
    type.  Repeated rows count each.  A text is read in blocks, so it may be as
    long as memory holds once.  An empty table gives no rows; other columns don't
    matter.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.keep(vocabulary(docs, doc_id, text, least_length, least_count))
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n")))
    sides = near_pairs(words).select(F.inline(both))
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    fits = -F.col("best.less") >= times * F.col("n")
    known = words.join(best, "word", "left").select(
        "word",
        F.when(fits, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, -F.col("best.less")).alias("form_n"),
    )
    known = scratch.keep(known)
    roots = last_forms(known.where("form IS NOT NULL"), scratch)
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
