"""Toxicity scores from class-conditional Kneser-Ney letter models."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import quoted
from .scratch import Scratch

#: White space between words; what stands for a word's begin and end, and for these two where a text has them.
SPACE, BEGIN, END, RARE = r"[\x20\x09-\x0D]+", "\x02", "\x03", "\x1a"
MARKS = f"[{BEGIN}{END}]"
#: Letters of the longest grams; no gram of the distinct words takes more than one part in HOT_GRAMS of a join's rows.
ORDER, HOT_GRAMS = 6, 10_000
#: The share of a toxic text's words that come from the toxic model: such texts are ordinary language for the most part.
TOXIC_SHARE = 0.01
#: Values are whole numbers of 1 / UNIT, so sums don't depend on the order of rows; words in a task's dictionary at most;
#: and labelled texts that are broadcast at most.
UNIT, DICTIONARY, LABEL_ROWS = 1 << 28, 400_000, 500_000
#: Distinct texts fall into MODELS parts; the model of a part learns from the other parts' texts and values its own.
MODELS = 4
#: Steps in which values are counted for the calibration: of the value near 0, and of its logarithm far from it.
NEAR, FAR = 1_000_000, 20_000
#: Entries of a part of the model that the tasks hold at a time, and parts of a model at most; the grams of larger ones meet in a join.
PART_ENTRIES, PARTS = 500_000, 8
#: Grams of the largest model that every task holds; the grams of larger ones meet those of the distinct words as above.
HELD_ENTRIES = 2_000_000
#: Grams that a task hands over or looks up at once, and words of texts that it takes together.
BATCH, TOGETHER = 200_000, 1_000_000


def fold(doc_id: Column) -> Column:
    """The CRC-32 of the id as text, modulo 3; rows of fold 1 are held out of training."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3))


def part_of(text_key: Column, models: int) -> Column:
    """The part that a text falls into, equal texts into the same."""
    return F.pmod(F.xxhash64(F.lit(models), text_key), F.lit(models)).cast("int")


def discounts(counts: DataFrame, *columns: Column) -> list[float]:
    """Kneser-Ney's discount for each column, from how many counts are 1 and 2."""
    met = counts.agg(*(F.count_if(c == k) for c in columns for k in (1, 2))).first()
    return [min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5 for once, twice in zip(met[::2], met[1::2], strict=True)]


def head(c: str = "gram") -> Column:
    return F.expr(f"substring({c}, 1, length({c}) - 1)")


def tail(c: str = "gram") -> Column:
    return F.expr(f"substring({c}, 2)")


def word_counts(rows: DataFrame, models: int = 0) -> DataFrame:
    """Rows (word, toxic, ordinary) from rows (words, label), a text's distinct words: how many texts of a class have the word; and toxic_0, ... in each ``part``."""
    of_class = {"toxic": F.col("label") == 1, "ordinary": F.col("label") == 0}
    own = [F.count_if(met & (F.col("part") == m)).alias(f"{name}_{m}") for name, met in of_class.items() for m in range(models)]
    words = rows.select(F.explode("words").alias("word"), "label", *(["part"] if models else []))
    return words.groupBy("word").agg(*(F.count_if(met).alias(name) for name, met in of_class.items()), *own)


def gram_counts(words: DataFrame, rare: str, order: int) -> DataFrame:
    """Rows (gram, toxic, ordinary, ...): in how many texts' words its last letter follows its others, which reach back to the word's begin at most."""
    figures = [c for c in words.columns if c != "word"]
    whole = F.concat(F.lit(BEGIN), F.regexp_replace("word", rare, RARE), F.lit(END))
    at = words.select(whole.alias("w"), *figures).select("w", *figures, F.explode(F.sequence(F.lit(2), F.length("w"))).alias("end"))
    start = F.greatest(F.col("end") - order + 1, F.lit(1))
    gram = F.substr(F.col("w"), start, F.col("end") - start + 1)
    return at.groupBy(gram.alias("gram")).agg(*(F.sum(c).alias(c) for c in figures))


def pooled(counts: DataFrame, scratch: Scratch, order: int) -> DataFrame:
    """Adds ``pool``, ``reserved`` and ``low`` to gram counts, from both classes' counts together.

    pool: the share of the last letter behind the gram's others; reserved: the
    probability that Kneser-Ney's discount sets aside there; low: the last
    letter's probability behind a context one letter shorter.  Grams of full
    length and of word begins count as often as they occur; each shorter gram
    counts how many letters it follows.
    """
    known = counts.select("gram", (F.col("toxic") + F.col("ordinary")).alias("n"))
    level = known.where(F.length("gram") == order).select("gram")
    lower: dict[int, DataFrame] = {}
    for k in range(order - 1, 0, -1):
        lower[k] = scratch.keep(level.groupBy(tail().alias("gram")).agg(F.count(F.lit(1)).alias("n")))
        level = lower[k].select("gram").union(known.where(F.length("gram") == k).select("gram"))

    def smoothed(own: DataFrame, below: DataFrame | None) -> DataFrame:
        (d,) = discounts(own, F.col("n"))
        sums = own.groupBy(head().alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        t = own.withColumn("context", head()).join(sums, "context")
        t = t.withColumns({"pool": F.col("n") / F.col("total"), "reserved": d * F.col("kinds") / F.col("total"), "shorter": tail()})
        t = t.withColumn("part", F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("total"))
        if below is None:
            t = t.withColumn("low", 1 / F.col("kinds"))
        else:
            t = t.join(below.select(F.col("gram").alias("shorter"), F.col("probability").alias("low")), "shorter")
        return t.select("gram", "pool", "reserved", "low", (F.col("part") + F.col("reserved") * F.col("low")).alias("probability"))

    below = None
    every = None
    for k in range(1, order):
        below = scratch.keep(smoothed(lower[k], below))
        every = below if every is None else every.union(below)
    return counts.join(smoothed(known, every).drop("probability"), "gram")


def differences(counts: DataFrame, scratch: Scratch, order: int, models: int = 0) -> DataFrame:
    """Rows (gram, weight): in each model, the logarithm of how much likelier the last letter is in toxic texts than in ordinary ones.

    Behind a context both classes set aside what the pooled counts do and back
    off to the same shorter context, so a letter that is new there weighs
    nothing.  The rest follows the class's discounted counts, completed from the
    pooled ones.  The pooled counts know no labels and are those of all texts; the
    classes' counts in the model of a part are those of the other parts, and a
    gram that these haven't weighs nothing.  ``models`` = 0: one model, of all parts.
    """
    table = scratch.keep(pooled(counts, scratch, order).withColumn("context", head()))
    names = [(m, name) for m in range(models or 1) for name in ("toxic", "ordinary")]
    count = {(m, name): F.col(name) - F.col(f"{name}_{m}") if models else F.col(name) for m, name in names}
    cut = dict(zip(names, discounts(table, *(count[at] for at in names)), strict=True))
    sums = []
    for m, name in names:
        sums += [F.sum(count[m, name]).alias(f"total_{name}_{m}"), F.sum(F.least(count[m, name], F.lit(cut[m, name]))).alias(f"taken_{name}_{m}")]
    t = table.join(table.groupBy("context").agg(*sums), "context")

    def likely(m: int, name: str) -> Column:
        met = F.col(f"total_{name}_{m}")
        total = F.greatest(met, F.lit(1))
        own = F.greatest(count[m, name] - cut[m, name], F.lit(0.0)) / total
        rest = F.when(met > 0, F.col(f"taken_{name}_{m}") / total).otherwise(1.0)
        return (1 - F.col("reserved")) * (own + rest * F.col("pool")) + F.col("reserved") * F.col("low")

    weight = [F.when(count[m, "toxic"] + count[m, "ordinary"] > 0, F.log(likely(m, "toxic") / likely(m, "ordinary"))).otherwise(0.0) for m in range(models or 1)]
    return t.select("gram", F.array(*weight).alias("weight"))


def logistic(rows: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and intercept for P(toxic | value) from rows (value, label, count), with a slight ridge."""
    x, y, n = (np.array(c, float) for c in zip(*rows, strict=True))
    scale = math.sqrt(np.average((x - np.average(x, weights=n)) ** 2, weights=n)) or 1.0
    a = np.stack([x / scale, np.ones_like(x)], 1)
    beta, ridge = np.zeros(2), np.diag([1e-2, 1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (n * (y - p)) - ridge @ beta)
        beta = beta + np.clip(step, -2, 2)
    return float(beta[0] / scale), float(beta[1])


def median(rows: list[tuple[float, int]]) -> float:
    """The least value up to which half of the counts lie."""
    rows, half, met = sorted(rows), sum(n for _, n in rows) / 2, 0
    for x, n in rows:
        met += n
        if met >= half:
            return x
    return 0.0


def spelled_grams(words: DataFrame, order: int) -> DataFrame:
    """Rows (row, model, gram) from rows (row, model, word): each letter of a word and its end, behind ``order`` - 1 letters at most."""

    def packed(rows: list[int], models: list[int], grams: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(models, pa.int32()), pa.array(grams, pa.string())], ["row", "model", "gram"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, models, grams = [], [], []
        for batch in batches:
            for row, model, word in zip(*(batch.column(c).to_pylist() for c in ("row", "model", "word")), strict=True):
                w = BEGIN + word + END
                for first in range(1, len(w), BATCH):
                    ends = range(first, min(len(w), first + BATCH))
                    grams += [w[max(0, i - order + 1) : i + 1] for i in ends]
                    rows += [row] * len(ends)
                    models += [model] * len(ends)
                    if len(grams) >= BATCH:
                        yield packed(rows, models, grams)
                        rows, models, grams = [], [], []
        yield packed(rows, models, grams)

    return words.select("row", "model", "word").mapInArrow(spell, "row long, model int, gram string")


def passed(words: DataFrame, weights: DataFrame, order: int, parts: int, scratch: Scratch) -> DataFrame:
    """Rows (word, model, n, total): each of ``parts`` parts of the weights passes over the words once."""

    def one_pass(t: DataFrame, part: pa.Table) -> DataFrame:
        of_model = np.array(part.column("weight").combine_chunks().flatten(), np.int64).reshape(max(1, part.num_rows), -1).T.copy()
        sent = t.sparkSession.sparkContext.broadcast(({g: i for i, g in enumerate(part.column("gram").to_pylist())}, of_model))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, figures = sent.value
            for batch in batches:
                out = []
                for word, model, total in zip(*(batch.column(c).to_pylist() for c in ("word", "model", "total")), strict=True):
                    w = BEGIN + word + END
                    met = [i for i in map(number.get, [w[max(0, e - order + 1) : e + 1] for e in range(1, len(w))]) if i is not None]
                    out.append(total + int(figures[model, met].sum()) if met else total)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("word", "model", "n")), pa.array(out, pa.int64())], ["word", "model", "n", "total"])

        return t.select("word", "model", "n", "total").mapInArrow(add, "word string, model int, n long, total long")

    t = words.withColumn("total", F.lit(0).cast("long"))
    for k in range(parts):
        t = scratch.keep(one_pass(t, weights.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == k).toArrow()))
        if k:
            scratch.forget(scratch.made - 2)
    return t


def joined(words: DataFrame, weights: DataFrame, order: int, scratch: Scratch) -> DataFrame:
    """Rows (word, model, n, total): the words' grams meet the weights in a join.

    A gram that takes more than one part in HOT_GRAMS of the rows is dealt over
    several keys; there are fewer than HOT_GRAMS of these, whatever the words
    are, so their list is broadcast.
    """
    table = scratch.keep(words.withColumn("row", F.monotonically_increasing_id()))
    total = table.agg(F.sum(F.length("word").cast("long") + 1)).first()[0] or 0
    grams = spelled_grams(table, order)
    counted = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") * HOT_GRAMS > total)
    hot = F.broadcast(scratch.keep(counted.select("gram", F.ceil(F.col("met") * HOT_GRAMS / total).cast("int").alias("keys"))))
    keys = F.coalesce("keys", F.lit(1))
    dealt = weights.join(hot, "gram", "left").select("gram", "weight", F.explode(F.sequence(F.lit(0), keys - 1)).alias("key"))
    asked = grams.join(hot, "gram", "left").select("row", "model", "gram", F.pmod(F.col("row"), keys).cast("int").alias("key"))
    weight = F.element_at("weight", F.col("model") + 1).alias("weight")
    sums = asked.join(dealt, ["gram", "key"]).select("row", weight).where("weight <> 0").groupBy("row").agg(F.sum("weight").alias("total"))
    return table.join(sums, "row", "left").drop("row").withColumn("total", F.coalesce("total", F.lit(0)))


def word_values(words: DataFrame, weights: DataFrame, scratch: Scratch, order: int) -> DataFrame:
    """Rows (word, model, n, value) of distinct words and models: the logarithm of how much likelier a toxic text has the word, in steps of 1 / UNIT.

    In a toxic text TOXIC_SHARE of the words come from the toxic model and the
    others from the ordinary one, so a word's likelihood there is a mixture.  A
    model of PARTS parts at most passes over the words part by part; a larger one
    meets their grams in a join.  Weights are whole numbers, so both ways give
    the same sums to the last digit.
    """
    model = F.col("model") if "model" in words.columns else F.lit(0).alias("model")
    given = words.select("word", model, "n")
    whole = weights.select("gram", F.transform("weight", lambda w: F.round(w * UNIT).cast("long")).alias("weight"))
    parts, first = max(1, math.ceil(weights.count() / PART_ENTRIES)), scratch.made
    found = passed(given, whole, order, parts, scratch) if parts <= PARTS else joined(given, whole, order, scratch)
    t, share = F.col("total") / UNIT, F.lit(TOXIC_SHARE)
    mixed = F.when(t > 0, t + F.log(share + (1 - share) * F.exp(-t))).otherwise(F.log1p(share * F.expm1(t)))
    out = scratch.keep(found.select("word", "model", "n", F.round(mixed * UNIT).cast("long").alias("value")))
    scratch.forget(*range(first, scratch.made - 1))
    return out


def common_words(values: DataFrame) -> tuple[dict[int, dict[bytes, int]], int]:
    """For each model the values of the words that occur most, DICTIONARY in all at most, and how often a word must occur to be one of them."""
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(map(tuple, values.groupBy(step.alias("step")).count().collect()), reverse=True)  # a row for each eighth of a doubling
    least, held = None, 0
    for at, number in sizes:
        held += number
        if held > DICTIONARY:
            break
        least = at
    if least is None:
        return {}, 1 << 62
    known = values.where(step >= least).select(F.col("word").cast("binary").alias("word"), "model", "value").toArrow()
    found: dict[int, dict[bytes, int]] = {}
    for word, model, value in zip(*(known.column(c).to_pylist() for c in ("word", "model", "value")), strict=True):
        found.setdefault(model, {})[word] = value
    return found, 0 if least == sizes[-1][0] else least


def text_values(texts: DataFrame, values: DataFrame, scratch: Scratch, models: int = 1) -> DataFrame:
    """Rows (doc_id, text_key, value) of rows (doc_id, text_key, text): the mean value of the text's words in its part's model, 0 if it has none.

    Common words have their values in a dictionary of bounded size in every
    task; the others are few of a text's words, and each is in few texts, so they
    meet their values in a join.
    """
    known, least = common_words(values)
    sent = texts.sparkSession.sparkContext.broadcast(known)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent.value
        for batch in batches:
            totals, sizes, rest = [], [], []
            for text, model in zip(batch.column("text"), batch.column("model").to_pylist(), strict=True):
                words = text.as_py().split()
                met = list(map(found.get(model, {}).get, words))
                if None in met:
                    rest.append([w for w, v in zip(words, met, strict=True) if v is None])
                    met = [v for v in met if v is not None]
                else:
                    rest.append([])
                totals.append(sum(met))
                sizes.append(len(words))
            columns = [*(batch.column(c) for c in ("doc_id", "text_key", "model", "row")), pa.array(totals, pa.int64()), pa.array(sizes, pa.int64()), pa.array(rest, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "model", "row", "total", "words", "rest"])

    given = texts.select("doc_id", "text_key", part_of(F.col("text_key"), models).alias("model"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("binary").alias("text"))
    t = scratch.keep(given.mapInArrow(look_up, "doc_id long, text_key long, model int, row long, total long, words long, rest array<binary>"))
    total = F.col("total")
    if least:
        each = t.select("row", "model", F.explode(F.col("rest").cast("array<string>")).alias("word")).groupBy("row", "model", "word").agg(F.count(F.lit(1)).alias("times"))
        rare = values.where(F.floor(F.log2("n") * 8) < least) if least < 1 << 62 else values
        more = each.join(rare.select("word", "model", "value"), ["word", "model"]).groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("more"))
        t = t.join(more, "row", "left")
        total = total + F.coalesce("more", F.lit(0))
    return t.select("doc_id", "text_key", F.when(F.col("words") > 0, total / F.col("words") / UNIT).otherwise(0.0).alias("value"))


class HeldModel:
    """A model's grams as sorted numbers whose digits are their letters, with their weights of each model."""

    def __init__(self, letters: np.ndarray, keys: np.ndarray, weights: np.ndarray, order: int):
        self.letters, self.keys, self.weights, self.order = letters, keys, weights, order

    @staticmethod
    def base(letters: np.ndarray) -> int:
        """0 is no letter, and the largest digit one that no gram has."""
        return len(letters) + 2

    def digits(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[at] == codes, at + 1, len(self.letters) + 1).astype(np.uint64)

    def totals(self, words: list[bytes]) -> np.ndarray:
        """The sums of the weights of each word's grams, a row for each model."""
        spelled = b"".join(BEGIN.encode() + w + END.encode() for w in words).decode("utf-8", "replace")
        # as if other words' begins stood before the first
        codes = np.frombuffer((BEGIN * self.order + spelled).encode("utf-32-le"), np.uint32)
        word = np.cumsum(codes == ord(BEGIN)) - 1 - self.order
        out, base = np.zeros((len(self.weights), len(words)), np.int64), self.base(self.letters)
        for low in range(self.order, len(codes), BATCH):
            high = min(len(codes), low + BATCH)
            near = codes[low - self.order : high]
            digit, begins = self.digits(near), near == ord(BEGIN)
            inside, key = np.ones(high - low, bool), np.zeros(high - low, np.uint64)
            for back in range(self.order):
                at = slice(self.order - back, len(near) - back)
                key += np.where(inside, digit[at], 0).astype(np.uint64) * np.uint64(base**back)
                inside &= ~begins[at]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            met = np.flatnonzero((self.keys[place] == key) & ~begins[self.order :])
            if not len(met):
                continue
            of, place = word[low:high][met], place[met]
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            out[:, of[first]] += np.add.reduceat(self.weights[:, place], first, axis=1)
        return out


def held_model(weights: DataFrame, order: int) -> HeldModel | None:
    """The model as the tasks hold it, or None if its grams are more than HELD_ENTRIES or their letters too many for 64 bits."""
    number = weights.count()
    if not 0 < number <= HELD_ENTRIES:
        return None
    whole = weights.select("gram", F.transform("weight", lambda w: F.round(w * UNIT).cast("long")).alias("weight"))
    keys, figures = [], []
    each = whole.select(F.explode(F.split("gram", "")).alias("letter")).distinct().limit(1 << 16).collect()
    letters = np.array(sorted({ord(r["letter"]) for r in each if r["letter"]}), np.uint32)
    if HeldModel.base(letters) ** order >= 1 << 64:
        return None
    base, empty = HeldModel.base(letters), HeldModel(letters, np.zeros(0, np.uint64), np.zeros((0, 0), np.int64), order)
    parts = math.ceil(number / PART_ENTRIES)
    for k in range(parts):
        part = whole.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == k).toArrow()
        if not part.num_rows:
            continue
        grams = part.column("gram").to_pylist()
        size = np.fromiter(map(len, grams), np.int64, len(grams))
        digit = empty.digits(np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32))
        end, key = np.cumsum(size), np.zeros(len(grams), np.uint64)
        for back in range(order):
            has = size > back
            key[has] += digit[end[has] - 1 - back] * np.uint64(base**back)
        keys.append(key)
        figures.append(np.array(part.column("weight").combine_chunks().flatten(), np.int64).reshape(len(grams), -1))
    key = np.concatenate(keys)
    by_key = np.argsort(key)
    return HeldModel(letters, key[by_key], np.concatenate(figures)[by_key].T.copy(), order)


def mixed_values(totals: np.ndarray) -> np.ndarray:
    """As in :func:`word_values`: the values of words from their grams' sums, in steps of 1 / UNIT."""
    t = totals / UNIT
    above = t + np.log(TOXIC_SHARE + (1 - TOXIC_SHARE) * np.exp(-np.maximum(t, 0)))
    return np.rint(np.where(t > 0, above, np.log1p(TOXIC_SHARE * np.expm1(np.minimum(t, 0)))) * UNIT).astype(np.int64)


def held_text_values(texts: DataFrame, model: HeldModel, models: int = 1) -> DataFrame:
    """The rows of :func:`text_values` in one pass over the texts, whose tasks hold the model: nothing is shuffled.

    A task values each word once, as long as it doesn't meet more than
    DICTIONARY different ones; then it begins anew.
    """
    sent = texts.sparkSession.sparkContext.broadcast((model.letters, model.keys, model.weights, model.order))
    dictionary, together = DICTIONARY, TOGETHER

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = HeldModel(*sent.value)
        number: dict[bytes, int] = {}
        values = np.zeros((models, 0), np.int64)

        def summed(texts: list[list[bytes]], parts: list[int]) -> np.ndarray:
            nonlocal values
            if len(number) > dictionary:
                number.clear()
                values = np.zeros((models, 0), np.int64)
            known = len(number)
            at = np.fromiter((number.setdefault(w, len(number)) for words in texts for w in words), np.int64)
            new = list(number)[known:]
            if new:
                values = np.concatenate([values, mixed_values(held.totals(new))], axis=1)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            each = values[np.repeat(np.array(parts, np.int64), sizes), at]
            return np.diff(np.r_[0, np.cumsum(each)][np.r_[0, np.cumsum(sizes)]])

        for batch in batches:
            totals, sizes, held_back, parts, count = [np.zeros(0, np.int64)], [], [], [], 0
            for text, part in zip(batch.column("text"), batch.column("model").to_pylist(), strict=True):
                words = text.as_py().split()
                held_back.append(words)
                parts.append(part)
                sizes.append(len(words))
                count += len(words)
                if count >= together:
                    totals.append(summed(held_back, parts))
                    held_back, parts, count = [], [], 0
            if held_back:
                totals.append(summed(held_back, parts))
            size = np.array(sizes, np.int64)
            value = np.where(size > 0, np.concatenate(totals) / np.maximum(size, 1) / UNIT, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(value)], ["doc_id", "text_key", "value"])

    given = texts.select("doc_id", "text_key", part_of(F.col("text_key"), models).alias("model"), F.col("text").cast("binary").alias("text"))
    return given.mapInArrow(look_up, "doc_id long, text_key long, value double")


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", order: int = ORDER, label_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Each class has a Kneser-Ney model of the letters in words, over labelled rows
    outside fold 1; both back off to one model of their pooled counts.  A gram
    counts once for each distinct text with a word that has it, so copies and
    repetition in a text weigh nothing.  Distinct texts fall into MODELS parts,
    and a text is valued by the models of the other parts' labels, so no text's value
    follows from its own label.  A text's value is the difference of its toxic and
    ordinary log-likelihoods over its number of words, where a word of a toxic
    text comes from the toxic model with probability TOXIC_SHARE and else from the
    ordinary one.  A logistic curve over the value's order of size, fitted on all
    training texts, turns it into the score; one that would fall is taken as flat.
    Both classes are taken as equally likely beforehand, so the score compares
    likelihoods and doesn't follow the share of toxic labels.

    All letters, all grams and all words count, and the order is the same for any
    input.  A model of HELD_ENTRIES grams at most is held by the tasks, which value
    the words as they read the texts; with a larger one distinct words are valued
    once, and the texts are read once for that and once for their scores.  Null and empty texts have value 0; very long ones are
    read whole.  An id labelled more than once is toxic if one label says so,
    and so is a text; null labels and ids are left out.  Repeated rows get equal
    scores.  Without training rows of both classes every score is the toxic share
    (0 if none).  An empty table gives no rows.  Ids must be whole numbers.
    """
    scratch, learnt, valued = (Scratch(docs.sparkSession, name) for name in ("toxic", "toxic-model", "toxic-words"))
    ident, mark_id = F.col(quoted(doc_id)).cast("long"), F.col(quoted(label_id)).cast("long")
    marks = labels.where(F.col(quoted(label)).isNotNull() & mark_id.isNotNull()).groupBy(mark_id.alias("doc_id"))
    marks = scratch.keep(marks.agg(F.max(quoted(label)).cast("int").alias("label")).where(fold(F.col("doc_id")) != 1))
    text_ = F.regexp_replace(F.lower(F.coalesce(F.col(quoted(text)), F.lit(""))), MARKS, RARE)
    texts = docs.select(ident.alias("doc_id"), text_.alias("text")).withColumn("text_key", F.xxhash64("text"))
    small = lambda t: F.broadcast(t) if t.count() <= LABEL_ROWS else t
    # one document stands for each distinct labelled text
    of_text = texts.select("doc_id", "text_key").join(small(marks), "doc_id").groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label"))
    of_text = scratch.keep(of_text.withColumn("part", part_of(F.col("text_key"), MODELS)))
    classes = {r["label"] for r in of_text.select("label").distinct().collect()}
    distinct = F.array_distinct(F.array_remove(F.split("text", SPACE), ""))
    training = texts.where(fold(F.col("doc_id")) != 1).select("doc_id", "text_key", distinct.alias("words")).join(small(of_text), ["doc_id", "text_key"])
    words = learnt.keep(word_counts(training.select("words", "label", "part"), MODELS))
    weights = scratch.keep(differences(learnt.keep(gram_counts(words, MARKS, order)), learnt, order, MODELS))
    learnt.forget(*range(learnt.made))
    held_by_tasks = held_model(weights, order)
    if held_by_tasks:
        values = scratch.keep(held_text_values(texts, held_by_tasks, MODELS))
    else:
        every = texts.select(part_of(F.col("text_key"), MODELS).alias("model"), F.explode(F.split("text", SPACE)).alias("word")).where("word <> ''")
        every = every.groupBy("word", "model").agg(F.count(F.lit(1)).alias("n"))
        values = scratch.keep(text_values(texts, word_values(every, weights, valued, order), valued, MODELS))
    valued.forget(*range(valued.made))
    score = F.lit(1.0 if 1 in classes and 0 not in classes else 0.0)
    if classes == {0, 1}:
        met = values.groupBy("text_key").agg(F.first("value").alias("value")).join(of_text, "text_key")
        bins = met.groupBy(F.round(F.asinh(F.col("value") * NEAR) * FAR).alias("bin"), "label").count().collect()  # by the logarithm, so about a million at most
        rows = [(math.sinh(r["bin"] / FAR) / NEAR, r["label"], r["count"]) for r in sorted(bins)]
        middle = median([(x, n) for x, _, n in rows])
        spread = max(1 / NEAR, median([(abs(x - middle), n) for x, _, n in rows]))
        # toxic texts' values are far above the others' and far apart, so the curve is one of their order of size
        slope, intercept = logistic([(math.asinh((x - middle) / spread), y, n) for x, y, n in rows])
        of_class = [sum(n for _, y, n in rows if y == k) for k in (0, 1)]
        intercept = intercept + math.log(of_class[0] / of_class[1]) if slope > 0 else 0.0
        score = 1 / (1 + F.exp(-(F.lit(max(slope, 0.0)) * F.asinh((F.col("value") - middle) / spread) + F.lit(intercept))))
    held = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return values.withColumn("score", score).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
