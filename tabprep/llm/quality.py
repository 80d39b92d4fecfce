"""Quality rules: base counts of a text, and robust multivariate outliers per language and source."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import quoted, row_fields, row_struct
from .ranks import meet
from .scratch import Scratch

#: White space that ends words, words, and the characters counted as symbols.
SPACE, WORD, SYMBOLS = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]", r"[#*$%&|<>]"
#: Words in a window whose repetition counts, and the base rules' limits.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Statistics are rounded to 1 / GRID.
GRID = 32
#: Share of a group that its estimate covers, part by which a determinant falls in a step that isn't the last, probability
#: with which an ordinary text counts in the second estimate, rows of its language's estimate that are added to a group's,
#: and the probability with which an ordinary text passes.
COVER, FALL, COUNTS, ADDED_ROWS, PASS = 0.5, 1e-3, 0.975, 10, 0.9999
#: Distances are compared in so many steps for each doubling of 1 + distance.
DISTANCE_STEPS = 8
#: What is estimated for itself: languages and sources at level 0, languages at 1, the whole table at 2.
GROUP = ("level", "lang", "source")
#: The transformed statistics, and the standard deviation that each has at least: prose varies so much even where most
#: of a group's texts are alike.  Repeated words have a wide floor, as a base rule limits them; repeated lines one that lets
#: a text fail by them alone, as none does.
FLOORS = {"word_length": 0.1, "symbols": 0.06, "repeats": 0.2, "dup_lines": 0.15, "capitals": 0.1}
STATISTICS = tuple(FLOORS)


def chi_square_below(x: float, freedom: int) -> float:
    """The probability that a chi-square variable is at most ``x``."""
    if x <= 0:
        return 0.0
    a, half = freedom / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= half / k
        total += term
    return total * math.exp(a * math.log(half) - half - math.lgamma(a))


def chi_square_quantile(p: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_below(mid, freedom) < p else (low, mid)
    return (low + high) / 2


def text_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals.

    A null text has no words.  Windows of WINDOW words are compared by hashes of
    their words' hashes, and the words themselves where hashes agree.
    """
    body = F.coalesce(F.col(quoted(text)), F.lit(""))
    kept = list(carry or {})
    t = docs.select(F.col(quoted(doc_id)).cast("long").alias("doc_id"), *[c.alias(n) for n, c in (carry or {}).items()], body.alias("body"))
    t = t.select(
        "doc_id",
        *kept,
        F.array_remove(F.split("body", SPACE + "+"), "").alias("words"),
        F.filter(F.split("body", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        (F.length("body") - F.regexp_count("body", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("body", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
    )
    counts = ["word_chars", "n_symbols", "n_capitals"]
    t = t.select(
        "doc_id",
        *kept,
        *counts,
        "words",
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    counts += ["n_lines", "n_dup_lines"]
    size = F.size("words")
    starts = F.when(size >= WINDOW, F.sequence(F.lit(0), size - WINDOW)).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.xxhash64(*[F.get(F.col("hashes"), i + k) for k in range(WINDOW)])
    t = t.select("doc_id", *kept, *counts, "words", F.transform(starts, window).alias("windows"))
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    t = t.select("doc_id", *kept, *counts, "words", F.when(twice, ordered).alias("sorted"))
    words = lambda x: F.slice("words", x["i"] + 1, WINDOW)
    alike = lambda x, y: y.isNotNull() & (x["h"] == y["h"]) & (words(x) == words(y))
    again = F.filter("sorted", lambda x, j: alike(x, F.get("sorted", j - 1)) | alike(x, F.get("sorted", j + 1)))
    places = F.array_sort(F.transform(again, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end"))
    covered = F.when(F.col("sorted").isNull(), F.lit(0)).otherwise(F.aggregate(places, start, step, lambda a: a["n"]))
    return t.select("doc_id", *kept, F.size("words").cast("long").alias("n_words"), *counts, covered.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def statistics() -> dict[str, Column]:
    """The transformed statistics of a row of counts, rounded to the grid, as integers."""
    part = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    found = {
        "word_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        "symbols": part("n_symbols", "word_chars"),
        "repeats": part("n_repeat_words", "n_words"),
        "dup_lines": part("n_dup_lines", "n_lines"),
        "capitals": part("n_capitals", "word_chars"),
    }
    return {k: F.round(v * GRID).cast("long") for k, v in found.items()}


def lower(i: int, j: int) -> str:
    return f"l_{i}_{j}"


def factored(moments: DataFrame, factor: float) -> DataFrame:
    """Adds means m_i and the Cholesky factor l_i_j of ``factor`` times the covariance plus the floors, from sums n, s_i, s_i_j."""
    p, floors = len(STATISTICS), [(x * GRID) ** 2 for x in FLOORS.values()]
    before = moments.columns[: moments.columns.index("n")]
    found = {f"m_{i}": f"s_{i} / n" for i in range(p)}
    for j in range(p):
        for i in range(j, p):
            # an entry of the factor needs those before it alone, which SQL's later columns may refer to
            rest = f"(s_{i}_{j} / n - m_{i} * m_{j}) * {factor!r}D" + (f" + {floors[i]!r}D" if i == j else "")
            rest += "".join(f" - {lower(i, k)} * {lower(j, k)}" for k in range(j))
            found[lower(i, j)] = f"sqrt(greatest({rest}, {floors[j] / 4!r}D))" if i == j else f"({rest}) / {lower(j, j)}"
    return moments.selectExpr(*before, *[f"{x} AS {k}" for k, x in found.items()])


def with_distance(rows: DataFrame) -> DataFrame:
    """Adds ``distance``, the squared Mahalanobis distance of the statistics from the row's estimate."""
    parts = []
    for i, name in enumerate(STATISTICS):
        rest = f"{name} - m_{i}" + "".join(f" - {lower(i, k)} * y_{k}" for k in range(i))
        parts.append(f"({rest}) / {lower(i, i)} AS y_{i}")
    return rows.selectExpr("*", *parts, " + ".join(f"y_{i} * y_{i}" for i in range(len(STATISTICS))) + " AS distance")


def moments(n: str) -> dict[str, str]:
    """SQL of the sums n, s_i, s_i_j of the statistics and their products over rows that count ``n`` times."""
    sums = {"n": f"sum({n})"}
    for i, a in enumerate(STATISTICS):
        sums[f"s_{i}"] = f"sum({a} * {n})"
        sums |= {f"s_{i}_{j}": f"sum({a} * {b} * {n})" for j, b in enumerate(STATISTICS[: i + 1])}
    return sums


def summed(rows: DataFrame, by: list[str], sums: dict[str, str]) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.expr(x).alias(k) for k, x in sums.items()])


def shrunk(sums: DataFrame) -> DataFrame:
    """The sums of each language with ADDED_ROWS rows like the whole table's, and of each source with as many like its language's."""
    names = [c for c in sums.columns if c not in GROUP]
    found = above = sums.where("level = 2")
    # all languages have one parent, named by an empty part of theirs, so that both levels are equality joins
    for level, up in ((1, "substring(lang, 1, 0)"), (0, "lang")):
        parents = above.selectExpr("lang AS up", *[f"{c} * {ADDED_ROWS} / n AS up_{c}" for c in names])
        own = sums.where(f"level = {level}").selectExpr("*", f"{up} AS up")
        above = own.join(parents, "up", "left").selectExpr(*GROUP, *[f"{c} + coalesce(up_{c}, 0D) AS {c}" for c in names])
        found = found.union(above)
    return found


def medians(cells: DataFrame) -> DataFrame:
    """Rows (level, lang, source, start, q_i, d_i): medians and median deviations over rows (start 0) and distinct vectors (1).

    Values of one statistic are counted first, so what meets in a task is a count
    for each value that a statistic takes in a group, not the group's cells.
    """
    of = ", ".join([*GROUP, "start", "which"])
    counts = cells.selectExpr(*GROUP, "n", f"posexplode(array({', '.join(STATISTICS)})) AS (which, value)")
    counts = counts.groupBy(*GROUP, "which", "value").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("vectors"))
    t = counts.selectExpr(*GROUP, "which", "value", "posexplode(array(rows, vectors)) AS (start, w)")
    for value, found in (("value", "q"), ("abs(value - q)", "d")):
        upto = f"sum(w) OVER (PARTITION BY {of} ORDER BY {value})"
        t = t.selectExpr("*", f"CASE WHEN 2 * {upto} >= sum(w) OVER (PARTITION BY {of}) THEN {value} END AS reached")
        t = t.selectExpr("*", f"min(reached) OVER (PARTITION BY {of}) AS {found}").drop("reached")
    picked = [f"max(CASE WHEN which = {i} THEN {c} END) AS {c}_{i}" for i in range(len(STATISTICS)) for c in "qd"]
    return t.groupBy(*GROUP, "start").agg(*[F.expr(x) for x in picked])


def starts(cells: DataFrame) -> DataFrame:
    """Sums of each group for three starts: medians and their deviations over rows, these over distinct vectors, all rows' moments."""
    sums = ["1D AS n"]
    for i in range(len(STATISTICS)):
        sums.append(f"double(q_{i}) AS s_{i}")
        sums += [f"q_{i} * q_{j}" + (f" + power(1.4826D * d_{i}, 2)" if i == j else " + 0D") + f" AS s_{i}_{j}" for j in range(i + 1)]
    everything = summed(cells.selectExpr(*GROUP, "2 AS start", *STATISTICS, "n AS rows"), [*GROUP, "start"], moments("rows"))
    return medians(cells).selectExpr(*GROUP, "start", *sums).union(everything)


def concentrated(cells: DataFrame, known: DataFrame) -> DataFrame:
    """Sums over the COVER share of each group's rows that lie nearest to its estimate, for each start.

    Moments are summed by steps of distance, whose number is bounded; the step at
    the limit counts in part, so copies there are not all taken in.
    """
    each = [*GROUP, "start"]
    rings = with_distance(meet(cells.withColumnRenamed("n", "rows"), known, list(GROUP), list(STATISTICS)))
    rings = rings.selectExpr(*each, *STATISTICS, "rows", f"floor(log2(1 + distance) * {DISTANCE_STEPS}) AS step")
    sums = moments("rows")
    rings = summed(rings, [*each, "step"], sums)
    whole = f"PARTITION BY {', '.join(each)}"
    rings = rings.selectExpr("*", f"{COVER!r}D * sum(n) OVER ({whole}) - sum(n) OVER ({whole} ORDER BY step) + n AS open")
    rings = rings.selectExpr(*each, *sums, "greatest(0D, least(1D, open / n)) AS part")
    # whole steps are sums of whole numbers and one step at most is a part, so the order of rows changes nothing
    return summed(rings, each, {c: f"sum(CASE WHEN part = 1 THEN {c} ELSE 0 END) + coalesce(max(CASE WHEN part > 0 AND part < 1 THEN part * {c} END), 0D)" for c in sums})


def estimates(cells: DataFrame, scratch: Scratch) -> DataFrame:
    """The reweighted minimum-covariance-determinant estimate of each group (columns level, lang, source) of weighted cells.

    From each start, concentration steps take the COVER share of the group's
    rows that lie nearest and estimate anew, until no group's determinant falls.
    The least determinant wins, and the rows that are near its estimate make the
    last one.  Groups are shrunk at last, the more the fewer rows they have.
    """
    p, each, first = len(STATISTICS), [*GROUP, "start"], scratch.made
    factor = COVER / chi_square_below(chi_square_quantile(COVER, p), p + 2)
    size = " + ".join(f"2 * ln({lower(i, i)})" for i in range(p)) + " AS size"
    known = scratch.keep(factored(starts(cells), 1.0).selectExpr("*", "double('infinity') AS size", "double('infinity') AS best"))
    while True:
        found = factored(concentrated(cells, known.drop("size", "best")), factor).selectExpr("*", size)
        found = found.join(known.select(*each, F.col("best").alias("before")), each)
        known = scratch.keep(found.selectExpr("*", "least(size, before) AS best"))
        fell = not known.where(f"size < before - {FALL!r}D").isEmpty()
        known = known.drop("before")
        scratch.forget(*range(first, scratch.made - 1))
        first = scratch.made - 1
        if not fell:
            break
    chosen = known.groupBy(*GROUP).agg(F.min_by(F.struct(*[c for c in known.columns if c not in GROUP]), F.struct("size", "start")).alias("of"))
    chosen = scratch.keep(chosen.select(*GROUP, "of.*"))
    near = chi_square_quantile(COUNTS, p)
    rows = with_distance(meet(cells.withColumnRenamed("n", "rows"), chosen, list(GROUP), list(STATISTICS))).where(f"distance <= {near!r}D")
    sums = scratch.keep(summed(rows, list(GROUP), moments("rows")))
    return scratch.keep(factored(shrunk(sums), COUNTS / chi_square_below(near, p + 2)))


def judged(docs: DataFrame, scratch: Scratch, doc_id: str, text: str, lang: str, source: str, carry: dict[str, Column]) -> DataFrame:
    """The counts of each row and ``carry``, with the estimate of its language and source, distance and verdict.

    No row is shuffled unless there are more languages and sources than ``meet`` broadcasts.
    """
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(quoted(c)).cast("string")), F.lit(""))
    counts = text_counts(docs, doc_id, text, {"lang": name(lang), "source": name(source)} | carry)
    counts = scratch.keep(counts.withColumns({"base_failed": base_failed()} | statistics()))
    cells = counts.where("not base_failed").groupBy("lang", "source", *STATISTICS).agg(F.count(F.lit(1)).alias("n"))
    levels = F.array(
        F.struct(F.lit(0).alias("level"), F.col("lang"), F.col("source")),
        F.struct(F.lit(1).alias("level"), F.col("lang"), F.lit("").alias("source")),
        F.struct(F.lit(2).alias("level"), F.lit("").alias("lang"), F.lit("").alias("source")),
    )
    cells = cells.select(F.explode(levels).alias("g"), *STATISTICS, "n").groupBy("g.level", "g.lang", "g.source", *STATISTICS).agg(F.sum("n").alias("n"))
    cells = scratch.keep(cells)
    known = scratch.keep(estimates(cells, scratch).where("level = 0").drop("level"))
    cut = chi_square_quantile(PASS, len(STATISTICS))
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) < cut)
    return with_distance(meet(counts, known, ["lang", "source"], ["doc_id", "word_chars"], "left")).withColumn("kept", kept)


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per input row: doc_id, the counts, base_failed, kept, distance and the statistics on their grid.

    Texts that fail no base rule are judged by the Mahalanobis distance of their
    transformed statistics from the minimum-covariance-determinant estimate of
    their language and source, to which ADDED_ROWS rows like their language's
    are added, and to those as many like the whole table's.  A text is kept if
    the distance is below the chi-square quantile of PASS.

    Statistics are rounded to a grid, and equal vectors of a group are counted,
    not listed, so the estimate's tables hardly grow with the input, its sums
    are exact and its results don't depend on the order of rows.  Null languages
    and sources are groups like others; a null or empty text has no words and
    fails.  Very long texts are read whole.  Repeated rows get equal verdicts; an
    empty table gives no rows.  Ids must be whole numbers.
    """
    found = judged(docs, Scratch(docs.sparkSession, "quality"), doc_id, text, lang, source, {})
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance", *STATISTICS)


def quality_filter(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps; all columns and repeated rows stay, whatever the columns' names.

    The rows are written once beside their counts and judged where they lie.
    """
    found = judged(docs, Scratch(docs.sparkSession, "quality"), doc_id, text, lang, source, {"row": row_struct(docs)})
    return found.where("kept").select(*row_fields(docs, "row"))
