"""Secret scans: known shapes, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import quoted

#: The base kinds in order: pattern, the group whose length counts, and that length.
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),  # a run of these letters is one match, so shorter ones need not be looked at
}
#: Candidate strings, and per character class: its strings, alphabet, window and least bits a character.
#: A candidate is of the first class that fits.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
SIGNS = "+/=_-"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = {
    "entropy_hex": (r"^[0-9A-Fa-f]+$", DIGITS + LOWER[:6], 20, 3.0),
    "entropy_lower": (r"^[^A-Z]+$", LOWER + DIGITS + SIGNS, 20, 3.5),
    "entropy_upper": (r"^[^a-z]+$", UPPER + DIGITS + SIGNS, 20, 3.5),
    "entropy_base64": (r"", UPPER + LOWER + DIGITS + SIGNS, 20, 3.7),
}
#: Whole candidates that are no secrets however mixed: numbers, words of the letters a to f, identifiers.
ALLOW = (
    r"^[^A-Za-z]+$",
    r"^[A-Fa-f]+$",
    r"^[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
)
#: Where a stretch changes between small letters, capitals and digits; a capital that begins a word counts once.  Words, camel
#: case, slugs and dates change seldom: a stretch outside hex with fewer changes than one in CHANGE_EVERY letters is allowed.
CHANGE, CHANGE_EVERY = r"(?<=[a-z])[A-Z]|(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]", 6
#: Words of examples.  Standing alone in a candidate they belong to no secret; joined to a stretch they allow it.
EXAMPLES = ("example", "sample", "placeholder", "changeme", "dummy", "abcdefgh", "01234567", "12345678")
KINDS = (*BASE, *CLASSES)
SPAN = "array<struct<start:int,kind:int,end:int>>"
#: Matches whose lengths are added up together.
BLOCK = 64


def split_at(body: Column, pattern: str) -> Column:
    """The text cut after each leftmost non-overlapping match, and its rest; empty without a match."""
    parts = F.regexp_extract_all(body, F.lit(f"(?s).*?(?:{pattern}|\\z)"), F.lit(0))
    return F.when(body.rlike(pattern), parts).otherwise(F.array().cast("array<string>"))


def matches(parts: str, pattern: str, group: int = 0) -> Column:
    """Array of (text, group, end): a match in each part of column ``parts`` and the code points up to its end.

    Lengths are added up by blocks, so a text with many matches stays cheap.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int")), lambda b: F.slice(parts, b * BLOCK + 1, BLOCK))
    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("starts"))
    step = lambda a, b: F.struct((a["end"] + total(b)).alias("end"), F.concat(a["starts"], F.array(a["end"])).alias("starts"))
    starts = lambda bs: F.aggregate(bs, zero, step, lambda a: a["starts"])

    def found(part: Column, end: Column) -> Column:
        return F.struct(
            F.regexp_extract(part, pattern, 0).alias("text"),
            F.regexp_extract(part, pattern, group).alias("group"),
            end.alias("end"),
        )

    each = lambda b, at: F.transform(b, lambda x, i: found(x, at + total(F.slice(b, 1, i + 1))))
    return F.filter(F.flatten(F.zip_with(blocks, starts(blocks), each)), lambda m: m["text"] != "")


def span(start: Column, kind: str, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.cast("int").alias("end"))


def long_enough(group: int, least: int) -> Callable[[Column], Column]:
    return lambda m: F.length(m["group"] if group else m["text"]) >= least


def of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda m: span(m["end"] - F.length(m["text"]), kind, m["end"])


def shifted(start: Column, kind: str) -> Callable[[Column], Column]:
    return lambda s: span(start + s["start"], kind, start + s["end"])


def base_spans() -> Column:
    """All spans of the base kinds, by start and then kind, from the columns parts_KIND."""
    found = []
    for kind, (pattern, group, least) in BASE.items():
        known = matches(f"parts_{kind}", pattern, group)
        found.append(F.transform(F.filter(known, long_enough(group, least)), of_kind(kind)))
    return F.array_sort(F.concat(*found))


def dense_windows(text: Column, alphabet: str, window: int, bits: float) -> Column:
    """The stretches of ``text`` covered by windows whose Shannon entropy is at least ``bits`` a character.

    One pass: a letter that enters and one that leaves change two counts, and the
    sum of c * log2(c) over the counts changes by their differences alone.  The
    entropy of a window of w letters is log2(w) less that sum over w.
    """
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    most = window * (math.log2(window) - bits)
    place = F.transform(F.split(text, ""), lambda ch: F.instr(F.lit(alphabet), ch) - 1)
    leaving = F.concat(F.array_repeat(F.lit(-1), window), place)
    steps = F.zip_with(place, F.slice(leaving, 1, F.length(text)), lambda a, b: F.struct(a.alias("enters"), b.alias("leaves")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    zero = F.struct(
        F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("seen"), none.alias("found")
    )

    def step(a: Column, x: Column) -> Column:
        same = x["enters"] == x["leaves"]
        more, less = F.get(a["counts"], x["enters"]), F.coalesce(F.get(a["counts"], x["leaves"]), F.lit(0))
        w = lambda c: F.get(weight, c)
        change = F.when(same, F.lit(0.0)).otherwise(w(more + 1) - w(more) + F.when(less > 0, w(less - 1) - w(less)).otherwise(F.lit(0.0)))
        counts = F.transform(a["counts"], lambda c, k: c + (k == x["enters"]).cast("int") - (k == x["leaves"]).cast("int"))
        total, seen = a["sum"] + change, a["seen"] + 1
        here = F.struct((seen - window).alias("start"), seen.alias("end"))
        last = F.get(a["found"], F.size(a["found"]) - 1)
        longer = F.concat(F.slice(a["found"], 1, F.greatest(F.size(a["found"]) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), seen.alias("end"))))
        joined = F.when(last["end"] >= seen - window, longer).otherwise(F.concat(a["found"], F.array(here)))
        hit = (seen >= window) & (total <= most + 1e-9)
        return F.struct(counts.alias("counts"), total.alias("sum"), seen.alias("seen"), F.when(hit, joined).otherwise(a["found"]).alias("found"))

    # where even the most mixed window of the letters present stays below the bound, none is looked at
    return F.when(F.size(F.array_distinct(place)) >= math.ceil(2**bits - 1e-9), F.aggregate(steps, zero, step, lambda a: a["found"])).otherwise(none)


def without_examples(text: Column) -> Column:
    """The text with example words that stand alone blanked by as many signs, which no dense window spans."""
    for word in EXAMPLES:
        text = F.regexp_replace(text, f"(?i)(?<![A-Za-z0-9]){word}(?![A-Za-z0-9])", "-" * len(word))
    return text


def allowed_stretch(text: Column, kind: str, s: Column) -> Column:
    """Whether a stretch is like words, or an example word has a letter in it."""
    body = F.substring(text, s["start"] + 1, s["end"] - s["start"])
    seldom = F.lit(False) if kind == "entropy_hex" else F.regexp_count(body, F.lit(CHANGE)) * CHANGE_EVERY < F.length(body)
    for word in EXAMPLES:
        first = F.greatest(s["start"] - (len(word) - 1), F.lit(0))
        seldom = seldom | F.contains(F.lower(F.substring(text, first + 1, s["end"] + len(word) - 1 - first)), F.lit(word))
    return seldom


def not_allowed(text: Column, kind: str) -> Callable[[Column], Column]:
    return lambda s: ~allowed_stretch(text, kind, s)


def entropy_spans(base: Column) -> Column:
    """Spans of high entropy in the candidates of column parts_candidate that the allow-list leaves and base spans cover less than half of."""

    def of_candidate(m: Column) -> Column:
        found = F.array().cast(SPAN)
        for kind, (shape, alphabet, window, bits) in reversed(CLASSES.items()):
            text = F.lower(m["text"]) if kind == "entropy_hex" else m["text"]
            dense = F.filter(dense_windows(text, alphabet, window, bits), not_allowed(m["text"], kind))
            found = F.when(m["text"].rlike(shape), F.transform(dense, shifted(m["start"], kind))).otherwise(found)
        return found

    def covered(s: Column) -> Column:
        common = lambda b: F.least(b["end"], s["end"]) - F.greatest(b["start"], s["start"])
        return F.exists(base, lambda b: 2 * common(b) >= s["end"] - s["start"])

    open_ = F.filter(matches("parts_candidate", CANDIDATE), lambda m: ~m["text"].rlike("|".join(f"(?:{p})" for p in ALLOW)))
    known = F.transform(open_, lambda m: F.struct(without_examples(m["text"]).alias("text"), (m["end"] - F.length(m["text"])).alias("start")))
    return F.filter(F.flatten(F.transform(known, of_candidate)), lambda s: ~covered(s))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy.

    Base kinds are shapes of secrets, matched leftmost and without overlap.  The
    entropy kinds add stretches of candidate strings in which sliding windows are
    as mixed as random letters of their class.  Places are code points, ends
    exclusive.  An added span that a base span covers by half or more is left out,
    as the secret is already listed.  A null text counts as empty; texts without spans get empty lists.
    Repeated rows give a row each, an empty table gives none, and other columns
    are not read.  All rows are scanned where they lie: nothing is shuffled.  Ids may
    be of any type; a text of any length is scanned whole, in memory.
    """
    t = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("body"))
    patterns = {k: v[0] for k, v in BASE.items()} | {"candidate": CANDIDATE}
    t = t.select("doc_id", *[split_at(F.col("body"), p).alias(f"parts_{k}") for k, p in patterns.items()])
    t = t.withColumn("base", base_spans())
    t = t.withColumn("added", entropy_spans(F.col("base")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return t.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_entropy"),
    )
