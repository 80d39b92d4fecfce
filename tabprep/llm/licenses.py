"""License scans: MinHash bands over text windows retrieve templates, shingle containment verifies them."""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import quoted
from .ranks import BROADCAST_ROWS
from .scratch import Scratch

#: Public license lines and notices.  Whole license texts lie in ``license_texts``.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "mit-line": "Released under the MIT License",
    "mit-line-2": "Licensed under the MIT License",
    "mit-line-3": "under the terms of the MIT license",
    "bsd-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-sa-line": "Text is available under the Creative Commons Attribution-ShareAlike License",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3",
    "mpl-2.0-line": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
    " distributed with this file, You can obtain one at",
    "apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"
    " as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"
    " as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public"
    " License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public"
    " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
}
#: Words, words in a shingle, and least part of a template's shingles.
WORD, SHINGLE, LEAST = r"[\p{L}\p{N}]+", 5, 0.8
#: Words of the shortest windows, by how much windows grow from level to level, and the bands of a level: short windows have
#: far more than shingles, so that hardly two shingles share one, long windows fewer.
FIRST, GROW, BANDS = 16, 4, {16: 1 << 16, 64: 1 << 10}
FEWEST_BANDS = 1 << 9


def whole_texts() -> dict[str, str]:
    """The whole license texts, by name."""
    return {p.stem.lower(): p.read_text() for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def words_of(body: Column) -> Column:
    return F.regexp_extract_all(F.lower(body), F.lit(WORD), F.lit(0))


def count_words(text: str) -> int:
    return len(re.findall(r"[^\W_]+", text))


def window_words(words: int) -> int:
    """Words of a window for a template of so many: half of it holds the template."""
    width = FIRST
    while width < 2 * words:
        width *= GROW
    return width


def bands_of(width: int) -> int:
    return BANDS.get(width, FEWEST_BANDS)


def collision_probability(words: int) -> float:
    """The probability that a template's bands meet those of a window that holds LEAST of its shingles.

    Each hash belongs to the band of its leading bits, where the least counts.  A
    shingle of both is the least of its band in both if none of the others there
    is less; those that share its band are a Poisson number.
    """
    own, there = words - SHINGLE + 1, window_words(words) - SHINGLE + 1
    both = math.ceil(LEAST * own)
    others = (there + own - both - 1) / bands_of(window_words(words))
    first = -math.expm1(-others) / others if others else 1.0
    # of the shingles of a band one alone can be first, so no more bands count than have one
    trials = bands_of(window_words(words)) * -math.expm1(-both / bands_of(window_words(words)))
    return 1 - (1 - first) ** trials if first < 1 else 1.0


def with_shingles(words: DataFrame) -> DataFrame:
    """Adds the hashes of the shingles, in order, to rows with ``words``; shorter texts have none."""
    t = words.selectExpr("*", "transform(words, w -> xxhash64(w)) AS hashes").drop("words")
    five = ", ".join(f"get(hashes, i + {k})" for k in range(SHINGLE))
    starts = f"CASE WHEN size(hashes) >= {SHINGLE} THEN sequence(0, size(hashes) - {SHINGLE}) ELSE array() END"
    return t.selectExpr("*", f"transform({starts}, i -> xxhash64({five})) AS shingles").drop("hashes")


def signature(hashes: str, width: int) -> str:
    """SQL of the MinHash signature of an array of hashes: the least one of each band that has any, where the leading bits tell the band."""
    band = lambda x: f"shiftright({x}, {64 - int(math.log2(bands_of(width)))})"
    return f"transform(array(sort_array({hashes})), s -> filter(s, (x, i) -> i = 0 OR {band('x')} <> {band('get(s, i - 1)')}))[0]"


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """Rows (license, width, own): a template's window length and its distinct shingles."""
    rows = [(name, window_words(count_words(text)), text) for name, text in templates.items()]
    given = spark.createDataFrame(rows, "license string, width int, body string").select("license", "width", words_of(F.col("body")).alias("words"))
    return with_shingles(given).selectExpr("license", "width", "array_distinct(shingles) AS own")


def windows(t: DataFrame, least: dict[int, int]) -> DataFrame:
    """Rows (doc_id, text_key, width, window, value): the values of all bands of all windows of texts with so many shingles as a template there needs.

    A segment is half a window.  Segments of a level are joined to those of the
    next, and two neighbours to a window; signatures of parts give the whole's.
    """
    width, keys = FIRST, ["doc_id", "text_key"]
    half = FIRST // 2
    t = t.selectExpr("*", f"transform(sequence(0, greatest(0, CAST(ceil(size(shingles) / {half}) AS INT) - 1)), s -> slice(shingles, s * {half} + 1, {half})) AS parts")
    found = []
    while True:
        if width in least:
            pair = "concat(get(parts, s), coalesce(get(parts, s + 1), array()))"
            each = f"transform(sequence(0, size(parts) - 1), s -> struct({width} AS width, s * {width // 2} AS window, {signature(pair, width)} AS least))"
            name = f"at_{width}"
            t = t.selectExpr("*", f"CASE WHEN size(shingles) >= {least[width]} THEN {each} ELSE array() END AS {name}")
            found.append(name)
        if width >= max(least):
            break
        width *= GROW
        merged = signature(f"flatten(slice(parts, s * {GROW} + 1, {GROW}))", width)
        rest = [c for c in t.columns if c != "parts"]
        t = t.selectExpr(*rest, f"transform(sequence(0, CAST(ceil(size(parts) / {GROW}) AS INT) - 1), s -> {merged}) AS parts")
    each = t.selectExpr(*keys, f"inline(concat({', '.join(found)}))")
    return each.selectExpr(*keys, "width", "window", "explode(least) AS value")


def that_may_meet(texts: DataFrame, index: DataFrame) -> DataFrame:
    """``texts``, those without shingles that share no value with the kept ``index``.

    A band's value is one of the text's shingle hashes, so such a text meets no
    template by any band of any window, and needs no signatures.  Where the index
    has more than BROADCAST_ROWS values, all texts keep their shingles.
    """
    if index.count() > BROADCAST_ROWS:
        return texts
    values = index.agg(F.collect_set("value")).scalar()
    shared = F.when(F.arrays_overlap("shingles", values), F.col("shingles")).otherwise(F.array().cast("array<bigint>"))
    return texts.withColumn("shingles", shared)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and license found: doc_id, license, containment, window (its first word), windows.

    Texts and templates become lower-cased words of letters and digits, and these
    shingles.  Each level cuts every text into overlapping windows, twice as long
    at least as the templates of the level.  The bands of a window's MinHash
    signature meet those of the templates in a join; ``collision_probability``
    says how surely.  A template is found if LEAST of its shingles stand in a
    window that met it.

    The index depends on the templates alone, and it and the windows met are
    broadcast only if they have BROADCAST_ROWS rows at most.  Templates shorter
    than a shingle are left out.  Null and short texts hold no license; very long
    ones are read whole.  Repeated rows are reported each; an empty table gives
    no rows.  Ids must be whole numbers.
    """
    spark = docs.sparkSession
    known = {k: v for k, v in (TEMPLATES | whole_texts() if templates is None else templates).items() if count_words(v) >= SHINGLE}
    scratch = Scratch(spark, "licenses")
    table = scratch.keep(template_table(spark, known))
    least = {r[0]: math.ceil(LEAST * r[1]) for r in table.groupBy("width").agg(F.min(F.size("own"))).collect()}  # a row for each level
    body, ident = F.coalesce(F.col(quoted(text)), F.lit("")), F.col(quoted(doc_id)).cast("long")
    given = docs.select(F.coalesce(ident, F.lit(-1)).alias("doc_id"), F.xxhash64(body, ident).alias("text_key"), ident.isNull().alias("none"), words_of(body).alias("words"))
    small = lambda t: F.broadcast(t) if t.count() <= BROADCAST_ROWS else t
    index = None
    for width in sorted(least):
        own = table.where(F.col("width") == width).selectExpr("license", "width", f"explode({signature('own', width)}) AS value")
        index = own if index is None else index.union(own)
    index = scratch.keep(index)
    # no filter on shingles here: it would be pushed below them, and work them out once for each shingle
    met = windows(that_may_meet(with_shingles(given.drop("none")), index), least).join(small(index), ["width", "value"]).select("doc_id", "text_key", "width", "window", "license").distinct()
    asked = scratch.keep(met.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("width", "window", "license")).alias("asked")))
    t = with_shingles(given.join(small(asked), ["doc_id", "text_key"]))
    t = t.selectExpr("doc_id", "text_key", "none", "shingles", "inline(asked)").join(small(table.drop("width")), "license")
    inside = f"slice(shingles, window + 1, width - {SHINGLE - 1})"
    keys = ["doc_id", "text_key", "none", "license"]
    each = t.selectExpr(*keys, "window", f"size(array_intersect({inside}, own)) / size(own) AS containment").where(f"containment >= {LEAST}")
    best = F.max_by("window", F.struct("containment", -F.col("window")))
    # repeated rows meet together, each with the same windows
    sums = [F.max("containment").alias("containment"), best.alias("window"), F.count_distinct("window").alias("windows"), F.count(F.lit(1)).alias("rows")]
    found = each.groupBy(*keys).agg(*sums).withColumn("copy", F.explode(F.sequence(F.lit(1), F.expr("rows div windows"))))
    return found.select(F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"), "license", "containment", "window", "windows")
