"""License scans: MinHash bands over overlapping text windows find templates, exact shingle containment confirms them.

Templates are grouped by length; a group of up to S shingles is searched in windows of 2 S shingles, S apart, so that
any quotation lies whole in some window. A band is one MinHash value; their number follows from the smallest similarity
that a window with a quotation can have.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHINGLE_WORDS, MIN_CONTAINMENT = 5, 0.8
#: A window with a quotation shares no band with its template with this probability at most.
MISS = 1e-5
#: Templates of at most so many characters are sent to all executors; more are joined by a shuffle.
BROADCAST_CHARS = 1 << 20
#: Public license notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    *[(f"{short}-{v}", text.format(short=short.replace("CC-", "CC "), name=name, v=v, port=port))
      for short, name in (("CC-BY", "Attribution"), ("CC-BY-SA", "Attribution-ShareAlike"),
                          ("CC-BY-NC", "Attribution-NonCommercial"), ("CC-BY-ND", "Attribution-NoDerivatives"),
                          ("CC-BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                          ("CC-BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
      for v, port in (("4.0", "International"), ("3.0", "Unported"))
      for text in ("Licensed under {short} {v}.", "Licensed under a Creative Commons {name} {v} {port} License.")],
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
                "this work."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    # Versions of one family differ in few words: short enough that another version falls below MIN_CONTAINMENT.
    *[(f"{short}-{v}", text.format(name=name, v=v, whole=v.removesuffix(".0")))
      for short, name, versions in (("GPL", "GNU", ("2.0", "3.0")), ("LGPL", "GNU Lesser", ("2.1", "3.0")),
                                    ("AGPL", "GNU Affero", ("3.0",)))
      for v in versions
      for text in ("{name} General Public License, version {whole}.", "the {name} General Public License v{v}.",
                   "under the terms of the {name} General Public License as published by the Free Software Foundation, "
                   "either version {whole} of the License")],
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MPL-2.0", "Licensed under the Mozilla Public License 2.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
                "License 2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
]


def _words(text: Column) -> Column:
    """Lower-case words of letters and digits; no words give an empty array."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.length(plain) > 0, F.split(plain, " ")).otherwise(F.array().cast("array<string>"))


def _shingle(words: Column, i: Column) -> Column:
    """Hash of the five words from number i (from 0)."""
    return F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE_WORDS)])


def _shingles(words: str) -> Column:
    """Hashes of all shingles of a column of words; none if there are fewer words."""
    last = F.size(words) - SHINGLE_WORDS
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: _shingle(F.col(words), i))).otherwise(
        F.array().cast("array<bigint>"))


def _templates(spark, templates) -> DataFrame:
    """(license, template, grams, hashes, span): distinct shingles as text and hash; span is S of the template's group."""
    rows = spark.createDataFrame([(n, k, t) for k, (n, t) in enumerate(templates)], "license string, template int, t string")
    rows = rows.select("license", "template", _words(F.col("t")).alias("w"))
    rows = rows.select("*", _shingles("w").alias("h")).where(F.size("h") > 0)
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - SHINGLE_WORDS), lambda i: F.array_join(
        F.slice("w", i + 1, F.lit(SHINGLE_WORDS)), " "))
    span = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("h").cast("double")))).cast("int")
    return rows.select("license", "template", F.array_distinct(grams).alias("grams"), F.array_distinct("h").alias("hashes"),
                       span.alias("span"))


def bands(span: int, grams: int) -> int:
    """Number of bands for templates of ``grams`` distinct shingles or more in windows of 2 * ``span``."""
    shared = math.ceil(MIN_CONTAINMENT * grams)
    similarity = shared / (2 * span + grams - shared)
    return 1 if similarity >= 1 else math.ceil(math.log(MISS) / math.log(1 - similarity))


def _signature(hashes: Column, n: int) -> Column:
    """The n MinHash values of an array of shingle hashes."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.array_min(F.transform(
        hashes, lambda h: F.xxhash64(h, b))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates=None) -> DataFrame:
    """``(doc_id, license, template, first_word, containment)``: the templates that a document quotes.

    A window quotes a template if it holds at least MIN_CONTAINMENT of its distinct five-word shingles; case,
    punctuation and white space don't count. One row for each row of ``docs`` and template, from the window of largest
    containment, then the first. Templates of fewer than five words and null, empty or shorter texts give nothing;
    repeated rows give repeated results; an empty table gives no rows. Whole texts are scanned. Only windows around
    shingles of templates get a signature: in others no band can agree.
    """
    known = _templates(docs.sparkSession, TEMPLATES if templates is None else templates)
    groups = known.select("span", F.size("hashes").alias("n"), "hashes").collect()   # a bounded list of templates
    spans = {s: min(x["n"] for x in groups if x["span"] == s) for s in sorted({x["span"] for x in groups})}
    if not spans:
        return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.lit("").alias("license"), F.lit(0).alias("template"),
                           F.lit(0).alias("first_word"), F.lit(0.0).alias("containment")).limit(0)
    listed = sorted({h for x in groups for h in x["hashes"]})
    of_templates = F.array(*[F.lit(h) for h in listed])
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), _words(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("w"))
    rows = rows.select("doc_id", "w", _shingles("w").alias("h"))
    # Nothing is filtered before it is exploded: the optimizer would move the filter, and with it all work, into the scan.
    hits = F.when(F.arrays_overlap("h", of_templates), F.filter(
        F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.array_contains(of_templates, F.get("h", i))))
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "w", "h", hits.alias("hits"))

    def windows(span: int) -> Column:
        first = F.array_distinct(F.flatten(F.transform("hits", lambda i: F.when(i >= span, F.array(
            F.floor(i / span).cast("int"), F.floor(i / span).cast("int") - 1)).otherwise(F.array(F.lit(0))))))
        n = bands(span, spans[span])
        return F.transform(first, lambda k: F.struct(
            F.lit(span).alias("span"), (k * span).alias("first_word"),
            F.slice("w", k * span + 1, F.lit(2 * span + SHINGLE_WORDS - 1)).alias("w"),
            _signature(F.slice("h", k * span + 1, F.lit(2 * span)), n).alias("bands")))

    rows = rows.select("doc_id", "row", F.explode_outer(
        F.when(F.size("hits") > 0, F.flatten(F.array(*[windows(s) for s in spans])))).alias("x"))
    marked = rows.where(F.col("x").isNotNull()).select("doc_id", "row", "x.span", "x.first_word", "x.w",
                                                       F.posexplode_outer("x.bands").alias("band", "value"))
    index = None
    for span in spans:
        own = known.where(F.col("span") == span).select("license", "template", "grams", F.col("span").alias("of_span"),
                                                        _signature(F.col("hashes"), bands(span, spans[span])).alias("b"))
        index = own if index is None else index.unionByName(own)
    index = index.select("license", "template", "grams", "of_span", F.posexplode("b").alias("of_band", "of_value"))
    if sum(len(t) for _, t in (TEMPLATES if templates is None else templates)) <= BROADCAST_CHARS:
        index = F.broadcast(index)
    found = marked.join(index, (F.col("span") == F.col("of_span")) & (F.col("band") == F.col("of_band"))
                        & (F.col("value") == F.col("of_value")))
    out = found.groupBy("row", "first_word", "span", "template").agg(
        *[F.any_value(c).alias(c) for c in ("doc_id", "license", "w", "grams")])
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - SHINGLE_WORDS), lambda i: F.array_join(
        F.slice("w", i + 1, F.lit(SHINGLE_WORDS)), " "))
    out = out.withColumn("containment", F.size(F.array_intersect("grams", grams)) / F.size("grams"))
    out = out.where(F.col("containment") >= MIN_CONTAINMENT)
    best = W.partitionBy("row", "template").orderBy(F.desc("containment"), "first_word")
    return out.withColumn("r", F.row_number().over(best)).where("r = 1").select(
        "doc_id", "license", "template", "first_word", "containment")


def oracle_sql(relation: str = "documents", templates=None) -> str:
    """DuckDB statement for (doc_id, license, template, containment): every window against every template, no bands."""
    listed = ", ".join("({}, '{}', '{}')".format(k, n, t.replace("'", "''"))
                       for k, (n, t) in enumerate(TEMPLATES if templates is None else templates))
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(SHINGLE_WORDS))
    clean = r"string_split(trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"
    return rf"""
with t as (select * from (values {listed}) v(template, license, t)),
tw as (select template, license, {clean.format('t')} as w from t),
tg as (select distinct template, license, {gram} as g from (select *, unnest(range(1, len(w) - 3)) as i from tw)),
ts as (select template, count(*) as n, (select pow(2, ceil(log2(len(w) - 4))) from tw where tw.template = tg.template)::int
  as span from tg group by template),
d as (select doc_id, {clean.format('text')} as w from {relation} where text is not null),
g as (select doc_id, i - 1 as i, {gram} as g from (select *, unnest(range(1, len(w) - 3)) as i from d)),
hit as (select doc_id, template, license, g, i, n, span from g join tg using (g) join ts using (template)),
win as (select *, i // span as k from hit union all select *, i // span - 1 as k from hit where i >= span),
c as (select doc_id, template, license, k, count(distinct g) / any_value(n) as containment from win group by all)
select doc_id, license, template, max(containment) as containment from c where containment >= {MIN_CONTAINMENT}
group by all"""
