"""License notices in texts, in DataFrame functions only.

A text's word shingles are cut into overlapping windows. Each window's MinHash values, one for
each band, are looked up among those of the templates' windows; a window that shares a share ``j``
of its shingles with a template's agrees in a band with chance j, so in none of ``BANDS`` with
(1 - j) ** BANDS: 4e-7 where 3 of 5 are shared, 0.001 for 1 of 3. Every band has a hash function of
its own. Templates of fewer shingles than a window's are looked up by their shingles as well, so
they are met with certainty. What is retrieved is verified by exact containment of shingles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

WIDTH, WINDOW, STRIDE, BANDS = 5, 4, 2, 16

#: Public license notices, as they are commonly written.
TEMPLATES = {
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-short": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
}


def shingles(text) -> F.Column:
    """64-bit hashes of the 5-word shingles of a text: runs of letters and digits, lower-cased."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    each = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WIDTH), lambda i: F.xxhash64(*[w[i + k] for k in range(WIDTH)]))
    return F.transform(F.array(words), lambda w: F.when(F.size(w) >= WIDTH, each(w)).otherwise(F.array().cast("array<bigint>")))[0]


def _windows(hashes, stride: int) -> F.Column:
    """Structs of a window's place and its shingles; the last windows may be shorter."""
    cut = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 1, F.lit(stride)), lambda i: F.struct(i.alias("at"), *[F.get(h, i + k).alias(f"h{k}") for k in range(WINDOW)]))
    return F.transform(F.array(hashes), lambda h: F.when(F.size(h) > 0, cut(h)))[0]


def _signatures(df: DataFrame, *keep: str, stride: int) -> DataFrame:
    """A row for each window and band with the band's MinHash ``value``, the smallest of the window's
    shingles' hashes by the band's own function; and for each place of the stride a row of band
    ``-1 - place`` with the shingle itself. Places past the text's end are null and do not count.
    Bands are rows, not columns: the compiled code stays small."""
    rows = df.select(*keep, F.inline(_windows(F.col("h"), stride))).select("*", F.explode(F.sequence(F.lit(-stride), F.lit(BANDS - 1))).alias("band"))
    banded = F.least(*[F.when(F.col(f"h{i}").isNotNull(), F.xxhash64("band", f"h{i}")) for i in range(WINDOW)])
    plain = F.when(F.col("band") == -1, F.col("h0"))
    for i in range(1, stride):
        plain = plain.when(F.col("band") == -1 - i, F.col(f"h{i}"))
    return rows.select(*keep, "at", "band", F.when(F.col("band") >= 0, banded).otherwise(plain).alias("value"))


def templates(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """``license, h`` of the templates; at most some hundreds of short texts."""
    return spark.createDataFrame(list((texts or TEMPLATES).items()), "license string, notice string").select("license", shingles(F.col("notice")).alias("h"))


def scan(docs: DataFrame, texts: dict[str, str] | None = None, containment: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, license, n_matched, n_template, containment, at``: notices found in whole texts.

    A row for each document and template of whose distinct shingles the document holds the share
    ``containment`` or more; ``at`` is the word where the first retrieving window begins. Null,
    empty and short texts (under 5 words) match nothing; repeated ids are judged together; rows
    with null ids are left out, as no result could name them; texts of any length are read whole;
    empty tables give no row; further columns are ignored.
    """
    spark = docs.sparkSession
    known = templates(spark, texts).persist()
    signs = _signatures(known, "license", stride=1)
    size = {r["license"]: r["n"] for r in known.select("license", F.size("h").alias("n")).collect()}
    # whole windows, or the only one; the shingles themselves of templates without a whole window
    rows = [r for r in signs.collect() if (r["at"] <= max(0, size[r["license"]] - WINDOW) if r["band"] >= 0 else size[r["license"]] < WINDOW)]
    by_value = spark.createDataFrame(sorted({(r["value"], r["license"]) for r in rows}), "value long, license string")

    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    hit = _signatures(named.select("id", shingles(F.col("text")).alias("h")), "id", stride=STRIDE)
    met = hit.where(F.expr(f"value IN ({', '.join(str(v) for v in sorted({r['value'] for r in rows}))})")).join(F.broadcast(by_value), "value").groupBy("id", "license").agg(F.min("at").cast("long").alias("at"))
    met = materialise(met, "license-candidates")

    wanted = named.join(met.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.collect_set("text").alias("t"))
    sets = wanted.select("id", F.array_distinct(F.flatten(F.transform("t", shingles))).alias("s"))
    exact = F.size(F.array_intersect("h", "s")).cast("long")
    out = met.join(sets, "id").join(F.broadcast(known.select("license", F.array_distinct("h").alias("h"))), "license").select(F.col("id").alias(id_col), "license", exact.alias("n_matched"), F.size("h").cast("long").alias("n_template"), "at")
    return out.withColumn("containment", F.col("n_matched") / F.col("n_template")).where(F.col("containment") >= containment).select(id_col, "license", "n_matched", "n_template", "containment", "at")
