"""Licence scan by diagonal voting (native: DataFrame functions only).

Every text is cut into rolling word 3-grams; their hashes meet the 3-grams of a fixed set of templates in one broadcast
join (the templates are constants of this module, under 200 KB). A hit votes for the diagonal
``word position - template position`` of its document; votes are aggregated per diagonal, diagonals at most ``slack``
words apart are merged, and a merged span is accepted when enough of the template's words stand in it.

Edge cases: a null text counts as empty and has no words; rows alike in doc_id and text are scanned once and returned as
often as they came; null ids are kept; other columns are not read. A hash hit counts only if the three words are equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from halocline.llm import common as C

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K, LONGEST = 3, 64

# Phrases whose every place counts, and the label of each.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# The sentences of well-known public licences and of the notices that name them, in lower-case words. A
# sentence of more than LONGEST words stands in several rows, so that the 3-grams of a row fit a mask of 64 bits.
TEMPLATES = [
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("apache-2", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2", "see the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsl-1", "distributed under the boost software license version 1 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
    ("proprietary", "in any form or by any means without the prior written permission of the publisher"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
]
SLACK, COVERAGE = 3, 0.6


def template_grams() -> list[tuple[int, str, bool, int, int, int, str]]:
    """(template, label, is a phrase, its words, its 3-grams, position, 3-gram), a row for each 3-gram."""
    out = []
    for t, (label, text, phrase) in enumerate([(a, b, True) for a, b in PHRASES] + [(a, b, False) for a, b in TEMPLATES]):
        w = text.split()
        for p in range(len(w) - K + 1):
            out.append((t, label, phrase, len(w), len(w) - K + 1, p, " ".join(w[p : p + K])))
    return out


def _values() -> str:
    return ", ".join(f"({t}, '{a}', {str(b).lower()}, {n}, {g}, {p}, '{s}')" for t, a, b, n, g, p, s in template_grams())


def license_spans(docs: DataFrame, slack: int = SLACK, coverage: float = COVERAGE) -> DataFrame:
    """A row per document: doc_id, n_words, spans array<struct<label, phrase, start_word, end_word, coverage>> (accepted
    spans in word order; of a phrase, every exact place)."""
    spark = docs.sparkSession
    templates = spark.sql(f"SELECT *, xxhash64(t_gram) AS t_hash FROM VALUES {_values()} AS t(tid, label, phrase, t_words, t_grams, t_pos, t_gram)")
    text = docs.select("doc_id", C.whole_text().alias("text"))
    # The words are bound to a name once: what stands in a lambda over positions would else be evaluated for each of them.
    # Position 0 is a row of the document itself, so that one pass keeps documents without a hit.
    found = F.transform(F.array(C.words(C.ascii_lower(F.col("text")), WORD)), lambda w: F.struct(
        F.size(w).alias("n_words"),
        F.concat(F.array(F.lit("")), F.when(F.size(w) >= K, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - K, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(K)]))).otherwise(F.array().cast("array<string>"))).alias("grams"),
    ))
    grams = text.select("doc_id", F.xxhash64("text").alias("th"), F.inline(found)).select("doc_id", "th", "n_words", F.posexplode("grams").alias("p", "gram")).withColumn("hash", F.xxhash64("gram"))
    hits = grams.join(F.broadcast(templates), (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")), "left").where("p = 0 OR tid IS NOT NULL")
    hits = hits.select("doc_id", "th", "n_words", "tid", "label", "phrase", "t_words", "t_grams", (F.col("p") - 1 - F.col("t_pos")).alias("diagonal"), F.expr("if(tid IS NULL, 0L, shiftleft(1L, t_pos))").alias("bit"), F.expr("if(tid IS NULL, 1L, 0L)").alias("own"))
    votes = hits.groupBy("doc_id", "th", "tid", "label", "phrase", "t_words", "t_grams", "diagonal").agg(F.bit_or("bit").alias("mask"), F.max("n_words").alias("n_words"), F.sum("own").alias("copies"))
    votes = votes.repartition("doc_id", "th")
    line = W.partitionBy("doc_id", "th", "tid").orderBy("diagonal")
    # Phrases must stand word for word: no merging of their diagonals.
    votes = votes.withColumn("apart", F.expr("if(phrase, 0, %d)" % slack)).withColumn("new", (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > F.col("apart"), F.lit(True))).cast("int"))
    votes = votes.withColumn("island", F.sum("new").over(line))
    spans = votes.groupBy("doc_id", "th", "tid", "label", "phrase", "t_words", "t_grams", "island").agg(
        F.min("diagonal").alias("lo"), F.max("diagonal").alias("hi"), F.bit_or("mask").alias("mask"), F.max("n_words").alias("n_words"), F.sum("copies").alias("copies")
    )
    # The words that the voted 3-grams cover: the mask and its two shifts.
    spans = spans.withColumn("covered", F.expr("bit_count(mask | shiftleft(mask, 1) | shiftleft(mask, 2)) / t_words")).withColumn("ok", F.expr(f"tid IS NOT NULL AND if(phrase, bit_count(mask) = t_grams, covered >= {coverage} AND hi - lo <= t_words)"))
    span = F.when(F.col("ok"), F.struct(F.greatest("lo", F.lit(0)).cast("long").alias("start_word"), F.least(F.col("hi") + F.col("t_words"), F.col("n_words")).cast("long").alias("end_word"), "label", "phrase", F.col("covered").alias("coverage")))
    out = spans.groupBy("doc_id", "th").agg(F.max("n_words").cast("long").alias("n_words"), F.sum("copies").alias("copies"), F.array_sort(F.collect_list(span)).alias("spans"))
    return out.select("doc_id", "n_words", "spans", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_spans(C.parquet(spark, sf_dir, "documents"))
    return found.selectExpr(
        "doc_id", "n_words", "cast(size(filter(spans, s -> s.phrase)) AS bigint) AS n_base",
        "array_min(transform(filter(spans, s -> s.phrase), s -> s.start_word)) AS first_word",
        "array_max(transform(filter(spans, s -> s.phrase), s -> s.start_word)) AS last_word",
        "array_join(array_sort(array_distinct(transform(filter(spans, s -> s.phrase), s -> s.label))), ',') AS base_labels",
        "array_join(array_sort(array_distinct(transform(spans, s -> s.label))), ',') AS labels",
        "round(coalesce(array_max(transform(spans, s -> s.coverage)), 0D), 6) AS score",
    )


SQL = f"""
WITH t(tid, label, phrase, t_words, t_grams, t_pos, t_gram) AS (VALUES {_values()}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(0, len(w) - {K - 1})) AS p, w FROM d WHERE len(w) >= {K}),
h AS (SELECT doc_id, p - t_pos AS diagonal, t.* FROM (SELECT doc_id, p, concat_ws(' ', w[p + 1], w[p + 2], w[p + 3]) AS gram FROM g) JOIN t ON gram = t_gram),
v AS (SELECT doc_id, tid, label, phrase, t_words, t_grams, diagonal, bit_or(1::BIGINT << t_pos) AS mask FROM h GROUP BY ALL),
f AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) <= CASE WHEN phrase THEN 0 ELSE {SLACK} END THEN 0 ELSE 1 END AS fresh FROM v),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, tid ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS island FROM f),
s AS (SELECT doc_id, tid, label, phrase, t_words, t_grams, island, min(diagonal) AS lo, max(diagonal) AS hi, bit_or(mask) AS mask FROM i GROUP BY ALL),
k AS (SELECT *, bit_count(mask | (mask << 1) | (mask << 2))::DOUBLE / t_words AS covered FROM s),
ok AS (SELECT *, greatest(lo, 0) AS start_word FROM k WHERE CASE WHEN phrase THEN bit_count(mask) = t_grams ELSE covered >= {COVERAGE} AND hi - lo <= t_words END)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, count(*) FILTER (phrase)::BIGINT AS n_base,
  (min(start_word) FILTER (phrase))::BIGINT AS first_word, (max(start_word) FILTER (phrase))::BIGINT AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, round(coalesce(max(covered), 0::DOUBLE), 6) AS score
FROM d LEFT JOIN ok ON d.doc_id = ok.doc_id GROUP BY d.doc_id, len(d.w)
"""
