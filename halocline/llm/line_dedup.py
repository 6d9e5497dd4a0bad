"""Line dedup over the whole corpus (native: DataFrame functions only).

Hashes of long lines are range-partitioned with a secondary sort by document and position; each run streams its first
occurrence per document, and the runs of one line (a line is dealt over ``salts`` runs, so that a line found in a third
of all documents does not meet in one task) are merged by sums. Lines found in many documents are broadcast to the lines
(they are few by their number), the others joined. What comes back is not text but a bitmap of kept lines
per document, compressed to the 64-line words in which something goes.

Edge cases: a null or empty text is one empty line; rows alike in doc_id and text count as one document and come back as
often as they came; of rows that share a doc_id, all count as the document that keeps the line if that id is the largest;
a null doc_id is smaller than any other. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from halocline.llm import common as C

MIN_CHARS, MIN_DOCS, SALTS, MOST_HOT = 40, 5, 64, 100_000


def _key(line: str) -> str:
    """SQL of a line's key: stripped of ASCII white space and lower-cased (A-Z)."""
    return f"translate(btrim({line}, ' \\t\\n\\u000b\\u000c\\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", C.whole_text().alias("text")).withColumn("th", F.xxhash64("text"))


def _long_lines(texts: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, th, pos, h: a row per line whose key has min_chars code points or more."""
    hashed = F.expr(f"transform(transform(split(text, '\\n', -1), l -> {_key('l')}), k -> if(length(k) >= {min_chars}, xxhash64(k), NULL))")
    return texts.select("doc_id", "th", F.posexplode(hashed).alias("pos", "h")).where("h IS NOT NULL")


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, salts: int = SALTS) -> DataFrame:
    """doc_id, th (xxhash64 of the text), keep map<int, bigint>: for each 64-line word that loses a line, the bits of the
    lines that stay. Documents that lose nothing have no row."""
    lines = C.materialise(_long_lines(_texts(docs), min_chars), "lines")
    ranged = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "th"), F.lit(salts))).repartitionByRange("h", "salt")
    run = W.partitionBy("h", "salt").orderBy(F.desc_nulls_last("doc_id"), "th", "pos")
    firsts = ranged.withColumn("first", ~F.coalesce(F.lag("doc_id").over(run).eqNullSafe(F.col("doc_id")) & (F.lag("th").over(run) == F.col("th")), F.lit(False)))
    runs = firsts.groupBy("h", "salt").agg(F.count(F.when(F.col("first"), 1)).alias("n"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("rows"))
    repeated = C.materialise(runs.groupBy("h").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.sum("rows").alias("rows")).where(F.col("n") >= min_docs), "repeated")
    # A line with so many rows is one of MOST_HOT at most.
    hot = F.col("rows") > (repeated.agg(F.sum("rows")).first()[0] or 0) / MOST_HOT
    goes = [lines.join(side, "h").where(~F.col("doc_id").eqNullSafe(F.col("last"))) for side in (F.broadcast(repeated.where(hot)), repeated.where(~hot))]
    goes = goes[0].unionByName(goes[1])
    bits = goes.repartition("doc_id", "th").groupBy("doc_id", "th", F.expr("pos div 64").cast("int").alias("word")).agg(F.expr("~bit_or(shiftleft(1L, cast(pos % 64 AS int)))").alias("bits"))
    return bits.groupBy("doc_id", "th").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, keep, kept_text: every document with the lines that its bitmap keeps."""
    texts, keep = _texts(docs), keep_bitmaps(docs, **options).hint("shuffle_hash")
    both = texts.join(keep.withColumnsRenamed({"doc_id": "k_id", "th": "k_th"}), F.expr("doc_id <=> k_id AND th = k_th"), "left")
    both = both.withColumn("lines", F.expr("split(text, '\\n', -1)"))
    # Dense words, so that a line finds its bit by index however long the document is.
    both = both.withColumn("dense", F.expr("if(keep IS NULL, NULL, transform(sequence(0, (size(lines) - 1) div 64), w -> coalesce(element_at(keep, cast(w AS int)), -1L)))"))
    both = both.withColumn("kept", F.expr("if(keep IS NULL, lines, filter(lines, (l, i) -> getbit(dense[cast(i div 64 AS int)], i % 64) = 1))"))
    return both.select("doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), "keep", F.array_join("kept", "\n").alias("kept_text"))


#: The bitmap as text: word:bits in hexadecimal, words in order; empty where nothing goes.
KEEP = "coalesce(array_join(transform(array_sort(map_entries(keep)), e -> concat(e.key, ':', lower(lpad(hex(e.value), 16, '0')))), ';'), '')"


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(C.parquet(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"), F.expr(KEEP).alias("keep"))


SQL = f"""
WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
d AS (SELECT k.*, r.last IS NOT NULL AND k.doc_id <> r.last AS goes FROM k LEFT JOIN r ON k.key = r.key),
w AS (SELECT doc_id, (pos - 1) // 64 AS word, printf('%016x', xor(18446744073709551615::UBIGINT, bit_or(1::UBIGINT << ((pos - 1) % 64)::INTEGER))) AS bits FROM d WHERE goes GROUP BY ALL),
b AS (SELECT doc_id, string_agg(word || ':' || bits, ';' ORDER BY word) AS keep FROM w GROUP BY doc_id)
SELECT doc_id, any_value(coalesce(b.keep, '')) AS keep, count(*)::BIGINT AS n_lines, count(*) FILTER (goes)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS kept_sha256
FROM d LEFT JOIN b USING (doc_id) GROUP BY doc_id
"""
