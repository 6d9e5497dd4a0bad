"""Document fingerprints as invertible Bloom lookup sketches (native: DataFrame functions only).

A text is the set of its paragraph digests: a paragraph is a line, and a line longer than PIECE code points is cut into
pieces of that length. A digest goes into one cell of each of three tables of eight; a cell holds (count, xor of digests,
xor of check values). Two versions are compared by subtracting cell by cell and peeling: a cell with count 1 or -1 and a
fitting check value gives up its digest, which is taken out of its other cells. If cells remain, the sketch is retried
eight times as large (digests are dealt over eight sketches by further bits), for the failing part only.

Edge cases: a null text is empty, and an empty text has no paragraphs; two empty sets are alike (1.0). Repeated paragraphs
count once. Rows may repeat; each row comes back. Null ids stand last in descending order. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from halocline.llm import common as C

PIECE, ROUNDS, LEVELS = 96, 12, 13
KNOTS, IDS_PER_CELL, CELLS_PER_GROUP, BROADCAST_ROWS = 1024, 64, 4096, 1_000_000


def _digests(text: str) -> str:
    """SQL: distinct 60-bit digests of a text's paragraphs."""
    return f"array_distinct(transform(regexp_extract_all({text}, '[^\\\\n]{{1,{PIECE}}}', 0), p -> cast(conv(substr(md5(p), 1, 15), 16, 10) AS bigint)))"


def _check(key: str) -> str:
    return f"((({key}) % 2147483647) * 48271 + 11) % 2147483647"


#: The 24 cells as (shift, value): a digest is in a cell if the three bits at shift have the value.
CELLS = "array(" + ", ".join(f"named_struct('s', {3 * t}, 'v', {v}L)" for t in range(3) for v in range(8)) + ")"


def _sketch(keys: str) -> str:
    """SQL: the 24 cells of an array of digests."""
    checked = f"transform({keys}, d -> named_struct('k', d, 'x', {_check('d')}))"
    own = f"transform({CELLS}, c -> filter(z, d -> (shiftright(d.k, c.s) & 7L) = c.v))"
    return f"transform(transform(array({checked}), z -> {own})[0], s -> aggregate(s, named_struct('n', 0, 'k', 0L, 'x', 0L), (a, d) -> named_struct('n', a.n + 1, 'k', a.k ^ d.k, 'x', a.x ^ d.x)))"


def _subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (p, q) -> named_struct('n', p.n - q.n, 'k', p.k ^ q.k, 'x', p.x ^ q.x))"


def _peel(cells: str) -> str:
    """SQL: struct(cells left, a_only, b_only) after peeling. All pure cells of a round go at once."""
    pure = f"array_distinct(transform(filter(s.cells, c -> abs(c.n) = 1 AND c.x = {_check('c.k')}), c -> named_struct('k', c.k, 'n', c.n)))"
    hit = f"(shiftright(q.k, {CELLS}[i].s) & 7L) = {CELLS}[i].v"
    out = (
        "named_struct('cells', transform(t.cells, (c, i) -> aggregate(t.pure, c, (z, q) -> if(" + hit + f", named_struct('n', z.n - q.n, 'k', z.k ^ q.k, 'x', z.x ^ ({_check('q.k')})), z))), "
        "'a', s.a + size(filter(t.pure, q -> q.n = 1)), 'b', s.b + size(filter(t.pure, q -> q.n = -1)))"
    )
    # An array of one element stands for "let t be this in ..."
    step = f"if(exists(s.cells, c -> abs(c.n) = 1), transform(array(named_struct('cells', s.cells, 'pure', {pure})), t -> {out})[0], s)"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {cells}, 'a', 0, 'b', 0), (s, r) -> {step})"


def _compare(a: str, b: str) -> str:
    """SQL: struct(ok, a_only, b_only) of two arrays of digests."""
    peeled = _peel(_subtract(_sketch(a), _sketch(b)))
    return f"transform(array({peeled}), s -> named_struct('ok', NOT exists(s.cells, c -> c.n <> 0 OR c.k <> 0 OR c.x <> 0), 'a', s.a, 'b', s.b))[0]"


def _cells(docs: DataFrame) -> Column:
    """The cell of a row, from doc_id (and th, the hash of its text, where that is null): a number that never falls as doc_id
    grows. KNOTS quantiles of the ids are cut into cells of equal width, of IDS_PER_CELL ids if they lie evenly; whatever
    their spread, a cell has about 1 / KNOTS of them at most."""
    n, quantiles = docs.agg(F.count("doc_id"), F.percentile_approx(F.col("doc_id").cast("long"), [i / KNOTS for i in range(KNOTS)], 10 * KNOTS)).first()
    knots = sorted(set(quantiles or [0]))
    number = max(1, -(-n // (KNOTS * IDS_PER_CELL)))
    step = 32
    array = lambda values: "array(" + ", ".join(f"{v}L" if v > -(2**63) else f"({v + 1}L - 1L)" for v in values) + ")"
    # The piece between two knots, in two steps; within it doubles are exact enough, as they never fall either.
    coarse = f"greatest(size(filter({array(knots[::step])}, k -> k <= doc_id)) - 1, 0)"
    piece = f"(c * {step} + greatest(size(filter(slice({array(knots)}, c * {step} + 1, {step}), k -> k <= doc_id)) - 1, 0))"
    low, high = (f"cast(element_at({array(x)}, i + 1) AS double)" for x in (knots, [*knots[1:], 2**63 - 1]))
    place = f"least(greatest(cast(floor((cast(doc_id AS double) - {low}) / greatest(({high} - {low}) / {number}, 1D)) AS bigint), 0L), {number - 1}L)"
    inside = f"transform(transform(array({coarse}), c -> {piece}), i -> i * {number}L + {place})[0]"
    return F.expr(f"if(doc_id IS NULL, -1 - pmod(th, 4096), {inside})")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, digests, next_text, next_digests: each document beside the next one in descending doc_id order (after
    the last, the first; ties by text hash). Documents meet in cells of neighbouring ids; only the last of a cell is joined
    with the first of the next cell. Cells lie between quantiles of the ids, so that a few far ids cannot fill one."""
    texts = docs.select("doc_id", C.whole_text().alias("text"))
    cell = _cells(docs)
    rows = texts.withColumn("th", F.xxhash64("text")).withColumn("cell", cell).withColumn("digests", F.expr(_digests("text"))).repartition("cell")
    ids = docs.select("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64(C.whole_text())).alias("th"))
    cells = ids.withColumn("cell", cell).groupBy("cell").agg(F.min("doc_id").alias("tail"), F.max("doc_id").alias("head")).withColumn("g", F.floor(F.col("cell") / CELLS_PER_GROUP))
    groups = cells.groupBy("g").agg(F.max("cell").alias("top"))
    order = W.orderBy(F.desc("g"))
    groups = groups.select("g", F.coalesce(F.lead("top").over(order), F.first("top").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("below"))
    inside = F.lead("cell").over(W.partitionBy("g").orderBy(F.desc("cell")))
    cells = cells.withColumn("inside", inside).join(groups, "g").select("cell", "tail", "head", F.coalesce("inside", "below").alias("next_cell"))
    line = W.partitionBy("cell").orderBy(F.desc_nulls_last("doc_id"), F.desc("th"))
    inner = rows.withColumn("mark", F.lead("th").over(line)).withColumn("next_text", F.lead("text").over(line)).withColumn("next_digests", F.lead("digests").over(line))
    inner = inner.where("mark IS NOT NULL").select("doc_id", "text", "digests", "next_text", "next_digests")
    if cells.count() <= BROADCAST_ROWS:  # 32 bytes a row; beyond that the join shuffles
        cells = F.broadcast(cells)
    held = texts.withColumn("th", F.xxhash64("text")).withColumn("cell", cell).join(cells, "cell")
    own = F.struct("th", "doc_id", "text", F.expr(_digests("text")).alias("digests"))
    ends = held.where("doc_id <=> tail").groupBy("cell", "next_cell").agg(F.min(own).alias("e"))
    heads = held.where("doc_id <=> head").groupBy("cell").agg(F.max(own).alias("h")).withColumnRenamed("cell", "h_cell")
    outer = ends.join(heads, F.col("next_cell") == F.col("h_cell")).select("e.doc_id", "e.text", "e.digests", F.col("h.text").alias("next_text"), F.col("h.digests").alias("next_digests"))
    return inner.unionByName(outer)


def likeness(pairs: DataFrame, names: list[tuple[str, str, str]]) -> DataFrame:
    """pairs (key uid, arrays of digests) with, for each (name, a, b), a column of the Jaccard likeness of the sets a and b
    as the sketches tell it. The first attempt stands in pairs as column name_0; what fails is retried larger."""
    sides = F.array(*[F.struct(F.lit(i).alias("pair"), F.col(f"{n}_0").alias("r"), F.col(a).alias("a"), F.col(b).alias("b")) for i, (n, a, b) in enumerate(names)])
    left = pairs.select("uid", F.inline(sides)).where("NOT r.ok")
    done = []
    for level in range(LEVELS):
        parts = left.select("uid", "pair", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("part"), "a", "b")
        deal = f"d -> (shiftright(d, {20 + 3 * level}) & 7) = part"
        parts = parts.selectExpr("uid", "pair", f"filter(a, {deal}) AS a", f"filter(b, {deal}) AS b")
        last = level == LEVELS - 1  # digests that no retry can part are counted one by one
        parts = parts.withColumn("r", F.expr("named_struct('ok', true, 'a', size(array_except(a, b)), 'b', size(array_except(b, a)))" if last else _compare("a", "b")))
        tried = C.materialise(parts.selectExpr("uid", "pair", "r", "if(r.ok, NULL, a) AS a", "if(r.ok, NULL, b) AS b"), f"sketch{level + 1}", compression="none")  # digests don't shrink
        done.append(tried.where("r.ok").select("uid", "pair", "r.a", "r.b"))
        left = tried.where("NOT r.ok")
        if left.isEmpty():
            break
    more = reduce(DataFrame.unionByName, done).groupBy("uid").agg(*[F.sum(F.when(F.col("pair") == i, F.col(x))).alias(f"more_{x}{i}") for i in range(len(names)) for x in "ab"])
    out = pairs.join(more.withColumnRenamed("uid", "m_uid"), F.col("uid") == F.col("m_uid"), "left")
    for i, (n, a, _) in enumerate(names):
        only_a, only_b = (f"if({n}_0.ok, {n}_0.{x}, more_{x}{i})" for x in "ab")
        out = out.withColumn(n, F.expr(f"if(size({a}) + {only_b} = 0, 1D, (size({a}) - {only_a}) / cast(size({a}) + {only_b} AS double))"))
    return out


def fingerprint_text(keys: str) -> str:
    """SQL: the sketch as text, cells parted by ';'."""
    return f"array_join(transform({_sketch(keys)}, c -> if(c.n = 0, '', concat_ws(':', c.n, c.k, c.x))), ';')"


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row, where the
    edited text has its last third replaced by the start of the next document."""
    both = with_next(docs).withColumn("n_chars", F.length("text").cast("long")).withColumn("cut", F.expr("cast(n_chars div 3 AS int)"))
    both = both.withColumn("edited", F.expr("concat(substr(text, 1, cast(n_chars AS int) - cut), substr(next_text, 1, cut))"))
    table = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "digests", F.expr(_digests("edited")).alias("edited_digests"), "next_digests")
    names = [("near_edited", "digests", "edited_digests"), ("near_next", "digests", "next_digests")]
    for n, a, b in names:
        table = table.withColumn(f"{n}_0", F.expr(_compare(a, b)))
    table = C.materialise(table.withColumn("uid", F.monotonically_increasing_id()), "sketch0", compression="none")
    return likeness(table, names).selectExpr("doc_id", "n_chars", "edited_sha256", f"{fingerprint_text('digests')} AS fingerprint", f"{fingerprint_text('edited_digests')} AS edited_fingerprint", "round(near_edited, 6) AS near_edited", "round(near_next, 6) AS near_next")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(C.parquet(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, length(text)::BIGINT AS n_chars, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text FROM d),
e AS (SELECT doc_id, n_chars, text, next_text, left(text, n_chars - n_chars // 3) || left(next_text, n_chars // 3) AS edited FROM n),
v AS (SELECT doc_id, 'own' AS v, text FROM e UNION ALL SELECT doc_id, 'edited', edited FROM e UNION ALL SELECT doc_id, 'next', next_text FROM e),
p AS (SELECT DISTINCT doc_id, v, ('0x' || substr(md5(x), 1, 15))::BIGINT AS k FROM (SELECT doc_id, v, unnest(regexp_extract_all(text, '[^\\n]{{1,{PIECE}}}')) AS x FROM v)),
c AS (SELECT doc_id, v, 8 * j + ((k >> (3 * j)) & 7) AS c, count(*) AS n, bit_xor(k) AS k, bit_xor(((k % 2147483647) * 48271 + 11) % 2147483647) AS x FROM p, (SELECT unnest(range(3))::INTEGER AS j) GROUP BY ALL),
f AS (SELECT a.doc_id, a.v, string_agg(coalesce(c.n || ':' || c.k || ':' || c.x, ''), ';' ORDER BY a.c) AS f FROM (SELECT doc_id, v, unnest(range(24)) AS c FROM v WHERE v <> 'next') a LEFT JOIN c ON a.doc_id = c.doc_id AND a.v = c.v AND a.c = c.c GROUP BY ALL),
s AS (SELECT doc_id, v, count(*) AS n FROM p GROUP BY ALL),
o AS (SELECT a.doc_id, b.v, count(*) AS n FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.k = b.k AND a.v = 'own' AND b.v <> 'own' GROUP BY ALL),
j AS (SELECT v.doc_id, v.v, coalesce(o.n, 0) AS both_n, coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(o.n, 0) AS any_n FROM v LEFT JOIN s a ON a.doc_id = v.doc_id AND a.v = 'own' LEFT JOIN s b ON b.doc_id = v.doc_id AND b.v = v.v LEFT JOIN o ON o.doc_id = v.doc_id AND o.v = v.v),
l AS (SELECT doc_id, v, round(CASE WHEN any_n = 0 THEN 1 ELSE both_n::DOUBLE / any_n END, 6) AS near FROM j)
SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, f1.f AS fingerprint, f2.f AS edited_fingerprint, l1.near AS near_edited, l2.near AS near_next
FROM e JOIN f f1 ON f1.doc_id = e.doc_id AND f1.v = 'own' JOIN f f2 ON f2.doc_id = e.doc_id AND f2.v = 'edited'
JOIN l l1 ON l1.doc_id = e.doc_id AND l1.v = 'edited' JOIN l l2 ON l2.doc_id = e.doc_id AND l2.v = 'next'
"""
