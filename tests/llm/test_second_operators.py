"""Source divergence, hard negatives and MinHash groups against brute force; ids that a double cannot hold; long texts."""

import collections
import itertools
import random
import re
import string
import time

import numpy as np
import pytest

from halocline.llm import decontaminate, divergence, hard_negatives, jaccard_join, language_id, language_model, license_scan, near_dedup, token_files, toxicity

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
CLASH = ", ".join(f"{c} string" for c in ("term", "n", "docs", "v", "at", "p", "total", "part", "item", "value", "rank", "sig", "keys", "node", "key"))


def frame(spark, rows, schema):
    extra = CLASH.count(",") + 1
    return spark.createDataFrame([(*r, *["?"] * extra) for r in rows], f"{schema}, {CLASH}")


# Source divergence


def divergence_by_hand(rows, min_docs, top):
    split = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(lang or "", source or "", split.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = collections.Counter(w for d in mine for w in set(d[2]))
        kept = [w for w, n in seen.items() if n >= min_docs]
        count = {s: collections.Counter(w for d in mine if d[1] == s for w in d[2]) for s in {d[1] for d in mine}}
        every = sum(count.values(), collections.Counter())
        share = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for w in kept}  # noqa: B023, E731
        p, q = {s: share(c) for s, c in count.items()}, share(every)
        for s in p:
            far = sorted(((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in p if o != s))
            out += [(lang, s, "pair", o.decode(), -f, i) for i, (f, o) in enumerate(far, 1)]
            above = sorted((q[w] - p[s][w], w.encode()) for w in kept if count[s][w] and p[s][w] > q[w])[:top]
            out += [(lang, s, "term", w.decode(), -f, i) for i, (f, w) in enumerate(above, 1)]
    return sorted(out)


@pytest.mark.parametrize("part, sources, held", [(256, 128, 300_000), (3, 2, 5)])
def test_divergence(spark, monkeypatch, part, sources, held):
    """Also in small parts, blocks and tables of tasks."""
    for name, value in (("PART", part), ("SOURCES", sources), ("HELD", held)):
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(3)
    words = ["The", "the", "été", "Éte", "a1b", "x_y", "wörd", "tab\tline", "nul\x00byte", "日本", "[q]", "zz"]
    rows = [(" ".join(rng.choices(words, range(1, 13), k=rng.randint(0, 30))), rng.choice(["en", "de", None, ""]), rng.choice([None, "", "s1", "s2", "s3", "é"])) for _ in range(120)]
    rows += [(None, "en", "s4"), ("", "xx", "s1"), ("123 !!", "xx", None), (None, None, None), *[rows[0]] * 3, ("the " * 30_000, "de", "s1")]
    got = divergence.audit(frame(spark, rows, "text string, lang string, source string").repartition(3), 5, 3)
    assert sorted(map(tuple, got.collect())) == divergence_by_hand(rows, 5, 3)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_divergence_of_nothing(spark):
    assert divergence.audit(frame(spark, [], "text string, lang string, source string")).count() == 0
    # No term is kept: pairs of value 0, no terms.
    got = divergence.audit(frame(spark, [("a", "en", "s"), ("b", "en", "t")], "text string, lang string, source string"))
    assert sorted(map(tuple, got.collect())) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def test_tokens_are_the_matches_of_the_pattern():
    text = "".join(map(chr, range(0, 0x180))) + "Aa-Zz_[b]`c{D}~é日"
    assert [w.decode() for w in divergence.terms(text.encode())] == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER))


def test_shares_are_exact_beyond_a_long(spark):
    big = 4 * 10**15
    row = spark.range(1).select(divergence.share(*(hard_negatives.F.lit(x).cast("long") for x in (big + 1, big * 3 + 7, 11))).alias("p")).first()
    assert row.p == 1 + 10**9 * (big + 6) // (big * 3 + 7 + 55)


# Hard negatives


def negatives_by_hand(rows):
    alive, seen = [], set()
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        r = (i, (label + 1) % 10 if i % 7 == 0 else label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v))
        if r not in seen:
            seen.add(r)
            alive.append(r)
    out = []
    for a in alive:
        if a[0] % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2], strict=False)), b[0], b[1]) for b in alive if b[0] != a[0])
        for s, p, _ in [x for x in scored if x[2] == a[1]][:5]:
            near = [x for x in scored if x[2] != a[1] and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(a[0], p, k, n, -s, -t) for k, (t, n, _) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("block, tile", [(512, (2048, 65_536)), (16, (50, 100))])
def test_hard_negatives(spark, monkeypatch, block, tile):
    """Also in small blocks and tiles; hot labels, ties, repeated rows, lengths that differ."""
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", tile)
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(4, 12))
    rows = []
    for i in range(700):
        label = 0 if i % 3 == 0 else int(rng.integers(0, 4))
        rows.append((i, [float(x) for x in (centre[label] + rng.normal(size=12) * 0.7).astype(np.float32) * 0.3], label))
    rows += [(1000 + i, rows[5][1], 2) for i in range(20)]  # ties
    rows += [rows[7], rows[50], (None, [0.1] * 12, 1), (1100, None, 1), (1101, [0.1, None], 1), (1102, [float("nan")] * 12, 1), (1103, [float("inf")] * 12, 2), (1104, [0.1] * 12, None), (1150, [], 1), (1151, [0.5], 2), (-50, rows[3][1], 1), (50, rows[4][1], 3)]
    df = frame(spark, rows, "vec_id long, embedding array<float>, label int").repartition(4)
    assert sorted(map(tuple, hard_negatives.mine(df).collect())) == negatives_by_hand(rows)


def test_hard_negatives_of_nothing_and_of_few(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert hard_negatives.mine(frame(spark, [], schema)).count() == 0
    assert hard_negatives.mine(frame(spark, [(50, None, 1), (1, [0.5], None)], schema)).count() == 0
    rows = [(50, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.75, 0.0], 2)]
    assert list(map(tuple, hard_negatives.mine(frame(spark, rows, schema)).collect())) == [(50, 1, 1, 2, 65536, 49152)]


def test_hard_negatives_of_large_numbers(spark):
    rows = [(50 if i == 0 else i, [float(np.float32(x)) for x in v], i % 2) for i, v in enumerate([[3e6, 1.0], [2e6, 5.0], [2.9e6, 1.0], [1.5e6, 2.0], [2.5e6, 0.0], [0.0, 1.0]])]
    assert sorted(map(tuple, hard_negatives.mine(frame(spark, rows, "vec_id long, embedding array<float>, label int")).collect())) == negatives_by_hand(rows)


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert_neighbours_are_one_step_apart(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = hard_negatives.hilbert(cells, bits)
    assert len(set(keys.tolist())) == len(cells)
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_zone_bounds_hold():
    rng = np.random.default_rng(1)
    a, m = np.floor(rng.normal(size=(20, 9)) * 99), np.floor(rng.normal(size=(60, 9)) * 99)
    least, most = hard_negatives.bounds(a, np.stack([m[i : i + 10].min(0) for i in range(0, 60, 10)]), np.stack([m[i : i + 10].max(0) for i in range(0, 60, 10)]))
    scores = (a @ m.T).reshape(20, 6, 10)
    assert (least <= scores.min(2)).all() and (scores.max(2) <= most).all()


# MinHash groups


def groups_by_hand(rows, k, percent):
    sets = collections.defaultdict(list)
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[doc].append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = {d: d for d in sets if d is not None}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in itertools.combinations(root, 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {d: find(d) for d in root}, sets


@pytest.mark.parametrize("k, percent, piece, small", [(2, 80, 2048, 256), (5, 80, 8, 256), (2, 80, 8, 0), (2, 80, 16, 90)])
def test_near_duplicates(spark, monkeypatch, k, percent, piece, small):
    """Chains of edits, a shared passage of many documents, repeated rows and ids; also in small pieces of blocks, and with no
    or few sets that ride along."""
    monkeypatch.setattr(jaccard_join, "PIECE", piece)
    monkeypatch.setattr(near_dedup, "SMALL", small)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(6):
        text = [rng.choice(words) for _ in range(rng.randint(40, 200))]
        for i in range(8):
            rows.append((100 * family + i, " ".join(text).title() if i % 3 == 0 else " ".join(text)))
            for _ in range(len(text) // 25):
                text[rng.randrange(len(text))] = rng.choice(words)
    passage = [rng.choice(words) for _ in range(60)]
    rows += [(1000 + i, " ".join(passage + [rng.choice(words) for _ in range(25)])) for i in range(30)]
    rows += [(2000, None), (2001, ""), (2002, "one"), (2003, "ONE"), (2004, "  "), (None, rows[0][1]), (None, None), rows[3], (2005, rows[0][1]), (2005, rows[9][1]), (2006, "long " * 50_000)]
    got = near_dedup.near_duplicates(frame(spark, rows, "doc_id long, text string").repartition(3), k, percent).collect()
    want, sets = groups_by_hand(rows, k, percent)
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.n_shingles in {len(s) for s in sets[r.doc_id]} and r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert near_dedup.near_duplicates(frame(spark, [], "doc_id long, text string"), k, percent).count() == 0


def test_bayesian_verification_misses_no_more_than_chosen():
    """Pairs at the threshold fall under the needed matches in no batch more often than the chosen share; far ones nearly always."""
    need = near_dedup.least_matches(80, 1e-3)
    rng = np.random.default_rng(2)
    for s, low, high in ((0.8, 0, 0.01), (0.9, 0, 1e-3), (0.3, 0.999, 1)):
        equal = np.cumsum((rng.random((20_000, near_dedup.HASHES)) < s).reshape(20_000, -1, near_dedup.BATCH).sum(2), axis=1)
        assert low <= (equal < need).any(1).mean() <= high
    assert all(a < b for a, b in itertools.pairwise(near_dedup.least_matches(80)))


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(4)
    common = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = (np.unique(np.append(common, rng.integers(0, 1 << 63, 750, dtype=np.uint64))) for _ in range(2))
    equal = (near_dedup.signature(a) == near_dedup.signature(b)).mean()
    assert abs(equal - 3000 / 4500) < 0.15


def test_stars_with_hubs(spark, monkeypatch):
    """Hubs meet a broadcast of themselves; the answer is the same."""
    from halocline.llm import components

    monkeypatch.setattr(components, "HUB", 4)
    monkeypatch.setattr(components, "HUBS", 50)
    links = [(1000, i) for i in range(1, 60)] + [(60 + i, 61 + i) for i in range(20)] + [(2000, 1000), (5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 1 for i in [*range(1, 60), 1000, 2000]} | {i: 60 for i in range(60, 81)}


# Ids


FAR = [2**53 + 1, 2**63 - 1, -(2**63), None, 7]


@pytest.fixture(scope="module")
def far(spark):
    text = "The cat sat on the mat and looked at the dog, which did not like it at all. Nobody was there."
    return frame(spark, [(i, text + (" More." * (n % 2)), "en", "src", i) for n, i in enumerate(FAR)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def test_ids_are_never_changed(spark, far):
    keep = far.columns
    wanted = collections.Counter(FAR)
    ids = lambda df: collections.Counter(r.doc_id for r in df.collect())
    assert ids(language_id.identify(far)) == wanted
    assert collections.Counter((r.doc_id, r.n_chars) for r in language_id.predict(far, language_id.learn(far), keep).collect()) == collections.Counter((i, i) for i in FAR)
    assert ids(language_model.score(far, language_model.fit(far))) == wanted
    assert collections.Counter((r.doc_id, r.n_chars) for r in toxicity.score(far, ({"cat": 2.0}, -5.0), keep).collect()) == collections.Counter((i, i) for i in FAR)
    assert ids(token_files.token_table(far)) == wanted
    assert ids(jaccard_join.jaccard_components(far)) == ids(near_dedup.near_duplicates(far)) == wanted
    groups = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(far, 2, 80).collect()}
    assert groups == {i: None if i is None else -(2**63) for i in FAR}
    items = spark.createDataFrame([(2**63 - 1, "looked at the dog, which did not like it")], "item_id long, text string")
    marked, name = decontaminate.mark(far, items, keep)
    assert collections.Counter((r.doc_id, r.n_chars, r[name][0].item_id) for r in marked.collect()) == collections.Counter((i, i, 2**63 - 1) for i in FAR)


def test_ids_pass_the_pipeline(spark, far, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, "a benchmark item that no document holds")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = far
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert {(r.doc_id, r.n_chars) for r in docs.collect()} <= {(i, i) for i in FAR} and docs.columns == far.columns
    assert docs.count()


# Long texts


def test_license_scan_is_linear_in_the_words(spark):
    rng = random.Random(1)
    took = []
    for n in (100_000, 400_000):
        text = " ".join(rng.choice(["alpha", "under", "the", "mit", "license"]) for _ in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        began = time.perf_counter()
        assert license_scan.license_spans(df).first().n_words == n
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 5


def test_every_template_is_found(spark):
    rows = [(i, f"some words before {text} and after") for i, (_, text) in enumerate(license_scan.TEMPLATES)]
    got = {r.doc_id: {s.label for s in r.spans} for r in license_scan.license_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in got[i] for i, (label, _) in enumerate(license_scan.TEMPLATES))
    assert max(len(t.split()) for _, t in license_scan.TEMPLATES) <= license_scan.LONGEST
