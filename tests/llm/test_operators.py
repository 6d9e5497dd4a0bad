"""The corpus operators against brute force on small frames, with nulls, empty, long and repeated texts, clashing columns
and empty tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import string
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from halocline.llm import common as C
from halocline.llm import components, decontaminate, fingerprint, jaccard_join, language_id, language_model, license_scan, line_dedup, mixing, token_files, toxicity

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WHITE = re.compile(r"[^\x20\x09-\x0D]+")
#: Extra columns whose names the operators use inside.
CLASH = ["score", "size", "h", "th", "m", "text_in", "matches", "lang_pred", "words", "key", "draw", "shard", "cell", "words_before"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
EN, DE = "the of and with shing tion ther whed".split(), "der und sch lich keit ung zwei ßer".split()


def sentence(rng, words, n):
    return " ".join("".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


def documents():
    rng = random.Random(5)
    text = [(i, "\n".join(sentence(rng, (EN, DE)[i % 2], rng.randint(3, 30)) for _ in range(rng.randint(1, 6))), ("en", "de")[i % 2], f"src{i % 3}") for i in range(40)]
    long = "\n".join(sentence(rng, EN, 40) for _ in range(60))
    line = "A line of more than forty characters that many documents share."
    near = long.replace(long.split()[1200], "changed", 1)
    text += [(40, None, "en", "src0"), (41, "", "de", None), (42, long, "en", "src1"), (43, long, "en", "src1"), (44, near, "en", None), (45, "1234 !!! --", "en", "src0"), (46, long, "en", "src1"), (46, long, "en", "src1")]
    text += [(50 + i, f"Start {i} of it.\n  {line.upper() if i % 2 else line}  \nUnder the MIT License, or the Apache License, Version 2.0; cc-by-nc. End {i}", "en", "src2") for i in range(7)]
    text += [(None, "A text without an id.", None, "src0"), (60, "x", None, "src9"), (61, "two words", "en", "src9")]
    return [(*r[:2], r[2], r[3], len(r[1] or ""), *["?"] * len(CLASH)) for r in text]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("d") / "documents.parquet")
    spark.createDataFrame(documents(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(x):
    return (x is None, x)


def test_license_scan(docs, rows, none):
    pattern = re.compile(license_scan.WORD)
    want = collections.Counter()
    for r in rows:
        w = pattern.findall((r.text or "").translate(LOWER))
        at = [i for _, p in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        want[(r.doc_id, len(w), len(at), min(at, default=None), max(at, default=None))] += 1
    got = collections.Counter()
    for r in license_scan.license_spans(docs).collect():
        at = [s.start_word for s in r.spans if s.phrase]
        got[(r.doc_id, r.n_words, len(at), min(at, default=None), max(at, default=None))] += 1
    assert got == want
    assert license_scan.license_spans(none).count() == 0


def test_license_span_survives_an_edit(spark, none):
    text = "foo " + next(t for label, t in license_scan.TEMPLATES if label == "bsd").replace("source and", "source codes and") + " bar"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = license_scan.license_spans(df).first().spans
    assert [s.label for s in spans] == ["bsd"] and spans[0].start_word <= 1 and not spans[0].phrase


def test_line_dedup(docs, rows, none):
    strip = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holds = collections.defaultdict(set)
    for r in rows:
        for line in (r.text or "").split("\n"):
            if len(strip(line)) >= 40:
                holds[strip(line)].add(r.doc_id)
    want = collections.Counter()
    for r in rows:
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if not (len(holds[strip(x)]) >= 5 and r.doc_id != max(d for d in holds[strip(x)] if d is not None))]
        want[(r.doc_id, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    got = collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(docs).collect())
    assert got == want and sum(k[2] for k in got) >= 6
    assert line_dedup.dedup_lines(none).count() == 0


def pieces(text):
    return set(re.findall(r"[^\n]{1,%d}" % fingerprint.PIECE, text or ""))


def test_fingerprints(docs, rows, none):
    order = sorted((r for r in rows if r.doc_id is not None), key=lambda r: -r.doc_id) + [r for r in rows if r.doc_id is None]
    want = collections.Counter()
    like = lambda a, b: round(len(a & b) / len(a | b), 6) if a | b else 1.0
    for r, n in zip(order, order[1:] + order[:1], strict=True):
        a, b = r.text or "", n.text or ""
        e = a[: len(a) - len(a) // 3] + b[: len(a) // 3]
        want[(r.doc_id, len(a), hashlib.sha256(e.encode()).hexdigest(), like(pieces(a), pieces(e)), like(pieces(a), pieces(b)))] += 1
    out = fingerprint.fingerprints(docs).collect()
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in out) == want
    text = {r.doc_id: r.text for r in rows}
    prints = {r.doc_id: r.fingerprint for r in out}
    assert prints[42] == prints[43] == prints[46] != prints[44]
    assert all(r.fingerprint == r.edited_fingerprint for r in out if not text[r.doc_id])
    assert fingerprint.fingerprints(none).count() == 0


def test_fingerprints_of_far_ids(spark):
    """A few far ids must not put all others into one cell, nor change who is next."""
    ids = [*range(3000), 2**60, -(2**63), 2**63 - 1, None]
    rows = [(i, f"text {i}\nline {(i or 0) % 7}") for i in ids]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cells = df.withColumn("th", F.xxhash64("text")).withColumn("cell", fingerprint._cells(df)).groupBy("cell").count().agg(F.max("count")).first()[0]
    assert cells <= 3 * max(fingerprint.IDS_PER_CELL, len(ids) // fingerprint.KNOTS)
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]) + [rows[-1]]
    want = {a[0]: b[1] for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert {r.doc_id: r.next_text for r in fingerprint.with_next(df).collect()} == want


def test_mixing(docs, rows, none):
    out = mixing.plan(docs).collect()
    assert sorted((r.doc_id, r["size"]) for r in out if r.doc_id is not None) == sorted((r.doc_id, len(WHITE.findall(r.text or ""))) for r in rows if r.doc_id is not None)
    total = collections.Counter()
    for r in rows:
        total[r.source] += len(WHITE.findall(r.text or ""))
    names = sorted(total, key=lambda s: (s is None, s))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(total.values())
    while True:  # reshare the excess until none is above
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3 * total[s]
            left -= 3 * total[s]
        free -= over
    source = {r.doc_id: r.source for r in rows}
    taken = collections.Counter()
    for r in out:
        assert r.source_size == total[source[r.doc_id]] and r.target == pytest.approx(target[source[r.doc_id]])
        assert r.taken <= 3 * r["size"] and r.taken == sum(d.words for d in r.draws) and all(0 <= d.shard < mixing.SHARDS for d in r.draws)
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    assert sorted(map(str, mixing.plan(docs.repartition(5)).drop("m").collect())) == sorted(map(str, (r for r in mixing.plan(docs).drop("m").collect())))
    mixed = mixing.mix(docs)
    assert mixed.columns[: len(docs.columns)] == docs.columns
    assert sum(len(WHITE.findall(r.text)) for r in mixed.collect()) == sum(taken.values())
    assert mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0


def test_quota_tree():
    quotas = [1000, 37, 0, 5, 2_000_000_000]
    table = mixing.split_quotas(quotas, 7)
    assert table.sum(1).tolist() == quotas and table.min() >= 0 and np.ptp(table.sum(0)) <= 7
    assert (table == mixing.split_quotas(quotas, 7)).all()


def test_token_files(docs, rows, none, tmp_path):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    order = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    folder = f"file://{tmp_path}/t"
    manifest = token_files.write_sequences(docs, folder, public_tokenizers.path("word_bpe_49k.json"), length=16)
    got = sorted(token_files.read_documents(manifest, folder).collect(), key=lambda r: r.start)
    start, stream = 0, []
    for r, g in zip(order, got, strict=True):
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        assert tuple(g) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        stream += ids
    from pyarrow import fs

    flat = []
    for f in manifest.orderBy("shard").collect():
        reader = token_files.open_file(fs.LocalFileSystem(), f.path)
        for i in range(-(-f.n_tokens // 16)):
            tokens, mask = token_files.sequence(reader, i)
            assert len(tokens) == 16 and not tokens.flags.owndata
            flat += tokens[mask].tolist()
    assert flat == stream
    assert token_files.token_table(none).count() == 0


def test_encoder_agrees_with_the_library_on_mixtures():
    """Letters that lower case or composition take apart, marks, and what ends a word, in all orders."""
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(11)
    lib, own = Tokenizer.from_file(path), token_files.Encoder(path, "H")
    signs = ["a", "B", "1", "İ", "I", "e\u0301", "é", "\u095d", "\u095e", "\u0a5e", "\u0b5d", "Σ", "й", "한", "\u1112\u1161", "日", "²", "_", "'s", ",", ".", ". ", ", ", " ", "\n", "…", "\u0307", "ﬁ", "Ⅳ", "<|", "\x1c", "BELGESİ, ", "ढ़. "]
    for _ in range(8000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 12)))
        assert np.frombuffer(own([text])[0], np.uint16).tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


def test_plain_words_go_to_the_model_at_once():
    """Every Latin-1 letter, digit and sign, in all pairs and in random words, without the normaliser's and pre-tokenizer's passes."""
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(5)
    lib, own = Tokenizer.from_file(path), token_files.Encoder(path, "H")
    signs = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x100))]
    words = signs + [a + b for a in signs for b in signs] + ["".join(rng.choices(signs, k=rng.randint(3, 20))) for _ in range(5000)]
    assert dict(own.ids(words)) == dict(zip(words, (e.ids for e in lib.encode_batch_fast(words, add_special_tokens=False)), strict=True))
    plain = ["straße", "ÉTÉ,", "it", "a1b22!?", "...", "x@y.z"]
    own.tokenizer = SimpleNamespace(model=own.tokenizer.model, encode_batch_fast=lambda ws, **_: [lib.encode(w) for w in ws if w not in plain])
    assert {w for w, _ in own.ids([*plain])} == {*plain}


def test_plain_words_go_to_the_model_many_in_a_call():
    """A call for WORDS different words of a slice, whatever their number; texts, empty ones too, get their own ids back."""
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(12)
    lib, own = Tokenizer.from_file(path), token_files.Encoder(path, "H")
    bare, calls = own.bare, []
    own.bare = SimpleNamespace(encode_batch_fast=lambda texts, **_: calls.append(texts) or bare.encode_batch_fast(texts, add_special_tokens=False))
    words = ["".join(rng.choices("abcdeßàíÉÿ", k=6)) + rng.choice(["", "", "!", "7b"]) for _ in range(1500)]
    texts = ["", *(" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(400)), "  a\n\nb  "]
    got = [np.frombuffer(b, np.uint16).tolist() for b in own(texts)]
    assert got == [e.ids for e in lib.encode_batch_fast(texts, add_special_tokens=False)] and own([]) == []
    assert len(calls) <= 2 + len(words) / token_files.WORDS
    sizes = np.array([0, token_files.TEXTS, 3 * token_files.TEXTS, 1, 2, token_files.TEXTS])
    assert [x for a, b in token_files.runs(sizes) for x in range(a, b)] == list(range(6)) and len(token_files.runs(sizes)) == 3


def test_encoder_forgets(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(token_files, "MEMORY", 20_000)
    lib, own = Tokenizer.from_file(path), token_files.Encoder(path, "H")
    for i in range(400):
        text = f"the word{i} and word{i // 2} " + "x" * 1000 + str(i)
        assert np.frombuffer(own([text])[0], np.uint16).tolist() == lib.encode(text, add_special_tokens=False).ids
        assert len(own.young) + len(own.old) < 400 and max(map(len, own.young)) <= token_files.LONGEST


@pytest.mark.parametrize("text", ["a\x1cb  C\td é ü", "it's <|endoftext|>x 12ab3!?\r\n\x00z", "é ́ ﬁ İ ß", "\n\n  ", "日本語 текст 👍🏽x"])
def test_encoder_agrees_with_the_library(text):
    path = public_tokenizers.path("word_bpe_49k.json")
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(token_files.encoder(path, "H")([text])[0], np.uint16).tolist() == want


def test_language_id(docs, rows, none):
    out = language_id.identify(docs).collect()
    text = {r.doc_id: r for r in rows}
    assert len(out) == len(rows)
    for r in out:
        t = text[r.doc_id].text
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1)
    tested = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 40]
    assert len(tested) > 5 and all(r.lang_pred == text[r.doc_id].lang for r in tested)
    assert language_id.identify(none).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_model(docs, rows, none):
    out = language_model.score(docs, language_model.fit(docs)).collect()
    tokens = lambda t: WHITE.findall((t or "").translate(LOWER)) + ["\n"]
    part = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 7
    c = collections.Counter(w for r in rows if part(r.doc_id) != 2 for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    want = collections.defaultdict(list)
    for r in rows:
        t = tokens(r.text)
        want[r.doc_id].append((part(r.doc_id) == 2, len(t), sum(w in c for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)))
    assert len(out) == len(rows)
    for r in out:
        w = want[r.doc_id][0]
        assert tuple(r)[1:5] == w[:4] and r.base_score == pytest.approx(w[4]) and r.score < 0
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    empty = language_model.score(docs, language_model.fit(none)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in empty)
    assert language_model.score(none, language_model.fit(none)).count() == 0


@pytest.mark.parametrize("block, part", [(50, 300), (1 << 20, 1 << 20)])
def test_language_model_keeps_every_pair(docs, rows, monkeypatch, block, part):
    """Scores are the interpolation of whole counts, a distribution for every context, however texts lie in blocks and parts."""
    monkeypatch.setattr(language_model, "BLOCK", block)
    monkeypatch.setattr(language_model, "PART", part)
    fitted = language_model.fit(docs)
    got = collections.defaultdict(list)
    for r in language_model.score(docs, fitted).collect():
        got[r.doc_id].append((r.n_known, r.base_score, r.score))
    tokens = lambda t: WHITE.findall((t or "").translate(LOWER)) + ["\n"]
    c, pairs = collections.Counter(), collections.Counter()
    for r in rows:
        if zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 7 != 2:
            t = tokens(r.text)
            c.update(t)
            pairs.update(zip(["\n", *t], t, strict=False))
    n, v, weights = sum(c.values()), len(c), fitted.weights
    assert (fitted.tokens, fitted.types) == (n, v) and weights.sum(1) == pytest.approx(np.ones(len(weights))) and weights.min() > 0
    want = collections.defaultdict(list)
    for r in rows:
        t, s = tokens(r.text), 0
        for a, b in zip(["\n", *t], t, strict=False):
            w = weights[min(int(math.log2(c[a] + 1)), language_model.BUCKETS - 1)]
            s += math.log10(w[2] * pairs[a, b] / max(c[a], 1) + w[1] * (c[b] + 1) / (n + v + 1) + w[0] / (v + 1))
        want[r.doc_id].append((sum(x in c for x in t), sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), s))
    assert got.keys() == want.keys()
    assert all(a == pytest.approx(b) for k in want for a, b in zip(sorted(got[k]), sorted(want[k]), strict=True))
    other = {r.doc_id: r.score for r in language_model.score(docs.where("doc_id < 40"), fitted).collect()}
    assert len(other) == 40 and all(want[d][0][2] == pytest.approx(x) for d, x in other.items())


def test_language_vectors_by_hand():
    """Prototype and document vectors against sums of products made letter by letter."""
    text = "Ça va, 東京 va ça ß1x"
    vector = {}

    def letter(c):
        if c not in vector:
            vector[c] = language_id.letter_vectors(np.array([ord(c) if c.isalpha() else 0]))[0].astype(int)
        return vector[c]

    low, want = f" {text.lower()} ", np.zeros(language_id.DIM, int)
    for a, b, c in zip(low, low[1:], low[2:], strict=False):
        if b.isalpha():
            want += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
    assert language_id.bundle(*language_id.gram_counts(text)).tolist() == want.tolist()
    letters = language_id.letter_vectors(np.arange(0x4E00, 0x4E40)).astype(int)
    assert abs(letters @ letters.T - language_id.DIM * np.eye(64)).max() < 150


def test_language_id_holds_little_at_a_time(spark, docs):
    """A batch becomes Python values in slices, and a text that is kept is not sent twice."""
    long = spark.range(2000, numPartitions=1).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))
    got = C.added(long, "text", "n int, size int", lambda texts: [[len(texts)] * len(texts), [len(t) for t in texts]], stays=True)
    r = got.agg(F.count("id"), F.max("n"), F.sum("size"), F.sum(F.length("text"))).first()
    assert r[0] == 2000 and 1 < r[1] <= C.SLICE // 10_000 and r[2] == r[3] == 20_000_000
    marked = language_id.predict(docs.drop("text_in"), language_id.learn(language_id.training(docs)), docs.drop("text_in").columns)
    assert "AS text_in" not in marked._jdf.queryExecution().analyzed().toString()


def test_language_id_by_hand(docs, rows):
    """Every prediction is the largest cosine with prototypes summed over the training rows one by one."""
    bundle = lambda t: language_id.bundle(*language_id.gram_counts(t or "")).astype(float)
    sums = collections.defaultdict(lambda: np.zeros(language_id.DIM))
    for r in rows:
        if zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 != 1 and r.lang is not None and r.text is not None:
            sums[r.lang] += bundle(r.text)
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    table = {k: unit(v) for k, v in sorted(sums.items())}
    mean = sum(table.values()) / len(table)
    want = {}
    for r in rows:
        cos = {k: float(unit(v - mean) @ unit(unit(bundle(r.text)) - mean)) for k, v in table.items()}
        best = max(cos, key=cos.get)
        want[r.doc_id] = (best, (1 + cos[best]) / 2) if any(c.isalpha() for c in r.text or "") else ("und", 0.0)
    for r in language_id.identify(docs).collect():
        assert r.lang_pred == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1], abs=1e-4)


def test_toxicity_scores_are_noisy_or(spark):
    """A document's score is one less the product of its sentences' complements."""
    weights, bias = {"bad": 2.0, "worse": 3.5}, -4.0
    texts = ["A bad day. Nothing here! A worse and bad one?", "Fine.", "worse worse"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score(df, (weights, bias), ["doc_id"]).collect():
        clean = 1.0
        for s in toxicity.sentences(texts[r.doc_id]):
            z = bias + sum(sum(weights.get(f, 0.0) for f in toxicity.features(w)) for w in s)
            clean *= 1 - 1 / (1 + math.exp(-z))
        assert r.score == pytest.approx(1 - clean, abs=1e-6)


def test_toxicity(spark, none):
    rng = random.Random(3)
    bad = ["scumbag", "worthless"]
    made = []
    for i in range(400):
        s = [sentence(rng, EN, 8) for _ in range(5)]
        if i % 5 == 0:
            s[2] = s[2][:-1] + f" {rng.choice(bad)}{rng.choice(['', 'ly'])} you."
        made.append((i, " ".join(s), int(i % 5 == 0)))
    df = spark.createDataFrame([(i, t) for i, t, _ in made] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in made] + [(None, 1), (5, None), (7777, 1)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score(df, toxicity.learn(toxicity.labelled(df, labels)), ["doc_id"]).collect()}
    wrong = [i for i, _, y in made if (out[i].score >= toxicity.THRESHOLD) != y]
    assert len(wrong) <= 2 and out[900].score == out[901].score == 0
    assert all([o.sentence for o in out[i].offending] == [2] for i, _, y in made if y and i not in wrong)
    nothing = toxicity.learn(toxicity.labelled(none.select("doc_id", "text"), labels))
    assert {round(r.score, 6) for r in toxicity.score(df, nothing, ["doc_id"]).collect()} == {0.0}


def test_toxicity_keeps_words_that_the_sample_lacks(spark):
    rng = random.Random(6)
    late = [r.id for r in spark.range(1000, 1100).where("pmod(xxhash64(id), 1000000000000000) > 600000000000000").take(6)]
    made = [(i, sentence(rng, EN, 8) + (" Scumbag you." if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(400)] + [(i, sentence(rng, EN, 8) + " You zorgon.", 1) for i in late]
    weights, bias = toxicity.learn(spark.createDataFrame(made, "doc_id long, text string, toxic int"), sample=203)
    out = toxicity.score(spark.createDataFrame([(1, "Such a zorgon."), (2, "Such a tree.")], "doc_id long, text string"), (weights, bias), ["doc_id"])
    scores = {r.doc_id: r.score for r in out.collect()}
    assert scores[1] > 0.5 > scores[2]


def brute_components(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = WHITE.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_jaccard_join(spark, docs, none, k, percent):
    rng = random.Random(k)
    made, vocabulary = [], [f"w{i}" for i in range(500)]
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 9, 11, 14, 30, 120, 400]))]
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            made.append((len(made), " ".join(w)))
    made += [(200, None), (201, ""), (202, "  "), (203, made[0][1].upper())]
    df = spark.createDataFrame([*made, (None, made[0][1]), made[1]], "doc_id long, text string")
    got = jaccard_join.jaccard_components(df, k, percent).collect()
    want = brute_components(made, k, percent)
    assert len(got) == len(made) + 2
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard_join.jaccard_components(none, k, percent).count() == 0


def test_jaccard_join_of_long_texts(spark):
    """200,000 words, with a near copy and one too far; keys stay in proportion to the words."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    near, far = list(base), list(base)
    for w, n in ((near, 3000), (far, 9000)):
        for i in rng.sample(range(len(w)), n):
            w[i] = f"y{i}"
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(df, 5, 80).collect()} == {1: 1, 2: 1, 3: 3}
    s = np.arange(200_000, dtype=np.uint64) * np.uint64(2**40)
    assert all(len(jaccard_join.run_keys(s, p)) <= 3 * len(s) * (100 - p) // 100 + 3 for p in (80, 90))


@pytest.mark.parametrize("percent", [50, 60, 70, 78, 80, 85, 90, 95, 100])
def test_linked_sets_share_a_run(percent):
    rng = np.random.default_rng(percent)
    for _ in range(1500):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.append(a[rng.random(len(a)) > rng.random() * 0.3], rng.integers(0, 2**63, int(rng.integers(0, 4))).astype(np.uint64)))
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both) and both < max(len(a), len(b)):
            assert len(np.intersect1d(jaccard_join.run_keys(a, percent), jaccard_join.run_keys(b, percent)))


def test_texts_of_one_id_are_in_one_component(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(1, a), (3, a), (2, b), (3, b), (4, "other words here")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard_join.jaccard_components(df, 3, 90).collect()) == [(1, 1), (2, 1), (3, 1), (3, 1), (4, 4)]


def test_jaccard_frequent_keys(spark, monkeypatch):
    """Keys counted in place give the blocks that a shuffle by key gives, repeated rows included."""
    rng = random.Random(5)
    rows = [(rng.randrange(200), rng.choice([1, 1, 1, 2, rng.randrange(3, 60)])) for _ in range(600)]
    keys = spark.createDataFrame(rows, "node long, key long")
    by_shuffle = collections.Counter(jaccard_join._members(keys).select("key", "node", "size").collect())
    plans = []
    broadcast = jaccard_join.F.broadcast
    monkeypatch.setattr(jaccard_join.F, "broadcast", lambda df: plans.append(df) or broadcast(df))
    monkeypatch.setattr(jaccard_join, "PIECE", 20)
    assert collections.Counter(jaccard_join._members(keys).select("key", "node", "size").collect()) == by_shuffle
    assert {r.key for r in plans[0].collect()} >= {1, 2}
    assert jaccard_join._members(keys.limit(0)).count() == 0


def test_jaccard_pair_is_a_candidate_once(spark, monkeypatch):
    """Pairs that share many open blocks come out of a later search once, not once a block, and all links are among them."""
    monkeypatch.setattr(jaccard_join, "PIECE", 4)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(600)]
    made = []
    for g in range(12):
        w = list(base)
        for i in rng.sample(range(600), 10 if g < 10 else 3):
            w[i] = f"x{g}-{i}"
        made.append((g, " ".join(w)))
    index = jaccard_join._index(spark.createDataFrame(made, "doc_id long, text string"), 5, 80).withColumnRenamed("doc_id", "node")
    members = jaccard_join._members(index.select("node", jaccard_join.F.explode("keys").alias("key"))).withColumn("component", jaccard_join.F.col("node"))
    got = [tuple(r) for r in jaccard_join._second_search(members, jaccard_join.open_blocks(members), index.select("node", "n", "point"), 80, None).collect()]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(596)} for _, t in made]
    near = [(i, j) for i, j in itertools.combinations(range(12), 2) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
    assert len(got) == len(set(got)) > len(near) > 0 and set(near) <= set(got)


def test_pairs_belong_to_one_block():
    """With lists that hold all blocks, one block for each pair that shares any; with shorter ones, one at least."""
    rng = np.random.default_rng(6)
    blocks = [np.sort(rng.choice(40, int(rng.integers(1, 12)), False)) for _ in range(60)]
    for listed in (12, 3):
        kept = collections.Counter()
        first = np.array([[*b[:listed], *[jaccard_join.NO_KEY] * (listed - len(b[:listed]))] for b in blocks])
        for key in range(40):
            at = np.array([i for i, b in enumerate(blocks) if key in b], int)
            i, j = (at[x] for x in np.triu_indices(len(at), 1))
            keep = jaccard_join.belongs(i, j, np.full(60, key), first)
            kept.update(zip(i[keep].tolist(), j[keep].tolist(), strict=True))
        want = {(i, j) for i, j in itertools.combinations(range(60), 2) if len(np.intersect1d(blocks[i], blocks[j]))}
        assert set(kept) == want and (listed < 12 or max(kept.values()) == 1)


@pytest.mark.parametrize("piece", [7, 512])
def test_jaccard_counts_every_link(spark, monkeypatch, piece):
    """A group of distinct near copies has all its pairs, not a star; exact copies and pieces change nothing."""
    monkeypatch.setattr(jaccard_join, "COUNT_PIECE", piece)
    rng = random.Random(2)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    made = []
    for g in range(60):
        w = list(base)
        for _ in range(g % 4):
            w[rng.randrange(150)] = f"x{rng.randrange(9)}"
        made.append((g, " ".join(w)))
    made += [(100, "two words here now"), (101, "Two words here now"), (102, "alone in the world"), (103, None)]
    sets = {d: {tuple((t or "").lower().split()[i : i + 3]) for i in range(max(0, len((t or "").split()) - 2))} for d, t in made}
    want = {d: sum(1 for e in sets if e != d and sets[d] and 190 * len(sets[d] & sets[e]) >= 90 * (len(sets[d]) + len(sets[e]))) for d in sets}
    df = spark.createDataFrame([*made, made[3], (None, made[0][1])], "doc_id long, text string")
    got = jaccard_join.jaccard_components(df, 3, 90).collect()
    assert len(got) == len(made) + 2 and {r.doc_id: r.n_links for r in got} == want | {None: 0}
    assert len(set(want.values())) > 3 and want[100] == 1


def test_rtree_loses_nothing():
    rng = np.random.default_rng(1)
    points = rng.poisson(4, (300, jaccard_join.GROUPS)).astype(np.int32)
    points[150:] = points[:150] + (rng.random((150, jaccard_join.GROUPS)) < 0.05)
    sizes = points.sum(1).astype(np.int64)
    tree = jaccard_join.RTree(points, sizes)
    for i in range(0, 300, 17):
        bound = np.minimum(points, points[i]).sum(1)
        want = {j for j in range(300) if 190 * bound[j] >= 90 * (sizes[i] + sizes[j])}
        assert want <= set(tree.search(points[i], sizes[i], 90).tolist())


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for p in links if p[0] != p[1] for x in p}


def edits(a, b):
    """Fewest edits of a within b, free ends in b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination(spark, docs, none):
    rng = random.Random(4)
    items = [(i, sentence(rng, EN, rng.randint(8, 30))) for i in range(12)] + [(90, None), (91, ""), (92, "ab")]
    texts = []
    for n in range(60):
        i, t = items[n % 12]
        hurt = list(t)
        for _ in range(n % 7):
            at = rng.randrange(len(hurt))
            hurt[at : at + 1] = rng.choice([[], ["q"], [hurt[at], "z"]])
        texts.append((n, sentence(rng, EN, 20) + " " + "".join(hurt).upper() + "\n" + sentence(rng, DE, 20)))
    df = spark.createDataFrame([*texts, (100, None), (101, ""), (None, texts[0][1])], "doc_id long, text string").withColumn("matches", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    marked, name = decontaminate.mark(df, bench, df.columns)
    assert name != "matches"
    got = {(r.doc_id, m.item_id): m.edits for r in marked.collect() for m in r[name]}
    clean = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).strip()
    want = {}
    for (d, t), (i, x) in itertools.product([*texts, (None, texts[0][1])], items[:12]):
        a = clean(x)
        if i == (d or 0) % 12 or d is None:
            e = edits(a, clean(t))
            if e <= len(a) * decontaminate.EDITS // 100:
                want[(d, i)] = e
    assert {k: v for k, v in got.items() if k in want} == want and len(want) > 20
    assert all(k in want or k[1] != (k[0] or 0) % 12 for k in got)
    assert decontaminate.mark(none, bench, ["doc_id"])[0].count() == 0
    assert all(not r[1] for r in decontaminate.mark(df.select("doc_id", "text"), bench.limit(0), ["doc_id"])[0].collect())


def test_decontamination_of_short_items_and_repeats(spark):
    items = [(1, "abcdefghijklmnopq"), (2, "abcdefgh ijklmnopqr"), (3, "ab c"), (4, "東京都"), (5, "The quick brown fox jumps over a lazy dog"), (6, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [f"xx {t[:i]}#{t[i + 1:]} yy".replace("#", "z") for _, t in items[:2] for i in range(1, len(t) - 1)]
    fox = items[4][1]
    texts += ["It was AB, c!", "ab cd", "xab c", "この東京都は 東京都東京都", f"{fox}. {fox.replace('brown', 'brawn')} and\n{fox}"]
    marked, name = decontaminate.mark(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench, ["doc_id"])
    got = {r.doc_id: [(m.item_id, m.edits) for m in r[name]] for r in marked.collect()}
    n = len(texts) - 5
    assert all(got[d] and {m[0] for m in got[d]} <= {1, 2} and min(m[1] for m in got[d]) <= 1 for d in range(n))
    assert [got[d] for d in range(n, n + 5)] == [[(3, 0)], [], [], [(4, 0)] * 3, [(5, 0), (5, 1), (5, 0)]]


def test_decontamination_starts():
    """Start and end enclose the item, whatever was put in or left out."""
    item = decontaminate.normal("the deepest northern harbour in the month of march")
    items = decontaminate.Items([(1, item)])
    for at in range(2, len(item) - 2):
        for middle in ([], [int(item[at]), 113]):
            hurt = np.concatenate([item[:at], np.array(middle, np.uint32), item[at + 1 :]]).astype(np.uint32)
            text = np.concatenate([decontaminate.normal("xyz "), [np.uint32(32)], hurt, [np.uint32(32)], decontaminate.normal("uvw")]).astype(np.uint32)
            [(_, start, end, edits)] = decontaminate.find(items, [text])[0]
            assert (start, end, edits) == (4, 4 + len(hurt), 1)


@pytest.mark.parametrize("length", range(3, 20))
def test_decontamination_of_items_of_every_length(length):
    rng = random.Random(length)
    item = "".join(rng.choice("abcdefgh") for _ in range(length))
    items = decontaminate.Items([(1, decontaminate.normal(item))])
    budget = length * decontaminate.EDITS // 100
    texts = [f"zz {item} zz"] + [f"zz {item[:i]}{x}{item[i + 1:]} zz" for i in range(1, length - 1) for x in ("q", "")]
    for t, found in zip(texts, decontaminate.find(items, [decontaminate.normal(t) for t in texts]), strict=True):
        assert bool(found) == (edits(item, t) <= budget)


@pytest.mark.parametrize("q", [2, 3, 7, 10])
def test_gram_hashes_tell_grams_apart(q):
    codes = np.random.default_rng(0).integers(97, 100, 400).astype(np.uint32)
    h = decontaminate.gram_hashes(codes, q)
    grams = ["".join(map(chr, codes[i : i + q])) for i in range(len(codes) - q + 1)]
    assert len(h) == len(grams) and len(set(h.tolist())) == len(set(grams)) == len(set(zip(h.tolist(), grams, strict=True)))
    assert len(decontaminate.gram_hashes(codes[: q - 1], q)) == 0


def test_shared_dir_follows_the_session(spark):
    assert C.shared_dir(spark)
