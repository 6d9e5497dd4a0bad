"""The pipeline's stages on a small folder, each against brute force on its own input."""

import re

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F
from tests.llm.test_operators import SCHEMA, brute_components, documents

ITEM = "This benchmark question asks which of the northern harbours has the deepest water in the month of March"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = documents()
    extra = ["?"] * (len(rows[0]) - 5)
    rows.append((70, "Some words before. " + ITEM.upper() + " - and after.", "en", "src0", 1, *extra))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for i, (name, stage) in enumerate(P.STAGES):
        before = docs.collect()
        out = stage(spark, docs, folder)
        if name != "token_files":
            assert out.columns == docs.columns
        path = f"{folder}/stage{i}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        ids = sorted((r.doc_id for r in docs.collect()), key=lambda x: (x is None, x))
        if name == "language_id":
            assert ids == sorted((r.doc_id for r in before if any(c.isalpha() for c in r.text or "")), key=lambda x: (x is None, x))
        elif name == "near_duplicates":
            comp = brute_components([(r.doc_id, r.text) for r in before if r.doc_id is not None], 5, 80)
            assert ids == sorted((r.doc_id for r in before if r.doc_id is None or comp[r.doc_id][1] == r.doc_id), key=lambda x: (x is None, x))
        elif name == "decontamination":
            clean = lambda t: re.sub(r"[\W_]+", " ", t.lower())
            assert ids == sorted((r.doc_id for r in before if clean(ITEM) not in clean(r.text)), key=lambda x: (x is None, x)) and 70 not in ids
        elif name == "mixing":
            assert set(ids) <= {r.doc_id for r in before}
        else:
            assert ids == sorted((r.doc_id for r in before), key=lambda x: (x is None, x))


def test_documents_without_labels_pass(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    kept = P.identify_language(spark, docs, folder)
    want = sum(any(c.isalpha() for c in r.text or "") for r in docs.collect())
    assert kept.columns == docs.columns and kept.count() == want > 40


def test_run(spark, folder):
    assert P.run(spark, folder).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
