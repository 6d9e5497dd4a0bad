"""The corpus pipeline: STAGES in order, each over all that its predecessor kept.

Every stage but the last returns the columns of its input. Null or repeated rows are treated as the operators say: a
document without text or letters leaves at the first stage; rows that share a doc_id are one document for the second; the
mix repeats a document as often as it draws it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.llm import common as C
from halocline.llm import decontaminate, jaccard_join, language_id, mixing, token_files

BROADCAST_ROWS = 1_000_000
#: Random letters have a likeness of 0.06 with a deviation of 0.04, the texts of sf0.1 one of 0.93 and at least 0.19.
FOREIGN = 0.15


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no language: those without a letter (found without the model), and those of LEAST or more different
    3-grams whose likeness with every learned prototype is under FOREIGN, that is, near what random letters have. Where no row
    has a lang to learn from, every document with letters passes."""
    lettered = docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    model = language_id.learn(language_id.training(docs))
    if not model:
        return lettered
    marked = language_id.predict(lettered, model, docs.columns)
    likeness = F.col(marked.columns[-1])
    return marked.where(likeness.isNull() | (likeness >= FOREIGN)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near duplicates (five words, 0.8) the smallest doc_id stays; a row without id stays."""
    found = jaccard_join.jaccard_components(docs.select("doc_id", "text"), count_links=False)
    gone = C.materialise(found.where("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    if gone.count() <= BROADCAST_ROWS:  # 8 bytes a row; beyond that the documents are shuffled
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    marked, name = decontaminate.mark(docs, C.parquet(spark, sf_dir, "benchmark"), docs.columns)
    return marked.where(F.size(name) == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix is dealt over shards by the splitting tree (its rows carry no more than the columns of documents, so that
    happens here); each shard has files of its own, in shuffled order."""
    dealt = mixing.mix(docs, once=True)
    return token_files.token_table(dealt, shard=dealt.columns[-2], place=dealt.columns[-1])


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]
#: SQL has no language model, permuted draw or tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the documents of sf_dir; between stages a table is written and read again."""
    docs = C.parquet(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = C.materialise(docs, name)
    return docs
