"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import string
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: White space of the word contracts; all of it is ASCII.
WHITE = r"\x20\x09-\x0D"
#: A word is a run of anything else.
WORD = rf"[^{WHITE}]+"
#: Bytes of an Arrow batch that become Python values at a time.
SLICE = 4_000_000


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def whole_text(column: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def word_hashes(text: Column) -> Column:
    """One 64-bit hash for each lower-cased word, in order."""
    return F.transform(words(ascii_lower(text)), lambda w: F.xxhash64(w))


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo modulus; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may lack that setting; it gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; executors need a folder that they share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage is cut and the files outlive executors. options
    go to the Parquet writer."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    vars(out)["written_to"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that materialise wrote and nothing reads any more."""
    for table in tables:
        spark, path = table.sparkSession, table.sparkSession._jvm.org.apache.hadoop.fs.Path(vars(table)["written_to"])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about SLICE bytes (a row at least), not copied."""
    step = max(1, batch.num_rows * SLICE // max(1, batch.nbytes))
    return (batch.slice(i, step) for i in range(0, batch.num_rows, step))


def added(rows: DataFrame, column: str, schema: str, make: Callable[[list], list[list]], stays: bool = False) -> DataFrame:
    """rows without a column (unless it stays), with the columns of schema (DDL) that make gives for a list of its values. All
    others ride along as Arrow arrays: nothing in them is converted, whatever their types and nulls. A worker makes and gives
    back about SLICE bytes at a time."""
    kept = [c for c in rows.columns if stays or c != column]
    new = StructType.fromDDL(schema).fields
    kinds = [to_arrow_type(f.dataType) for f in new]
    out = StructType([*rows.select(*kept).schema.fields, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            values = make(batch.column(column).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(v, k) for v, k in zip(values, kinds, strict=True))], names=out.names)

    return rows.mapInArrow(run, out)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names close to names that df does not have yet (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
