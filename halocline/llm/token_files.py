"""Token ids in Arrow stream-file format with fixed-size-list batches.

Documents are range-partitioned by id (or by the shard and place that a mix gave them), encoded, closed with an end id and
laid end to end; each partition writes one Arrow IPC file per shard whose record batches hold sequences of equal length
(fixed_size_list) and their masks (false where the last sequence is padded), and a small index file of its documents. A mapped file gives any sequence without a copy. File names
carry a random part and only the files that a finished task reports stand in the manifest, so retried tasks do no harm.

The encoder splits at spaces, line feeds and before closing commas and full stops, which no token of the vocabulary
crosses, and encodes words with the tokenizers library; frequent words are remembered in two generations of MEMORY bytes.
A text's words are numbered by Arrow, so Python meets each different word of a slice once.
Words of Latin-1 letters, ASCII digits and signs need no normaliser but lower case, and are cut here as the pre-tokenizer
cuts them, so the library's model gets the pieces of many words in a call.

Edge cases: a null or empty text has the end id only; null ids come first; rows that share an id are ordered by text and
each has its own entry; an empty table gives no file and an empty manifest. Other columns are not read.
"""

from __future__ import annotations

import array
import itertools
import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from halocline.llm import common as C

SEQUENCE, SEQUENCES_PER_BATCH, END_ID, MEMORY, LONGEST = 1024, 256, 2, 20_000_000, 32
#: Characters of the texts encoded at once, and words of letters that the library gets in a call.
TEXTS, WORDS = 1_000_000, 500
#: What stands before a comma or full stop at the end of a word, unless it is an ASCII letter or digit.
BEFORE = re.compile(r"([^A-Za-z0-9 ])[.,] ")
#: The pre-tokenizer's pieces of a plain word. The apostrophe (it has rules of its own) and what opens a special token are not plain.
LETTERS, SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:;=-@\[-`{-~"
LETTERED, PLAIN, PIECES = re.compile(f"[{LETTERS}]+"), re.compile(f"[{LETTERS}0-9{SIGNS}]+"), re.compile(f"[{LETTERS}]+|[0-9]|[{SIGNS}]+")
#: The byte-level vocabulary has a sign of Latin-1 for each byte, but others for 80 to A0 and AD, of which lower-case letters have these.
SHIFTED = [("\x9f", "Ł"), ("\xa0", "ł"), ("\xad", "Ń")]
MANIFEST = "shard int, part int, path string, index_path string, n_docs long, n_tokens long"


@lru_cache(maxsize=100_000)
def parts(char: str) -> bool:
    """Whether a comma or full stop after char is a token of its own: the normalised char is one letter or digit. (Some lower
    cases and compositions end in a mark, and a mark and the full stop may be one token.)"""
    norm = unicodedata.normalize("NFC", unicodedata.normalize("NFC", char).lower())
    return len(norm) == 1 and unicodedata.category(norm)[0] in "LN"


class Encoder:
    """Text to the bytes of its token ids."""

    def __init__(self, path: str, code: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.code = Tokenizer.from_file(path), code
        self.bare = Tokenizer(self.tokenizer.model)  # the model alone, between spaces
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(1 + max(vocabulary.values()), bool)  # the tokens that end a word
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.young, self.old, self.size = {}, {}, 0

    def packed(self, words: list[str]) -> Iterator[tuple[list[str], list[bytes]]]:
        """The words, in any order, and the bytes of their token ids, a list of words at a time."""
        lettered, plain, rest = [], [], []
        for w in words:
            (lettered if LETTERED.fullmatch(w) else plain if PLAIN.fullmatch(w) else rest).append(w)
        for kind in (lettered, plain):
            for at in range(0, len(kind), WORDS):
                some = kind[at : at + WORDS]
                pieces = None if kind is lettered else [PIECES.findall(w.lower()) for w in some]
                joined = " ".join(some).lower() if pieces is None else " ".join(map(" ".join, pieces))
                if not joined.isascii():
                    joined = joined.encode().decode("latin-1")
                    for byte, sign in SHIFTED:
                        joined = joined.replace(byte, sign)
                ids = np.array(self.bare.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.code)
                ends = ids.itemsize * (1 + np.flatnonzero(self.closes[ids]))  # of pieces, that is, of words of letters
                ends = (ends if pieces is None else ends[np.cumsum(list(map(len, pieces))) - 1]).tolist()
                flat = ids.tobytes()
                yield some, [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        yield rest, [array.array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]

    def ids(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """Each word, in any order, and its token ids."""
        return ((w, np.frombuffer(b, self.code).tolist()) for some, known in self.packed(words) for w, b in zip(some, known, strict=True))

    def learn(self, words: set[str]) -> list[str]:
        """Brings words into young; returns those that are too long to stay."""
        if self.size > MEMORY:  # words not met in a whole generation are forgotten
            self.young, self.old, self.size = {}, self.young, 0
        missing = words.difference(self.young)
        new = list(missing.difference(self.old))
        again = list(missing.intersection(self.old))
        for some, known in itertools.chain([(again, [self.old[w] for w in again])], self.packed(new)):
            self.young.update(zip(some, known, strict=True))
            self.size += 150 * len(some) + sum(map(len, some)) + sum(map(len, known))
        return [w for w in new if len(w) > LONGEST]

    @staticmethod
    def spaced(text: str) -> str:
        """The text with spaces for line feeds, and before a comma or full stop that ends a word of letters and digits; ASCII in
        lower case, as the vocabulary has it. Texts where that could change a token have spaces for line feeds only."""
        text = text.replace("\n", " ") + " "
        if "<|" not in text:
            if text.isascii():
                text = text.lower()
            if all(map(parts, set(BEFORE.findall(text)))):
                text = text.replace(", ", " , ").replace(". ", " . ")
        return text

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = pc.split_pattern(pa.array(map(self.spaced, texts), pa.string()), " ")
        numbered = split.values.dictionary_encode()
        words = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        long = self.learn(set(words))
        known = [self.young[w] for w in words]
        for w in long:
            self.size -= 150 + len(self.young.pop(w)) + len(w)
        ids = np.frombuffer(b"".join(known), self.code)
        n = np.fromiter(map(len, known), np.int64, len(known)) // ids.itemsize
        numbers, cut = numbered.indices.to_numpy(), split.offsets.to_numpy()
        sizes = n[numbers]
        ends = np.cumsum(sizes)
        place = np.repeat((np.cumsum(n) - n)[numbers] - ends + sizes, sizes)
        place += np.arange(len(place))
        ids = ids[place]
        bounds = np.append(0, ends)[cut].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def runs(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Rows (from, to) in runs of about TEXTS characters, a row at least."""
    run = (np.cumsum(sizes) - sizes) // TEXTS
    cut = [0, *(1 + np.flatnonzero(run[1:] != run[:-1])).tolist(), len(sizes)]
    return list(zip(cut[:-1], cut[1:], strict=True))


@lru_cache(maxsize=2)
def encoder(path: str, code: str) -> Encoder:
    return Encoder(path, code)


def _sequences(values: np.ndarray, valid: int, length: int) -> pa.RecordBatch:
    mask = pa.array(np.arange(len(values)) < valid)
    return pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(values), length), pa.FixedSizeListArray.from_arrays(mask, length)], names=["tokens", "mask"])


class Files:
    """A file of sequences and the index of its documents, being written."""

    def __init__(self, store: pafs.FileSystem, base: str, shard: int, part: int, length: int, dtype: str):
        self.shard, self.part, self.length, self.step, self.dtype = shard, part, length, length * SEQUENCES_PER_BATCH, np.dtype(dtype)
        self.paths = [f"{base}/{kind}-{shard:06d}-{part:06d}-{uuid.uuid4().hex}.arrow" for kind in ("tokens", "index")]
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        schema = pa.schema([("tokens", pa.list_(pa.from_numpy_dtype(self.dtype), length)), ("mask", pa.list_(pa.bool_(), length))])
        store.create_dir(base, recursive=True)
        self.sinks = [store.open_output_stream(p) for p in self.paths]
        self.out, self.index = pa.ipc.new_file(self.sinks[0], schema), pa.ipc.new_file(self.sinks[1], self.index_schema)
        self.held, self.size, self.total, self.n_docs = [], 0, 0, 0

    def add(self, keys: list[int | None], ids: list[bytes]) -> None:
        counts = np.array([len(b) for b in ids], np.int64) // self.dtype.itemsize
        starts = self.total + np.cumsum(counts) - counts
        self.index.write_batch(pa.record_batch([pa.array(keys, pa.int64()), pa.array(starts), pa.array(counts)], schema=self.index_schema))
        self.total, self.n_docs, self.size = self.total + int(counts.sum()), self.n_docs + len(ids), self.size + int(counts.sum())
        self.held += ids
        if self.size >= self.step:
            flat = np.frombuffer(b"".join(self.held), self.dtype)
            whole = len(flat) // self.step * self.step
            for at in range(0, whole, self.step):
                self.out.write_batch(_sequences(flat[at : at + self.step], self.step, self.length))
            self.held, self.size = [flat[whole:].tobytes()], len(flat) - whole

    def close(self) -> pd.DataFrame:
        if self.size:
            flat = np.frombuffer(b"".join(self.held), self.dtype)
            padded = np.concatenate([flat, np.zeros(-len(flat) % self.length, self.dtype)])
            self.out.write_batch(_sequences(padded, len(flat), self.length))
        for x in (self.out, self.index, *self.sinks):
            x.close()
        return pd.DataFrame({"shard": [self.shard], "part": [self.part], "path": self.paths[:1], "index_path": self.paths[1:], "n_docs": [self.n_docs], "n_tokens": [self.total]})


def write_sequences(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, length: int = SEQUENCE, dtype: str = "uint16", shard: str | None = None, place: str | None = None) -> DataFrame:
    """Writes the files into folder (a URI that all executors reach) and returns the manifest, one row per file. Documents lie
    in ascending doc_id order or, if columns shard (int) and place are named, in order of place in files of one shard each."""
    code = {"uint16": "H", "uint32": "I"}[dtype]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer, code), np.array([end_id], dtype).tobytes()
        store, base = pafs.FileSystem.from_uri(folder)
        part, files = TaskContext.get().partitionId(), None
        for batch in batches:
            for first, last in runs(batch["text"].str.len().to_numpy()) if len(batch) else []:
                rows = batch.iloc[first:last]
                of = rows["shard"].to_numpy()
                ids = [b + end for b in encode(rows["text"].tolist())]
                keys = [None if gone else int(x) for x, gone in zip(rows["doc_id"], rows["no_id"], strict=True)]
                cut = [0, *(1 + np.flatnonzero(of[1:] != of[:-1])).tolist(), len(rows)]
                for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                    if files is None or files.shard != of[lo]:
                        if files is not None:
                            yield files.close()
                        files = Files(store, base, int(of[lo]), part, length, dtype)
                    files.add(keys[lo:hi], ids[lo:hi])
        if files is not None:
            yield files.close()

    rows = docs.select("doc_id", C.whole_text().alias("text"), (F.col(shard) if shard else F.lit(0)).cast("int").alias("shard"), *([F.col(place).alias("place")] if place else [])).withColumn("th", F.xxhash64("text"))
    order = ["shard", "place"] if place else [F.asc_nulls_first("doc_id")]
    ordered = rows.repartitionByRange(*order, "th").sortWithinPartitions(*order, "th", "text")
    return C.materialise(ordered.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text", "shard").mapInPandas(write, MANIFEST), "manifest")


def open_file(store: pafs.FileSystem, path: str) -> pa.ipc.RecordBatchFileReader:
    """The file mapped into memory where the store is a local or shared disk, else read as needed."""
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(store, pafs.LocalFileSystem) else store.open_input_file(path))


def sequence(reader: pa.ipc.RecordBatchFileReader, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence i of a file and its mask; the tokens are a view of the mapped file."""
    batch = reader.get_batch(i // SEQUENCES_PER_BATCH)
    i %= SEQUENCES_PER_BATCH
    return batch.column(0)[i].values.to_numpy(zero_copy_only=True), batch.column(1)[i].values.to_numpy(zero_copy_only=False)


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files of the manifest."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for f in batch.itertuples():
                tokens = open_file(store, f.path)
                chunks = (tokens.get_batch(b).column(0).values.to_numpy(zero_copy_only=True) for b in range(tokens.num_record_batches))
                now, at = np.empty(0, "u2"), 0
                index = open_file(store, f.index_path)
                for b in range(index.num_record_batches):
                    part = index.get_batch(b)
                    sums, sizes = [], part.column("n_tokens").to_pylist()
                    for n in sizes:
                        crc = 0
                        while n > 0:
                            if at == len(now):
                                now, at = next(chunks), 0
                            take = now[at : at + n]
                            crc = zlib.crc32(take.astype("<u4").tobytes(), crc)
                            at, n = at + len(take), n - len(take)
                        sums.append(crc)
                    ids = part.column("doc_id")
                    known = pd.Series(ids.fill_null(0).to_numpy(zero_copy_only=False)).astype("Int64").mask(ids.is_null().to_numpy(zero_copy_only=False))
                    yield pd.DataFrame({"doc_id": known, "start": part.column("start").to_numpy() + f.offset, "n_tokens": np.array(sizes, "int64"), "ids_crc32": np.array(sums, "int64")})

    # A row per file: their number is that of the partitions, not of the documents.
    before = W.orderBy("shard", "part").rowsBetween(W.unboundedPreceding, -1)
    files = manifest.withColumn("offset", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return files.repartition(max(1, manifest.count())).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, **order: str) -> DataFrame:
    """Write and read back with the production parameters."""
    import public_tokenizers

    folder = f"{C.shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_documents(write_sequences(docs, folder, public_tokenizers.path("word_bpe_49k.json"), **order), folder)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(C.parquet(spark, sf_dir, "documents"))
