"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import re
import uuid
import zlib
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quiltlens.llm.rows import partitions
from quiltlens.session import materialize, shared_dir

END_ID = 2
CACHE = 700_000  # pieces a generation remembers; two are kept
STRIDE = 1000
_AROUND = re.compile(r"\s \s|  ")
_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
_ASCII_SPACES = [c for c in _SPACES if c.isascii()]


def _spaced(text: str) -> bool:
    """``_AROUND`` matches: white space on both sides of a space. Looked for piecewise, which is faster than the pattern."""
    return "  " in text or (any(" " + c in text for c in (_ASCII_SPACES if text.isascii() else _SPACES)) and _AROUND.search(text) is not None)


def _byte_letters() -> dict[int, int]:
    """Byte-level vocabularies spell each byte as a visible letter: itself if printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()
SPACE = chr(BYTE_LETTERS[32])


class ChunkEncoder(dict):
    """Encodes texts with a byte-level BPE tokenizer whose words carry the space before them.

    Such a tokenizer never merges across the start of " word", so a text may be cut there; every distinct piece is
    encoded once by the library and remembered. A piece of letters is one pre-token, which the library's model takes
    directly. Texts with runs of white space around a space, or with a special token's spelling, go to the library
    whole. Memory is bounded: when there are too many pieces, those that were not asked for since the last time are
    forgotten, so frequent ones stay.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        kind = self.tokenizer.pre_tokenizer
        self.direct = type(kind).__name__ == "ByteLevel" and not kind.add_prefix_space and self.tokenizer.normalizer is None
        self.marks = {m: self._whole(m) for m in (".", ",", "\n")}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, text: str, space: str) -> bytes:
        """Ids of ``space + text``: letters with at most one full stop or comma after them need no pre-tokenizer."""
        body = text[:-1] if text[-1:] in (".", ",") else text
        if not (self.direct and body.isalpha()):
            return self._whole(space + text)
        spelled = (SPACE if space else "") + body if body.isascii() else (space + body).encode().decode("latin-1").translate(BYTE_LETTERS)
        tokens = self.tokenizer.model.tokenize(spelled)
        ids = b"".join([t.id.to_bytes(4, "little") for t in tokens])
        return ids + self.marks[text[-1]] if len(body) < len(text) else ids

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            before, line_end, after = word.partition("\n")
            if line_end and before and after and not any(c.isspace() for c in before + after):
                ids = self[before] + self.marks["\n"] + self._piece(after, "")
            else:
                ids = self._piece(word, " ")
        self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if _spaced(text) or (self.special and self.special.search(text)):
            return self._whole(text)
        words = text.split(" ")
        return (self._whole(words[0]) if words[0] else b"") + b"".join(map(self.__getitem__, islice(words, 1, None)))


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder per Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``doc_id, part, at, ids`` as ORC in ascending id order over the numbered files.

    Rows are range-partitioned by id (rows that share an id by a hash of their text), one file per partition; ``part``
    and ``at`` give the order. Integers are run-length encoded, every 1,000 rows have index entries, and doc_id has a
    Bloom filter, so that readers split files by stripe and skip stripes and row groups by id. A null text has only the
    end id; null ids come first; an empty table gives an empty folder of files with the schema.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows = rows.select("doc_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"), "text")
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def encode(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                ids = [enc.encode(t) + end for t in piece.column("text").to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(b) // 4 for b in ids])]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("part"), piece.column("at"), pa.ListArray.from_arrays(pa.array(offsets), flat)],
                                                 names=["doc_id", "part", "at", "ids"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    coded = rows.mapInArrow(encode, f"doc_id {id_type}, part int, at long, ids array<int>")
    (coded.write.option("orc.compress", "ZSTD").option("orc.compression.zstd.level", "1").option("orc.create.index", "true").option("orc.row.index.stride", str(STRIDE))
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").mode("error").orc(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, part, at, ids`` of a folder of token files; filters on doc_id reach the stripes' indexes."""
    return spark.read.orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """From the files: ``doc_id, start, n_tokens, ids_crc32``; start counts the ids of all rows before, in file order."""

    def digest(batches):
        for batch in batches:
            lists = batch.column("ids")
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("at"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                                             names=["doc_id", "part", "at", "n_tokens", "ids_crc32"])

    files = read_tokens(spark, path)
    id_type = files.schema["doc_id"].dataType.simpleString()
    rows = materialize(files.mapInArrow(digest, f"doc_id {id_type}, part int, at long, n_tokens long, ids_crc32 long"), "token-index")
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # a file is one bounded range of ids
    return rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(sizes, "part").select(
        "doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def tokenize(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the token files (under the shared folder unless ``path`` is given) and return their index."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/quiltlens/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer)
    return token_index(spark, path)


def lookup(spark: SparkSession, path: str, ids: list) -> pd.DataFrame:
    """The rows of a few documents: stripes without them are skipped by their statistics and Bloom filters."""
    return read_tokens(spark, path).filter(F.col("doc_id").isin(ids)).select("doc_id", "ids").toPandas()
