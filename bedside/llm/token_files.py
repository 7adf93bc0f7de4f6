"""Token ids of documents as compressed binary segments in ascending id order."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from bedside.llm import rans
from bedside.llm.bpe import byte_alphabet
from bedside.session import new_path

SEGMENT = 1 << 20  # ids after which a segment is closed
KEEP, PARTS = 3 << 18, 1 << 20  # words and their parts a worker keeps the ids of
SLICE = 1 << 20  # bytes split into words at once
#: Words the vocabulary's splitter cuts into letters and one run of marks, whose
#: lower case and composed form are plain.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:$%&#*()\-]*)\Z")


class Encoder:
    """Ids as the library gives them for a whole text; words are encoded once.

    Valid for vocabularies that drop white space: then a text is its words, cut
    at ASCII white space, one after the other.
    """

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content.decode())
        self.library.no_truncation()
        self.library.no_padding()
        self.character = {b: c for c, b in byte_alphabet().items()}
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            mapped = "".join([self.character[b] for b in part.encode()])
            found = np.array([t.id for t in self.library.model.tokenize(mapped)], "<u4").tobytes()
            if len(self.parts) < PARTS:
                self.parts[part] = found
        return found

    def _word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        simple = SIMPLE.match(text) if len(word) <= 64 else None
        if simple:
            found = self._part(simple[1].lower()) + (self._part(simple[2]) if simple[2] else b"")
        else:
            found = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.words) < KEEP and len(word) <= 64:
            self.words[word] = found
        return found

    def __call__(self, text: str) -> np.ndarray:
        raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
        known, word = self.words.get, self._word
        while at < len(raw):
            end = at + SLICE
            blank = raw.find(b" ", end) if end < len(raw) else -1
            end = len(raw) if blank < 0 else blank
            out += [known(w) or word(w) for w in raw[at:end].split()]
            at = end
        return np.frombuffer(b"".join(out), "<u4")


_LOADED: dict[int, Encoder] = {}


def _encoder(content: bytes) -> Encoder:
    key = zlib.crc32(content)
    if key not in _LOADED:
        _LOADED[key] = Encoder(zlib.decompress(content))
    return _LOADED[key]


COLUMNS = "part int, segment int, n_ids long, doc_ids {0}, lengths array<long>, body binary"


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts, append ``end_id`` to each, and write segments under ``path``.

    Rows are range-partitioned and sorted by id (null first; equal ids by
    text), tasks close a segment after about ``SEGMENT`` ids at the end of a
    document, and only one segment is held at a time. A segment is one row:
    ``part`` (the range), ``segment`` (its number inside), ids and lengths of its
    documents, and the coded ids with their frequency table, checkpoints and
    checksums. Null texts count as empty and hold the end id alone. Spark's
    writer commits the files, so a lost task leaves none behind.
    """
    content = docs.sparkSession.sparkContext.broadcast(zlib.compress(Path(vocabulary).read_bytes()))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, number = _encoder(content.value), TaskContext.get().partitionId(), 0
        doc_ids, ids, size, kind_of_id = [], [], 0, None

        def segment():
            lengths = [len(x) for x in ids]
            row = [
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([sum(lengths)], pa.int64()),
                pa.array([doc_ids], pa.list_(kind_of_id)), pa.array([lengths], pa.list_(pa.int64())),
                pa.array([rans.encode(np.concatenate(ids))], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(row, names=["part", "segment", "n_ids", "doc_ids", "lengths", "body"])

        end = np.array([end_id], "<u4")
        for batch in batches:
            kind_of_id = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.append(encode(text.as_py() or ""), end)
                doc_ids.append(doc_id)
                ids.append(found)
                size += len(found)
                if size >= SEGMENT:
                    yield segment()
                    number, doc_ids, ids, size = number + 1, [], [], 0
        if ids:
            yield segment()

    rows = docs.select(docs[id_col].alias("i"), docs[text_col].alias("text"))
    rows = rows.repartitionByRange(F.col("i").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.sortWithinPartitions(F.col("i").asc_nulls_first(), F.xxhash64("text"))
    rows.mapInArrow(run, COLUMNS.format(f"array<{kind}>")).write.option("compression", "uncompressed").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the files: ``doc_id``, ``start`` (ids of all documents before),
    ``n_tokens`` and ``ids`` decoded. Segments are decoded in parallel; where a
    segment starts comes from counts, one per segment."""
    return _placed(spark, path, "ids array<long>", lambda x: (pa.list_(pa.int64()), x.astype(np.int64)))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """As ``read``, with ``ids_crc32`` of the ids as little-endian 32-bit numbers
    instead of the ids."""
    return _placed(spark, path, "ids_crc32 long", lambda x: (pa.int64(), zlib.crc32(x.astype("<u4").tobytes())))


def _placed(spark: SparkSession, path: str, column: str, of_ids) -> DataFrame:
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    name = column.split(" ")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, number, doc_ids, lengths, body = (batch.column(c)[i].as_py() for c in range(5))
                ids = rans.decode(body)
                ends = np.cumsum(lengths)
                if ends[-1] != len(ids):
                    raise rans.Damaged("lengths do not fit")
                kind_of, values = None, []
                for a, b in zip([0, *ends[:-1]], ends):
                    kind_of, value = of_ids(ids[a:b])
                    values.append(value)
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), pa.array([number] * n, pa.int32()),
                     pa.array(doc_ids, batch.schema.field(2).type.value_type), pa.array(ends - lengths),
                     pa.array(lengths, pa.int64()), pa.array(values, kind_of)],
                    names=["part", "segment", "doc_id", "inside", "n_tokens", name],
                )

    found = files.select("part", "segment", "doc_ids", "lengths", "body").mapInArrow(
        run, f"part int, segment int, doc_id {kind}, inside long, n_tokens long, {column}"
    )
    sizes = files.select("part", "segment", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition meets in one task: a setting, not data.
    parts = parts.select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("p0"))
    inside = F.coalesce(F.sum("n_ids").over(before(Window.partitionBy("part").orderBy("segment"))), F.lit(0))
    starts = sizes.withColumn("s0", inside).join(parts, "part").select("part", "segment", (F.col("s0") + F.col("p0")).alias("s0"))
    return found.join(starts, ["part", "segment"]).select(
        "doc_id", (F.col("s0") + F.col("inside")).alias("start"), "n_tokens", name
    )


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to the shared folder and read them back as checksums.

    One row per document: ``doc_id``, ``start``, ``n_tokens`` with the end id,
    ``ids_crc32``. Null texts count as empty, null ids come first, repeated ids
    stay rows of their own, other columns are never read, and an empty table
    gives an empty result.
    """
    path = new_path(docs.sparkSession, "token-files")
    write(docs, path, vocabulary, end_id, id_col, text_col)
    return checksums(docs.sparkSession, path)
