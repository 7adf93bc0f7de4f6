"""Packing token ids into sequences: first-fit decreasing in randomised groups."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from bedside.llm.bpe import STRETCH, byte_alphabet

GROUP = 1 << 22  # ids after which a group of documents is packed
DEALT = 1 << 25  # bytes of text a partition holds, about two groups
SLICE = 1 << 21  # ids of pieces handed on at once
KEEP = 1 << 19  # pieces of text a worker keeps the ids of
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
BLANKS = r" \t-\r"
#: Texts of ASCII and Western letters only, for which ``re`` knows all classes.
PLAIN = re.compile(rf"[{LETTERS}0-9{BLANKS}!-/:-@\[-`{{-~]*\Z")
#: Fixed values of the file format: its splitter's pattern for such texts.
PLAIN_PIECES = re.compile(
    rf" ?[{LETTERS}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^{BLANKS}{LETTERS}0-9]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
)


class _Kept(dict):
    """Results of ``make`` for short keys, up to ``KEEP`` of them."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) < KEEP and len(key) <= 64:
            self[key] = value
        return value


class Encoder:
    """Ids as the library gives them for a whole text; equal pieces once.

    For byte-level vocabularies. Plain texts are split by the vocabulary's own
    pattern; others into stretches, since a piece never reaches across the start
    of a run of white space.
    """

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content.decode())
        self.library.no_truncation()
        self.library.no_padding()
        self.tokenize = self.library.model.tokenize
        self.character = {b: c for c, b in byte_alphabet().items()}
        self.ascii = {b: c for b, c in self.character.items() if b < 128}
        added = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.pieces = _Kept(self._piece)
        self.stretches = _Kept(lambda s: array("I", self.library.encode(s, add_special_tokens=False).ids).tobytes())

    def _piece(self, piece: str) -> bytes:
        mapped = piece.translate(self.ascii) if piece.isascii() else "".join([self.character[b] for b in piece.encode()])
        return array("I", [t.id for t in self.tokenize(mapped)]).tobytes()

    def __call__(self, text: str) -> np.ndarray:
        out = []
        for i, part in enumerate(self.added.split(text) if self.added else [text]):
            if i % 2:
                out.append(array("I", [self.library.token_to_id(part)]).tobytes())
            elif PLAIN.match(part):
                out += map(self.pieces.__getitem__, PLAIN_PIECES.findall(part))
            else:
                out += map(self.stretches.__getitem__, STRETCH.findall(part))
        return np.frombuffer(b"".join(out), "<u4")


_LOADED: dict[int, Encoder] = {}


def _encoder(content: bytes) -> Encoder:
    key = zlib.crc32(content)
    if key not in _LOADED:
        _LOADED[key] = Encoder(zlib.decompress(content))
    return _LOADED[key]


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: largest first, each into the first bin with room.

    The bins are the leaves of a tournament tree whose inner nodes hold the
    larger free capacity of their two sides; an item goes down to the left
    wherever the left side has room. Equal sizes keep their order.
    """
    leaves = 1 << max(len(sizes) - 1, 0).bit_length()
    free = [capacity] * (2 * leaves)
    bins = np.empty(len(sizes), np.int64)
    for item in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[item]), 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bins[item] = node - leaves
        free[node] -= size
        while node > 1:
            node //= 2
            free[node] = max(free[2 * node], free[2 * node + 1])
    return bins


def place(lengths: np.ndarray, capacity: int, least: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one group.

    Whole sequences are cut off the front of each document and the remainders
    packed first-fit decreasing. Then the emptiest bins are dissolved: their
    remainders, cut where needed, fill the gaps of at least ``least`` ids that
    others have, fullest bins first. One bin at most stays open that way, and it
    is cut into sequences whose lengths are powers of two, which need no padding.
    """
    pieces, sequence = [], 0
    for doc, length in enumerate(lengths.tolist()):
        for start in range(0, length - capacity + 1, capacity):
            pieces.append((doc, start, capacity, sequence, 0))
            sequence += 1
    rest = lengths % capacity
    docs = np.flatnonzero(rest)
    if not len(docs):
        return pieces
    bins = first_fit_decreasing(rest[docs], capacity)
    held: list[list[tuple[int, int, int]]] = [[] for _ in range(bins.max() + 1)]
    for doc, b in zip(docs.tolist(), bins.tolist()):
        held[b].append((doc, int(lengths[doc] - rest[doc]), int(rest[doc])))
    used = [sum(p[2] for p in b) for b in held]
    order = sorted((b for b in range(len(held)) if capacity - used[b] >= least), key=lambda b: (-used[b], b))
    while len(order) > 1:
        last, target = order[-1], order[0]
        if used[target] == capacity or target == last:
            order.pop(0)
            continue
        doc, start, length = held[last].pop()
        taken = min(length, capacity - used[target])
        held[target].append((doc, start, taken))
        used[target] += taken
        used[last] -= taken
        if taken < length:
            held[last].append((doc, start + taken, length - taken))
        if not held[last]:
            order.pop()
    for b in [b for b in range(len(held)) if held[b]]:
        room = capacity
        if order and b == order[0] and used[b] & (used[b] - 1):
            room = 1 << (used[b].bit_length() - 1)
        at, left = 0, used[b]
        for doc, start, length in held[b]:
            while length:
                taken = min(length, room - at)
                pieces.append((doc, start, taken, sequence, at))
                at, start, length, left = at + taken, start + taken, length - taken, left - taken
                if at == room and left:
                    sequence, at = sequence + 1, 0
                    room = 1 << (left.bit_length() - 1)
        sequence += 1
    return pieces


def pack(
    docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 1024, least: int = 64,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids.

    Returns one row per piece: ``doc_id``, ``start`` (ids of its document before
    it), ``length``, ``ids`` (array of int), ``doc_tokens`` (ids of the document
    with the end id), ``sequence_id`` and ``offset`` in the sequence. Every
    document is its ids followed by ``end_id``; every id lies in one piece. A
    sequence shorter than ``capacity`` is to be padded to it unless its length is
    a power of two.

    Rows are dealt evenly over partitions by Spark's own round robin, which sorts
    them by hash first, so a retry deals them alike and no key can be hot. A task
    packs groups of about ``GROUP`` ids one after the other and holds one group;
    ``sequence_id`` is the task's number times 2**33 plus the sequence's number
    in the task. Null texts count as empty and hold the end id alone; null and
    repeated ids are passed on, other columns are never read, an empty table
    gives no rows. A long text is one document of many pieces.
    """
    spark = docs.sparkSession
    content = spark.sparkContext.broadcast(zlib.compress(Path(vocabulary).read_bytes()))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    end = np.array([end_id], "<u4")

    def packed(doc_ids: list, ids: list[np.ndarray], kind_of: pa.DataType, first: int) -> tuple[list[pa.RecordBatch], int]:
        lengths = np.array([len(x) for x in ids])
        pieces = np.array(place(lengths, capacity, least), np.int64)
        batches, ends = [], np.cumsum(pieces[:, 2])
        for at in range(0, int(ends[-1]), SLICE):
            part = pieces[(ends > at) & (ends <= at + SLICE)]
            if not len(part):
                continue
            doc, start, length, sequence, offset = part.T
            values = np.concatenate([ids[d][s : s + n] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist())])
            offsets = pa.array(np.concatenate([[0], np.cumsum(length)]).astype("i4"))
            batches.append(pa.RecordBatch.from_arrays(
                [pa.array([doc_ids[d] for d in doc.tolist()], kind_of), pa.array(start), pa.array(length),
                 pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int32))), pa.array(lengths[doc]),
                 pa.array(sequence + first), pa.array(offset)],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            ))
        return batches, first + int(pieces[:, 3].max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, first = _encoder(content.value), TaskContext.get().partitionId() << 33
        doc_ids, ids, held, kind_of = [], [], 0, None
        for batch in batches:
            kind_of = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids.append(doc_id)
                ids.append(np.concatenate([encode(text.as_py() or ""), end]))
                held += len(ids[-1])
                if held >= GROUP:
                    out, first = packed(doc_ids, ids, kind_of, first)
                    yield from out
                    doc_ids, ids, held = [], [], 0
        if ids:
            yield from packed(doc_ids, ids, kind_of, first)[0]

    return rows.repartition(size // DEALT + 1).mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"
    )
