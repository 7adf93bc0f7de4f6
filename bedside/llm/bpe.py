"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

``Transducer`` takes a text in pieces of any size and emits token ids as soon as
no later text can change them. Between calls it keeps the text since the last
safe cut, which the lookahead of the merge list bounds however long the text is.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed values of the file format: the pattern its byte-level splitter uses.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: A piece always starts where white space follows other text, so a run of white
#: space with the text after it can be split on its own.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
STRETCH = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
RUNS = {kind: regex.compile(f"{kind}*") for kind in (r"\p{L}", r"\p{N}", r"\p{White_Space}", r"[^\p{White_Space}\p{L}\p{N}]")}
CONTRACTION = 3  # characters the longest of 's 't 're 've 'm 'll 'd takes
CHUNK = 1 << 16  # characters fed at once
RESULT = 1 << 21  # characters of results a task holds before it hands them on
LONG = 1 << 12  # an open piece longer than this is encoded before it ends
BLOCK = 1 << 10  # bytes encoded at once inside such a piece
SMALL = 48  # bytes up to which a linear scan beats a heap
NONE = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in the vocabulary: printable bytes for
    themselves, the others for the characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A vocabulary file of the byte-level kind; ``lookahead`` is computed from it."""

    def __init__(self, content: bytes, keep: int = 1 << 18):
        spec = json.loads(content)
        model, alphabet = spec["model"], byte_alphabet()
        vocab = model["vocab"]
        self.bytes_of = {i: bytes(alphabet[c] for c in token) for token, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: text.encode() for text, i in self.added.items()}
        self.split_added = (
            regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
            if self.added else None
        )
        self.byte_id = [vocab.get(c) for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        listed = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = [(vocab[u], vocab[v], vocab[u + v]) for u, v in listed]
        self.rank = {(u, v): r for r, (u, v, _) in enumerate(self.merges)}
        self.merged = [w for _, _, w in self.merges]
        self.follow: dict[int, dict[int, int]] = {i: {} for i in self.bytes_of}
        for (u, v), r in self.rank.items():
            self.follow[u][v] = r
        self.lookahead = self._sufficient_lookahead()
        self.pieces = _Kept(self._encode_piece, 2 * keep)
        self.stretches = _Kept(self._encode_stretch, keep)

    def _sufficient_lookahead(self) -> int:
        """Bytes after which no later byte can change a token.

        Let two texts agree up to byte q. Whether merge r happens across the
        border of agreement depends on the token after the border, and moves the
        border left by the bytes of its left part. A later merge s can move it
        again only if its right part starts with the left part of r, that is,
        holds it on its left spine of merges, and s comes after r, since merges
        apply in order of rank. The longest such chain bounds the move.
        """
        made: dict[int, int] = {}
        for u, v, w in self.merges:
            if any(len(self.bytes_of[t]) > 1 and t not in made for t in (u, v)):
                raise ValueError("a merge uses a token that no earlier merge makes")
            made.setdefault(w, u)
        reach: dict[int, int] = {}
        most = 0
        for u, v, _ in reversed(self.merges):
            moved = len(self.bytes_of[u]) + reach.get(u, 0)
            most = max(most, moved)
            spine: int | None = v
            while spine is not None:
                reach[spine] = max(reach.get(spine, 0), moved)
                spine = made.get(spine)
        return most

    def encode_bytes(self, raw: bytes) -> list[int]:
        ids = [self.byte_id[b] for b in raw]
        return self._scan(ids) if len(ids) <= SMALL else self._heap(ids)

    def _scan(self, ids: list[int]) -> list[int]:
        follow, merged = self.follow, self.merged
        ranks = [follow[u].get(v, NONE) for u, v in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            token = ids[i] = merged[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = follow[ids[i - 1]].get(token, NONE)
            if i < len(ranks):
                ranks[i] = follow[token].get(ids[i + 1], NONE)
        return ids

    def _heap(self, ids: list[int]) -> list[int]:
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, pair in enumerate(zip(ids, ids[1:])) if (r := self.rank.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] < 0 or self.rank.get((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j], after[i] = self.merged[r], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (s := self.rank.get((ids[i], ids[after[j]]))) is not None:
                    heapq.heappush(heap, (s, i))
            if before[i] >= 0 and (s := self.rank.get((ids[before[i]], ids[i]))) is not None:
                heapq.heappush(heap, (s, before[i]))
        return [t for t in ids if t >= 0]

    def _encode_piece(self, piece: str) -> bytes:
        return array("i", self.encode_bytes(piece.encode())).tobytes()

    def _encode_stretch(self, stretch: str) -> bytes:
        return b"".join([self.pieces[p] for p in PIECES.findall(stretch)])


class _Kept(dict):
    """Results of ``make`` for short keys, up to a fixed number of them."""

    def __init__(self, make, most: int, longest: int = 64):
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, key):
        value = self.make(key)
        if len(self) < self.most and len(key) <= self.longest:
            self[key] = value
        return value


class _OpenPiece:
    """Encodes one piece while it still grows."""

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, bytearray()

    def feed(self, text: str) -> Iterator[bytes]:
        raw = text.encode()
        for at in range(0, len(raw), BLOCK):
            self.held += raw[at : at + BLOCK]
            if len(self.held) >= BLOCK + self.merges.lookahead:
                yield self._stable(len(self.held) - self.merges.lookahead)

    def _stable(self, border: int) -> bytes:
        out, end = [], 0
        for token in self.merges.encode_bytes(bytes(self.held)):
            size = len(self.merges.bytes_of[token])
            if end + size > border:
                break
            out.append(token)
            end += size
        del self.held[:end]
        return np.array(out, "<i4").tobytes()

    def finish(self) -> bytes:
        return np.array(self.merges.encode_bytes(bytes(self.held)), "<i4").tobytes()


class Transducer:
    """Encode a text fed in pieces; yields ids as native 32-bit integers."""

    def __init__(self, merges: Merges):
        self.merges, self.tail = merges, ""
        self.piece: _OpenPiece | None = None
        self.run = None

    def feed(self, text: str) -> Iterator[bytes]:
        buffer = self.tail + text
        if self.piece is not None:
            end = self.run.match(buffer).end()
            spaces = self.run is RUNS[r"\p{White_Space}"]
            taken = max(end - spaces, 0)  # the last blank may belong to the next piece
            yield from self.piece.feed(buffer[:taken])
            self.tail = buffer[taken:]
            if end == len(buffer):
                return
            yield self.piece.finish()
            self.piece, buffer = None, self.tail
        stretches = STRETCH.findall(buffer)
        self.tail = stretches.pop() if stretches else ""
        kept = self.merges.stretches
        yield b"".join([kept[s] for s in stretches])
        if len(self.tail) > LONG:
            yield from self._long_tail()

    def _long_tail(self) -> Iterator[bytes]:
        found = list(PIECES.finditer(self.tail))
        last, size = found[-1], len(self.tail)
        done = 0
        for m in found[:-1]:
            if m.end() > size - CONTRACTION:
                break
            yield self.merges.pieces[m.group()] if m.end() - m.start() <= LONG else self._whole(m.group())
            done = m.end()
        if last.start() == done and last.end() - done > LONG // 2:
            self.run = next(r for r in RUNS.values() if r.match(self.tail[-1]).end())
            spaces = self.run is RUNS[r"\p{White_Space}"]
            self.piece = _OpenPiece(self.merges)
            yield from self.piece.feed(self.tail[done : size - spaces])
            done = size - spaces
        self.tail = self.tail[done:]

    def _whole(self, text: str) -> bytes:
        piece = _OpenPiece(self.merges)
        return b"".join([*piece.feed(text), piece.finish()])

    def finish(self) -> Iterator[bytes]:
        if self.piece is not None:
            yield from self.piece.feed(self.tail)
            yield self.piece.finish()
        elif len(self.tail) <= LONG:
            yield self.merges.stretches[self.tail] if self.tail else b""
        else:
            for m in PIECES.finditer(self.tail):
                yield self._whole(m.group())
        self.piece, self.tail = None, ""


def encode(merges: Merges, text: str) -> np.ndarray:
    """Ids of a whole text. Added tokens are recognised in it, as the library does."""
    parts = merges.split_added.split(text) if merges.split_added else [text]
    out: list[bytes] = []
    for i, part in enumerate(parts):
        if i % 2:
            out.append(np.array([merges.added[part]], "<i4").tobytes())
            continue
        stream = Transducer(merges)
        for at in range(0, len(part), CHUNK):
            out.extend(stream.feed(part[at : at + CHUNK]))
        out.extend(stream.finish())
    return np.frombuffer(b"".join(out), "<i4")


def decode(merges: Merges, ids) -> str:
    """Text of the ids, bytes to text by a state machine that keeps an unfinished
    character between steps; broken sequences become U+FFFD."""
    state = codecs.getincrementaldecoder("utf-8")("replace")
    table, out = merges.bytes_of, []
    for at in range(0, len(ids), CHUNK):
        out.append(state.decode(b"".join([table[i] for i in ids[at : at + CHUNK].tolist()])))
    out.append(state.decode(b"", True))
    return "".join(out)


_LOADED: dict[int, Merges] = {}


def loaded(content: bytes) -> Merges:
    """One vocabulary per worker process; its caches are bounded."""
    key = zlib.crc32(content)
    if key not in _LOADED:
        _LOADED[key] = Merges(zlib.decompress(content))
    return _LOADED[key]


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each whole text and decode its ids again.

    Returns one row per input row: ``doc_id``, ``ids`` (array of int) and
    ``decoded``. A null text counts as empty and has no ids. Null or repeated
    ids are passed on as they are; other columns are never read. An empty table
    gives an empty result. No shuffle; a task holds a batch of texts and few results.
    """
    content = docs.sparkSession.sparkContext.broadcast(zlib.compress(Path(path).read_bytes()))

    def packed(ids: list, encoded: list[np.ndarray], texts: list[str], kind: pa.DataType) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(e) for e in encoded])]).astype("i4")
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(encoded), pa.int32()))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, kind), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = loaded(content.value)
        for batch in batches:
            kind, rows, size = batch.column(0).type, ([], [], []), 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = encode(merges, text.as_py() or "")
                for column, value in zip(rows, (doc_id.as_py(), ids, decode(merges, ids))):
                    column.append(value)
                size += len(rows[2][-1])
                if size >= RESULT:
                    yield packed(*rows, kind)
                    rows, size = ([], [], []), 0
            if rows[0]:
                yield packed(*rows, kind)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
