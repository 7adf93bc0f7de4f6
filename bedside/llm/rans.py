"""Static range asymmetric numeral system over numpy lanes.

A segment is a list of ids with one frequency table, cut into blocks of
``LANES * STEPS`` ids. A block has its own states, words and checksum, so the
blocks of a segment can be decoded apart; their starts are the checkpoints.
Inside a block ``LANES`` coders are interleaved over one stream of words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"RANS"
VERSION = 1
LANES = 64
STEPS = 1024
BITS = 18
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
HEAD = struct.Struct("<4sHHIIII")  # magic, version, bits, ids, blocks, lanes, bytes of the table
BLOCK = LANES * STEPS
DENSE = 1 << 22  # ids below this are counted and looked up by table, others by sorting


class Damaged(ValueError):
    """A segment whose content does not fit its header or checksums."""


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, shares of 2**BITS), each share 1 at least."""
    if len(ids) and ids.max() < DENSE:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
    else:
        symbols, counts = np.unique(ids, return_counts=True)
    if len(symbols) > 1 << BITS:
        raise ValueError("more different ids than shares")
    share = np.maximum(counts * (1 << BITS) // counts.sum(), 1)
    over = int(share.sum()) - (1 << BITS)
    order = np.argsort(-share, kind="stable")
    if over < 0:
        share[order[0]] -= over
    for i in order:
        if over <= 0:
            break
        cut = min(over, int(share[i]) // 2)
        share[i] -= cut
        over -= cut
    while over > 0:  # many shares of 1 or 2: take one at a time
        big = np.flatnonzero(share > 1)[:over]
        share[big] -= 1
        over -= len(big)
    return symbols.astype(np.uint32), share.astype(np.uint32)


def _padded(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(blocks, steps, lanes) of ids and which of them are real."""
    blocks = -(-len(ids) // BLOCK)
    steps = STEPS if blocks > 1 else -(-len(ids) // LANES)
    full = np.zeros(blocks * steps * LANES, ids.dtype)
    full[: len(ids)] = ids
    real = np.arange(len(full)) < len(ids)
    return full.reshape(blocks, steps, LANES), real.reshape(blocks, steps, LANES), steps


def encode(ids: np.ndarray) -> bytes:
    """One segment; ``ids`` are unsigned and there is one at least."""
    symbols, share = frequencies(ids)
    start = np.concatenate([[0], np.cumsum(share)[:-1]]).astype(np.uint64)
    if symbols[-1] < DENSE:
        place_of = np.zeros(symbols[-1] + 1, np.int64)
        place_of[symbols] = np.arange(len(symbols))
        places = place_of[ids]
    else:
        places = np.searchsorted(symbols, ids).astype(np.int64)
    place, real, steps = _padded(places)
    freq, first = share.astype(np.uint64)[place], start[place]
    blocks = len(place)
    state = np.full((blocks, LANES), LOW, np.uint64)
    most = (LOW >> np.uint64(BITS)) << WORD
    whole_steps = (len(ids) - (blocks - 1) * BLOCK) // LANES  # steps all lanes take part in
    words, owners = [], []
    for step in range(steps - 1, -1, -1):
        f, on = freq[:, step], real[:, step]
        spill = state >= most * f
        if step >= whole_steps:
            spill &= on
        words.append((state[spill] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        owners.append(np.nonzero(spill)[0])
        state[spill] >>= WORD
        whole = state // f
        next_ = (whole << np.uint64(BITS)) + (state - whole * f) + first[:, step]
        state = next_ if step < whole_steps else np.where(on, next_, state)
    words, owners = np.concatenate(words[::-1]), np.concatenate(owners[::-1])
    words = words[np.argsort(owners, kind="stable")]
    sizes = np.bincount(owners, minlength=blocks).astype("<u4")
    sums = np.array([zlib.crc32(ids[i : i + BLOCK].astype("<u4").tobytes()) for i in range(0, len(ids), BLOCK)], "<u4")
    table = zlib.compress(np.diff(symbols, prepend=np.uint32(0)).astype("<u4").tobytes() + share.astype("<u4").tobytes(), 6)
    head = HEAD.pack(MAGIC, VERSION, BITS, len(ids), blocks, LANES, len(table))
    return b"".join([head, table, sizes.tobytes(), sums.tobytes(), state.astype("<u8").tobytes(), words.astype("<u4").tobytes()])


def decode(body: bytes, only: range | None = None) -> np.ndarray:
    """The ids of a segment, or of some of its blocks; checks every checksum."""
    if len(body) < HEAD.size:
        raise Damaged("too short")
    magic, version, bits, count, blocks, lanes, table_size = HEAD.unpack_from(body)
    if (magic, version, bits, lanes) != (MAGIC, VERSION, BITS, LANES):
        raise Damaged("unknown header")
    try:
        table = np.frombuffer(zlib.decompress(body[HEAD.size : HEAD.size + table_size]), "<u4")
    except zlib.error as error:
        raise Damaged("frequency table") from error
    symbols, share = np.cumsum(table[: len(table) // 2]).astype(np.uint32), table[len(table) // 2 :]
    at = HEAD.size + table_size
    sizes = np.frombuffer(body, "<u4", blocks, at).astype(np.int64)
    sums = np.frombuffer(body, "<u4", blocks, at + 4 * blocks)
    states = np.frombuffer(body, "<u8", blocks * lanes, at + 8 * blocks).reshape(blocks, lanes)
    words = np.frombuffer(body, "<u4", -1, at + 8 * blocks + 8 * blocks * lanes)
    if int(share.sum()) != 1 << bits or sizes.sum() != len(words):
        raise Damaged("sizes do not fit")
    picked = np.arange(blocks) if only is None else np.array(only)
    lengths = np.minimum(count - picked * BLOCK, BLOCK)
    ids = _run(symbols, share, states[picked], (np.cumsum(sizes) - sizes)[picked], words, lengths)
    out = []
    for row, length, total in zip(ids, lengths, sums[picked]):
        piece = row[:length].astype("<u4")
        if zlib.crc32(piece.tobytes()) != total:
            raise Damaged("checksum")
        out.append(piece)
    return np.concatenate(out) if out else np.empty(0, "<u4")


def _run(symbols, share, states, pointers, words, lengths) -> np.ndarray:
    start = np.concatenate([[0], np.cumsum(share)[:-1]])
    # Per slot of the state: its symbol, and its share with its place inside the share.
    symbol_of = np.repeat(symbols, share)
    inside = np.arange(1 << BITS) - np.repeat(start, share)
    step_of = (np.repeat(share, share).astype(np.uint64) << WORD) | inside.astype(np.uint64)
    state, pointers = states.astype(np.uint64).ravel(), pointers.copy()
    words = np.append(words, np.uint32(0)).astype(np.uint64)
    mask, low_word, bits = np.uint64((1 << BITS) - 1), np.uint64(0xFFFFFFFF), np.uint64(BITS)
    blocks = len(states)
    steps, full = -(-int(lengths.max(initial=0)) // LANES), int(lengths.min(initial=0)) // LANES
    out = np.empty((steps, blocks * LANES), np.uint64)
    lane, row = np.tile(np.arange(LANES), blocks), np.repeat(np.arange(blocks), LANES)
    last = np.repeat(lengths, LANES)
    for step in range(steps):
        slot = state & mask
        out[step] = slot
        packed = step_of[slot]
        next_ = (packed >> WORD) * (state >> bits) + (packed & low_word)
        state = next_ if step < full else np.where(step * LANES + lane < last, next_, state)
        need = np.flatnonzero(state < LOW) if step < full else np.flatnonzero((state < LOW) & (step * LANES + lane < last))
        if len(need):
            of = row[need]
            taken = np.bincount(of, minlength=blocks)
            place = np.arange(len(need)) + np.repeat(pointers - np.cumsum(taken) + taken, taken)
            state[need] = (state[need] << WORD) | words[np.minimum(place, len(words) - 1)]
            pointers += taken
    return symbol_of[out].reshape(steps, blocks, LANES).transpose(1, 0, 2).reshape(blocks, -1)
