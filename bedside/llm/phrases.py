"""Phrase collocations: words, then phrases of 2, 3 and 4 words, counted by tries.

Words are known by 64-bit hashes made with numpy for all words of a block of
text at once. A scan broadcasts a double-array trie of the candidates of one
length, moves the states of all text positions through it together, counts the
accepting states, and hands in the extensions of accepted positions, which are
the candidates of the next length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from bedside.llm.common import prefix_sums
from bedside.session import cut

BLOCK = 1 << 21  # bytes of text worked on at once
ROWS = 1 << 16  # counts handed on at once
STRIP = 1 << 20  # bytes hashed at once
HELD = 1 << 20  # extensions a task gathers before it counts them
TRIE = 1 << 19  # phrases a broadcast trie holds, about
SMALL = 16  # children up to which trie nodes are placed together
#: Odd multipliers of the word hash; the next one is taken if two words meet.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
WORD, BLANK, STOP = 0, 1, 2


def _byte_kinds() -> tuple[np.ndarray, np.ndarray]:
    kinds = np.zeros(256, np.uint8)
    kinds[[0x20, 0x09]] = BLANK
    kinds[[*b".,;:!?", *range(0x0A, 0x0E)]] = STOP
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    return kinds, lower


KINDS, LOWER = _byte_kinds()


class Words:
    """The words of a block of documents: hashes, places, and which ones follow
    another word of the same piece of the same document."""

    def __init__(self, texts: list[bytes], base: int):
        self.raw = LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
        kinds = KINDS[self.raw]
        inside = np.concatenate([[False], kinds == WORD, [False]])
        border = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = border[::2], border[1::2]
        stops = np.searchsorted(np.flatnonzero(kinds == STOP), self.starts)
        self.follows = np.concatenate([[False], stops[1:] == stops[:-1]])[: len(stops)]
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        self.doc = np.searchsorted(begins, self.starts, "right") - 1
        self.hash = np.empty(len(self.starts), np.int64)
        cuts = np.searchsorted(self.starts, np.arange(0, len(self.raw), STRIP))
        for first, last in zip(cuts, np.append(cuts[1:], len(self.starts))):
            if first < last:
                self._hash(first, last, base)

    def _hash(self, first: int, last: int, base: int) -> None:
        """Sums of bytes times powers modulo 2**64; a word's part of them is
        moved to power 0."""
        begin, end = self.starts[first], self.ends[last - 1]
        power, inverse = _powers(base, end - begin)
        sums = np.zeros(end - begin + 1, np.uint64)
        np.cumsum((self.raw[begin:end].astype(np.uint64) + np.uint64(1)) * power[: end - begin], out=sums[1:])
        at = self.starts[first:last] - begin
        mixed = (sums[self.ends[first:last] - begin] - sums[at]) * inverse[at]
        mixed ^= mixed >> np.uint64(29)
        self.hash[first:last] = (mixed * np.uint64(BASES[0])).view(np.int64)

    def text(self, chosen: np.ndarray) -> pa.Array:
        """The chosen words as strings."""
        sizes = self.ends[chosen] - self.starts[chosen]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        place = np.repeat(self.starts[chosen] - offsets[:-1], sizes) + np.arange(offsets[-1])
        buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.raw[place])]
        return pa.LargeStringArray.from_buffers(len(chosen), buffers[1], buffers[2]).cast(pa.string())


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64, at least ``size`` of them."""
    if base not in _POWERS or len(_POWERS[base][0]) < size:
        both = []
        for step in (base, pow(base, -1, 1 << 64)):
            powers = np.full(max(size, 1), step, np.uint64)
            powers[0] = 1
            both.append(np.cumprod(powers))
        _POWERS[base] = (both[0], both[1])
    return _POWERS[base]


def _blocks(batches: Iterator[pa.RecordBatch], base: int) -> Iterator[tuple[Words, np.ndarray, list[str]]]:
    """Blocks of whole documents (lang, text): their words, the language of each
    word as a place in the list of the block's languages, and that list."""

    def block():
        found = Words(texts, base)
        names = sorted(set(langs))
        code = {name: i for i, name in enumerate(names)}
        return found, np.array([code[x] for x in langs])[found.doc], names

    texts, langs, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            texts.append(text.as_py())
            langs.append(lang)
            size += len(texts[-1]) + 1
            if size >= BLOCK:
                yield block()
                texts, langs, size = [], [], 0
    if texts:
        yield block()


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)])


def _word_counts(base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, lang, names in _blocks(batches, base):
            by_lang = np.argsort(lang, kind="stable")
            begins = np.searchsorted(lang[by_lang], np.arange(len(names) + 1))
            for name, first, last in zip(names, begins, begins[1:]):
                order = by_lang[first:last]
                order = order[np.argsort(words.hash[order])]
                new = _runs(words.hash[order])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(new), pa.string()), pa.array(words.hash[order[new]]),
                     words.text(order[new]), pa.array(np.diff(np.append(new, len(order))))],
                    names=["lang", "h", "word", "n"],
                )

    return run


class DoubleArray:
    """Trie of (lang, word hashes) rows: a state's child by word ``w`` is the state
    ``base[state] + w`` if ``check`` there names the state."""

    def __init__(self, langs: list[str], phrases: list[list[int]]):
        lengths = np.array([len(p) for p in phrases])
        self.depth = int(lengths.max())
        flat = np.concatenate([np.array(p, np.int64) for p in phrases])
        self.vocabulary, word = np.unique(flat, return_inverse=True)
        begins = np.cumsum(lengths) - lengths
        self.langs, node = np.unique(np.array(langs, object).astype(str), return_inverse=True)
        parents, words, ends = [], [], np.empty(len(phrases), np.int64)
        first, nodes = 0, len(self.langs)
        owner = node.astype(np.int64)  # node reached so far by each phrase
        for level in range(self.depth):
            longer = np.flatnonzero(lengths > level)
            key = owner[longer] * len(self.vocabulary) + word[begins[longer] + level]
            distinct, place = np.unique(key, return_inverse=True)
            parents.append(distinct // len(self.vocabulary))
            words.append(distinct % len(self.vocabulary))
            owner[longer] = nodes + place
            ends[longer] = owner[longer]
            first, nodes = nodes, nodes + len(distinct)
        self._place(np.concatenate(parents), np.concatenate(words), nodes)
        self.accept = np.full(len(self.check), -1, np.int64)
        self.accept[self.state[ends]] = np.arange(len(phrases))
        self.size = len(phrases)

    def _place(self, parents: np.ndarray, words: np.ndarray, nodes: int) -> None:
        """Give every node with children a base such that no two children share a slot.

        Nodes with most children go first, one at a time; the small ones all try a
        random slot together, and of those that meet the first wins. Where tries
        fail the array grows.
        """
        order = np.lexsort((words, parents))
        parents, words = parents[order], words[order]
        begin = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        counts = np.diff(np.append(begin, len(parents)))
        roots, width = len(self.langs), len(self.vocabulary)
        taken = np.zeros(roots + 1 + 2 * width + 2 * len(parents), bool)
        taken[: roots + 1] = True
        base_of = np.zeros(nodes, np.int64)
        waiting = np.argsort(-counts, kind="stable")
        draw = np.random.default_rng(0)
        for i in waiting[counts[waiting] > SMALL].tolist():
            own = words[begin[i] : begin[i] + counts[i]]
            tries = draw.integers(roots + 1, len(taken) - width, 32)
            free = np.flatnonzero(~taken[tries[:, None] + own].any(axis=1))
            if len(free):
                base = int(tries[free[0]])
            else:
                base = len(taken)
                taken = np.append(taken, np.zeros(width, bool))
            taken[base + own] = True
            base_of[parents[begin[i]]] = base
        waiting = waiting[counts[waiting] <= SMALL]
        while len(waiting):
            base = draw.integers(roots + 1, len(taken) - width, len(waiting))
            sizes = counts[waiting]
            own = np.repeat(np.arange(len(waiting)), sizes)
            child = np.repeat(begin[waiting] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(own))
            slot = base[own] + words[child]
            bad = taken[slot]
            seen = np.argsort(slot, kind="stable")
            bad[seen[np.concatenate([[False], slot[seen][1:] == slot[seen][:-1]])]] = True
            failed = np.bincount(own, bad, len(waiting)) > 0
            taken[slot[~failed[own]]] = True
            base_of[parents[begin[waiting[~failed]]]] = base[~failed]
            if failed.mean() > 0.5:
                taken = np.append(taken, np.zeros(len(taken) // 2 + width, bool))
            waiting = waiting[failed]
        size = len(taken)
        self.check = np.full(size, -1, np.int32)
        self.state = np.empty(nodes, np.int64)
        self.state[:roots] = np.arange(roots)
        slots = base_of[parents] + words
        # Children are numbered in the order they were given, after the roots.
        self.state[roots + order] = slots
        self.check[slots] = self.state[parents]
        self.base = np.zeros(size, np.int32)
        self.base[self.state] = base_of

    def words(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash in the vocabulary, -1 for other words."""
        place = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[place] == hashes, place, -1)

    def step(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """States of all positions after one more word; -1 is dead."""
        target = np.where((states >= 0) & (words >= 0), self.base[states] + words, 0)
        return np.where((target > 0) & (self.check[target] == states), target, -1)


def _scan(trie, base: int, k: int, whole: bool, extend: bool):
    """Counts of the trie's phrases of ``k`` words (id, no hash) and, handed in with
    the number of times seen, their extensions (id, hash of the next word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree: DoubleArray = trie.value
        root = {name: i for i, name in enumerate(tree.langs.tolist())}

        def handed(ids: np.ndarray, hashes: np.ndarray | None, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(n), ROWS):
                part = slice(at, at + ROWS)
                h = pa.nulls(len(n[part]), pa.int64()) if hashes is None else pa.array(hashes[part])
                yield pa.RecordBatch.from_arrays([pa.array(ids[part]), h, pa.array(n[part])], names=["id", "h", "n"])

        def extensions(keys: np.ndarray, following: np.ndarray) -> Iterator[pa.RecordBatch]:
            key, n = np.unique(keys, return_counts=True)
            return handed(key // len(following), following[key % len(following)], n)

        total = np.zeros(tree.size, np.int64)
        held, waiting = [], 0
        for found, lang, names in _blocks(batches, base):
            size = len(found.hash)
            words = tree.words(found.hash)
            at = np.array([root.get(name, -1) for name in names], np.int64)[lang]
            alive = np.ones(size, bool)  # the next word belongs to the same piece
            for level in range(k):
                if level:
                    alive[: max(size - level, 0)] &= found.follows[level:]
                    alive[max(size - level, 0) :] = False
                at = np.where(alive, tree.step(at, np.concatenate([words[level:], np.full(min(level, size), -1)])), -1)
            accepted = tree.accept[at]
            accepted[at < 0] = -1
            total += np.bincount(accepted[accepted >= 0], minlength=tree.size)
            if not extend or size <= k:
                continue
            further = np.flatnonzero((accepted[:-k] >= 0) & found.follows[k:])
            if whole:  # the last k words must be a candidate too, so the next word is known
                further = further[accepted[further + 1] >= 0]
                held.append(accepted[further] * len(tree.vocabulary) + words[further + k])
                waiting += len(further)
                if waiting >= HELD:
                    yield from extensions(np.concatenate(held), tree.vocabulary)
                    held, waiting = [], 0
            elif len(further):
                following, place = np.unique(found.hash[further + k], return_inverse=True)
                yield from extensions(accepted[further] * len(following) + place, following)
        if waiting:
            yield from extensions(np.concatenate(held), tree.vocabulary)
        if k > 1:  # words are counted before
            hit = np.flatnonzero(total)
            yield from handed(hit, None, total[hit])

    return run


def _counted(texts: DataFrame, candidates: DataFrame, base: int, k: int, least: int, extend: bool, trie_size: int) -> DataFrame:
    """(lang, p, n) of candidates of ``k`` words, and of candidates of ``k + 1``."""
    spark = texts.sparkSession
    shards = -(-candidates.count() // trie_size)
    out = None
    for shard in range(shards):
        own = candidates.filter(F.pmod(F.xxhash64("lang", "p"), F.lit(shards)) == shard)
        rows = own.select("lang", "p").toArrow()
        if not rows.num_rows:
            continue
        trie = spark.sparkContext.broadcast(DoubleArray(rows["lang"].to_pylist(), rows["p"].to_pylist()))
        found = texts.mapInArrow(_scan(trie, base, k, shards == 1, extend), "id long, h long, n long")
        found = found.groupBy("id", "h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        named = spark.createDataFrame(rows.append_column("id", pa.array(range(rows.num_rows), pa.int64())))
        found = cut(found, f"found-{k}-{shard}").join(cut(named, f"candidates-{k}-{shard}"), "id")
        longer = F.when(F.col("h").isNull(), F.col("p")).otherwise(F.concat("p", F.array("h")))
        found = cut(found.select("lang", longer.alias("p"), "n"), f"phrases-{k}-{shard}")
        out = found if out is None else out.unionByName(found)
    return out


def collocations(
    docs: DataFrame, least: int = 30, most: int = 2000, longest: int = 4, share: int = 80, trie_size: int = TRIE,
    lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """The ``most`` best phrases of 2 to ``longest`` words of every language:
    ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Texts are lower-cased (A-Z) and cut into pieces at ``.,;:!?`` and line ends,
    pieces into words at blanks and tabs. ``a`` counts a phrase inside pieces,
    overlaps included; phrases with ``a >= least`` are candidates. A cut into
    first part (count ``l``) and rest (``r``) scores floor(2000000 a / (l + r));
    the lowest cut counts, of equal ones the shortest first part. Candidates that
    lie in a longer one of at least ``share`` percent of their count go. Order:
    score, then ``a``, both descending, then phrase by bytes. ``n`` is the number
    of words of the language.

    All counts are over all texts. A phrase can be frequent only if its parts are,
    so a scan hands in just the extensions of frequent phrases, summed before and
    after the shuffle, and those that reach ``least`` are the candidates the next
    trie counts. A trie holds about ``trie_size`` phrases, which bounds the
    broadcast; more candidates make more tries and one scan each. Words are
    hashed to 64 bits; that no two words of a language share a hash is checked
    over all words, and another hash is taken if they do.

    A null text is empty, a null language ``und``; ids and other columns are never
    read; equal rows count each. An empty table, or one without frequent phrases,
    gives no rows. A long text is one block; a word may be of any length.
    """
    texts = docs.select(
        F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(docs[text_col], F.lit("")).alias("text"),
    )
    for base in BASES:
        words = texts.mapInArrow(_word_counts(base), "lang string, h long, word string, n long")
        words = cut(words.groupBy("lang", "h", "word").agg(F.sum("n").alias("n")), "words")
        if words.groupBy("lang", "h").count().filter("count > 1").isEmpty():
            break
    else:
        raise ValueError("words share hashes under every multiplier")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = cut(words.filter(F.col("n") >= least), "frequent-words")
    counts = frequent.select("lang", F.array("h").alias("p"), "n")
    level = counts
    for k in range(1, longest + 1):
        found = _counted(texts, level, base, k, least, k < longest, trie_size)
        if found is None:
            break
        if k > 1:
            counts = counts.unionByName(found.filter(F.size("p") == k))
        level = found.filter(F.size("p") == k + 1)
    scored = _scored(cut(counts, "counts"), longest, share)
    return _ranked(scored, frequent, totals, most)


def _scored(counts: DataFrame, longest: int, share: int) -> DataFrame:
    """Candidates that stay, with the counts and score of their lowest cut."""
    size = F.size("p")
    long = counts.filter(size > 1)
    cuts = long.select("lang", "p", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    for name, part in (("l", F.slice("p", F.lit(1), F.col("k"))), ("r", F.slice("p", F.col("k") + 1, F.size("p") - F.col("k")))):
        parts = counts.select("lang", F.col("p").alias("part"), F.col("n").alias(name))
        cuts = cuts.withColumn("part", part).join(parts, ["lang", "part"]).drop("part")
    both = "(cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))"
    score = F.expr(f"cast((cast(2000000 as decimal(8, 0)) * cast(a as decimal(20, 0))) div {both} as bigint)")
    best = cuts.withColumn("score", score).groupBy("lang", "p", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    inside = long.filter(size > 2).select(
        "lang", F.col("n").alias("longer"), F.col("p").alias("q"),
        F.explode(F.sequence(F.lit(2), size - 1)).alias("m"),
    )
    inside = inside.select("lang", "longer", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("q") - F.col("m") + 1), lambda i: F.slice("q", i, F.col("m"))
    )).alias("p")).groupBy("lang", "p").agg(F.max("longer").alias("longer"))
    held = F.lit(100).cast("decimal(20,0)") * F.col("longer") >= F.lit(share).cast("decimal(20,0)") * F.col("a")
    kept = best.join(inside, ["lang", "p"], "left").filter(~F.coalesce(held, F.lit(False)))
    return cut(kept.select("lang", "p", "a", "b.l", "b.r", "b.score"), "scored")


def _ranked(scored: DataFrame, frequent: DataFrame, totals: DataFrame, most: int) -> DataFrame:
    """The ``most`` first rows of a language, phrases as text. Ranks come from a
    range sort, so a language may hold any share of the phrases."""
    named = scored.select("*", F.posexplode("p").alias("i", "h"))
    named = named.join(frequent.select("lang", "h", "word"), ["lang", "h"])
    order = F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"])
    named = named.groupBy("lang", "p", "a", "l", "r", "score").agg(F.concat_ws(" ", order).alias("phrase")).drop("p")
    keys = [F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    placed = prefix_sums(named.withColumn("_one", F.lit(0)), keys, "_one", "phrases-ranked")
    # One row per language of all candidates.
    firsts = named.groupBy("lang").agg(F.count(F.lit(1)).alias("c"))
    before = Window.orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cut(firsts.select("lang", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first")), "firsts")
    placed = placed.withColumnRenamed("rank", "_rank").join(firsts, "lang")
    placed = placed.withColumn("rank", F.col("_rank") - F.col("first") + 1).filter(F.col("rank") <= most)
    return placed.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"
    )
