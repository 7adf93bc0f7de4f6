"""Language of a text by prediction by partial matching.

Each language has a tree of byte contexts of up to ``ORDER`` bytes. A byte costs
the code length of its count in the longest known context, after the escapes
from longer ones (method C, no exclusion); the language with the shortest code
for the whole text wins. The trees are frozen after learning.
"""

from __future__ import annotations

import uuid
from collections import ChainMap
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window, functions as F

from bedside.llm.common import held_out
from bedside.session import cut

ORDER = 4
BLANK = 32
KEEP = 3 << 18  # words a worker keeps the costs of
COSTS = 1 << 26  # bytes of costs a worker keeps, whatever the number of languages
SENT, PARTS = 4096, 64  # languages whose counts are sent to each task; parts of one beyond
SLICE = 1 << 20  # characters split into words at once
LETTER = regex.compile(r"\p{L}")
#: ASCII that is neither letter nor other text becomes a blank.
PLAIN = bytes(b if b > 127 or chr(b).isalpha() else BLANK for b in range(256))


def slices(text: str) -> Iterator[str]:
    """The whole text in parts that end at blanks."""
    at = 0
    while at < len(text):
        end = at + SLICE
        blank = text.find(" ", end) if end < len(text) else -1
        end = len(text) if blank < 0 else blank + 1
        yield text[at:end]
        at = end


def words_of(text: str) -> list[bytes]:
    """Lower-cased words; a word is coded with a blank before and after it, in
    contexts that reach back to the blank before."""
    return text.lower().encode("utf-8", "surrogatepass").translate(PLAIN).split()


def grams(words: list[bytes]) -> tuple[list[np.ndarray], int]:
    """Per order k, a key of k context bytes and the coded byte for every coded
    byte of the words, 0 where the context would reach before the word."""
    line = np.frombuffer(b" " + b"  ".join(words) + b" ", np.uint8).astype(np.int64)
    sizes = np.array([len(w) + 2 for w in words])
    place = np.arange(len(line)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keys, key = [], line.copy()
    for k in range(ORDER + 1):
        if k:
            key = key.copy()
            key[k:] += line[:-k] << (8 * k)
        # A leading 1 tells contexts of different length apart.
        keys.append(np.where(place >= max(k, 1), key + (1 << (8 * (k + 1))), 0))
    return keys, int(sizes.sum())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, key, n) of the texts of a batch."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        texts = batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            for text in [texts[i] or "" for i in np.flatnonzero(langs == lang)]:
                for part in slices(text):
                    words = words_of(part)
                    if not words:
                        continue
                    seen = np.concatenate(grams(words)[0])
                    keys, n = np.unique(seen[seen > 0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["lang", "key", "n"]
                    )


class Sparse:
    """Values by key and language, sorted by key; what is not there has the value ``absent``."""

    def __init__(self, key: np.ndarray, lang: np.ndarray, value: np.ndarray, wide: int, absent: float):
        self.keys, starts = np.unique(key, return_index=True)
        self.starts = np.append(starts, len(key))
        self.lang, self.value = lang.astype(np.int32), value.astype(np.float32)
        self.wide, self.absent = wide, absent

    def rows(self, wanted: np.ndarray) -> np.ndarray:
        """A row per wanted key, a column per language."""
        out = np.full((len(wanted), self.wide), self.absent, np.float32)
        if not len(self.keys):
            return out
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == wanted)
        first = self.starts[at[hit]]
        size = self.starts[at[hit] + 1] - first
        entry = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
        out[np.repeat(hit, size), self.lang[entry]] = self.value[entry]
        return out


class Trees:
    """Costs in bits of each (context, byte) and each escape, by language."""

    def __init__(self, langs: list[str], lang: np.ndarray, key: np.ndarray, n: np.ndarray):
        self.langs = langs
        order = np.lexsort((lang, key))
        lang, key, n = lang[order], key[order], n[order]
        pairs, of = np.unique((key >> 8) * max(len(langs), 1) + lang, return_inverse=True)
        total, kinds = np.bincount(of, n, len(pairs)), np.bincount(of, minlength=len(pairs))
        room = total + kinds
        # In a language that does not know a context the byte has no cost and the escape is free.
        self.cost = Sparse(key, lang, -np.log2(n / room[of]), len(langs), np.inf)
        context, own = np.divmod(pairs, max(len(langs), 1))
        self.escape = Sparse(context, own, -np.log2(kinds / room), len(langs), 0)

    def code_lengths(self, words: list[bytes]) -> np.ndarray:
        """Bits of each word, a row per word and a column per language."""
        keys, n = grams(words)
        bits = np.zeros((n, len(self.langs)), np.float32)
        missing = np.ones(bits.shape, bool)
        for key in reversed(keys):
            distinct, back = np.unique(key, return_inverse=True)
            real = (distinct > 0)[:, None]
            cost = self.cost.rows(distinct)
            escape = np.where(real, self.escape.rows(distinct >> 8), 0)
            known = np.isfinite(cost) & real
            step = np.where(known, cost, escape)
            bits += np.where(missing, step[back], 0)
            missing &= ~known[back]
        coded = np.concatenate(keys[:1]) > 0
        bits += np.where(missing & coded[:, None], np.float32(8), 0)
        sizes = np.array([len(w) + 2 for w in words])
        return np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0)


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_lang: int) -> Trees:
    """Trees of up to ``docs_per_lang`` whole documents a language, chosen by a hash
    of the id among those outside the held-out fold; every (context, byte) pair
    of them is kept."""
    usable = docs.select(docs[id_col].alias("i"), docs[lang_col].alias("lang"), docs[text_col].alias("text"))
    usable = usable.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("i"))
    # By hash, first by a border that lets about twice as many pass, so that no task
    # sorts more than those of a language. The border is found before any shuffle, or
    # by parts of a language where there are too many languages to send to each task.
    ids = usable.select("i", "lang", F.pmod(F.xxhash64("i"), F.lit(1 << 30)).alias("h"))
    sizes = cut(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "sizes")
    if sizes.count() <= SENT:
        sized = ids.join(F.broadcast(sizes), "lang")
    else:
        parts = sizes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        sized = ids.withColumn("part", (F.col("h") % PARTS).cast("int")).join(parts, ["lang", "part"])
    passed = sized.filter(F.col("h") < F.lit(float(2 * docs_per_lang << 30)) / F.col("n")).select("i", "lang", "h")
    order = Window.partitionBy("lang").orderBy("h", "i")
    chosen = passed.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= docs_per_lang)
    chosen = cut(chosen.select("i").distinct(), "sample")
    sample = usable.join(chosen, "i", "left_semi").select("lang", "text")
    counts = sample.mapInArrow(_count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    rows = counts.toArrow()
    langs = sorted(rows["lang"].unique().to_pylist())
    lang = pc.index_in(rows["lang"], pa.array(langs, pa.string())).to_numpy()
    return Trees(langs, lang, rows["key"].to_numpy(), rows["n"].to_numpy().astype(np.float64))


_KEPT: dict[str, tuple[dict[bytes, int], np.ndarray]] = {}


class Scorer:
    """Code lengths of whole texts, the words of which are coded once."""

    def __init__(self, name: str, trees: Trees):
        self.trees = trees
        if name not in _KEPT:
            _KEPT.clear()
            rows = min(KEEP, COSTS // (4 * max(len(trees.langs), 1)))
            _KEPT[name] = ({}, np.zeros((rows, len(trees.langs)), np.float32))
        self.place, self.costs = _KEPT[name]

    def __call__(self, texts: list[str]) -> np.ndarray:
        """A row of code lengths per text; texts are taken together while small."""
        out = np.zeros((len(texts), len(self.trees.langs)))
        held, size = [], 0
        for i, text in enumerate(texts):
            for part in slices(text):
                held.append((i, words_of(part)))
                size += len(part)
                if size >= SLICE:
                    self._add(held, out)
                    held, size = [], 0
        self._add(held, out)
        return out

    def _add(self, held: list[tuple[int, list[bytes]]], out: np.ndarray) -> None:
        """Add the costs of the words; words beyond those kept are coded each time."""
        fresh = sorted(set().union(*[words for _, words in held]) - self.place.keys())
        place, costs = self.place, self.costs
        if fresh:
            found = self.trees.code_lengths(fresh)
            at, room = len(place), len(costs) - len(place)
            costs[at : at + len(fresh[:room])] = found[:room]
            place.update(zip(fresh[:room], range(at, at + room)))
            if fresh[room:]:
                costs = np.vstack([costs, found[room:]])
                extra = dict(zip(fresh[room:], range(len(self.costs), len(costs))))
                place = ChainMap(extra, place)
        for i, words in held:
            if words:
                out[i] += costs[list(map(place.__getitem__, words))].sum(axis=0, dtype=np.float64)


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    docs_per_lang: int = 2000,
) -> DataFrame:
    """Language of every row: ``doc_id``, ``held_out``, ``lang_pred``, ``score``.

    The trees are learned from whole texts with a language, outside the fold
    ``crc32(id) mod 5 = 0``, at most ``docs_per_lang`` a language, and keep all that
    these hold; every language with a word in them can be the answer. No other
    column is used. ``score`` is the share of the winner's probability, 2 to the minus
    code length, among all languages; equal code lengths go to the first name.
    A null text, a text without a letter and any text when nothing could be
    learned is ``und`` with score 0. Null ids are held out; repeated rows are
    answered alike; an empty table gives an empty result.
    """
    trees = learn(docs, id_col, text_col, lang_col, docs_per_lang)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(trees)  # bounded by the learning texts
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(name, shared.value)
        langs = score.trees.langs
        for batch in batches:
            texts = batch.column(2).to_pylist()
            real = np.array([bool(langs) and t is not None and LETTER.search(t) is not None for t in texts], bool)
            names, shares = np.full(len(texts), "und", object), np.zeros(len(texts))
            if real.any():
                bits = score([t for t, r in zip(texts, real) if r])
                best = bits.argmin(axis=1)
                lead = bits - bits.min(axis=1, keepdims=True)
                names[real] = np.array(langs, object)[best]
                shares[real] = 1 / np.exp2(-np.minimum(lead, 1000)).sum(axis=1)
            columns = [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(shares)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
