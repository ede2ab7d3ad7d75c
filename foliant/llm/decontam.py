"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment on words.

Words are runs of letters and digits, A-Z as a-z. The test items go through in
blocks of a bounded number of words, so that a block's seeds can be broadcast
whatever the benchmark's size; the documents are scanned twice for each block:
once to count the seeds over all documents, once to align what seeds point to.
A rare seed is enough for that; where common ones stand alone, enough of the
item's words must stand around them for the least score, which no listed pair fails.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.textops import U64, chunks, shingle_hashes, word_hashes

SEED_WORDS = 3
#: Test words in a block: its seeds take some 20 MB at most.
BLOCK_WORDS = 500_000
#: A seed is rare if it stands in the corpus at most once in so many words, or is in the rarer half of those of its item's seeds that the corpus has.
RARE_ONCE_IN = 1_000_000
#: Alignment: a match counts 1, a mismatch or a gap of one word costs 1.
LEAST_SHARE, LEAST_SCORE = 0.4, 8
#: So many items that a text opens are looked at one by one; of more, their words are counted first.
FEW_ITEMS = 16
_FILTER_BITS = 22


def _lists(keys: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct keys in order, n + 1 heads of their runs, the values run by run)."""
    order = np.argsort(keys, kind="stable")
    own, first = np.unique(keys[order], return_index=True)
    return own, np.append(first, len(keys)), [v[order] for v in values]


def _runs(heads: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The places of all values of the runs which, one run after the other."""
    sizes = heads[which + 1] - heads[which]
    return np.repeat(heads[which] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


@dataclass
class Block:
    """The items of a block as word hashes, with lists by seed (item, place in it) and by word (item, how often)."""

    ids: list
    words: list[np.ndarray]

    def __post_init__(self) -> None:
        n = np.array([len(w) for w in self.words], np.int64)
        rows = np.concatenate([[0], np.cumsum(n)])
        every = np.concatenate([*self.words, np.zeros(0, U64)])
        hashes, heads = shingle_hashes(every, rows, SEED_WORDS)
        seeds = np.diff(heads)
        item = np.repeat(np.arange(len(n)), seeds)
        place = np.arange(len(hashes)) - np.repeat(heads[:-1], seeds)
        whole = n[item] >= SEED_WORDS  # an item of fewer words is no passage
        self.seeds, self.seed_heads, (self.seed_item, self.seed_place) = _lists(hashes[whole], [item[whole], place[whole]])
        self.vocabulary, self.word_heads, (self.word_item,) = _lists(every, [np.repeat(np.arange(len(n)), n)])
        self.least = np.maximum(np.minimum(LEAST_SCORE, n), LEAST_SHARE * n)
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[(self.seeds >> U64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of hashes that are seeds, and the seeds' numbers."""
        at = np.flatnonzero(self.bits[(hashes >> U64(64 - _FILTER_BITS)).astype(np.int64)])
        if not len(at) or not len(self.seeds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        seed = np.minimum(np.searchsorted(self.seeds, hashes[at]), len(self.seeds) - 1)
        own = self.seeds[seed] == hashes[at]
        return at[own], seed[own]

    def rare(self, counts: np.ndarray, n_words: int) -> np.ndarray:
        rare = counts * RARE_ONCE_IN <= n_words
        by_item: dict[int, set[int]] = defaultdict(set)
        for seed in np.flatnonzero(counts).tolist():
            for item in self.seed_item[self.seed_heads[seed] : self.seed_heads[seed + 1]].tolist():
                by_item[item].add(seed)
        for seeds in by_item.values():
            rarer = sorted(seeds, key=lambda x: (counts[x], x))
            rare[rarer[: (len(rarer) + 1) // 2]] = True
        return rare

    def words_in(self, text: np.ndarray) -> np.ndarray:
        """How many of each item's words stand in a text, by one pass over the lists of the text's words."""
        own = np.unique(text)
        at = np.minimum(np.searchsorted(self.vocabulary, own), len(self.vocabulary) - 1)
        at = at[self.vocabulary[at] == own]
        return np.bincount(self.word_item[_runs(self.word_heads, at)], minlength=len(self.words))

    def opened(self, text: np.ndarray, seeds: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(open, sure) by item: open are those with a seed in the text, sure those with a rare one.

        Of more than FEW_ITEMS only those are open of which enough words stand
        in the text. A word of an item adds 1 to a score at most, and only if it
        stands there: no item that is left out reaches its least score. Seeds
        that very many items share cost one look at their lists, not one for
        each item.
        """
        sure, open_ = np.zeros(len(self.words), bool), np.zeros(len(self.words), bool)
        sure[self.seed_item[_runs(self.seed_heads, seeds[rare[seeds]])]] = True
        open_[self.seed_item[_runs(self.seed_heads, seeds)]] = True
        if np.count_nonzero(open_) > FEW_ITEMS:
            open_ &= self.words_in(text) >= self.least
        return open_, sure

    def starts(self, places: np.ndarray, seeds: np.ndarray, open_: np.ndarray) -> dict[int, list[int]]:
        """Where the open items should begin, by the places in a text where their seeds stand."""
        out: dict[int, list[int]] = defaultdict(list)
        order = np.argsort(seeds, kind="stable")
        which, first = np.unique(seeds[order], return_index=True)
        for k, at in zip(which.tolist(), np.split(places[order], first[1:])):
            own = slice(self.seed_heads[k], self.seed_heads[k + 1])
            for item, q in zip(self.seed_item[own][open_[self.seed_item[own]]].tolist(), self.seed_place[own][open_[self.seed_item[own]]].tolist()):
                out[item] += (at - q).tolist()
        return out


def _seeds_of(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for i, j, data, offsets in chunks(text):
        words, rows = word_hashes(data, offsets, plain=True)
        hashes, heads = shingle_hashes(words, rows, SEED_WORDS)
        yield i, j, words, rows, hashes, heads


def _count(block: Block, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n_words = np.zeros(len(block.seeds), np.int64), 0
    for batch in batches:
        for _, _, words, _, hashes, _ in _seeds_of(batch.column("text")):
            total += np.bincount(block.hits(hashes)[1], minlength=len(total))
            n_words += len(words)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], n_words))], ["seed", "n"])


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score and the end of its place in the text."""
    best, end = 0, 0
    ramp = np.arange(len(text))
    above = np.zeros(len(text), np.int64)
    for word in item:
        diagonal = np.empty_like(above)
        diagonal[0], diagonal[1:] = 0, above[:-1]
        row = np.maximum(np.maximum(diagonal + np.where(text == word, 1, -1), above - 1), 0)
        above = np.maximum.accumulate(row + ramp) - ramp  # gaps in the item: the best cell to the left, less the distance
        at = int(above.argmax())
        if above[at] > best:
            best, end = int(above[at]), at + 1
    return best, end


def _windows(starts: list[int], length: int, n: int) -> Iterator[tuple[int, int]]:
    """Parts of a text of n words around the places where an item of a length should begin."""
    starts.sort()
    low = high = starts[0]
    for s in starts[1:]:
        if s - high > length:
            yield max(0, low - length // 2), min(n, high + length + length // 2)
            low = s
        high = s
    yield max(0, low - length // 2), min(n, high + length + length // 2)


def _search(block: Block, rare: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "item_no", "score", "start_word", "end_word"]
    for batch in batches:
        ids = batch.column("id")
        rows_out, found = [], []
        for i, j, words, rows, hashes, heads in _seeds_of(batch.column("text")):
            at, seed = block.hits(hashes)
            owner = np.searchsorted(heads, at, "right") - 1
            for r in np.unique(owner):
                own = words[rows[r] : rows[r + 1]]
                places, seeds = at[owner == r] - heads[r], seed[owner == r]
                open_, sure = block.opened(own, np.unique(seeds), rare)
                begin = block.starts(places, seeds, open_)
                crowded = len(begin) > FEW_ITEMS
                for item, starts in begin.items():
                    target, best = block.words[item], (0, 0, 0)
                    least = block.least[item]
                    for a, b in _windows(starts, len(target), len(own)):
                        # A word of the item adds 1 to a score at most, and only if it stands in the window.
                        if (crowded or not sure[item]) and np.isin(target, own[a:b]).sum() < least:
                            continue
                        score, end = align(target, own[a:b])
                        best = max(best, (score, -a, a + end))
                    if best[0] >= least:
                        rows_out.append(i + r)
                        found.append((item, best[0] / len(target), -best[1], best[2]))
        if found:
            item, score, a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows_out)), pa.array(item, pa.int32()), pa.array(score, pa.float64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(id, item, score, start_word, end_word) of documents (id, text) that hold test items (item, text).

    score is the best local alignment's over the number of the item's words:
    1 for an exact copy. A pair is listed if it is LEAST_SHARE and the alignment
    counts LEAST_SCORE or more; the words given are the part of the document
    that was aligned, up to the alignment's end. An item of fewer than
    LEAST_SCORE words is found as an exact copy; one of fewer than SEED_WORDS
    words is no passage and never found. Null and empty texts hold nothing;
    very long texts are searched whole, around their seeds; of several best
    places the first counts; repeated rows are listed each; further columns are
    ignored, whatever their names; tables without rows give none.
    """
    spark = docs.sparkSession
    n_words = items.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "[^0-9A-Za-z\\u0080-\\x{10ffff}]+")))).first()[0] or 0
    n_blocks = max(1, -(-n_words // BLOCK_WORDS))
    key = items.schema["item"].dataType.simpleString()
    rows = docs.select("id", "text").filter("text is not null")
    parts = []
    for b in range(n_blocks):
        own = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == b).select("item", "text").orderBy("item", "text").collect()
        texts = pa.array([r["text"] or "" for r in own], pa.string())
        words = [w[r[k] : r[k + 1]] for i, j, w, r, _, _ in _seeds_of(texts) for k in range(j - i)]
        block = Block([r["item"] for r in own], words)
        shared = spark.sparkContext.broadcast(block)
        counted = rows.select("text").mapInArrow(lambda it, s=shared: _count(s.value, it), "seed int, n long")
        counts = counted.groupBy("seed").agg(F.sum("n").alias("n")).toPandas()
        total = np.zeros(len(block.seeds) + 1, np.int64)
        total[counts["seed"].to_numpy()] = counts["n"].to_numpy()  # the words are at -1, the last place
        rare = spark.sparkContext.broadcast(block.rare(total[:-1], int(total[-1])))
        found = rows.mapInArrow(lambda it, s=shared, r=rare: _search(s.value, r.value, it), f"id {docs.schema['id'].dataType.simpleString()}, item_no int, score double, start_word long, end_word long")
        names = spark.createDataFrame(list(enumerate(block.ids)) or [(-1, None)], f"item_no int, item {key}")
        parts.append(found.join(F.broadcast(names), "item_no").select("id", "item", "score", "start_word", "end_word"))
    return reduce(DataFrame.union, parts)
