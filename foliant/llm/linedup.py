"""Fuzzy line dedup: MinHash of character shingles, banding, exact Jaccard, union-find.

Lines are compared without outer white space and with A-Z as a-z. Equal lines
are one class, named by a 64-bit hash of the line (two lines must also agree
in a second one to be equal). A line's signature holds the least shingle hash
of each of BANDS * ROWS bins of one hash function; an empty bin takes the value
of the first full one in an order of its own. Classes that share a band are a
group. Its members are compared with a leader first and then, where a group of
three or more still holds several components, across components in exact
blocks. Of every component the first line by (document, line) stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.components import connected_components, joined_further
from foliant.llm.groups import PACKED, block_links, in_units, open_members, packed_rows, packed_trees, star_pairs
from foliant.llm.shared import PREFILTER_BITS, bitmap, free, materialize, possible_ids, release
from foliant.llm.textops import U64, _splitmix, chunks, mix, span_hashes

#: One changed character inside a line kills six shingles: lines of 47 characters or more stay linked.
SHINGLE_CHARS = 6
#: Lines of similarity 0.75 share a band with 1 - (1 - 0.75^5)^16 = 0.987, those of 0.8 with 0.998; of 0.1, with 0.0002.
BANDS, ROWS = 16, 5
BINS = BANDS * ROWS
LEAST = 0.75
#: Bits of a shingle's hash.
TOKEN_BITS = 44
#: Bytes of text that are signed at a time: arrays of eight bytes for each stay in a core's cache.
CHUNK = 1 << 17
#: Lines that are signed at a time; their numbers must fit beside TOKEN_BITS in 64 bits.
LINES = 1 << 15
#: Memberships that are put into trees at a time, and pairs, and shingles of pairs, that are compared at a time.
MEMBERS, PAIRS, _AT_ONCE = 1 << 19, 1 << 12, 1 << 20

_MIXERS = _splitmix(BINS, 23) | U64(1)
_FACTORS = _splitmix(SHINGLE_CHARS, 26) | U64(1)
_BLANK = (32, 9, 10, 11, 12, 13)
#: For each bin the order in which it looks for a full one.
_DONORS = np.argsort(_splitmix(BINS * BINS, 27).reshape(BINS, BINS), axis=1)


class _Seen:
    """Hashes that a task has had; it forgets them all when there are more than LIMIT (they are then given again)."""

    LIMIT = 1 << 21

    def __init__(self) -> None:
        self.known = np.zeros(0, U64)

    def first(self, hashes: np.ndarray) -> np.ndarray:
        """The places of the hashes that are new, the first of each."""
        new, at = np.unique(hashes, return_index=True)
        there = np.searchsorted(self.known, new)
        old = np.zeros(len(new), bool)
        inside = there < len(self.known)
        old[inside] = self.known[there[inside]] == new[inside]
        self.known = np.insert(self.known, there[~old], new[~old]) if len(self.known) < self.LIMIT else new
        return np.sort(at[~old])


def _code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and the offsets of the rows in them."""
    if not len(data):
        return np.zeros(0, np.uint32), offsets
    if data.max() < 128:
        return data.astype(np.uint32), offsets
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return codes, heads[offsets]


def _lines(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, number in its row, start, end) of the lines with anything but white space, trimmed."""
    breaks = np.flatnonzero(codes == 10)
    n = len(offsets) - 1
    rows = np.concatenate([np.arange(n), np.searchsorted(offsets[1:], breaks, "right")])
    order = np.argsort(rows, kind="stable")  # each row's own start, then its breaks in order
    rows, starts = rows[order], np.concatenate([offsets[:-1], breaks + 1])[order]
    same = rows[1:] == rows[:-1]
    ends = np.append(np.where(same, starts[1:] - 1, offsets[1:][rows[:-1]]), offsets[-1]) if len(rows) else starts
    first = np.searchsorted(rows, np.arange(n))
    number = np.arange(len(rows)) - first[rows]
    full = np.ones(len(codes), bool)
    for c in _BLANK:
        full &= codes != c
    at = np.flatnonzero(full)
    a, b = np.searchsorted(at, starts), np.searchsorted(at, ends)
    own = b > a
    return rows[own], number[own], at[a[own]], at[b[own] - 1] + 1


def _mark_of(codes: np.ndarray) -> np.ndarray:
    upper = (codes >= 65) & (codes <= 90)
    return mix((codes + upper * np.uint32(32)).astype(U64) * U64(0x9E3779B97F4A7C15))


#: The marks of the first code points, looked up rather than computed.
_MARKS = _mark_of(np.arange(1 << 14, dtype=np.uint32))


def _folded(codes: np.ndarray) -> np.ndarray:
    """64-bit marks of code points, A-Z as a-z."""
    return _MARKS[codes] if not len(codes) or codes.max() < len(_MARKS) else _mark_of(codes)


def _sets(marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, token) of the distinct shingles of lines, sorted; a line shorter than a shingle has itself as the one."""
    n = np.maximum(0, ends - starts - SHINGLE_CHARS + 1)
    full = np.zeros(max(0, len(marks) - SHINGLE_CHARS + 1), U64)
    for k in range(SHINGLE_CHARS):
        full += marks[k : k + len(full)] * _FACTORS[k]
    first = np.cumsum(n) - n
    at = np.repeat(starts - first, n) + np.arange(n.sum())
    line = np.repeat(np.arange(len(n)), n)
    short = np.flatnonzero(n == 0)
    tokens = np.concatenate([mix(full[at]), span_hashes(marks, starts[short], ends[short])]) >> U64(64 - TOKEN_BITS)
    packed = np.sort((np.concatenate([line, short]).astype(U64) << U64(TOKEN_BITS)) | tokens)
    new = np.ones(len(packed), bool)
    new[1:] = packed[1:] != packed[:-1]
    packed = packed[new]
    return (packed >> U64(TOKEN_BITS)).astype(np.int64), packed & U64((1 << TOKEN_BITS) - 1)


def _bands(line: np.ndarray, token: np.ndarray, n: int) -> np.ndarray:
    """(n, BANDS) keys of the bands of n lines with their sorted sets."""
    place = line * BINS + ((token * U64(BINS)) >> U64(TOKEN_BITS)).astype(np.int64)
    new = np.ones(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    values = np.zeros(n * BINS, U64)
    values[place[new]] = mix(token[new] + U64(1)) | U64(1)
    values = values.reshape(n, BINS)
    own = values.copy()
    at, bin_ = np.nonzero(values == 0)
    for k in range(BINS):
        if not len(at):
            break
        there = own[at, _DONORS[bin_, k]]
        values[at, bin_] = there
        empty = there == 0
        at, bin_ = at[empty], bin_[empty]
    keys = (values * _MIXERS).reshape(n, BANDS, ROWS).sum(axis=2, dtype=U64)
    return mix(keys + np.arange(1, BANDS + 1, dtype=U64) * U64(0xD6E8FEB86659FD93))


def _keys(marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bands of any number of lines, in runs of LINES: a set's row packs its line's number above TOKEN_BITS bits."""
    parts = [np.zeros((0, BANDS), U64)]
    for k in range(0, len(starts), LINES):
        a, b = starts[k : k + LINES], ends[k : k + LINES]
        low = a[0]
        parts.append(_bands(*_sets(marks[low : b[-1]], a - low, b - low), len(a)))
    return np.concatenate(parts)


def _names(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each line the hash that names its class, and what equal lines agree in besides: their length and the sum of their folded code points."""
    upper = (codes >= 65) & (codes <= 90)
    total = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(codes + upper * np.uint32(32), out=total[1:])
    return span_hashes(_folded(codes), starts, ends), ((ends - starts) << 40) ^ (total[ends] - total[starts])


def _line_rows(bits: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, line, node, mark, x) of the lines of each text; x, the trimmed line, where bits have its hash and this task hasn't given it yet."""
    seen = _Seen()
    for batch in batches:
        for i, _, data, offsets in chunks(batch.column("text"), CHUNK):
            codes, heads = _code_points(data, offsets)
            rows, number, starts, ends = _lines(codes, heads)
            node, mark = _names(codes, starts, ends)
            at = (node & U64(PREFILTER_BITS - 1)).astype(np.int64)
            wanted = np.flatnonzero((bits[at >> 3] >> (at & 7)) & 1)
            wanted = wanted[seen.first(node[wanted])]
            places = np.arange(len(codes) + 1) if len(codes) == len(data) else np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
            x: list[str | None] = [None] * len(node)
            for k, a, b in zip(wanted.tolist(), places[starts[wanted]].tolist(), places[ends[wanted]].tolist()):
                x[k] = data[a:b].tobytes().decode()
            columns = [batch.column("id").take(pa.array(rows + i)), pa.array(number.astype(np.int32)), pa.array(node.view(np.int64)), pa.array(mark), pa.array(x, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "line", "node", "mark", "x"])


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of packed_rows of the bands of a task's distinct lines, a batch at a time."""
    seen = _Seen()
    for batch in batches:
        bands, nodes = [], []
        for _, _, data, offsets in chunks(batch.column("text"), CHUNK):
            codes, heads = _code_points(data, offsets)
            _, _, starts, ends = _lines(codes, heads)
            marks = _folded(codes)
            node = span_hashes(marks, starts, ends)
            first = seen.first(node)
            node, starts, ends = node[first], starts[first], ends[first]
            if len(node):
                bands.append(_keys(marks, starts, ends).ravel().view(np.int64))
                nodes.append(np.repeat(node.view(np.int64), BANDS))
                if sum(map(len, nodes)) >= MEMBERS:
                    yield from packed_rows(np.concatenate(bands), np.concatenate(nodes))
                    bands, nodes = [], []
        if nodes:
            yield from packed_rows(np.concatenate(bands), np.concatenate(nodes))


def _sets_of(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of texts of one trimmed line each, line by line, and the n + 1 starts of the lines in them."""
    tokens, sizes = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for i, j, data, offsets in chunks(lines, CHUNK):
        codes, heads = _code_points(data, offsets)
        line, token = _sets(_folded(codes), heads[:-1], heads[1:])
        tokens.append(token)
        sizes.append(np.bincount(line, minlength=j - i))
    return np.concatenate(tokens), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of lines (x, y) with exact similarity LEAST or more on their whole sets."""
    for whole in batches:
        for i in range(0, whole.num_rows, PAIRS):
            batch = whole.slice(i, PAIRS)
            n = batch.num_rows
            both = pa.chunked_array([batch.column("x"), batch.column("y")]).combine_chunks().dictionary_encode()
            which = both.indices.to_numpy()
            token, starts = _sets_of(both.dictionary)
            sizes = np.diff(starts)
            x, y = which[:n], which[n:]
            able = 100 * np.minimum(sizes[x], sizes[y]) >= round(100 * LEAST) * np.maximum(sizes[x], sizes[y])
            pairs = np.flatnonzero(able)
            cuts = np.cumsum(sizes[x[pairs]] + sizes[y[pairs]]) // _AT_ONCE
            kept = [np.zeros(0, np.int64)]
            for part in np.split(pairs, np.flatnonzero(np.diff(cuts)) + 1) if len(pairs) else []:
                sides = np.concatenate([x[part], y[part]])
                lengths = sizes[sides]
                at = np.repeat(starts[sides] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
                pair = np.repeat(np.tile(np.arange(len(part)), 2), lengths)
                packed = np.sort((pair.astype(U64) << U64(TOKEN_BITS)) | token[at])
                again = packed[1:][packed[1:] == packed[:-1]] >> U64(TOKEN_BITS)
                common = np.bincount(again.astype(np.int64), minlength=len(part))
                union = sizes[x[part]] + sizes[y[part]] - common
                kept.append(part[100 * common >= round(100 * LEAST) * union])
            yield batch.select(["a", "b"]).take(pa.array(np.concatenate(kept)))


def _unit_sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    token, starts = _sets_of(table.column("x").combine_chunks())
    return token, np.repeat(np.arange(table.num_rows), np.diff(starts))


def _confirm(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose lines have exact Jaccard similarity LEAST or more on character shingles."""
    left = lines.select(F.col("node").alias("a"), "x")
    right = lines.select(F.col("node").alias("b"), F.col("x").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_jaccard, "a long, b long")


def _linked(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, joined): all lines (id, line, node, mark, x) and the (node, component) of their classes that are linked with others."""
    trees = materialize(packed_trees(texts.select("text").mapInArrow(_band_rows, PACKED)), "trees")
    pairs = materialize(star_pairs(trees), "pairs")
    nodes = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "nodes")
    bits = texts.sparkSession.sparkContext.broadcast(bitmap(nodes, "node"))
    found = texts.mapInArrow(lambda it: _line_rows(np.frombuffer(bits.value, np.uint8), it), "id long, line int, node long, mark long, x string")
    lines = materialize(found, "lines")
    given = materialize(lines.filter("x is not null").select("node", "x").join(nodes, "node", "left_semi").dropDuplicates(["node"]), "texts")
    links = materialize(_confirm(pairs, given), "links")
    joined = connected_components(links)

    side = lambda k: joined.toDF(k, f"c{k}")
    failed = pairs.join(links, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
    apart = materialize(failed.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "apart")
    members = materialize(open_members(trees, apart, joined), "open")
    if not members.isEmpty():
        units = in_units(members.join(given, "node"))
        more = materialize(units.select("band", "unit", "own", "node", "c", "x").mapInArrow(block_links(_unit_sets, LEAST), "a long, b long"), "links")
        joined = joined_further(joined, more)
    release(trees, pairs, nodes, given, apart, members)
    return lines, joined


def line_decisions(docs: DataFrame) -> DataFrame:
    """(id, removed) of the documents (id, text) that lose lines: the numbers, from 0, of the lines to remove."""
    lines, joined = _linked(docs.filter("id is not null and text is not null").select("id", "text"))
    # A class matters if it has several lines or is linked; the first line of its component stays.
    classes = lines.groupBy("node", "mark").agg(F.min(F.struct("id", "line")).alias("first"), F.count("*").alias("n"))
    some = possible_ids(classes, "node", joined.select("node"), mark="_maybe").filter("n > 1 or _maybe").drop("_maybe")
    named = some.join(joined, "node", "left").filter("n > 1 or component is not null")
    named = materialize(named.withColumn("c", F.coalesce("component", "node")).select("node", "mark", "first", "c"), "named")
    keepers = named.groupBy("c").agg(F.min("first").alias("keep"))
    fates = materialize(named.join(keepers, "c").select("node", "mark", "keep"), "fates")
    hit = possible_ids(lines.drop("x"), "node", fates.select("node")).join(fates, ["node", "mark"])
    gone = hit.filter(F.struct("id", "line") != F.col("keep"))
    removed = materialize(gone.groupBy("id").agg(F.array_sort(F.collect_set("line")).alias("removed")), "removed")
    release(lines, named, fates)
    return removed


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with its text less the lines that are near copies of an earlier one, and removed (their numbers from 0).

    Earlier is by (key, line number). Blank lines stay, and so do the texts of
    rows with a null key or text (removed: empty). Rows that repeat a key count
    as one document. An older column named removed goes; an empty table gives
    an empty one.
    """
    docs = docs.drop("removed")
    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    gone = line_decisions(plain).withColumnRenamed("id", "_id")
    # Documents that surely keep all lines don't move; the others meet their decisions.
    own, mark = free(docs, "_id", "_touched")
    gone = gone.withColumnRenamed("_id", own)
    rows = docs.withColumn(own, F.col(key).cast("long"))
    touched = possible_ids(rows, own, gone.select(own), mark=mark)
    none = F.array().cast("array<int>")
    still = touched.filter(~F.col(mark)).withColumn("removed", none)
    moved = touched.filter(F.col(mark)).join(gone, own, "left").withColumn("removed", F.coalesce("removed", none))
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    moved = moved.withColumn(text, F.when(F.size("removed") > 0, left).otherwise(F.col(text)))
    columns = [*docs.columns, "removed"]
    return still.select(columns).union(moved.select(columns))
