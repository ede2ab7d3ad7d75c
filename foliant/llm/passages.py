"""Near-duplicate passages by compact windows.

The tokens of a document are its 5-word shingles. Under each of HASHES min-hash
functions, a node of the Cartesian tree over the token hashes is a compact
window: the widest range in which that token is the least, which stands for
all subsequences with that signature. Only nodes as wide as a passage of
LEAST_WORDS words matter; they are the least tokens of some range of that
width. Windows with one signature are a group. Its members meet a leader, and
the collisions of a text with one leader are joined by their intervals: a
window counts if a window of another hash function overlaps it by a passage's
width in both texts, so that AGREE of the HASHES signatures agree. What counts
is verified by exact Jaccard similarity.

A leader may lack what two others share. Windows that no verified passage of
their text covers are therefore grouped again, with the others of their groups, by pairs
of signatures whose intervals overlap inside the text, which is the same join
taken within each text first. What is not covered
then meets all others of it in exact blocks, within AROUND tokens of the shared
one. Texts with equal words are one text throughout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.components import connected_components
from foliant.llm.groups import PART_BITS, in_units, unit_tables
from foliant.llm.shared import materialize, possible_ids, release
from foliant.llm.textops import SHINGLE_WORDS, U64, _splitmix, chunks, mix, shingle_hashes, span_hashes, word_hashes

LEAST_WORDS = 50
WIDTH = LEAST_WORDS - SHINGLE_WORDS + 1
LEAST = 0.75
#: Signatures of a passage, and how many must agree: at similarity 0.75, with 1 - 0.25^4 - 4 * 0.75 * 0.25^3 = 0.95, at 0.85 with 0.99; equal passages agree in all.
HASHES, AGREE = 4, 2
#: Tokens on either side of a shared one that hold WIDTH tokens of any passage of that width around it.
AROUND = WIDTH - 1
#: Rows of units that are compared together, and their pairs that are made at a time.
_UNIT_ROWS, _PAIRS = 1024, 1 << 18

_SALT = (_splitmix(HASHES, 31) >> U64(32)).astype(np.uint32)
_ODD = (_splitmix(HASHES, 32) >> U64(32)).astype(np.uint32) | np.uint32(1)
_KEYS = _splitmix(HASHES, 33)

_WINDOW = "band long, node long, k int, l int, c int, r int, leader long, l2 int, c2 int, r2 int"
#: A window as it is dealt, without a leader and with one, and windows that are packed at a time.
_OWN = np.dtype([("band", "<i8"), ("node", "<i8"), ("k", "i1"), ("l", "<i4"), ("c", "<i4"), ("r", "<i4")])
_LED = np.dtype([*_OWN.descr, ("leader", "<i8"), ("l2", "<i4"), ("c2", "<i4"), ("r2", "<i4")])
_AT_ONCE = 1 << 18
_CAND = "struct<band:bigint,k:int,l:int,c:int,r:int,l2:int,c2:int,r2:int>"


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least (or greatest) value of every width neighbours of x: running values from both ends of blocks meet."""
    f, fill = (np.minimum, np.uint32(0xFFFFFFFF)) if least else (np.maximum, np.uint32(0))
    n = len(x)
    size = -(-n // width) * width
    blocks = np.full(size, fill, np.uint32)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = f.accumulate(blocks, axis=1).ravel()
    back = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[: n - width + 1], ahead[width - 1 : n])


def wide_nodes(x: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Positions that are the least of some WIDTH neighbours inside their row."""
    if len(x) < WIDTH:
        return np.zeros(0, np.int64)
    least = _sliding(x, WIDTH, True)
    for k in heads[1:-1]:  # ranges across two rows don't count
        least[max(0, k - WIDTH + 1) : min(len(least), k)] = 0
    padded = np.zeros(len(x) + WIDTH - 1, np.uint32)
    padded[WIDTH - 1 : WIDTH - 1 + len(least)] = least
    return np.flatnonzero((_sliding(padded, WIDTH, False) == x) & (x > 0))


def _nearest(values: np.ndarray, equal: bool) -> np.ndarray:
    """For each value but -1, of which the first is one, the last place before it with a smaller one, or, with equal, one that is no greater."""
    near = np.arange(-1, len(values) - 1)
    left = np.flatnonzero(values >= 0)
    while len(left):  # what lies between a place and the one it points to is greater, so that pointers are followed
        there = values[near[left]]
        left = left[there > values[left] if equal else there >= values[left]]
        near[left] = near[near[left]]
    return near


def windows_of(values: np.ndarray, places: np.ndarray, cuts: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """(row, left, centre, right) of the Cartesian trees' nodes of WIDTH or more; equal values in one range are one node.

    values and places are the wide nodes of all rows; cuts gives the first of
    these of each row, heads the first place of each row (and both the end).
    All smaller neighbours of a wide node are wide themselves.
    """
    # Before and after each row stands a value that is less than all: its own place ends all ranges.
    own = np.arange(len(values)) + 1 + np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    value = np.full(len(values) + len(cuts), -1, np.int64)
    place = np.empty(len(value), np.int64)
    value[own], place[own] = values, places
    edges = cuts + np.arange(len(cuts))
    place[edges] = heads
    before = _nearest(value, True)[own]
    after = len(value) - 1 - _nearest(value[::-1], False)[::-1][own]
    edge = np.zeros(len(value), bool)
    edge[edges] = True
    left, right = place[before] + ~edge[before], place[after] - 1
    keep = np.flatnonzero((value[before] < values) & (right - left >= AROUND))
    row = np.searchsorted(cuts, keep, "right") - 1
    return np.column_stack([row, left[keep], places[keep], right[keep]])


def compact_windows(values: list[int], places: list[int], rows: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """windows_of() rows that follow one another, given by their first and last (exclusive) wide nodes and the ranges they span."""
    cuts, heads = ([*(row[k] for row in rows), rows[-1][k + 1]] for k in (0, 2))
    return list(map(tuple, windows_of(np.array(values, np.int64), np.array(places, np.int64), np.array(cuts), np.array(heads)).tolist()))


def _row_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, its first token, mark of the text, key, hash function, left, centre, right) of the windows of all rows; places are counted over all rows."""
    words, rows = word_hashes(data, offsets)
    tokens, heads = shingle_hashes(words, rows)
    marks = span_hashes(words, rows[:-1], rows[1:])
    enough = np.diff(rows) >= LEAST_WORDS
    short = (tokens >> U64(32)).astype(np.uint32)
    found = []
    for k in range(HASHES):
        x = (short ^ _SALT[k]) * _ODD[k]
        at = wide_nodes(x, heads)
        cuts = np.searchsorted(at, heads)
        flat = windows_of(x[at], at, cuts, heads)
        found.append(np.column_stack([flat[:, 0], np.full(len(flat), k), flat[:, 1:]]))
    flat = np.concatenate(found)
    flat = flat[enough[flat[:, 0]]]
    row, k, left, centre, right = flat.T
    keys = mix(tokens[centre] ^ _KEYS[k])
    return row, heads[row], marks[row].view(np.int64), keys.view(np.int64), k, left, centre, right


def _text_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(mark of the text, key, hash function, left, centre, right) of the windows of all rows."""
    _, base, node, keys, k, left, centre, right = _row_windows(data, offsets)
    return node, keys, k, left - base, centre - base, right - base


def _with_leaders(band: np.ndarray, node: np.ndarray, rest: list[np.ndarray]) -> pa.RecordBatch:
    """Windows, with the first window of each band here as leader of the others; a leader's own leader is null."""
    order = np.lexsort((rest[2], node, band))
    band, node, rest = band[order], node[order], [x[order] for x in rest]
    first = np.ones(len(band), bool)
    first[1:] = band[1:] != band[:-1]
    again = np.zeros(len(band), bool)  # copies of a text
    again[1:] = ~first[1:] & (node[1:] == node[:-1]) & (rest[2][1:] == rest[2][:-1])
    at = np.flatnonzero(first)[np.cumsum(first) - 1]
    keep = ~again
    own, at, first = np.flatnonzero(keep), at[keep], first[keep]
    columns = [pa.array(x[own]) for x in (band, node)] + [pa.array(x[own].astype(np.int32)) for x in rest]
    columns += [pa.array(node[at], mask=first)] + [pa.array(x[at].astype(np.int32), mask=first) for x in rest[1:]]
    return pa.RecordBatch.from_arrays(columns, ["band", "node", "k", "l", "c", "r", "leader", "l2", "c2", "r2"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [_text_windows(data, offsets) for _, _, data, offsets in chunks(batch.column("text"))]
        if parts:
            node, band, *rest = (np.concatenate(x) for x in zip(*parts))
            yield _with_leaders(band, node, rest)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows by parts of their bands, those that follow a leader by parts of their texts, as records one after the other: many to a row."""
    for batch in batches:
        for first in range(0, batch.num_rows, _AT_ONCE):
            rows = batch.slice(first, _AT_ONCE)
            alone = rows.column("leader").is_null().to_numpy(zero_copy_only=False)
            for into, kind, chosen, key in (("own", _OWN, alone, "band"), ("led", _LED, ~alone, "node")):
                found = np.empty(int(chosen.sum()), kind)
                for name in kind.names:
                    found[name] = rows.column(name).filter(pa.array(chosen)).to_numpy()
                part = (found[key] >> (64 - PART_BITS)).astype(np.int16)
                order = np.argsort(part, kind="stable")
                part = part[order]
                cuts = np.flatnonzero(np.diff(part, prepend=-9999))
                ends = pa.py_buffer((np.append(cuts, len(part)) * kind.itemsize).astype(np.int32))
                records = pa.Array.from_buffers(pa.binary(), len(cuts), [None, ends, pa.py_buffer(found[order].tobytes())])
                none = pa.nulls(len(cuts), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int32)), records if into == "own" else none, records if into == "led" else none], ["part", "own", "led"])


def _unpacked(records: pa.Array, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(records.drop_null().to_pylist()), kind)


def _window_rows(rows: np.ndarray, leads: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """Windows and their leaders (whose columns are names) as rows; copies of a text's own window are left out."""
    others = (rows["node"] != leads[names[0]]) | (rows["c"] != leads[names[2]])
    columns = [rows[x][others] for x in ("band", "node", "k", "l", "c", "r")] + [leads[x][others] for x in names]
    columns = [x.astype(np.int64 if x.itemsize == 8 else np.int32) for x in columns]
    return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["band", "node", "k", "l", "c", "r", "leader", "l2", "c2", "r2"])


def _leading(rows: np.ndarray) -> pa.RecordBatch:
    """Windows with the first of their band, by text and place, as leader; the first gives no row."""
    order = np.argsort(rows["band"])
    band = rows["band"][order]
    same = np.zeros(len(band) + 1, bool)
    same[1:-1] = band[1:] == band[:-1]
    rows = rows[order[same[1:] | same[:-1]]]  # most bands have one window
    rows = rows[np.lexsort((rows["c"], rows["node"], rows["band"]))]
    first = np.diff(rows["band"], prepend=~rows["band"][:1]) != 0
    return _window_rows(rows, rows[np.flatnonzero(first)[np.cumsum(first) - 1]], ["node", "l", "c", "r"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of _packed() rows in the order of parts, each with a leader's: those that have one as they are, the others a part at a time."""
    held = np.zeros(0, _OWN)  # the last part: more of it may come
    for batch in batches:
        led = _unpacked(batch.column("led"), _LED)
        yield _window_rows(led, led, ["leader", "l2", "c2", "r2"])
        rows = np.concatenate([held, _unpacked(batch.column("own"), _OWN)])
        part = rows["band"] >> (64 - PART_BITS)
        whole = int(np.searchsorted(part, part[-1])) if len(part) else 0
        yield _leading(rows[:whole])
        held = rows[whole:]
    yield _leading(held)


def _pairs_within(keys: np.ndarray, k: np.ndarray, l: np.ndarray, c: np.ndarray, r: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, key) of windows of different hash functions, i of the lower, one of them asked, that some range of WIDTH tokens lies in with both centres."""
    order = np.argsort(c, kind="stable")
    own = np.flatnonzero(asked)
    low, high = np.searchsorted(c[order], c[own] - AROUND), np.searchsorted(c[order], c[own] + AROUND, "right")
    n = high - low
    i = np.repeat(own, n)
    j = order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    fit = (k[i] != k[j]) & (np.minimum(r[i], r[j]) - np.maximum(l[i], l[j]) >= AROUND)
    fit &= (k[i] < k[j]) | ~asked[j]  # two that are asked meet twice
    i, j = i[fit], j[fit]
    i, j = np.where(k[i] < k[j], i, j), np.where(k[i] < k[j], j, i)
    return i, j, mix(keys[i].view(U64) * U64(0x9E3779B97F4A7C15) + keys[j].view(U64)).view(np.int64)


def _paired_windows(batches: Iterator[pa.RecordBatch], told: bool = False) -> Iterator[pa.RecordBatch]:
    """The windows of texts (mark, text) by pairs of signatures of which one is wanted (k and c of windows); told: only of texts that have the mark."""
    for batch in batches:
        parts = []
        wanted, marks = batch.column("wanted"), batch.column("mark").to_numpy()
        flat, sizes = wanted.flatten(), wanted.value_lengths().to_numpy()
        row, want_c, want_k = np.repeat(np.arange(len(sizes)), sizes), flat.field("c").to_numpy().astype(np.int64), flat.field("k").to_numpy()
        starts = np.concatenate([[0], np.cumsum(sizes)])
        for first, last, data, offsets in chunks(batch.column("text")):
            own, base, node, keys, k, left, c, right = _row_windows(data, offsets)
            heads = np.zeros(last - first, np.int64)  # of the rows that have windows; of no use for others
            heads[own] = base
            a, b = starts[first], starts[last]
            asked = np.isin(c * HASHES + k, (want_c[a:b] + heads[row[a:b] - first]) * HASHES + want_k[a:b]) if b > a else np.zeros(len(c), bool)
            i, _, key = _pairs_within(keys, k, left, c, right, asked)  # windows of two rows have no token in common
            if told:
                mine = node[i] == marks[first + own[i]]
                i, key = i[mine], key[mine]
            parts.append((node[i], key, k[i], (left - base)[i], (c - base)[i], (right - base)[i]))
        if parts:
            node, band, *rest = (np.concatenate(x) for x in zip(*parts))
            yield _with_leaders(band, node, rest)


def window_groups(texts: DataFrame, windows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """One row for every window, but one, of each signature that several windows of the texts have, with a leader's window.

    As with other groups, only one row of a task's share of a signature is
    dealt by the signature, and the windows that follow a leader of their own
    task are spread out. Windows are dealt as records in rows of many: a task
    holds one of 2^PART_BITS parts of the signatures at a time.
    """
    rows = texts.mapInArrow(lambda batches: _packed(windows(batches)), "part int, own binary, led binary")
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(_merge, _WINDOW)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, mark, mark2, n_words): two hashes of a text's words."""
    for batch in batches:
        for i, j, data, offsets in chunks(batch.column("text")):
            words, rows = word_hashes(data, offsets)
            marks = [span_hashes(x, rows[:-1], rows[1:]).view(np.int64) for x in (words, mix(words ^ U64(0xA0761D6478BD642F)))]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), *map(pa.array, marks), pa.array(np.diff(rows))], ["id", "mark", "mark2", "n_words"])


def agreeing(k: np.ndarray, l: np.ndarray, r: np.ndarray, l2: np.ndarray, r2: np.ndarray) -> np.ndarray:
    """Which collisions of two texts overlap, by WIDTH in both, collisions of AGREE - 1 other hash functions or more."""
    out = np.zeros(len(k), np.int64)
    for other in range(HASHES):
        have = np.flatnonzero(k == other)
        for part in np.array_split(have, -(-len(have) * len(k) // (1 << 22)) or 1):
            wide = np.minimum(r[:, None], r[part]) - np.maximum(l[:, None], l[part]) >= AROUND
            wide &= np.minimum(r2[:, None], r2[part]) - np.maximum(l2[:, None], l2[part]) >= AROUND
            out = np.where((k != other) & wide.any(axis=1), out | (1 << other), out)
    return np.bitwise_count(out) >= AGREE - 1


def _interval_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, good, rest): the collisions (cands) of pairs that agree with others, and those that don't."""
    for batch in batches:
        cands = batch.column("cands")
        flat, starts = cands.flatten(), cands.offsets.to_numpy() - cands.offsets[0].as_py()
        k, l, r, l2, r2 = (flat.field(c).to_numpy() for c in ("k", "l", "r", "l2", "r2"))
        good = np.zeros(len(flat), bool)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if b - a > 1:
                good[a:b] = agreeing(k[a:b], l[a:b], r[a:b], l2[a:b], r2[a:b])
        lists = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(own)])[starts].astype(np.int32), flat.filter(pa.array(own))) for own in (good, ~good)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *lists], ["a", "b", "good", "rest"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mark, items): the mark of each text and its tokens."""
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column("text")):
            words, rows = word_hashes(data, offsets)
            tokens, heads = shingle_hashes(words, rows)
            items = pa.ListArray.from_arrays(pa.array(heads.astype(np.int32)), pa.array((tokens >> U64(32)).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(span_hashes(words, rows[:-1], rows[1:]).view(np.int64)), items], ["mark", "items"])


def _reach(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of a side, and their scores, that no longer one equals or beats: a side ends with tokens in common."""
    total = np.cumsum(score)
    best = score > 0
    best[:-1] &= total[:-1] > np.maximum.accumulate(total[:0:-1])[::-1]
    at = np.flatnonzero(best)
    return at + 1, total[at]


def _member(values: np.ndarray, size: int) -> np.ndarray:
    """Which of the numbers below size are among the values."""
    there = np.zeros(size, bool)
    there[values] = True
    return there


def _best_range(hit: np.ndarray, at: int) -> tuple[int, int]:
    """The range around a place with the greatest 4 common - 3 union: a token in common adds 4, another takes 3."""
    score = hit * np.int64(7) - 3
    return at - int(score[at::-1].cumsum().argmax()), int(score[at:].cumsum().argmax()) + at + 1


def _filled(hit: np.ndarray, a: int, b: int) -> tuple[int, int]:
    """The range a to b, or where it is shorter, the WIDTH places around it that have most in common with the other side."""
    if b - a >= WIDTH:
        return a, b
    first = max(0, b - WIDTH)
    common = np.cumsum(np.append(0, hit[first : a + WIDTH]))
    a = first + int((common[WIDTH:] - common[:-WIDTH]).argmax())
    return a, a + WIDTH


def numbered_part(x: np.ndarray, y: np.ndarray, cx: int, cy: int, size: int) -> tuple[int, int, int, int] | None:
    """The longest passages of two sequences of token numbers below size, around a shared one, that have WIDTH tokens and similarity LEAST.

    At similarity 0.75 a quarter of a passage's tokens may be missing from the
    other, so that ranges of x are tried, the longest first, in which a token in
    common counts 1 and another one -3, and the sum is not negative.
    """
    if len(x) < WIDTH or len(y) < WIDTH:
        return None
    score = _member(y, size)[x] * np.int64(4) - 3
    left, ls = _reach(score[cx::-1])
    right, rs = _reach(score[cx:])
    length = left[:, None] + right[None, :] - 1
    able = ls[:, None] + rs[None, :] - 1 - 3 * np.maximum(0, WIDTH - length) >= 0
    ways = np.flatnonzero(able)
    for k in ways[np.argsort(-length.ravel()[ways], kind="stable")].tolist():
        i, j = divmod(k, len(right))
        a, b = cx - int(left[i]) + 1, cx + int(right[j])
        hit = _member(x[a:b], size)[y]
        c, d = _filled(hit, *_best_range(hit, cy))
        theirs = _member(y[c:d], size)
        a, b = _filled(theirs[x], a, b)
        own = _member(x[a:b], size)
        common, union = np.count_nonzero(own & theirs), np.count_nonzero(own | theirs)
        if 100 * common >= round(100 * LEAST) * union:
            return a, b, c, d
    return None


def common_part(x: np.ndarray, y: np.ndarray, cx: int, cy: int) -> tuple[int, int, int, int] | None:
    """numbered_part() of two token sequences."""
    known, number = np.unique(np.concatenate([x, y]), return_inverse=True)
    return numbered_part(number[: len(x)], number[len(x) :], cx, cy, len(known))


_SPANS = "array<struct<start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _in_words(got: list[tuple[int, int, int, int]], k: int) -> list[dict[str, int]]:
    return [{"start": g[k], "end": g[k + 1] + SHINGLE_WORDS - 1} for g in got]


def _beside(c: np.ndarray, c2: np.ndarray, part: tuple[int, int, int, int]) -> np.ndarray:
    """Which collisions lie in a passage of their two texts or, in both, within AROUND tokens of it: an edited place of a longer copy."""
    a, b, a2, b2 = part
    return (a - AROUND <= c) & (c < b + AROUND) & (a2 - AROUND <= c2) & (c2 < b2 + AROUND)


def _passages_of(x: np.ndarray, y: np.ndarray, l: np.ndarray, c: np.ndarray, r: np.ndarray, l2: np.ndarray, c2: np.ndarray, r2: np.ndarray) -> list[tuple[int, int, int, int]]:
    """The passages of two texts that their collisions lead to, the widest windows first."""
    order = np.lexsort((c, l - r))
    l, c, r, l2, c2, r2 = (v[order] for v in (l, c, r, l2, c2, r2))
    # A changed token may be less than the shared one and end the window inside the passage.
    low, high, low2, high2 = np.maximum(0, l - AROUND).tolist(), (r + AROUND + 1).tolist(), np.maximum(0, l2 - AROUND).tolist(), (r2 + AROUND + 1).tolist()
    got: list[tuple[int, int, int, int]] = []
    done = np.zeros(len(c), bool)
    left, number, size = len(x) + len(y), None, 0
    for k, (at, at2) in enumerate(zip(c.tolist(), c2.tolist())):
        if done[k]:  # the longest passage there is found already, or it failed by another signature, in a wider window
            continue
        u, v = x[low[k] : high[k]], y[low2[k] : high2[k]]
        left -= len(u) + len(v)
        if left < 0 and number is None:  # as much as both texts was numbered: number them once
            known, number = np.unique(np.concatenate([x, y]), return_inverse=True)
            x, y, size = number[: len(x)], number[len(x) :], len(known)
            u, v = x[low[k] : high[k]], y[low2[k] : high2[k]]
        part = common_part(u, v, at - low[k], at2 - low2[k]) if number is None else numbered_part(u, v, at - low[k], at2 - low2[k], size)
        if part:
            a, b, a2, b2 = part
            got.append((low[k] + a, low[k] + b, low2[k] + a2, low2[k] + b2))
            done |= _beside(c, c2, got[-1])
        else:
            done |= (c == at) & (c2 == at2)
    return got


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, spans_a, spans_b, rest): the verified passages of two texts in words, end exclusive, and the collisions outside them.

    good are the collisions to verify, rest others of the two texts.
    """
    for batch in batches:
        spans, left_over = ([], []), [np.zeros(0, np.int64)]
        xs, ys, good, rest = (batch.column(c) for c in ("x", "y", "good", "rest"))
        flat = pa.concat_arrays([good.flatten().cast(rest.type.value_type), rest.flatten()])
        places = [flat.field(v).to_numpy() for v in ("l", "c", "r", "l2", "c2", "r2")]
        ends, others = (np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy())]) for col in (good, rest))
        others = others + ends[-1]
        for k in range(batch.num_rows):
            own = slice(int(ends[k]), int(ends[k + 1]))
            got = _passages_of(xs[k].values.to_numpy(), ys[k].values.to_numpy(), *(v[own] for v in places))
            for side, j in zip(spans, (0, 2)):
                side.append(_in_words(got, j))
            at = np.concatenate([np.arange(own.start, own.stop), np.arange(others[k], others[k + 1])])
            for a, b, _, _ in got:
                at = at[(places[1][at] < a) | (places[1][at] >= b)]
            left_over.append(at)
        lists = pa.ListArray.from_arrays(np.cumsum([len(at) for at in left_over]).astype(np.int32), flat.take(pa.array(np.concatenate(left_over))))
        columns = [batch.column("a"), batch.column("b"), *[pa.array(x, _SPAN_TYPE) for x in spans], lists]
        yield pa.RecordBatch.from_arrays(columns, ["a", "b", "spans_a", "spans_b", "rest"])


def _ids_of(marks: DataFrame, classes: DataFrame) -> DataFrame:
    """(mark, id): of marks the least id whose text has it."""
    own = possible_ids(classes.select("mark", "id"), "mark", marks).join(marks, "mark", "left_semi")
    return materialize(own.groupBy("mark").agg(F.min("id").alias("id")), "wanted")


def _tokens_of(marks: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(mark, items) of the texts of marks; an id may have several texts, so that each tells its own mark."""
    wanted = _ids_of(marks, classes)
    items = possible_ids(docs.select("id", "text"), "id", wanted.select("id")).select("text").mapInArrow(_tokens, "mark long, items array<int>")
    return items.join(wanted.select("mark"), "mark", "left_semi").dropDuplicates(["mark"])


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b, good, rest) of texts verified on their tokens: (a, b, spans_a, spans_b, rest)."""
    tokens = materialize(_tokens_of(pairs.select(F.explode(F.array("a", "b")).alias("mark")).distinct(), classes, docs), "tokens")
    side = lambda k, items: tokens.select(F.col("mark").alias(k), F.col("items").alias(items))
    both = pairs.select("a", "b", "good", "rest").join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y", "good", "rest")
    met = materialize(both.mapInArrow(_verify, f"a long, b long, spans_a {_SPANS}, spans_b {_SPANS}, rest array<{_CAND}>"), "met")
    release(tokens)
    return met


def _followers(groups: DataFrame) -> DataFrame:
    """(a, b, cands): the windows of texts with those of their leaders, by pairs of different texts."""
    cands = groups.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"), F.struct("band", "k", "l", "c", "r", "l2", "c2", "r2").alias("w"))
    return cands.groupBy("a", "b").agg(F.collect_list("w").alias("cands"))


def _spans(found: DataFrame) -> DataFrame:
    """(mark, start, end) of both sides of verified passages, each once."""
    return found.select(F.col("a").alias("mark"), F.inline("spans_a")).union(found.select("b", F.inline("spans_b"))).distinct()


def _around_missed(groups: DataFrame, rests: list[DataFrame], found: DataFrame) -> DataFrame:
    """(band, n, node, k, l, c, r, open, comp) of the groups of three windows or more that have open ones or several components.

    A window is open if it failed with its leader and no passage of its text
    that was found with whatever other text covers its centre. comp is the
    component of the text by the passages found so far: windows that are
    covered on both sides may still hold a link between two of them.
    """
    missed = groups.filter("node = leader").select("band", "node", "c")
    for df in rests:
        missed = missed.union(df.select(F.col("a").alias("node"), F.explode("rest").alias("w")).select("w.band", "node", "w.c"))
    missed = materialize(missed.distinct(), "missed")
    spans = _merged_spans(_spans(found)).withColumnRenamed("mark", "node")
    covers = F.exists("spans", lambda x: (x["start"] <= F.col("c")) & (F.col("c") < x["end"] - (SHINGLE_WORDS - 1)))
    uncovered = missed.join(spans, "node", "left").filter(~F.coalesce(covers, F.lit(False))).select("band", "node", "c", F.lit(True).alias("open"))
    near = groups.join(missed.select("band").distinct(), "band", "left_semi")
    members = near.select("band", "node", "k", "l", "c", "r").union(near.select("band", "leader", "k", "l2", "c2", "r2"))
    members = members.groupBy("band", "node", "c").agg(*[F.min(x).alias(x) for x in ("k", "l", "r")])
    joined = connected_components(found.select("a", "b"))
    members = members.join(uncovered, ["band", "node", "c"], "left").join(joined, "node", "left")
    members = materialize(members.select("band", "node", "c", "k", "l", "r", F.coalesce("open", F.lit(False)).alias("open"), F.coalesce("component", "node").alias("comp")), "members")
    large = members.groupBy("band").agg(F.count("*").alias("n"), F.bool_or("open").alias("some"), (F.min("comp") != F.max("comp")).alias("several"))
    out = materialize(members.join(large.filter("n > 2 and (some or several)").select("band", "n"), "band"), "members")
    release(missed, members)
    return out


def _dense(place: np.ndarray, near: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether of WIDTH places of near[i] around its shared token three quarters hold tokens of window j; place: (windows, numbers), near: -1 beyond a text."""
    out = np.zeros(len(i), bool)
    for part in np.array_split(np.arange(len(i)), -(-len(i) // 4096) or 1):
        own = near[i[part]]
        hits = (place[j[part][:, None], own] >= 0) & (own >= 0)
        some = np.flatnonzero(4 * np.count_nonzero(hits, axis=1) >= 3 * WIDTH - 3)
        total = np.zeros((len(some), hits.shape[1] + 1), np.int16)
        np.cumsum(hits[some], axis=1, out=total[:, 1:])
        out[part[some]] = 4 * (total[:, WIDTH:] - total[:, :-WIDTH]).max(axis=1) >= 3 * WIDTH - 3
    return out


def _in_common(place: np.ndarray, near: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many different tokens the windows i and j have in common."""
    out = np.zeros(len(i), np.int64)
    for part in np.array_split(np.arange(len(i)), -(-len(i) // 4096) or 1):
        own = near[i[part]]
        counts = (own >= 0) & (place[i[part][:, None], own] == np.arange(near.shape[1]))  # one place of each token
        out[part] = np.count_nonzero(counts & (place[j[part][:, None], own] >= 0), axis=1)
    return out


def _reaches(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lengths of each row _reach() gives, and the scores of all."""
    total = np.cumsum(score, axis=1, dtype=np.int16)
    later = np.full_like(total, np.iinfo(np.int16).min)
    later[:, :-1] = np.maximum.accumulate(total[:, ::-1], axis=1)[:, ::-1][:, 1:]
    return (total > later) & (score > 0), total


def _widened(hit: np.ndarray, a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_filled() of many rows, whose texts go from low to high."""
    common = np.pad(np.cumsum(hit, axis=1, dtype=np.int16), ((0, 0), (1, 0)))
    common = common[:, WIDTH:] - common[:, :-WIDTH]
    start = np.arange(common.shape[1])
    common[(start < np.maximum(low, b - WIDTH)[:, None]) | (start > np.minimum(a, high - WIDTH)[:, None])] = -1
    short = b - a < WIDTH
    a = np.where(short, common.argmax(axis=1), a)
    return a, np.where(short, a + WIDTH, b)


def _passing(place: np.ndarray, near: np.ndarray, low: np.ndarray, high: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For which pairs of windows i and j without repeated tokens numbered_part() finds passages: its steps for all ways at once.

    near has the shared token of every window in the column AROUND and -1 beyond
    its range low to high; place gives the column of a token number in a window, or -1.
    """
    out = np.zeros(len(i), bool)
    length = np.add.outer(np.arange(1, AROUND + 2), np.arange(AROUND + 1))
    lacking = (1 + 3 * np.maximum(0, WIDTH - length)).astype(np.int16)
    here, beyond = np.int16(-3), np.int16(-100)  # beyond the texts no range gains
    for part in np.array_split(np.arange(len(i)), -(-len(i) // 1024) or 1):
        p, q = i[part], j[part]
        x, y = near[p], near[q]
        in_y = np.where(x >= 0, place[q[:, None], x], np.int8(-1))  # where a token of x is in y
        in_x = np.where(y >= 0, place[p[:, None], y], np.int8(-1))
        score = np.where(in_y >= 0, np.int16(1), np.where(x >= 0, here, beyond))
        (left, ls), (right, rs) = _reaches(score[:, AROUND::-1]), _reaches(score[:, AROUND:])
        # Lengths that are none have no score that is enough.
        able = np.where(left, ls, np.int16(-9999))[:, :, None] + np.where(right, rs, np.int16(-9999))[:, None, :] >= lacking
        w, u, v = np.nonzero(able)
        if not len(w):
            continue
        in_y, in_x, p, q = in_y[w], in_x[w], p[w], q[w]
        a, b = AROUND - u, AROUND + v + 1
        hit = (in_x >= a[:, None]) & (in_x < b[:, None])
        score = np.where(hit, np.int16(4), np.where(near[q] >= 0, here, beyond))
        c = AROUND - np.cumsum(score[:, AROUND::-1], axis=1, dtype=np.int16).argmax(axis=1)
        d = AROUND + np.cumsum(score[:, AROUND:], axis=1, dtype=np.int16).argmax(axis=1) + 1
        c, d = _widened(hit, c, d, low[q], high[q])
        theirs = (in_y >= c[:, None]) & (in_y < d[:, None])
        a, b = _widened(theirs, a, b, low[p], high[p])
        column = np.arange(near.shape[1])
        common = np.count_nonzero(theirs & (column >= a[:, None]) & (column < b[:, None]), axis=1)
        out[part[w[100 * common >= round(100 * LEAST) * (b - a + d - c - common)]]] = True
    return out


def _unit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole units together, of _UNIT_ROWS rows or one unit, and the first row of each and the end."""
    held, starts = [], [0]
    for table in unit_tables(batches):
        if held and starts[-1] + table.num_rows > _UNIT_ROWS:
            yield pa.concat_tables(held), np.array(starts)
            held, starts = [], [0]
        held.append(table)
        starts.append(starts[-1] + table.num_rows)
    if held:
        yield pa.concat_tables(held), np.array(starts)


def _able_pairs(table: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows i < j of one unit and of different texts and, but for a block with itself, blocks, of which one is open or no links lead from text to text."""
    node, own, opened, comp = (table.column(x).to_numpy() for x in ("node", "own", "open", "comp"))
    whole = np.minimum.reduceat(own, starts[:-1]) == np.maximum.reduceat(own, starts[:-1])
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(node)) - 1
    whole = np.repeat(whole, np.diff(starts))
    out = []
    for part in np.split(np.arange(len(node)), np.flatnonzero(np.diff(np.cumsum(left) // _PAIRS)) + 1):
        n = left[part]
        i = np.repeat(part, n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        able = (node[i] != node[j]) & (whole[i] | (own[i] != own[j])) & (opened[i] | opened[j] | (comp[i] != comp[j]))
        out.append((i[able], j[able]))
    return tuple(map(np.concatenate, zip(*out)))


def _compare_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, spans_a, spans_b) of windows (node, at, c, near, open) of one signature, for the pairs of each unit.

    A pair is compared if one of its windows is open or no links lead from one
    text to the other (comp), and both are dense() in the other, the more tokens in common
    the sooner; not if a passage already covers both and links lead from one to the other.
    Small units are screened together: what a unit takes by itself is then spent on those with pairs that pass.
    """
    for table, starts in _unit_batches(batches):
        i, j = _able_pairs(table, starts)
        lists = table.column("near").combine_chunks()
        heads = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        sizes = np.diff(heads)
        wide = (sizes[i] >= WIDTH) & (sizes[j] >= WIDTH)
        i, j = i[wide], j[wide]
        if not len(i):
            continue
        at = table.column("at").to_numpy()
        low = AROUND - at  # the shared token of each window is in the column AROUND
        unit = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        row = np.repeat(np.arange(len(sizes)), sizes)
        column = np.arange(len(row)) - np.repeat(heads[:-1] - low, sizes)
        tokens = (unit[row] << 32) | lists.flatten().to_numpy().view(np.uint32)
        order = np.argsort(tokens)
        new = np.ones(len(order), bool)
        new[1:] = np.diff(tokens[order]) != 0
        shared = np.diff(np.append(np.flatnonzero(new), len(order))) > 1
        # The tokens that a unit has twice are numbered in it, the others have one number, which is nowhere.
        count = np.concatenate([[0], np.cumsum(shared)])
        told = tokens[order[new]]
        firsts = np.searchsorted(told, np.arange(len(starts)) << 32)
        most = int(np.diff(count[firsts]).max())
        number = np.empty(len(order), np.int32)
        number[order] = np.where(shared, count[:-1] - count[firsts[told >> 32]], most)[np.cumsum(new) - 1]
        near = np.full((len(sizes), 2 * AROUND + 1), -1, np.int32)
        near[row, column] = number
        place = np.full((len(sizes), most + 1), -1, np.int8)
        twice = number < most
        place[row[twice], number[twice]] = column[twice]
        again = np.count_nonzero(place >= 0, axis=1) < np.bincount(row[twice], minlength=len(sizes))  # windows that repeat a token
        # Windows of equal tokens around the shared one fare alike.
        _, kind = np.unique(near.view(f"V{near.shape[1] * near.itemsize}").ravel(), return_inverse=True)
        _, first, alike = np.unique(kind[i] * len(sizes) + kind[j], return_index=True, return_inverse=True)
        u, v = i[first], j[first]
        able = np.zeros(len(u), bool)
        dense = np.flatnonzero(_dense(place, near, u, v))
        dense = dense[_dense(place, near, v[dense], u[dense])]
        able[dense] = True
        plain = dense[~(again[u[dense]] | again[v[dense]])]  # the others are compared one by one
        able[plain] = _passing(place, near, low, low + sizes, u[plain], v[plain])
        i, j = i[able[alike]], j[able[alike]]
        if not len(i):
            continue
        common = _in_common(place, near, i, j)
        order = np.lexsort((-common, unit[i]))
        i, j = i[order], j[order]
        node, opened, comp, c = (table.column(x).to_numpy() for x in ("node", "open", "comp", "c"))
        items = lists.flatten().to_numpy()
        covered = (~opened.astype(bool)).tolist()
        out = ([], [], [], [])
        for pairs in np.split(np.arange(len(i)), np.flatnonzero(np.diff(unit[i])) + 1):
            own = slice(starts[unit[i[pairs[0]]]], starts[unit[i[pairs[0]]] + 1])
            root = dict(zip(node[own].tolist(), comp[own].tolist())) | {k: k for k in comp[own].tolist()}

            def find(k: int) -> int:
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            for x, y in zip(i[pairs].tolist(), j[pairs].tolist()):
                p, q = find(int(node[x])), find(int(node[y]))
                if p == q and covered[x] and covered[y]:
                    continue
                part = common_part(items[heads[x] : heads[x + 1]], items[heads[y] : heads[y + 1]], int(at[x]), int(at[y]))
                if part:
                    root[p] = q
                    covered[x] = covered[y] = True
                    got = [(*(int(c[x] - at[x]) + v for v in part[:2]), *(int(c[y] - at[y]) + v for v in part[2:]))]
                    for side, value in zip(out, (int(node[x]), int(node[y]), _in_words(got, 0), _in_words(got, 2))):
                        side.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], _SPAN_TYPE), pa.array(out[3], _SPAN_TYPE)], ["a", "b", "spans_a", "spans_b"])


def _merged_spans(spans: DataFrame) -> DataFrame:
    """(mark, spans): the spans (mark, start, end) of each text, those that meet as one, in order."""
    in_text = Window.partitionBy("mark").orderBy("start", "end")
    reached = F.max("end").over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("new", F.coalesce((reached < F.col("start")).cast("int"), F.lit(1)))
    rows = rows.withColumn("island", F.sum("new").over(in_text.rowsBetween(Window.unboundedPreceding, 0)))
    whole = rows.groupBy("mark", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.groupBy("mark").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(id, class_id, n_passages, spans) of the documents (id, text) with a passage that repeats in another.

    A passage has LEAST_WORDS words or more, and its set of 5-word shingles has
    similarity LEAST or more to the other's. spans are merged ranges of words,
    end exclusive. class_id is the least id reachable by shared passages.
    A document whose words another has too, LEAST_WORDS or more, is repeated as
    a whole. Null and short texts and rows with a null id have no row. Rows
    that repeat an id with one text count as one document; with different
    texts, each text has a row. Very long texts are taken whole. Which of
    several equal partners is met first changes neither classes nor what is
    covered by equal passages. Further columns are ignored, whatever their
    names; an empty table gives an empty one.
    """
    rows = docs.filter("id is not null and text is not null").select(F.col("id").cast("long").alias("id"), "text")
    marked = rows.mapInArrow(_marks, "id long, mark long, mark2 long, n_words long").filter(F.col("n_words") >= LEAST_WORDS)
    marked = materialize(marked.distinct(), "marks")
    classes = materialize(marked.groupBy("mark", "mark2").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.first("n_words").alias("n_words")), "classes")
    groups = materialize(window_groups(rows.select("text"), _windows), "groups")
    pairs = materialize(_followers(groups).mapInArrow(_interval_join, f"a long, b long, good array<{_CAND}>, rest array<{_CAND}>"), "pairs")
    met = _verified(pairs.filter(F.size("good") > 0), classes, rows)
    passages = lambda df: df.filter(F.size("spans_a") > 0).select("a", "b", "spans_a", "spans_b")
    found = passages(met)

    members = _around_missed(groups, [pairs.filter(F.size("good") == 0), met], found)
    wanted = members.groupBy(F.col("node").alias("mark")).agg(F.collect_set(F.struct("k", "c")).alias("wanted"))
    asked = wanted.join(_ids_of(wanted.select("mark"), classes), "mark")
    # An id may have several texts.
    texts = possible_ids(rows, "id", asked.select("id")).join(asked, "id").select("mark", "text", "wanted")
    again = materialize(window_groups(texts, lambda it: _paired_windows(it, told=True)), "groups")
    release(groups, pairs, members)
    met = _verified(_followers(again).select("a", "b", F.col("cands").alias("good"), F.array().cast(f"array<{_CAND}>").alias("rest")), classes, rows)
    found = found.union(passages(met))

    members = _around_missed(again, [met], found)
    if not members.isEmpty():
        texts = _tokens_of(members.select(F.col("node").alias("mark")).distinct(), classes, rows).withColumnRenamed("mark", "node")
        low = F.greatest(F.col("c") - AROUND, F.lit(0))
        placed = members.join(texts, "node").withColumns({"near": F.slice("items", low + 1, F.col("c") - low + AROUND + 1), "at": F.col("c") - low})
        units = in_units(placed.select("band", "n", "node", "c", "at", "near", "open", "comp"), "node")
        found = found.union(materialize(units.mapInArrow(_compare_units, f"a long, b long, spans_a {_SPANS}, spans_b {_SPANS}"), "more"))
    joined = connected_components(found.select("a", "b"))
    release(again, members)

    marks = classes.join(_merged_spans(_spans(found)), "mark", "left").join(joined.withColumnRenamed("node", "mark"), "mark", "left")
    marks = marks.filter("spans is not null or last > id").withColumn("component", F.coalesce("component", "mark"))
    names = marks.groupBy("component").agg(F.min("id").alias("class_id"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    marks = marks.join(names, "component").select("mark", "mark2", "class_id", F.when(F.col("last") > F.col("id"), whole).otherwise(F.col("spans")).alias("spans"))
    return marked.select("id", "mark", "mark2").join(marks, ["mark", "mark2"]).select("id", "class_id", F.size("spans").cast("long").alias("n_passages"), "spans")
