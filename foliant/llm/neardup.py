"""MinHash near-duplicates by an LSH forest.

A document's set is its distinct 5-word shingles. Documents with equal sets
are one class from the start. Each of TREES orders sorts the class
representatives by a sequence of min-hashes. Neighbours in an order with a
common prefix of LEAST_DEPTH or more are candidates; runs of them are a
region, whose members meet its first one, and a region with more than REGION
members descends to longer and longer prefixes until its parts are small, each
with a first member of its own. Candidates are confirmed on full sets.

Where a region of three or more still holds several components after that,
its members of different components are compared in exact blocks. No caps and
no estimates: a pair of similar documents that share a region in any order is
in one component in the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.components import connected_components, joined_further
from foliant.llm.groups import TREE, _merge, block_links, in_units, open_members
from foliant.llm.shared import materialize, possible_ids, release
from foliant.llm.textops import U64, _splitmix, chunks, mix, shingle_hashes, word_hashes

TREES = 20
#: Depth of the prefixes that make a region: two sets of similarity 0.75 share one in some tree with 1 - (1 - 0.75^3)^20 = 0.99998.
LEAST_DEPTH = 3
#: Members beyond which a region descends, to prefixes of MOST_DEPTH at most.
REGION, MOST_DEPTH = 64, 8
HASHES = TREES * LEAST_DEPTH

_SALT = (_splitmix(HASHES, 11) >> U64(32)).astype(np.uint32)
_ODD = (_splitmix(HASHES, 12) >> U64(32)).astype(np.uint32) | np.uint32(1)
_FACTORS = _splitmix(MOST_DEPTH, 13) | U64(1)
#: The hash functions of each tree: its own LEAST_DEPTH first, then those of the next trees.
ORDER = np.array([[(t * LEAST_DEPTH + d) % HASHES for d in range(MOST_DEPTH)] for t in range(TREES)])


def min_hashes(hashes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """(rows, HASHES) least values of each hash function over the shingles of each row; rows must not be empty."""
    short = (hashes >> U64(32)).astype(np.uint32)
    out = np.empty((len(heads) - 1, HASHES), np.uint32)
    for k in range(HASHES):
        x = short ^ _SALT[k]
        x *= _ODD[k]
        x ^= x >> np.uint32(15)
        out[:, k] = np.minimum.reduceat(x, heads[:-1])
    return out


def _sets(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, distinct shingle hashes sorted row by row, n + 1 starts)."""
    for i, j, data, offsets in chunks(text):
        words, rows = word_hashes(data, offsets)
        hashes, heads = shingle_hashes(words, rows)
        parts = [np.unique(hashes[a:b]) for a, b in zip(heads[:-1], heads[1:])]
        sizes = np.array([len(p) for p in parts], np.int64)
        yield i, j, (np.concatenate(parts) if parts else hashes), np.concatenate([[0], np.cumsum(sizes)])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, hashes, starts in _sets(batch.column("text")):
            full = np.flatnonzero(np.diff(starts))
            sizes = np.diff(starts)
            marks = np.zeros((j - i, 2), np.int64)
            signs: list[bytes | None] = [None] * (j - i)
            if len(full):
                heads = np.append(starts[:-1][full], starts[-1])
                marks[full, 0] = np.add.reduceat(hashes, heads[:-1]).view(np.int64)
                marks[full, 1] = np.bitwise_xor.reduceat(hashes * U64(0x9E3779B97F4A7C15), heads[:-1]).view(np.int64)
                for r, row in zip(full, min_hashes(hashes, heads)):
                    signs[r] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").slice(i, j - i), pa.array(sizes), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(signs, pa.binary())],
                ["id", "n_shingles", "m1", "m2", "sign"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    """(id, n_shingles, m1, m2, sign) of documents (id, text): set size, 128-bit mark of the set and min-hashes (null if empty)."""
    return docs.select("id", "text").mapInArrow(_sign, "id long, n_shingles long, m1 long, m2 long, sign binary")


def _order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tree, key, id): key holds MOST_DEPTH min-hashes in the tree's order, big-endian so that bytes sort as numbers."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        signs = np.frombuffer(b"".join(batch.column("sign").to_pylist()), np.uint32).reshape(n, HASHES)
        for t in range(TREES):
            keys = np.ascontiguousarray(signs[:, ORDER[t]].astype(">u4"))
            offsets = pa.py_buffer((np.arange(n + 1) * MOST_DEPTH * 4).astype(np.int32).tobytes())
            key = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(keys.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), key, batch.column("id")], ["tree", "key", "id"])


def _runs(first: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs that begin where first is true: each row's run, the runs' sizes and their least ids."""
    starts = np.flatnonzero(first)
    return np.cumsum(first) - 1, np.diff(np.append(starts, len(ids))), np.minimum.reduceat(ids, starts)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, band, node, leader) of rows (tree, key, id) in an order's sequence.

    Depth LEAST_DEPTH: members of a region and its least one; the least one of
    a region at either end of a batch leads itself, as the region may go on
    elsewhere. Greater depths: members of parts of crowded regions. Depth 0:
    neighbours.
    """
    before = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        tree, ids = batch.column("tree").to_numpy(), batch.column("id").to_numpy()
        keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), ">u4").reshape(n, MOST_DEPTH).astype(U64)
        same = (keys[1:] == keys[:-1]) & (tree[1:] == tree[:-1])[:, None]
        prefix = np.append(0, np.logical_and.accumulate(same, axis=1).sum(axis=1))  # with the row before
        names = (np.cumsum((keys + U64(1)) * _FACTORS, axis=1, dtype=U64) + (tree.astype(U64) << U64(40))[:, None]) * U64(0x9E3779B97F4A7C15)
        depths, bands, nodes, leads = [], [], [], []

        def put(depth: int, at: np.ndarray, leader: np.ndarray) -> None:
            depths.append(np.full(len(at), depth, np.int32))
            bands.append(mix(names[at, max(depth, LEAST_DEPTH) - 1] + U64(depth)).view(np.int64))
            nodes.append(ids[at])
            leads.append(leader)

        near = np.flatnonzero(prefix >= LEAST_DEPTH)
        put(0, near, ids[near - 1])
        if before is not None and before[0] == tree[0] and (before[1][:LEAST_DEPTH] == keys[0, :LEAST_DEPTH]).all():
            put(0, np.zeros(1, np.int64), np.array([before[2]]))
        before = (tree[-1], keys[-1], ids[-1])

        crowded = np.ones(n, bool)
        for depth in range(LEAST_DEPTH, MOST_DEPTH + 1):
            run, sizes, least = _runs(prefix < depth, ids)
            leader = least[run]
            member = crowded & (ids != leader)
            put(depth, np.flatnonzero(member), leader[member])
            if depth == LEAST_DEPTH:
                ends = np.flatnonzero(((run == 0) | (run == run[-1])) & (ids == leader))
                put(depth, ends, ids[ends])
            crowded &= sizes[run] > REGION
            if not crowded.any():
                break
        columns = [np.concatenate(x) for x in (depths, bands, nodes, leads)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["depth", "band", "node", "leader"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, hashes, starts in _sets(batch.column("text")):
            sets = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), sets], ["id", "items"])


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, items) of the documents of ids. Only their texts move: ids are screened by a bitmap of fixed size before the join."""
    texts = possible_ids(docs.select("id", "text"), "id", ids).join(ids, "id", "left_semi").distinct()
    return texts.mapInArrow(_full_sets, "id long, items array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, least: float = 0.75) -> DataFrame:
    """The pairs (a, b) of ids whose full shingle sets (id, items) have 100 * intersection >= 100 * least * union."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    nx, ny = F.size("x"), F.size("y")
    alike = F.lit(round(100 * least)) * F.greatest(nx, ny) <= F.lit(100) * F.least(nx, ny)
    common = F.when(alike, F.size(F.array_intersect("x", "y"))).otherwise(0)
    return both.filter(F.lit(100) * common >= F.lit(round(100 * least)) * (nx + ny - common)).select("a", "b")


def _unit_sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    items = table.column("items").combine_chunks()
    return items.flatten().to_numpy(), np.repeat(np.arange(len(items)), np.diff(items.offsets.to_numpy()))


def _linked(reps: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """(id, c) of the representatives (id, sign) that are linked with others."""
    orders = reps.select("id", "sign").mapInArrow(_order, "tree int, key binary, id long")
    ordered = orders.repartitionByRange("tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    forest = materialize(ordered.mapInArrow(_forest, f"depth int, {TREE}"), "forest")
    regions = forest.filter(F.col("depth") == LEAST_DEPTH).drop("depth")
    # A region that several tasks hold parts of: their least members meet.
    parts = regions.filter("node = leader").repartition(F.xxhash64("band")).sortWithinPartitions("band", "node").mapInArrow(_merge, TREE)
    parts = materialize(parts, "parts")
    trees = regions.filter("node <> leader").union(parts)

    met = forest.filter("node <> leader").select("node", "leader").union(parts.select("node", "leader"))
    pairs = materialize(met.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), "pairs")
    sets = materialize(full_sets(rows, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "sets")
    links = materialize(confirm(pairs, sets, least), "links")
    joined = connected_components(links)

    side = lambda k: joined.toDF(k, f"c{k}")
    failed = pairs.join(links, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
    apart = materialize(failed.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "apart")
    members = materialize(open_members(trees, apart, joined), "open")
    if not members.isEmpty():
        units = in_units(members.join(sets.withColumnRenamed("id", "node"), "node"))
        more = materialize(units.select("band", "unit", "own", "node", "c", "items").mapInArrow(block_links(_unit_sets, least), "a long, b long"), "links")
        joined = joined_further(joined, more)
    release(forest, parts, pairs, sets, apart, members)
    return joined.toDF("id", "c")


def components(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """(id, n_shingles, component_id) of documents (id, text).

    component_id is the least id reachable by links of similarity least or
    more, the document included. Null texts and texts without words have an
    empty set and are linked with nothing. Each row is returned; rows that
    repeat an id are one document, which is linked by any of its texts. Rows
    with a null id are linked with nothing. Very long texts are sets like any
    other, whole. Ties don't matter: a component is the same whatever order
    its links are found in. Further columns are ignored, whatever their names;
    an empty table gives an empty one.
    """
    rows = docs.select(F.col("id").cast("long").alias("id"), "text")
    signed = materialize(signatures(rows), "signatures")
    full = signed.filter("n_shingles > 0 and id is not null")
    classes = full.groupBy("m1", "m2").agg(F.min("id").alias("id"), F.first("sign").alias("sign"))
    reps = materialize(classes, "classes")
    joined = _linked(reps, rows, least)
    named = reps.select("m1", "m2", "id").join(joined, "id", "left").select("m1", "m2", F.coalesce("c", "id").alias("component_id"))
    # A repeated id whose texts lie in several classes: its rows have the id's least class, too.
    found = full.select("id", "n_shingles", "m1", "m2").join(named, ["m1", "m2"])
    alone = signed.filter("n_shingles = 0 or id is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    return found.select("id", "n_shingles", "component_id").union(alone)
