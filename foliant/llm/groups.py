"""Comparisons inside groups of any size: links to leaders first, then exact blocks, never all pairs as rows.

A group (of lines that share a band, of documents in one region of an order)
is kept as a tree: one row (group, node, leader) for every member but the
first. Members that meet in one task are numbered there, so that only one row
of a task's share of a hot group is dealt by the group's key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.shared import possible_ids

#: Members of a group that one side of a block comparison holds.
BLOCK = 512
#: Tokens that a comparison counts at a time.
_STRIP = 4096

TREE = "band long, node long, leader long"
#: Bits of a band that are kept where memberships are packed, and those by which they are dealt.
BAND_BITS, PART_BITS = 44, 12
PACKED = "part int, low array<int>, lead array<long>, band array<long>, node array<long>, leader array<long>"
_PACKED_LISTS = ("low", "lead", "band", "node", "leader")


def tree_rows(band: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """Memberships (band, node) as rows of a tree: the least node of each band here leads itself, other ones follow it.

    The leader of one that leads itself is null: most do, and zeros take no place in a shuffle.
    """
    order = np.argsort(band)
    band, node = band[order], node[order]
    first = np.ones(len(band), bool)
    first[1:] = band[1:] != band[:-1]
    leader = np.minimum.reduceat(node, np.flatnonzero(first))[np.cumsum(first) - 1] if len(band) else node
    return pa.RecordBatch.from_arrays([pa.array(band), pa.array(node), pa.array(leader, mask=leader == node)], ["band", "node", "leader"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of bands: those that lead themselves (or have no leader) follow the first of their band; a band's first gives no row."""
    last_band, last_leader = None, 0
    for batch in batches:
        band, node = (batch.column(c).to_numpy() for c in ("band", "node"))
        alone = batch.column("leader").is_null().to_numpy(zero_copy_only=False)
        leader = np.where(alone, node, batch.column("leader").fill_null(0).to_numpy())
        own = np.flatnonzero(node == leader)
        heads, nodes = band[own], node[own]
        first = np.ones(len(own), bool)
        first[1:] = heads[1:] != heads[:-1]
        if len(own) and last_band is not None and heads[0] == last_band:
            first[0] = False
        at = np.cumsum(first) - 1
        starts = nodes[first]
        leads = np.where(at >= 0, starts[np.maximum(at, 0)] if len(starts) else 0, last_leader)
        if len(own):
            last_band, last_leader = heads[-1], leads[-1]
        leader = leader.copy()
        leader[own] = leads
        keep = np.flatnonzero(node != leader)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (band, node, leader)], ["band", "node", "leader"])


def group_trees(rows: DataFrame) -> DataFrame:
    """(band, node, leader) of all groups with two members or more, from the rows of tree_rows of all tasks.

    Rows that follow a leader of their own task are dealt by band and node, so
    that a band with a third of all rows is spread out; one row for each
    task's share meets the others of its band, in order, a batch at a time.
    """
    deal = F.when(F.col("leader").isNull(), F.xxhash64("band")).otherwise(F.xxhash64("band", "node"))
    return rows.repartition(deal).sortWithinPartitions("band", "node").mapInArrow(_merge, TREE)


def packed_rows(band: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Memberships (band, node) as in tree_rows, many to a row: the least nodes of bands by part of the bands, those that follow them by part of the nodes.

    Bands count by their first BAND_BITS bits, so that a membership takes 12 bytes in a shuffle. Of n
    bands, a share of n / 2^BAND_BITS meets another by chance; members of one group are compared in any case.
    """
    rows = tree_rows(band >> (64 - BAND_BITS), node)
    alone = rows.column("leader").is_null().to_numpy(zero_copy_only=False)
    band, node = (rows.column(c).to_numpy()[alone] for c in ("band", "node"))
    cuts = _cuts(band >> 32)
    yield _packed(band[cuts[:-1]] >> 32, cuts, {"low": band.astype(np.int32), "lead": node})  # the last 32 bits
    if alone.all():
        return
    rows = rows.filter(pa.array(~alone))
    rows = rows.take(pa.array(np.argsort(rows.column("node").to_numpy())))
    node = rows.column("node").to_numpy()
    cuts = _cuts(node >> (64 - PART_BITS))
    yield _packed(node[cuts[:-1]] >> (64 - PART_BITS), cuts, {c: rows.column(c).to_numpy(zero_copy_only=False) for c in ("band", "node", "leader")})


def _cuts(part: np.ndarray) -> np.ndarray:
    """Where the runs of sorted parts begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]]) if len(part) else np.zeros(1, np.int64)


def _packed(part: np.ndarray, cuts: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    lists = {c: pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x)) for c, x in columns.items()}
    none = lambda kind: pa.nulls(len(part), pa.list_(kind))
    own = [lists[c] if c in lists else none(pa.int32() if c == "low" else pa.int64()) for c in _PACKED_LISTS]
    return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *own], ["part", *_PACKED_LISTS])


def _merge_packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trees of packed_rows of all tasks, in the order of parts: of each band's members those but the least."""
    held = (np.zeros(0, np.int64), np.zeros(0, np.int64))  # the last part: more of it may come
    for batch in batches:
        followers = [batch.column(c).flatten() for c in ("band", "node", "leader")]
        if len(followers[0]):
            yield pa.RecordBatch.from_arrays(followers, ["band", "node", "leader"])
        low, lead = batch.column("low"), batch.column("lead").flatten().to_numpy()
        part = np.repeat(batch.column("part").to_numpy().astype(np.int64), low.value_lengths().fill_null(0).to_numpy())
        band = np.concatenate([held[0], (part << 32) | low.flatten().to_numpy().view(np.uint32)])
        node = np.concatenate([held[1], lead])
        whole = int(np.searchsorted(band >> 32, band[-1] >> 32)) if len(band) else 0
        held = (band[whole:], node[whole:])
        yield _followers(band[:whole], node[:whole])
    yield _followers(*held)


def _followers(band: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    rows = tree_rows(band, node)
    return rows.filter(rows.column("leader").is_valid())


def packed_trees(rows: DataFrame) -> DataFrame:
    """group_trees() from the rows of packed_rows of all tasks: a task holds one of 2^PART_BITS parts of the bands at a time, whatever their sizes."""
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(_merge_packed, TREE)


def star_pairs(trees: DataFrame) -> DataFrame:
    """The distinct pairs (a, b), a < b, of members and their leaders."""
    return trees.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()


def open_members(trees: DataFrame, apart: DataFrame, joined: DataFrame) -> DataFrame:
    """(band, n, node, c) of the groups with three members or more of which some are apart.

    apart: the pairs of star_pairs that different components hold; joined:
    (node, component). As a group's rows are a tree, it holds one component
    alone if none of its pairs is apart.
    """
    pair = trees.withColumns({"a": F.least("node", "leader"), "b": F.greatest("node", "leader"), "_ab": F.xxhash64(F.least("node", "leader"), F.greatest("node", "leader"))})
    # Most rows are of closed groups and don't move: both joins are screened by bitmaps of fixed size.
    pair = possible_ids(pair, "_ab", apart.select(F.xxhash64("a", "b").alias("_ab")))
    bands = pair.join(apart.select("a", "b"), ["a", "b"], "left_semi").select("band").distinct()
    rows = possible_ids(trees, "band", bands).join(bands, "band", "left_semi")
    large = rows.groupBy("band").agg((F.count("*") + 1).alias("n")).filter("n > 2")
    members = rows.select("band", F.explode(F.array("node", "leader")).alias("node")).distinct().join(large, "band")
    return members.join(joined, "node", "left").select("band", "n", "node", F.coalesce("component", "node").alias("c"))


def in_units(members: DataFrame, node: str = "node") -> DataFrame:
    """members (band, n, ...) with own (their block) and unit, once for each pair of blocks that theirs is in, dealt and sorted by unit.

    A group with more than BLOCK members is many units, each of about two
    blocks, so that no task holds a group whole.
    """
    more = F.floor((F.col("n") - 1) / BLOCK).cast("int")
    rows = members.withColumn("own", F.pmod(F.xxhash64(node, F.lit(7)), more + 1).cast("int"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), more)))
    rows = rows.withColumn("unit", F.least("own", "block").cast("long") * (more + 1) + F.greatest("own", "block")).drop("block")
    return rows.repartition("band", "unit").sortWithinPartitions("band", "unit")


def unit_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (band, unit) of batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        band, unit = batch.column("band").to_numpy(), batch.column("unit").to_numpy()
        cuts = np.flatnonzero((band[1:] != band[:-1]) | (unit[1:] != unit[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(band)]):
            if last != (band[a], unit[a]) and held:
                yield pa.Table.from_batches(held)
                held = []
            last = (band[a], unit[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def comparable(table: pa.Table) -> np.ndarray:
    """Which pairs of a unit's rows are in different components and, but for a block with itself, in different blocks."""
    c, own = table.column("c").to_numpy(), table.column("own").to_numpy()
    able = c[:, None] != c[None, :]
    if own.min() != own.max():
        able &= own[:, None] != own[None, :]
    return able


def common_counts(tokens: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, n) numbers of common tokens of n sets, given as tokens and the set of each; exact."""
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    number = np.cumsum(new) - 1
    count = np.bincount(number)
    shared = count > 1
    keep = shared[number] if len(number) else np.zeros(0, bool)
    number, owner = (np.cumsum(shared) - 1)[number[keep]], owner[keep]
    common = np.zeros((n, n), np.float32)
    for a in range(0, int(shared.sum()), _STRIP):
        low, high = np.searchsorted(number, [a, a + _STRIP])
        part = np.zeros((n, _STRIP), np.float32)
        part[owner[low:high], number[low:high] - a] = 1
        common += part @ part.T
    return common.astype(np.int64)


def linked(common: np.ndarray, sizes: np.ndarray, able: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The places i < j of able pairs with 100 * common >= 100 * least * union."""
    union = sizes[:, None] + sizes[None, :] - common
    return np.nonzero(np.triu(able & (100 * common >= round(100 * least) * union), 1))


def spanning(i: np.ndarray, j: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which links (i, j) are enough to join the same components c: a forest."""
    if not len(i):
        return np.zeros(0, np.int64)
    _, code = np.unique(c, return_inverse=True)
    x, y = np.minimum(code[i], code[j]), np.maximum(code[i], code[j])
    _, first = np.unique(x * (code.max() + 1) + y, return_index=True)
    root = list(range(code.max() + 1))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    keep = []
    for at in first.tolist():
        p, q = find(int(x[at])), find(int(y[at]))
        if p != q:
            root[p] = q
            keep.append(at)
    return np.array(keep, np.int64)


def block_links(sets: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow on in_units(): links (a, b) between components of each unit by exact similarity of members.

    sets gives the tokens of the distinct sets of a unit's rows and the row of each token.
    """

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in unit_tables(batches):
            able = comparable(table)
            if not able.any():
                continue
            tokens, owner = sets(table)
            n = table.num_rows
            i, j = linked(common_counts(tokens, owner, n), np.bincount(owner, minlength=n), able, least)
            keep = spanning(i, j, table.column("c").to_numpy())
            c = table.column("c").to_numpy()
            x, y = c[i[keep]], c[j[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return links
