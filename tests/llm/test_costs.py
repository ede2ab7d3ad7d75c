"""What the costly steps of the operators compute, and how often."""

import numpy as np
import pyarrow as pa

from foliant.llm import components, groups, linedup, passages, pieces
from foliant.llm.textops import span_hashes, word_hashes


def windows(rng, n):
    """(node, near, at): windows around one shared token that have more or less of one passage, at places of their own, some with repeated tokens."""
    whole = np.arange(2 * passages.AROUND + 1)
    out = []
    for k in range(n):
        near = whole + 1000 * (k + 1)
        for _ in range(rng.integers(1, 4)):
            a, b = np.sort(rng.integers(0, len(whole) + 1, 2))
            near[a:b] = whole[a:b]
        lost = rng.random(len(whole)) < rng.choice([0, 0.05, 0.15])
        near[lost] += 100 * (k + 1)
        near[passages.AROUND] = passages.AROUND
        if rng.random() < 0.1:
            near[3:9] = near[60:66]
        at = int(rng.choice([passages.AROUND, rng.integers(0, passages.AROUND + 1)]))
        size = passages.AROUND + int(rng.choice([passages.AROUND + 1, rng.integers(1, passages.AROUND + 2)]))
        out.append((k + 1, near[passages.AROUND - at : size].tolist(), at))
    return out


def unit(rows):
    node, near, at = zip(*rows)
    n = len(rows)
    same = lambda v, t: pa.array([v] * n, t)
    return pa.RecordBatch.from_arrays(
        [same(9, pa.int64()), same(0, pa.int64()), same(0, pa.int32()), pa.array(node, pa.int64()), pa.array(node, pa.int64()), pa.array(at, pa.int32()), pa.array([50] * n, pa.int32()), same(True, pa.bool_()), pa.array(near, pa.list_(pa.int32()))],
        ["band", "unit", "own", "node", "comp", "at", "c", "open", "near"],
    )


def test_windows_that_fail_are_told_at_once(monkeypatch):
    """Of a unit's pairs only those with passages, and those that repeat tokens, are compared one by one; no pair with a passage is lost."""
    calls = []
    plain = passages.numbered_part
    monkeypatch.setattr(passages, "numbered_part", lambda *a: calls.append(1) or plain(*a))
    for seed in range(6):
        rows = windows(np.random.default_rng(seed), 60)
        passing = {(a, b) for i, (a, x, cx) in enumerate(rows) for b, y, cy in rows[i + 1 :] if passages.common_part(np.array(x), np.array(y), cx, cy)}
        repeats = sum(len(set(x)) < len(x) for _, x, _ in rows)
        calls.clear()
        got = {(r["a"], r["b"]) for batch in passages._compare_units([unit(rows)]) for r in batch.select(["a", "b"]).to_pylist()}
        assert got <= passing
        root = {a: a for a, _, _ in rows}
        find = lambda k: k if root[k] == k else find(root[k])
        for a, b in got:
            root[find(a)] = find(b)
        assert all(find(a) == find(b) for a, b in passing)
        assert len(passing) > 5 and len(calls) <= len(passing) + repeats * len(rows)


def test_near_misses_cost_no_search(monkeypatch):
    """Windows that share 7 of 9 tokens are dense in one another, but no passages: none of their pairs is searched."""
    monkeypatch.setattr(passages, "numbered_part", lambda *a: (_ for _ in ()).throw(AssertionError("searched")))
    rows = []
    for k in range(9):
        near = np.arange(2 * passages.AROUND + 1)
        own = (near % 9 == k) & (near != passages.AROUND)
        rows.append((k + 1, np.where(own, near + 1000 * (k + 1), near).tolist(), passages.AROUND))
    assert sum(b.num_rows for b in passages._compare_units([unit(rows)])) == 0


def test_small_units_are_screened_together(monkeypatch):
    """Hundreds of units take a few screens, whose pairs are those of each unit alone; tokens and windows that two units share link nothing."""
    calls = []
    plain = passages._passing
    monkeypatch.setattr(passages, "_passing", lambda *a: calls.append(1) or plain(*a))
    units = []
    for k in range(300):
        rows = windows(np.random.default_rng(k % 250), 3 + k % 7)  # the last units repeat the windows of the first
        batch = unit([(1000 * k + node, near, at) for node, near, at in rows])
        units.append(batch.set_column(0, "band", pa.array([k // 2] * batch.num_rows)).set_column(1, "unit", pa.array([k % 2] * batch.num_rows)))
    alone = [r for u in units for batch in passages._compare_units([u]) for r in batch.to_pylist()]
    calls.clear()
    together = pa.Table.from_batches(units).combine_chunks().to_batches(max_chunksize=100)
    assert [r for batch in passages._compare_units(together) for r in batch.to_pylist()] == alone
    assert len(alone) > 50 and 0 < len(calls) < 10


def test_windows_are_dealt_as_records(monkeypatch):
    """Packed by parts, which batches cut anywhere, windows give the rows of all of them put in order at once."""
    monkeypatch.setattr(passages, "PART_BITS", 4)
    monkeypatch.setattr(passages, "_AT_ONCE", 500)
    rng = np.random.default_rng(8)
    shared = [" ".join(f"s{v}" for v in rng.integers(0, 5000, 120)) for _ in range(4)]
    text = lambda: " ".join(f"w{v}" for v in rng.integers(0, 5000, 60)) + " " + " ".join(rng.choice(shared, 2))
    batches = [pa.RecordBatch.from_pydict({"text": [text() for _ in range(n)] + ["short", None]}) for n in (30, 1, 45)]
    windows = [w for b in batches for w in passages._windows([b])]
    packed = pa.Table.from_batches(list(passages._packed(windows))).sort_by("part")
    rows = [r for w in windows for r in w.to_pylist()]
    assert packed.num_rows < len(rows) / 10
    want = [r for r in rows if r["leader"] is not None]
    bands = {}
    for r in sorted((r for r in rows if r["leader"] is None), key=lambda r: (r["node"], r["c"])):
        lead = bands.setdefault(r["band"], r)
        want.append(r | {"leader": lead["node"], "l2": lead["l"], "c2": lead["c"], "r2": lead["r"]})
    want = sorted(tuple(r.values()) for r in want if (r["node"], r["c"]) != (r["leader"], r["c2"]))
    for size in (1, 3, 1000):
        got = [r for b in passages._merge(packed.to_batches(max_chunksize=size)) for r in b.to_pylist()]
        assert sorted(tuple(r.values()) for r in got) == want
    assert len(want) > 500 and not any(b.num_rows for b in passages._merge([]))


def test_pairs_of_windows_of_many_texts():
    """Texts that are windowed together give the pairs of signatures that each gives alone, and all that are wanted."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{v}" for v in rng.integers(0, 3000, n)) for n in (400, 90, 60, 51, 300)]
    wanted = []
    for text in texts:
        data = np.frombuffer(text.encode(), np.uint8)
        _, _, k, _, c, _ = passages._text_windows(data, np.array([0, len(data)]))
        wanted.append([{"k": int(k[j]), "c": int(c[j])} for j in range(0, len(k), 3)])
    kind = pa.list_(pa.struct([("k", pa.int32()), ("c", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(texts), pa.array(wanted, kind)], ["mark", "text", "wanted"])
    rows = lambda parts: sorted(tuple(r[f] for f in ("band", "node", "k", "l", "c", "r")) for b in parts for r in b.to_pylist())
    together = rows(passages._paired_windows([batch]))
    assert together and together == rows(passages._paired_windows([batch.slice(k, 1) for k in range(5)]))
    brute = set()
    for text, asked in zip(texts, wanted):
        data = np.frombuffer(text.encode(), np.uint8)
        node, _, k, left, c, right = (v.tolist() for v in passages._text_windows(data, np.array([0, len(data)])))
        asked = {(w["k"], w["c"]) for w in asked}
        for i in range(len(k)):
            for j in range(len(k)):
                near = abs(c[i] - c[j]) <= passages.AROUND and min(right[i], right[j]) - max(left[i], left[j]) >= passages.AROUND
                if k[i] < k[j] and near and ((k[i], c[i]) in asked or (k[j], c[j]) in asked):
                    brute.add((node[i], k[i], left[i], c[i], right[i]))
    assert {r[1:] for r in together} == brute


def test_rows_of_trees_name_no_leader_but_another(spark):
    """Members that lead themselves are dealt without a leader, whose bytes would be shuffled; the trees hold every member but the first."""
    first = groups.tree_rows(np.array([7, 7, 8, 9]), np.array([5, 3, 4, 1]))
    second = groups.tree_rows(np.array([7, 8, 10]), np.array([2, 4, 6]))
    rows = [r for b in (first, second) for r in b.to_pylist()]
    assert {(r["band"], r["node"], r["leader"]) for r in rows} == {(7, 5, 3), (7, 3, None), (8, 4, None), (9, 1, None), (7, 2, None), (10, 6, None)}
    got = groups.group_trees(spark.createDataFrame([tuple(r.values()) for r in rows], groups.TREE)).collect()
    assert {(r.band, r.node, r.leader) for r in got} == {(7, 5, 3), (7, 3, 2)}


def test_bands_are_packed_before_they_are_shuffled(spark):
    rng = np.random.default_rng(5)
    text = "\n".join("".join(map(chr, rng.integers(97, 123, 40))) for _ in range(2000))
    rows = list(linedup._band_rows(iter([pa.RecordBatch.from_pydict({"text": [text]})])))
    assert sum(r.num_rows for r in rows) <= 1 << groups.PART_BITS  # and not 2000 * BANDS
    assert sum(len(r.column("lead").flatten()) for r in rows) == 2000 * linedup.BANDS


def test_packed_trees_are_the_trees_of_all_memberships(spark):
    rng = np.random.default_rng(6)
    hashes = np.array([*rng.integers(-(2**63), 2**63 - 1, 400), -(2**63), 2**63 - 1, -1, 0])
    band, node = rng.choice(hashes, 5000), rng.integers(-(2**63), 2**63 - 1, 5000)
    hot = np.concatenate([np.full(3000, hashes[0]), band])  # one band with a third of all
    node = np.concatenate([rng.integers(-(2**63), 2**63 - 1, 3000), node])
    packed = [r for part in np.array_split(np.arange(len(hot)), 5) for r in groups.packed_rows(hot[part], node[part])]
    frames = spark.createDataFrame(pa.Table.from_batches(packed), groups.PACKED)
    got = groups.packed_trees(frames).collect()
    want: dict[int, set[int]] = {}
    for b, x in zip((hot >> (64 - groups.BAND_BITS)).tolist(), node.tolist()):
        want.setdefault(b, set()).add(x)
    found: dict[int, dict[int, int]] = {}
    for row in got:
        assert row.node not in found.setdefault(row.band, {})
        found[row.band][row.node] = row.leader
    assert set(found) == {b for b, x in want.items() if len(x) > 1}
    for b, tree in found.items():
        least = min(want[b])
        assert set(tree) == want[b] - {least}
        for x in tree:
            while x in tree:
                assert tree[x] < x
                x = tree[x]
            assert x == least


def test_tokens_of_an_id_with_several_texts(spark):
    """Each mark gets the tokens of its own text, and not those of another text of the same id."""
    texts = [" ".join(f"{a}{k}" for k in range(60)) for a in "uvwxyz"]
    docs = spark.createDataFrame([(1, t) for t in texts], "id long, text string")
    marked = docs.mapInArrow(passages._marks, "id long, mark long, mark2 long, n_words long")
    got = {r.mark: r["items"] for r in passages._tokens_of(marked.select("mark"), marked, docs).collect()}
    want = {}
    for t in texts:
        own = next(passages._tokens(iter([pa.RecordBatch.from_pydict({"mark": [0], "text": [t]})])))
        words, rows = word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))
        want[int(span_hashes(words, rows[:-1], rows[1:]).view(np.int64)[0])] = own.column("items")[0].as_py()
    assert got == want


def test_pieces_are_found_character_by_character():
    """A chunk's two best scores take no look at the table of pieces, each of which costs a slice and its hash."""
    found = {p: (k, -1.0 - k / 7) for k, p in enumerate(["a", "b", "ab", "abab", "ba", "bab", "▁a", "ж", "bжa"])}
    plain, other = pieces.Vocabulary(found, {}, 99), pieces.Vocabulary(found, {}, 99)
    other.table, other.root = {}, other.trie()
    for chunk in ("a", "ababab", "▁abba", "bжab", "xaxbж", "▁"):
        best = plain.n_best(chunk, 2)
        score, ids, second = other.two_best(chunk)
        assert (round(score, 9), ids) == (round(best[0][0], 9), best[0][1])
        assert round(second, 9) == round(best[1][0], 9) if len(best) > 1 else second == float("-inf")


def test_edges_of_a_task_need_no_rounds(spark, monkeypatch):
    """Each round adds jobs and plans that the driver keeps: a chain that one task has at hand takes none, and the result is a table."""
    rounds = []
    plain = components._large_star
    monkeypatch.setattr(components, "_large_star", lambda e: rounds.append(1) or plain(e))
    chain = [(k, k + 1) for k in range(200)] + [(900, 900), (70, 30), (901, 950), (901, 950)]
    edges = spark.createDataFrame(chain, "a long, b long")
    got = components.connected_components(edges.coalesce(1))
    want = {k: 0 for k in range(201)} | {900: 900, 901: 901, 950: 901}
    assert {(r.node, r.component) for r in got.collect()} == set(want.items()) and got.count() == len(want)
    assert not rounds and hasattr(got, "written_to")
    again = components.connected_components(edges.repartition(40, "a", "b"))
    assert {(r.node, r.component) for r in again.collect()} == set(want.items())


def test_contracted_edges_keep_their_components(monkeypatch):
    """However few edges are contracted at a time, nothing is lost."""
    monkeypatch.setattr(components, "AT_ONCE", 8)
    rng = np.random.default_rng(3)
    for n in (5, 40, 200):
        a, b = rng.integers(-(2**62), 2**62, n)[rng.integers(0, n, (2, n))]
        batches = [pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"]) for x, y in zip(np.array_split(a, 7), np.array_split(b, 7))]
        out = [tuple(batch.column(c).to_numpy() for c in ("a", "b")) for batch in components._contracted(iter(batches))]
        x, y = map(np.concatenate, zip(*out))
        assert len(x) <= n and (x > y).all()
        whole, parts = ({k: v for k, v in zip(*(v.tolist() for v in components.stars(*e)))} for e in ((a, b), (x, y)))
        assert whole == parts
