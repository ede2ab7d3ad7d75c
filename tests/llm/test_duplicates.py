"""Near-duplicate documents, lines and passages against brute force on small tables."""

import collections
import random
import re

from foliant.llm import linedup, neardup, passages
from foliant.llm.components import connected_components
from tests.llm.test_text_operators import text

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


class Union(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def edited(t: str, rate: float, rng: random.Random) -> str:
    return " ".join("new%d" % rng.randrange(10**6) if rng.random() < rate else w for w in t.split())


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000 + k) for k in range(1, 60)] + [(k, k + 1) for k in range(2000, 2040)]
    known = Union()
    for a, b in edges:
        known.join(a, b)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {n: known.find(n) for n in known}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(4)
    base = text(7, 150)
    rows = [(k, text(k, 40 + k)) for k in range(20, 60)]
    rows += [(100 + k, edited(base, 0.025, rng)) for k in range(60)] + [(200 + k, rows[k][1].upper()) for k in range(5)]
    rows += [(300, "two words"), (301, "Two  words"), (302, None), (303, ""), (304, " \n"), (305, None), (306, "five words are just enough"), (307, text(9, 20000)), (308, text(9, 20000) + " tail")]
    known, sets = Union(), {i: shingles(t) for i, t in rows}
    for i in sets:
        known.find(i)
        for j in sets:
            common = len(sets[i] & sets[j])
            if i < j and sets[i] and sets[j] and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                known.join(i, j)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "id long, text string, m1 string")
    got = {r.id: (r.n_shingles, r.component_id) for r in neardup.components(df).collect()}
    assert got == {i: (len(s), known.find(i)) for i, s in sets.items()}
    assert neardup.components(df.limit(0)).count() == 0


def test_lines(spark):
    rng = random.Random(6)
    line = text(3, 30)
    near = ["".join("#" if rng.random() < 0.01 else c for c in line) for _ in range(25)]
    rows = [(k, "\n".join([text(1000 + k, 12), near[k], "", "Same line", text(2000 + k, 3)])) for k in range(25)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (53, "same line\n  SAME LINE \nown"), (54, "x"), (55, text(77, 9000))]
    for k in range(30):  # lines of 60 to 90 characters and a copy with one changed character
        x = text(4000 + k, 20)[: 60 + k]
        rows += [(100 + 2 * k, x), (101 + 2 * k, f"{x[:20]}#{x[21:]}")]
    flat = [(i, k, x.strip(" \t\n\x0b\x0c\r").translate(LOWER)) for i, t in rows for k, x in enumerate((t or "").split("\n"))]
    flat = [x for x in flat if x[2]]
    sets = {(i, k): {x[j : j + linedup.SHINGLE_CHARS] for j in range(max(1, len(x) - linedup.SHINGLE_CHARS + 1))} for i, k, x in flat}
    known = Union()
    for a in sets:
        known.find(a)
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                known.join(a, b)
    gone = collections.defaultdict(list)
    for i, k, _ in flat:
        if known.find((i, k)) != (i, k):
            gone[i].append(k)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows] + [(None, "Same line", 1)], "doc_id long, text string, removed int")
    for r in linedup.dedup_lines(df).collect():
        if r.doc_id is None:
            assert r.text == "Same line"
            continue
        t = dict(rows)[r.doc_id]
        assert list(r.removed) == gone[r.doc_id]
        assert r.text == (t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[r.doc_id]))
    assert linedup.dedup_lines(df.limit(0)).count() == 0


def test_passages(spark):
    rng = random.Random(8)
    shared, short = text(5, 60), text(6, 30)
    rows = [(k, text(100 + k, 90)) for k in range(10)]
    rows += [(20 + k, f"{text(300 + k, 40)} {shared} {text(400 + k, 40)}") for k in range(6)]
    rows += [(40 + k, f"{text(500 + k, 40)} {short} {text(600 + k, 40)}") for k in range(4)]
    rows += [(60, text(100, 90).upper()), (61, None), (62, ""), (63, "a " * 3000), (64, "b " * 40), (65, f"{text(700, 20)} {edited(text(5, 60), 0.02, rng)} x")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "id long, text string, mark int")
    got = {r.id: r for r in passages.repeated_passages(df).collect()}
    assert {20, 21, 22, 23, 24, 25, 0, 60} <= set(got) <= {20, 21, 22, 23, 24, 25, 0, 60, 65}
    assert {got[k].class_id for k in range(20, 26)} == {20} and got[60].class_id == got[0].class_id == 0
    for k in range(20, 26):
        assert got[k].spans[0].start <= 40 and got[k].spans[-1].end >= 100
    assert passages.repeated_passages(df.limit(0)).count() == 0


def test_edited_passages(spark):
    rng, rows = random.Random(9), []
    for k in range(120):
        words = text(9000 + k, (50, 55, 60)[k % 3]).split()
        changed = [w if j != (k // 3) % len(words) else f"changed{k}" for j, w in enumerate(words)]
        for side, own in enumerate((words, changed)):
            around = [" ".join(f"own{rng.randrange(10**9)}" for _ in range(rng.randrange(25, 60))) for _ in range(2)]
            rows.append((2 * k + side, f"{around[0]} {' '.join(own)} {around[1]}"))
    got = {r.id: r for r in passages.repeated_passages(spark.createDataFrame(rows, "id long, text string")).collect()}
    whole = [k for k in range(120) if 2 * k in got and 2 * k + 1 in got and got[2 * k].class_id == got[2 * k + 1].class_id == 2 * k]
    assert len(whole) >= 110


def test_second_passage_of_linked_texts(spark):
    rng, rows, places = random.Random(10), [], {}
    license_words = text(70, 60)

    def own(n: int) -> str:
        return " ".join(f"own{rng.randrange(10**9)}" for _ in range(n))

    for p in range(4):
        words = text(7100 + p, 60).split()
        for k in range(2):  # the license links all texts, a second passage these two alone
            places[1000 * p + k] = 130 + k
            rows.append((1000 * p + k, f"{license_words} {own(70 + k)} {' '.join(words)} {own(30)}"))
        for k in range(60):  # others have parts of it, too short for a passage, with the same signatures
            rows.append((1000 * p + 10 + k, f"{license_words} {own(60)} {' '.join(words[k % 3 * 11 :][:38])} {own(60)}"))
    got = {r.id: r for r in passages.repeated_passages(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert len(got) == len(rows) and {r.class_id for r in got.values()} == {0}
    for i, at in places.items():
        assert any(s.start <= at and at + 60 <= s.end for s in got[i].spans)


def test_link_between_covered_windows(spark):
    """Two windows that passages with other texts cover may still hold the only link between two classes."""
    window = "band long, node long, k int, l int, c int, r int, leader long, l2 int, c2 int, r2 int"
    groups = spark.createDataFrame([(9, n, 0, 0, 50, 99, 1, 0, 50, 99) for n in (2, 3)], window)
    cand = "array<struct<band:bigint,k:int,l:int,c:int,r:int,l2:int,c2:int,r2:int>>"
    rest = spark.createDataFrame([(n, 1, [(9, 0, 0, 50, 99, 0, 50, 99)]) for n in (2, 3)], f"a long, b long, rest {cand}")
    found = lambda rows: spark.createDataFrame([(a, b, [(20, 90)], [(20, 90)]) for a, b in rows], "a long, b long, spans_a array<struct<start:int,end:int>>, spans_b array<struct<start:int,end:int>>")
    members = passages._around_missed(groups, [rest], found([(2, 4), (3, 5)]))
    assert {(r.node, r.open, r.comp) for r in members.collect()} == {(1, False, 1), (2, False, 2), (3, False, 3)}
    assert passages._around_missed(groups, [rest], found([(2, 4), (3, 5), (2, 3), (1, 2)])).count() == 0  # linked and covered
    near, other = list(range(91)), list(range(1000, 1091))
    other[45] = 45
    rows = [(9, n, 50, 45, x, False, n, 0, 0) for n, x in ((1, other), (2, near), (3, near))]
    table = spark.createDataFrame(rows, "band long, node long, c int, at int, near array<int>, open boolean, comp long, own int, unit long")
    got = table.coalesce(1).mapInArrow(passages._compare_units, f"a long, b long, spans_a {passages._SPANS}, spans_b {passages._SPANS}").collect()
    assert [(r.a, r.b) for r in got] == [(2, 3)]


def test_window_beside_a_passage_meets_other_texts():
    """A collision near a passage of its two texts, but outside it, is left over for other partners."""
    import pyarrow as pa

    x, y = list(range(200)), [*range(100), *range(5000, 5045), 145, *range(5046, 5100)]
    w = lambda l, c, r: {"band": c, "k": 0, "l": l, "c": c, "r": r, "l2": l, "c2": c, "r2": r}  # noqa: E731, E741
    kind = pa.list_(pa.struct([("band", pa.int64()), *[(f, pa.int32()) for f in ("k", "l", "c", "r", "l2", "c2", "r2")]]))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1], pa.int64()), pa.array([2], pa.int64()), pa.array([x], pa.list_(pa.int32())), pa.array([y], pa.list_(pa.int32())), pa.array([[w(0, 50, 199)]], kind), pa.array([[w(101, 145, 199)]], kind)],
        ["a", "b", "x", "y", "good", "rest"],
    )
    (got,) = passages._verify([batch])
    assert got.column("spans_a").to_pylist()[0] and [v["c"] for v in got.column("rest").to_pylist()[0]] == [145]
