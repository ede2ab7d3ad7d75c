"""The methods against plain versions: recall of candidates, out-of-fold chains, filters, seeds."""

import random

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import decontam, langid, linedup, neardup, passages, toxicity
from foliant.llm.textops import shingle_hashes, word_hashes
from tests.llm.test_text_operators import text


def test_bands_of_lines_reach_their_recall():
    rng = random.Random(1)
    xs, ys = [], []
    for k in range(3000):
        x = text(4000 + k, 30)[: 50 + k % 40].strip()
        at = rng.randrange(5, len(x) - 5)
        xs.append(x)
        ys.append(f"{x[:at]}#{x[at + 1 :]}")
    def bands_of(lines):
        token, starts = linedup._sets_of(pa.array(lines))
        return linedup._bands(np.repeat(np.arange(len(lines)), np.diff(starts)), token, len(lines))

    bands = [bands_of(v) for v in (xs, ys)]
    found = (bands[0] == bands[1]).any(axis=1)
    cut = lambda t: {t[i : i + linedup.SHINGLE_CHARS] for i in range(len(t) - linedup.SHINGLE_CHARS + 1)}
    j = np.array([len(cut(x) & cut(y)) / len(cut(x) | cut(y)) for x, y in zip(xs, ys)])
    near = (j >= 0.75) & (j < 0.8)
    assert near.sum() > 500 and found[near].mean() >= 0.985 and found[j >= 0.8].mean() >= 0.995


def test_pairs_of_lines_are_exact():
    rng = random.Random(2)
    xs = ["".join(rng.choice("abc ") for _ in range(rng.randrange(1, 60))).strip() or "x" for _ in range(400)]
    ys = [x if rng.random() < 0.3 else x[: len(x) // 2] + x[len(x) // 2 + 1 :] or "y" for x in xs]
    n = linedup.SHINGLE_CHARS
    cut = lambda t: {t[i : i + n] for i in range(max(1, len(t) - n + 1))}
    want = [k for k, (x, y) in enumerate(zip(xs, ys)) if 100 * len(cut(x) & cut(y)) >= 75 * len(cut(x) | cut(y))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(range(400)), pa.array(xs), pa.array(ys)], ["a", "b", "x", "y"])
    assert [a for part in linedup._jaccard(iter([batch])) for a in part.column("a").to_pylist()] == want


def test_orders_of_documents_reach_their_recall():
    rng, pairs = np.random.default_rng(3), 2000
    common, own = 120, 18  # similarity 120 / 156 = 0.77
    sets = [[], []]
    for _ in range(pairs):
        both = rng.integers(0, 2**64, common, np.uint64)
        for side in sets:
            side.append(np.concatenate([both, rng.integers(0, 2**64, own, np.uint64)]))
    heads = np.arange(pairs + 1) * (common + own)
    signs = [neardup.min_hashes(np.concatenate(s), heads) for s in sets]
    same = (signs[0][:, neardup.ORDER[:, : neardup.LEAST_DEPTH]] == signs[1][:, neardup.ORDER[:, : neardup.LEAST_DEPTH]]).all(axis=2).any(axis=1)
    assert same.mean() >= 0.9995


def test_forest_regions_against_prefixes():
    """Every pair with a common prefix of LEAST_DEPTH is joined by the rows of its region, batch borders included."""
    rng = np.random.default_rng(4)
    rows = []
    for t in range(2):
        keys = rng.integers(0, 2, (900, neardup.MOST_DEPTH)).astype(">u4")
        order = sorted(range(900), key=lambda k: (keys[k].tobytes(), k))
        rows += [(t, keys[k].tobytes(), k) for k in order]
    table = pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.binary(), pa.int64()))], names=["tree", "key", "id"])
    got = pa.Table.from_batches(neardup._forest(iter(table.to_batches(max_chunksize=310)))).to_pylist()
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for r in got:
        if r["depth"] == neardup.LEAST_DEPTH:
            a, b, c = find((r["band"], r["node"])), find((r["band"], r["leader"])), find(r["band"])
            root[a] = c
            root[find(b)] = find(c)
    regions = {}
    for t, key, k in rows:
        regions.setdefault((t, key[: 4 * neardup.LEAST_DEPTH]), []).append(k)
    members = {}
    for r in got:
        if r["depth"] == neardup.LEAST_DEPTH:
            members.setdefault(r["band"], set()).update((r["node"], r["leader"]))
    large = sorted(sorted(v) for v in regions.values() if len(v) > 1)
    assert large == sorted(sorted(v) for v in members.values() if len(v) > 1)
    assert max(r["depth"] for r in got) > neardup.LEAST_DEPTH  # crowded regions descend


def test_compact_windows_against_all_ranges():
    rng = np.random.default_rng(5)
    x = rng.integers(1, 10**6, 300).astype(np.uint32)
    at = passages.wide_nodes(x, np.array([0, 300]))
    got = {(left, c, right) for _, left, c, right in passages.compact_windows(x[at].tolist(), at.tolist(), [(0, len(at), 0, 300)])}
    want = set()
    for a in range(300 - passages.WIDTH + 1):
        c = a + int(x[a : a + passages.WIDTH].argmin())
        left, right = c, c
        while left > 0 and x[left - 1] > x[c]:
            left -= 1
        while right < 299 and x[right + 1] > x[c]:
            right += 1
        want.add((left, c, right))
    assert got == want


@pytest.mark.parametrize("n,changed,least", [(50, 1, 0.93), (60, 1, 0.95), (80, 2, 0.93), (120, 3, 0.95)])
def test_collisions_of_passages_agree(n, changed, least):
    """Share of edited passages, set in other text, of which two signatures agree over the passage's width."""
    rng, found = random.Random(n), 0
    own = lambda k: " ".join(f"own{rng.randrange(10**9)}" for _ in range(k))
    for _ in range(150):
        words = own(n).split()
        other = words[:]
        for k in rng.sample(range(n), changed):
            other[k] = f"new{rng.randrange(10**9)}"
        sides = []
        for part in (words, other):
            data = f"{own(30)} {' '.join(part)} {own(30)}".encode()
            sides.append(passages._text_windows(np.frombuffer(data, np.uint8), np.array([0, len(data)])))
        (_, key, k, l, _, r), (_, key2, _, l2, _, r2) = sides
        i, j = np.nonzero(key[:, None] == key2[None, :])
        found += bool(len(i)) and bool(passages.agreeing(k[i], l[i], r[i], l2[j], r2[j]).any())
    assert found >= least * 150


def test_chain_is_trained_out_of_fold():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4)).astype(np.float32)
    first = (x[:, 0] + rng.normal(size=300) > 0).astype(float)
    second = (x[:, 1] + 2 * first + rng.normal(size=300) > 1).astype(float)
    folds = rng.integers(0, toxicity.FOLDS, 300)
    got = toxicity.fit_chain(x, np.array([first, second]), folds)
    held = np.zeros(300)
    for k in range(toxicity.FOLDS):
        held[folds == k] = toxicity.probability(toxicity.fit(x[folds != k], first[folds != k]), x[folds == k])
    assert np.allclose(got[0], toxicity.fit(x, first))
    assert np.allclose(got[1], toxicity.fit(np.hstack([x, toxicity._logit(held)]), second), atol=1e-5)


def test_filters_hold_every_chosen_ngram(spark):
    rows = [(text(k, 60), "a") for k in range(20)] + [(text(k, 60)[::-1], "b") for k in range(20)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = langid.train(docs)
    exact = {}
    for t, lang in rows:
        raw = t.encode()
        ids, _ = langid._grams(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        for g in ids.tolist():
            exact.setdefault(lang, {}).setdefault(g, 0)
            exact[lang][g] += 1
    share = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in exact.items()}
    for k, lang in enumerate(model.langs):
        chosen = [g for g, s in share[lang].items() if s >= langid.LEAST_SHARE and s >= langid.SHARE_OF_MOST * max(x.get(g, 0) for x in share.values())]
        a, b = model.slots(np.array(chosen))
        assert (model.masks[a, 0] & model.masks[b, 0] & np.uint64(1 << k)).all()
        other = np.random.default_rng(k).integers(0, 2**40, 200_000)
        a, b = model.slots(other)
        assert abs(((model.masks[a, 0] & model.masks[b, 0] >> np.uint64(k)) & np.uint64(1)).mean() - model.false_rate[k]) < 0.01


def test_leaks_against_all_pairs(spark):
    rng = random.Random(7)
    items = [(k, text(100 + k, rng.randrange(9, 40))) for k in range(8)]
    docs = []
    for k in range(60):
        words = items[k % 8][1].split()
        rate = (0, 0.1, 0.25, 0.5, 0.8)[k % 5]
        words = [w if rng.random() >= rate else f"new{rng.randrange(10**6)}" for w in words]
        docs.append((k, f"{text(500 + k, 30)} {' '.join(words)} {text(700 + k, 30)}"))

    def words_of(t):
        raw = t.encode()
        return word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), plain=True)[0]

    def seeds(w):
        return set(shingle_hashes(w, np.array([0, len(w)]), decontam.SEED_WORDS)[0].tolist())

    want = set()
    for i, t in docs:
        for item, s in items:
            a, b = words_of(s), words_of(t)
            if seeds(a) & seeds(b) and decontam.align(a, b)[0] >= max(decontam.LEAST_SCORE, decontam.LEAST_SHARE * len(a)):
                want.add((i, item))
    got = decontam.leaks(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(items, "item long, text string"))
    assert {(r.id, r.item) for r in got.collect()} == want and len(want) > 20



def _plain_words(t):
    raw = t.encode()
    return word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), plain=True)[0]


def test_leaks_of_items_that_share_an_opening(spark):
    """Hundreds of items begin alike: the result is that of all pairs that share a seed, copies found, openings alone not."""
    rng = random.Random(17)
    opening = "which of the following is true about"
    items = [(k, f"{opening} {text(9000 + k, rng.randrange(4, 30))}") for k in range(300)] + [(1000, "two words"), (1001, "")]
    docs = []
    for k in range(30):
        words = items[rng.randrange(300)][1].split()
        words = [w if k % 3 or rng.random() >= 0.2 else f"new{rng.randrange(10**6)}" for w in words]
        docs.append((k, f"{text(20000 + k, 40)} {opening} {text(21000 + k, 40)} {' '.join(words) if k % 2 else ''}"))
    hashed = {i: _plain_words(s) for i, s in items}
    seeds = {i: set(shingle_hashes(w, np.array([0, len(w)]), decontam.SEED_WORDS)[0].tolist()) if len(w) >= decontam.SEED_WORDS else set() for i, w in hashed.items()}
    want = set()
    for k, t in docs:
        b = _plain_words(t)
        own = set(shingle_hashes(b, np.array([0, len(b)]), decontam.SEED_WORDS)[0].tolist())
        want |= {(k, i) for i, a in hashed.items() if seeds[i] & own and decontam.align(a, b)[0] >= max(min(decontam.LEAST_SCORE, len(a)), decontam.LEAST_SHARE * len(a))}
    got = decontam.leaks(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(items, "item long, text string")).collect()
    assert {(r.id, r.item) for r in got} == want and len(want) >= 15 and len(got) == len(want)


def test_leaks_against_pairs_without_seeds():
    """Of edited copies that reach the score, seeds or not, those are found that keep three words in a row."""
    rng = random.Random(18)
    found = reached = 0
    for k in range(400):
        a = text(30000 + k, rng.randrange(15, 40)).split()
        rate = (0.1, 0.2, 0.3, 0.4)[k % 4]
        b = [w if rng.random() >= rate else f"new{rng.randrange(10**6)}" for w in a]
        x, y = _plain_words(" ".join(a)), _plain_words(" ".join(b))
        if decontam.align(x, y)[0] >= max(decontam.LEAST_SCORE, decontam.LEAST_SHARE * len(x)):
            reached += 1
            found += bool(set(shingle_hashes(x, np.array([0, len(x)]), 3)[0].tolist()) & set(shingle_hashes(y, np.array([0, len(y)]), 3)[0].tolist()))
    print(found, reached)
    assert reached > 200 and found >= 0.99 * reached


def test_lines_of_a_text_beyond_a_million():
    """Bands don't depend on how many lines stand before a line."""
    lines = [f"{k:07d}{'x' * (k % 9)}" for k in range(1_100_000)]
    codes, heads = linedup._code_points(np.frombuffer("\n".join(lines).encode(), np.uint8), np.array([0, sum(map(len, lines)) + len(lines) - 1]))
    _, number, starts, ends = linedup._lines(codes, heads)
    assert len(number) == len(lines) and number[-1] == len(lines) - 1
    keys = linedup._keys(linedup._folded(codes), starts, ends)
    assert len(keys) == len(lines)
    for k in (0, linedup.LINES - 1, linedup.LINES, (1 << 20) - 1, 1 << 20, len(lines) - 1):
        alone, at = linedup._code_points(np.frombuffer(lines[k].encode(), np.uint8), np.array([0, len(lines[k])]))
        assert (linedup._keys(linedup._folded(alone), at[:-1], at[1:])[0] == keys[k]).all()
    beyond = keys[1 << 20 :, 0]
    assert len(np.unique(beyond)) > len(beyond) // 2  # they share no band for being far down
