"""Drifting JSON, sections out of published pages and back, candidate pictures."""

import json
import random

from foliant.functions import variants as vx
from foliant.operators import sidecars
from foliant.sources.markup import trees
from pyspark.sql import functions as F


def walk(x, path="$"):
    if isinstance(x, dict):
        return [y for k in sorted(x, key=lambda k: k.encode()) for y in walk(x[k], f"{path}.{k}")]
    if isinstance(x, list):
        return [y for k, v in enumerate(x) for y in walk(v, f"{path}[{k}]")]
    return [(path, x)]


def test_walk_to_any_depth(spark):
    rng = random.Random(2)

    def made(depth):
        kind = rng.randrange(6) if depth else rng.randrange(2, 6)
        if kind == 0:
            return {rng.choice(["a", "b", "Z", "é", "x y"]) + str(k): made(depth - 1) for k in range(rng.randrange(4))}
        if kind == 1:
            return [made(depth - 1) for _ in range(rng.randrange(4))]
        return [None, True, rng.randrange(100), rng.choice(["", 'quo"te', "back\\slash", "{[", "数据"])][kind - 2]

    docs = [made(6) for _ in range(60)] + [json.loads("[" * 40 + '"deep"' + "]" * 40), {}, [], "only", "[{["]
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)] + [(-1, "no json {"), (-2, None), (-3, ""), (-4, "{} {"), (-5, "1],[2"), (-6, '1}, {"x":2'), (-7, "1, 2"), (-8, "[1] x")], "id int, t string")
    rows = {r.id: r for r in df.select("id", vx.strings(F.col("t")).alias("s"), F.transform(vx.leaves(F.col("t")), lambda x: x["path"]).alias("p")).collect()}
    for k, d in enumerate(docs):
        assert rows[k].p == [p for p, _ in walk(d)], d
        assert rows[k].s == [v for _, v in walk(d) if isinstance(v, str)], d
    assert all(rows[k].s is None for k in range(-8, 0))


def test_both_shapes_of_a_sidecar(spark):
    old = {
        "date": "2026-05-09", "week_start": "2026-05-03", "term_to_know": {"term": "战备", "term_translation": "readiness", "explanation": "e"}, "sources_seen": ["S1", "S2"],
        "source_trail": [{"label": "L", "url": "https://www.a.example/x", "is_significant": 1}, {"title": "T", "url": "u", "source": "S9", "date": "2026-05-04", "title_zh": "题"}, {"url": "https://www.b.example/y"}, {}],
    }
    new = {"date": "2026-08-08", "week_ending": "2026-08-08", "days_covered": "5", "term_to_know_term": "t", "term_to_know_explanation": "x", "articles": [{"title": "A", "url": "w", "source": None, "is_significant": True}], "source_trail": [{"label": "no"}]}
    half = {"term_to_know": {"term_translation": "only"}, "term_to_know_term": "flat", "week_start": "2026-02-30", "source_trail": None, "days_covered": 0}
    texts = [json.dumps(old), json.dumps(new), json.dumps(half), "[1]", "{broken", None, '{"term_to_know": "text", "term_to_know_term": "flat"}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").selectExpr("*", "'old' as term", "'x' as articles")
    r = sidecars.editions(df).orderBy("id").collect()
    trail = [("L", "", "https://www.a.example/x", "S1", "", True), ("T", "题", "u", "S9", "2026-05-04", False), ("b.example", "", "https://www.b.example/y", "S1", "", False), ("", "", "", "S1", "", False)]
    assert (r[0].date, r[0].term, r[0].explanation, r[0].days_covered, [tuple(a) for a in r[0].articles], r[0].corrupt) == ("2026-05-09", "战备 — readiness", "e", 7, trail, False)
    assert (r[1].term, r[1].explanation, r[1].days_covered, [tuple(a) for a in r[1].articles]) == ("t", "x", 5, [("A", "", "w", "", "", True)])
    assert (r[2].date, r[2].term, r[2].explanation, r[2].days_covered, r[2].articles) == ("", "only", "", 0, [])
    assert [x.corrupt for x in r] == [False, False, False, True, True, True, False] and r[6].term == "flat"
    assert all((x.term, x.days_covered, x.articles) == ("", None, []) for x in r[3:6])


def page(fields, signal=None, term=None):
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")
    out = ["<html><body>"]
    for heading, paragraphs in fields:
        out.append(f'<div class="mod"><div class="mod-heading brand">{heading}</div>\n<div class="section-text">' + "".join(f"<p>{esc(p)}</p>" for p in paragraphs) + "</div></div>")
    if term:
        out.append(f'<div class="term-word"> {term[0]} </div><div class="term-explanation">{term[1]}</div>')
    if signal:
        out.append(f'<div class="signal-text"><b>{esc(signal)}</b></div>')
    return "".join(out)


def test_sections_there_and_back(spark):
    rng = random.Random(8)
    cases, want = [], []
    names = [*sidecars.HEADINGS, "Opening Note ", "unknown heading"]
    for _ in range(40):
        fields = [(rng.choice(names), [rng.choice(["one & two", "a < b", "  ", "“quoted”"]) + rng.choice(["", " more"]) for _ in range(rng.randrange(4))]) for _ in range(rng.randrange(6))]
        expected = {}
        for heading, paragraphs in fields:
            text = "\n\n".join(p.strip() for p in paragraphs if p.strip())
            if (name := sidecars.HEADINGS.get(heading.strip().lower())) and text:
                expected[name] = text
        cases.append(page(fields, "sig" if rng.random() < 0.5 else None, ("词", "<p>p1</p><p>p2</p>") if rng.random() < 0.5 else None))
        if "signal-text" in cases[-1]:
            expected["signal"] = "sig"
        if "term-word" in cases[-1]:
            expected |= {"term_to_know_term": "词", "term_to_know_explanation": "p1\n\np2"}
        want.append(expected)
    cases += ['<div class="mod-heading">what stood out</div><span>x</span><div class="section-text"><p>far</p></div>', '<div class="term-explanation">plain <i>text</i></div>', "", None]
    want += [{}, {"term_to_know_explanation": "plain text"}, {}, {}]
    df = spark.createDataFrame([(k, "u", c) for k, c in enumerate(cases)], "id int, url string, html string")
    got = {r.id: r.fields for r in sidecars.sections(trees(df)).collect()}
    assert [got[k] for k in range(len(cases))] == want


def test_candidate_pictures(spark):
    full = {"url": "http://i/1.jpg", "mime": "image/jpeg", "width": 10, "extmetadata": {"LicenseShortName": {"value": "<b>CC BY</b>"}, "License": {"value": "cc"}, "Artist": {"value": "A &amp; B"}}, "descriptionurl": "http://d"}
    rows = [("a b", full), ("c", full | {"mime": "image/gif"}), ("d", full | {"url": ""}), ("e f", {"url": "u", "mime": "image/png", "width": None, "extmetadata": None}), ("g", None)]
    df = spark.createDataFrame([(t, json.dumps(d)) for t, d in rows], "title string, text string")
    got = sidecars.candidates(df).orderBy("title").collect()
    assert [tuple(r) for r in got] == [
        ("a b", "http://i/1.jpg", "image/jpeg", 10, 0, "CC BY", "A & B", "", "http://d"),
        ("e f", "u", "image/png", 0, 0, "Unknown", "", "", "https://commons.wikimedia.org/wiki/e_f"),
    ]
