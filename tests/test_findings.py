"""Each rule of the gates, broken alone."""

import copy
import json

import pytest
from pyspark.sql import functions as F

from foliant.operators import findings


def rules(df, full=False):
    return sorted((r.subject, r.rule, r.severity, r.detail) if full else (r.rule, r.severity) for r in df.collect())


def test_output(spark):
    rows = [(1, "article/1.html", "2026-05-01", "s"), (2, "article/2.html", "2026-5-1", "s"), (3, None, "2026-02-30", "s"), (4, "article/1.html", " ", " \n"), (5, "article/1.html", None, None)]
    files = spark.createDataFrame([("article/1.html",), ("article/2.html",), ("article/1.html",)], "name string")
    df = findings.output_findings(spark.createDataFrame(rows, "id long, article_path string, date string, summary string"), files)
    want = [("2", "malformed_date", "error", "2026-5-1"), ("3", "malformed_date", "error", "2026-02-30"), ("3", "missing_page", "error", ""), ("4", "blank_date", "warning", None), ("4", "blank_summary", "error", None), ("5", "blank_date", "warning", None), ("5", "blank_summary", "error", None)]
    assert rules(df, True) == want
    told = {r.rule: (r.n, r.subjects) for r in findings.summary(df, sample=1).collect()}
    assert told == {"malformed_date": (2, ["2"]), "missing_page": (1, ["3"]), "blank_date": (2, ["4"]), "blank_summary": (2, ["4"])}
    with pytest.raises(findings.Refused, match=r"blank_summary \(2\), malformed_date \(2\), missing_page \(1\)"):
        findings.passed(df)
    assert findings.passed(df.filter("severity = 'warning'")).count() == 2


EDITION = {
    "date": "2026-05-09", "week_ending": "2026-05-09", "week_start": "2026-05-03", "title": "T", "dek": "D", "n_articles": 2, "n_significant": 1, "edition_type": "weekly", "opening_note": "note", "issue_number": 4,
    "source_trail": [{"title": "a", "url": "u", "source": "s", "date": "2026-05-04", "is_significant": True}, {"title": "b", "url": "v", "source": "s", "date": "2026-05-09"}],
}


def edition(**change):
    made = copy.deepcopy(EDITION)
    for k, v in change.items():
        if v is ...:
            made.pop(k)
        else:
            made[k] = v
    return made


@pytest.mark.parametrize(
    "made, want",
    [
        (edition(), []),
        (edition(n_articles=0, n_significant=0, source_trail=[]), [("missing_field", "error")]),
        (edition(title=..., dek=" "), [("missing_field", "error")]),
        (edition(date="2026-05-10"), [("date_is_not_week_ending", "error"), ("name_is_not_date", "error")]),
        (edition(week_start="2026-05-04"), [("span", "error")]),
        (edition(week_start="2026-05-04", edition_label="Pilot edition"), [("span", "warning")]),
        (edition(week_start="2026-05-32"), [("malformed_week", "error"), ("trail_outside_week", "warning"), ("trail_outside_week", "warning")]),
        (edition(n_significant=3), [("flagged_beyond_articles", "error")]),
        (edition(n_articles=1), [("trail_beyond_articles", "error")]),
        (edition(source_trail=[{"title": "a", "url": "", "date": "2026-05-04", "is_significant": True}]), [("trail_entry", "error")]),
        (edition(source_trail=[{"title": "a", "url": "u", "source": "s"}]), [("trail_without_flag", "warning"), ("undated_trail", "warning")]),
        (edition(source_trail=[{"title": "a", "url": "u", "source": "s", "date": "2026-05-11", "is_significant": True}]), [("trail_outside_week", "warning")]),
        (edition(opening_note=" "), [("no_body", "error")]),
        (edition(issue_number=...), [("no_issue", "warning")]),
        ("{broken", [("no_parse", "error")]),
    ],
)
def test_editions(spark, made, want):
    text = made if isinstance(made, str) else json.dumps(made)
    files = spark.createDataFrame([("posts/2026-05-09.html",)], "name string")
    assert rules(findings.edition_findings(spark.createDataFrame([("posts/2026-05-09.json", text)], "name string, text string"), files)) == want


def test_editions_among_one_another(spark):
    def one(day, issue):
        return (f"2026-05-{day:02d}.json", json.dumps(edition(date=f"2026-05-{day:02d}", week_ending=f"2026-05-{day:02d}", week_start=f"2026-05-{day - 6:02d}", issue_number=issue, source_trail=[EDITION["source_trail"][0] | {"date": f"2026-05-{day:02d}"}])))

    files = spark.createDataFrame([("2026-05-09.html",), ("2026-05-16.html",), ("2026-05-30.html",)], "name string")
    df = spark.createDataFrame([one(9, 2), one(16, 1), one(23, 2)], "name string, text string")
    assert rules(findings.edition_findings(df, files), True) == [
        ("2026-05-09.json", "repeated_issue", "error", "2"),
        ("2026-05-16.json", "issue_order", "error", "1 after 2"),
        ("2026-05-23.json", "no_page", "error", None),
        ("2026-05-30.html", "no_sidecar", "error", None),
    ]


def test_pictures(spark):
    manifest = spark.createDataFrame(
        [("p1", "p1.jpg", "http://credit/1", "veil", ["home", "pw-post"], None), ("p2", "p2.jpg", None, "dither", ["article"], ["http://x/2"]), ("p3", None, "http://credit/3", None, [], []), ("src-2026-05-09", None, "http://cited/", None, None, None)],
        "id string, file string, source_page string, treatment string, routes array<string>, article_urls array<string>",
    )
    good = '<div data-editorial-id="p1" aria-label="x"></div><a href="http://credit/1">not Evidence</a><img src="../assets/editorial/p1.jpg"><i style="background:url(assets/editorial/derivatives/none.jpg)">'
    pages = [
        ("index.html", good.replace("../", "")),
        ("a/b.html", '<b data-editorial-id="p9" aria-label="x">'),
        ("article/2.html", '<b data-editorial-id="p2" aria-label=""> http://y/ <img src="../assets/editorial/p1.jpg">'),
        ("article/3.html", '<b data-editorial-id="p2" aria-label="y"> http://x/2 not evidence <div class="lead-figure">'),
        ("posts/c.html", '<b data-editorial-id="src-2026-05-09" aria-label="x"> not evidence'),
        ("plain.html", "nothing"),
    ]
    files = spark.createDataFrame([(n,) for n in ("assets/editorial/p1.jpg", "assets/editorial/derivatives/p1-duo-paper.jpg", "assets/editorial/derivatives/p2-dither-ink.png")], "name string")
    got = rules(findings.image_findings(spark.createDataFrame(pages, "name string, text string"), manifest, files), True)
    assert got == sorted([
        ("index.html", "asset_missing", "error", "assets/editorial/derivatives/none.jpg"),
        ("a/b.html", "unknown_picture", "error", "p9"),
        ("article/2.html", "no_aria_label", "error", "p2"), ("article/2.html", "no_context", "error", "p2"), ("article/2.html", "no_article_url", "error", "p2"),
        ("article/3.html", "retired_pattern", "error", 'class="lead-figure"'),
        ("posts/c.html", "no_credit", "error", "src-2026-05-09"),
        ("p1", "derivative_missing", "error", "assets/editorial/derivatives/p1-duo-navy.jpg"),
        ("p2", "file_missing", "error", "assets/editorial/p2.jpg"),
        ("src-2026-05-09", "derivative_missing", "error", "media/2026-05-09-veil.jpg"),
    ])


def test_currency(spark):
    core = findings.CORE_TABLES
    ledger = lambda *v: spark.createDataFrame([(x,) for x in v], "version string")
    cases = [(core[1:], ledger("1"), "structurally_incompatible", ["2"]), (core, None, "ledger_absent", ["1", "2"]), (core, ledger(), "ledger_absent", ["1", "2"]), (core, ledger("1", "9"), "partially_applied", ["2"]), (core, ledger("1", "2", "2"), "fully_current", [])]
    for tables, applied, state, missing in cases:
        assert tuple(findings.currency(spark, tables, applied, ["1", "2"]).first()) == (state, missing)


def manifest(desk="d", **change):
    made = {
        "desk": {"desk_id": desk, "display_name": "D", "jurisdiction_code": "X", "default_timezone": "UTC", "public_status": "public", "supported_language_tags": ["en", "zh-Hans"]},
        "institutions": [{"institution_id": "i1", "display_name": "I", "institution_type": "other"}, {"institution_id": "i2", "display_name": "J", "institution_type": "other", "parent_institution_id": "i1"}],
        "sources": [{"slug": f"s-{desk}", "institution_id": "i1", "display_name": "S", "base_url": "u", "language_tag": "en", "access_method": "rss", "authority_tier": "B", "source_type": "news", "originality": "original", "expected_cadence_days": 2}],
    }
    for path, value in change.items():
        *heads, last = path.split("__")
        at = made
        for h in heads:
            at = at[int(h)] if h.isdigit() else at[h]
        if value is ...:
            at.pop(last)
        elif last == "more":
            at.append(value)
        else:
            at[last] = value
    return json.dumps(made)


MANIFESTS = [
    ({}, []),
    ({"desk__public_status": "open"}, [("m:desk", "not_permitted", "public_status=open")]),
    ({"desk__display_name": " "}, [("m:desk", "missing_field", "display_name")]),
    ({"desk__supported_language_tags": []}, [("m:desk", "missing_field", "supported_language_tags"), ("m:sources[0]", "undeclared_language", "en")]),
    ({"desk__supported_language_tags": ["en", "zh_CN"]}, [("m:desk", "language_tag", "zh_CN")]),
    ({"institutions__0__institution_type": "army"}, [("m:institutions[0]", "not_permitted", "institution_type=army")]),
    ({"institutions__1__parent_institution_id": "i9"}, [("m:institutions[1]", "unknown_parent", "i9")]),
    ({"institutions__1__institution_id": "i1"}, [("m:institutions[1]", "repeated_institution", "i1")]),
    ({"sources__0__institution_id": "i9"}, [("m:sources[0]", "unknown_institution", "i9")]),
    ({"sources__0__base_url": ...}, [("m:sources[0]", "missing_field", "base_url")]),
    ({"sources__0__authority_tier": "E"}, [("m:sources[0]", "not_permitted", "authority_tier=E")]),
    ({"sources__0__language_tag": "fr"}, [("m:sources[0]", "undeclared_language", "fr")]),
    ({"sources__0__language_tag": "chinese"}, [("m:sources[0]", "language_tag", "chinese")]),
    ({"sources__0__expected_cadence_days": 0}, [("m:sources[0]", "cadence", None)]),
    ({"sources__0__expected_cadence_days": "often"}, [("m:sources[0]", "cadence", None)]),
    ({"sources__0__expected_cadence_days": None}, []),
    ({"sources__0__listing_endpoints": "u"}, [("m:sources[0]", "not_a_list", "listing_endpoints")]),
]


def test_manifests(spark):
    """One change to each of many manifests, all judged at once."""
    df = spark.createDataFrame([(f"m{k}", manifest(f"d{k}", **change)) for k, (change, _) in enumerate(MANIFESTS)], "name string, text string")
    got = {}
    for r in findings.manifest_findings(df).collect():
        name, _, rest = r.subject.partition(":")
        got.setdefault(name, []).append((f"m:{rest}", r.rule, r.detail))
    for k, (change, want) in enumerate(MANIFESTS):
        assert sorted(got.get(f"m{k}", []), key=lambda x: x[:2]) == sorted(want, key=lambda x: x[:2]), change


def test_manifests_among_one_another(spark):
    df = spark.createDataFrame([("a", manifest("d")), ("b", manifest("d")), ("c", "{"), ("d", "[]"), ("e", None)], "name string, text string")
    got = findings.manifest_findings(df).collect()
    assert sorted((r.subject, r.rule) for r in got) == [("b:desk", "repeated_desk"), ("b:sources[0]", "repeated_slug"), ("c", "no_parse"), ("d", "no_parse"), ("e", "no_parse")]


def test_spend(spark):
    prices = spark.createDataFrame([("small", 1.0, 5.0), ("large", 3.0, 15.0)], "model string, input double, output double")
    stages = spark.createDataFrame([("screen", 1_000_001, "small", 0.1), ("translate", 500_000, "large", 1.3)], "label string, input_chars long, model string, output_ratio double")
    est = findings.spend(stages, prices)
    rows = {r.label: r for r in est.collect()}
    assert (rows["screen"].input_tokens, rows["screen"].output_tokens, rows["translate"].output_tokens) == (1_000_001, 100_000, 650_000)
    assert rows["translate"].total_usd == pytest.approx(1.5 + 9.75)
    assert findings.affordable(est, True, 5.0) == pytest.approx(11.25 + 1.000001 + 0.5000005)
    with pytest.raises(findings.Refused):
        findings.affordable(est, False, 5.0)
    assert findings.affordable(est.limit(0), False, 5.0) == 0.0
    with pytest.raises(Exception, match="no price on file for other"):
        findings.affordable(findings.spend(stages.withColumn("model", F.lit("other")), prices), True, 1.0)
