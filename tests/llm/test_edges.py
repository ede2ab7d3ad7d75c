"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns of the operators that work row by row."""

import os

import pyarrow as pa
import pytest

from foliant.llm import decontam, html, langid, pieces, quality, secrets, toxicity
from tests.llm.test_text_operators import text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LONG = text(31, 30000)
ROWS = [(1, "The first text of a few plain words."), (1, "The first text of a few plain words."), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (None, "a row without an id"), (6, "€ — … 🙂 123")]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with columns that have the names of results."""
    names = ["lang_pred", "score", "ids", "n_pieces", "n_best", "scores", "exact", "p_toxic", "toxic", "base", "found", "spans", "n_words", "kept", "item", "end_word", "n_chars"]
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", *[f"'old' as {n}" for n in names])


def by_id(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append(r)
    assert {k: len(v) for k, v in out.items()} == {1: 2, 2: 1, 3: 1, 4: 1, 5: 1, None: 1, 6: 1}
    assert out[1][0] == out[1][1]
    return {k: v[0] for k, v in out.items()}


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary here")
def test_pieces(docs):
    got = by_id(pieces.encode(docs, MODEL, ["doc_id"]).collect())
    assert got[2].ids == got[3].ids == [] and got[2].scores == got[3].scores == [] and got[2].exact
    assert got[5].n_pieces == len(got[5].ids) > 30000 and all(r.exact for r in got.values())
    assert all(x >= y for r in got.values() for x, y in zip(r.scores, r.scores[1:]))
    empty = pieces.encode(docs.limit(0), MODEL, ["doc_id"])
    assert empty.count() == 0 and pieces.decode(empty, MODEL, ["doc_id"]).count() == 0


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary here")
def test_pieces_of_many_rows_and_a_small_memory(monkeypatch):
    """Segmentations that a worker forgets and makes again are the same."""
    v = pieces.Vocabulary.load(MODEL)
    rows = [text(k, 40) + f" é{k}x" for k in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(rows)], ["text"])
    many = pa.Table.from_batches(pieces._encode(v, 4, iter([batch]))).to_pylist()
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    again = pa.Table.from_batches(pieces._encode(pieces.Vocabulary.load(MODEL), 4, iter([batch]))).to_pylist()
    assert many == again and all(r["exact"] and len(r["n_best"]) == 4 and r["n_best"][0] == r["ids"] for r in many)
    assert [v.decode(r["ids"]) for r in many] == rows and all(r["n_pieces"] == len(r["ids"]) for r in many)


def test_languages(spark, docs):
    learned = spark.createDataFrame([("the plain words of the first text", "en"), ("die einfachen Wörter des ersten Textes", "de"), (None, "fr"), ("x", None)], "text string, lang string")
    model = langid.train(learned)
    got = by_id(langid.predict(docs, model, ["doc_id"]).collect())
    assert model.langs == ["de", "en"] and got[1].lang_pred == "en"
    assert [got[k].lang_pred for k in (2, 3, 4, 6)] == ["und"] * 4 and got[5].lang_pred in model.langs
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(docs.limit(0), model, ["doc_id"]).count() == 0
    none = langid.train(learned.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, none, ["doc_id"]).collect()} == {"und"}


def test_toxicity(spark, docs):
    learned = spark.createDataFrame([(k, text(k, 20) + (" idiot clown" if k % 3 == 0 else "")) for k in range(90)], "id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(90)], "id long, quality int, toxic int")
    got = by_id(toxicity.score(docs, toxicity.train(learned, labels), ["doc_id"]).collect())
    assert got[2].p_toxic == got[3].p_toxic and not any(r.toxic for r in got.values())
    assert toxicity.score(docs.limit(0), toxicity.train(learned.limit(0), labels), ["doc_id"]).count() == 0


def test_quality(docs):
    got = by_id(quality.quality_rules(docs).collect())
    assert got[2].n_words == got[3].n_words == got[4].n_words == 0 and got[2].base_failed and not got[2].kept
    assert got[5].n_words == 30000 and got[5].word_chars == sum(map(len, LONG.split()))
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_secrets(spark, docs):
    late = spark.createDataFrame([(7, LONG + " password=abcdefgh1234")], "doc_id long, text string")
    rows = docs.unionByName(late.selectExpr("doc_id", "text", *[f"'old' as {c}" for c in docs.columns[2:]]))
    got = {r.doc_id: r for r in secrets.digest(secrets.findings(rows, secrets.update_ledger(rows))).collect()}
    assert len(got) == 8 and got[7].n_assign == 1 and got[7].spans == f"assign:{len(LONG) + 1}:{len(LONG) + 22}"
    assert {got[k].spans for k in (1, 2, 3, 4, 5, None)} == {""}
    empty = docs.limit(0)
    assert secrets.digest(secrets.findings(empty, secrets.update_ledger(empty))).count() == 0


def test_leaks(spark, docs):
    item, short = text(61, 25), "seven rather odd little words stand here"
    items = spark.createDataFrame([(1, item), (2, short), (3, "two words"), (4, None), (5, ""), (1, item)], "item long, text string")
    rows = [(10, f"{LONG} {item} {LONG}"), (11, f"before {short.upper()}, after"), (11, f"before {short.upper()}, after"), (12, "two words"), (13, short.replace("odd", "even")), (14, None)]
    df = spark.createDataFrame(rows, "id long, text string").selectExpr("*", "'old' as score", "'old' as item")
    got = decontam.leaks(df, items).collect()
    assert sorted({(r.id, r.item) for r in got}) == [(10, 1), (11, 2)] and sum(r.id == 11 for r in got) == 2
    assert decontam.leaks(df.limit(0), items).count() == 0 and decontam.leaks(df, items.limit(0)).count() == 0


def test_pages(spark):
    page = f"<article><h1>Head</h1><p>{LONG}</p><p>tail of the page</p></article>"
    df = spark.createDataFrame([(1, page, "old"), (1, page, "old"), (2, None, "old"), (None, "", "old")], "page_id long, html string, text string")
    got = html.extract(df, ["page_id"]).collect()
    assert [r.text for r in got if r.page_id == 1] == [f"Head\n{LONG}\ntail of the page"] * 2
    assert [(r.text, r.n_chars) for r in got if r.page_id != 1] == [("", 0)] * 2


def test_columns_named_like_work_columns(spark):
    """Whatever the other columns are called, they come back as they were."""
    from pyspark.sql import functions as F

    from foliant.llm import linedup, shared

    line = "one line of text that stands in two of the documents here"
    df = spark.createDataFrame([(1, line), (2, f"{line}\nand more"), (3, None)], "doc_id long, text string")
    odd = ["_id", "_touched", "_bucket", "_bits", "__id", "id", "line", "node", "_text", "_n", "_n_words", "_words", "_lines", "_wins", "_order", "_same", "_places", "_row", "_t"]
    df = df.select("*", *[F.lit(f"old {c}").alias(c) for c in odd])
    got = {r.doc_id: r for r in linedup.dedup_lines(df).collect()}
    assert [got[k].removed for k in (1, 2, 3)] == [[], [0], []] and got[2].text == "and more"
    assert all(r[c] == f"old {c}" for r in got.values() for c in odd)
    ids = spark.createDataFrame([(2,)], "doc_id long")
    assert {r.doc_id for r in shared.possible_ids(df, "doc_id", ids).collect()} >= {2}
    rows = quality.quality_rules(df).collect()
    assert all(r[c] == f"old {c}" for r in rows for c in odd) and sorted(r.n_words for r in rows) == [0, 12, 14]
