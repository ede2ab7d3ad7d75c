import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_pipeline_keeps_the_columns_and_drops_what_it_should(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = []
    for name, stage in p.STAGES:
        docs = stage(spark, docs, SF).cache()
        sizes.append(docs.count())
        if name != "pieces":
            assert docs.columns == p.COLUMNS
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 100
    assert docs.filter("not exact").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_stages_on_odd_rows(spark):
    import corpus_pipeline as p
    from tests.llm.test_text_operators import text

    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    plain, other = text(1, 60), text(2, 4000)
    rows = [(1, plain), (1, plain), (2, plain), (3, None), (4, ""), (5, " \n "), (6, f"{other}\n{item}"), (7, f"{text(3, 40)}\n{text(3, 40)}"), (None, plain), (8, "€ — … 123")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t), "old") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, removed string")
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=str)
    stages = dict(p.STAGES)
    assert ids(stages["language_id"](spark, docs, SF)) == sorted([1, 1, 2, 6, 7, None], key=str)
    lines = stages["line_dedup"](spark, docs, SF)
    assert lines.columns == p.COLUMNS and ids(lines) == sorted([1, 1, 3, 4, 5, 6, 7, None, 8], key=str)
    assert {r.doc_id: r.n_chars for r in lines.collect()}[7] == len(text(3, 40))
    assert ids(stages["near_dedup"](spark, docs, SF)) == sorted([1, 1, 3, 4, 5, 6, 7, None, 8], key=str)
    assert ids(stages["decontamination"](spark, docs, SF)) == sorted([1, 1, 2, 3, 4, 5, 7, None, 8], key=str)
    encoded = stages["pieces"](spark, docs, SF)
    assert ids(encoded) == ids(docs) and {r.n_pieces for r in encoded.filter("doc_id in (3, 4)").collect()} == {0}
    for name, stage in p.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
