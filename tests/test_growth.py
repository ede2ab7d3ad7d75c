"""Queries whose cost must grow no faster than their tables: work done once, in tasks of bounded size."""

import pyarrow as pa
from pyspark.sql import functions as F

from foliant.operators import findings, lineage, reconcile, records, sidecars, site
from foliant.sources import markup
from foliant.sources.snapshots import spread


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def stored(df, tmp_path, name):
    path = str(tmp_path / name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def test_narrow_rows_are_spread(spark):
    assert spread(spark.range(1000).coalesce(1), "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_trees_are_handed_on_in_bounded_batches():
    pages = [f"<p>{k}</p>" * 3000 for k in range(20)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(22)), pa.array(pages), pa.array(["u"] * 22)], ["c0", "html_", "url_"])
    got = list(markup._parse(["c0"], "nodes", iter([batch])))
    assert len(got) > 3 and [i for b in got for i in b.column("c0").to_pylist()] == list(range(22))
    for b in got:
        for i, tree in zip(b.column("c0").to_pylist(), b.column("nodes").to_pylist()):
            assert len(tree) == (6000 if i < 20 else 0) and all(n["text"] == str(i) for n in tree if n["tag"] == "#text")


def test_manifests_are_read_and_parsed_once(spark, tmp_path):
    rows = stored(spark.createDataFrame([("a", '{"desk": {"desk_id": "d"}}')], "name string, text string"), tmp_path, "manifests")
    text = plan(findings.manifest_findings(rows))
    assert text.count("Relation [name") == 1 and text.count("explode(array(") >= 1


def test_metadata_is_parsed_once(spark, tmp_path):
    rows = stored(spark.createDataFrame([("t", '{"url": "u", "mime": "image/png"}')], "title string, text string"), tmp_path, "media")
    got = sidecars.candidates(rows)
    assert plan(got).count('{"x":') == 1 and got.count() == 1


def test_summary_is_collapsed_once(spark):
    lint = records.summary_lint(F.col("t"), F.col("s"), ["this "], ["worth"])
    text = plan(spark.createDataFrame([("t", "This is worth. It.")], "t string, s string").select(lint.alias("x")))
    assert text.count("regexp_replace(coalesce(s") + text.count("regexp_replace(s") == 1


def test_merge_is_computed_once_for_its_gates(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", True, "s"), (2, "v", None, "s")], "id long, url string, passed_relevance boolean, source_slug string")
    merged = stored(df.withColumn("only_merged", F.lit(1)).unionByName(df.limit(1).withColumn("only_merged", F.lit(1)).withColumn("url", F.lit("w"))), tmp_path, "merged")
    got = reconcile.gates(df, df, df, merged)
    assert plan(got).count("Relation [") == 1
    counts = {r["name"]: r["violations"] for r in got.collect()}
    assert counts["duplicate_id"] == 1 and counts["duplicate_url"] == 0 and sum(counts.values()) == 1


def test_groups_are_dealt_before_they_are_sorted(spark):
    rows = spark.createDataFrame([(k, "p") for k in range(6)], "id long, p string")
    assert "RepartitionByExpression [id" in plan(lineage.explained(rows, rows, rows, rows, ["p"]))
    values = spark.createDataFrame([("g", "a", 2), ("g", "A", 1), ("g", "b", 3)], "g string, v string, position int")
    got = site.distinct_in_order(values, "g", "v")
    assert "RepartitionByExpression [xxhash64" in plan(got)
    assert [(r.v, r.position, r.place) for r in got.orderBy("place").collect()] == [("A", 1, 1), ("b", 3, 2)]


def test_sections_are_computed_once(spark):
    html = '<div><div class="mod-heading">What stood out</div><div class="section-text"><p>x</p></div></div>'
    rows = markup.trees(spark.createDataFrame([(1, "u", html)], "k int, url string, html string"))
    got = sidecars.sections(rows)
    assert plan(got).count("map_from_entries") == 1 and plan(got).count("opening note") == 1 and got.first()["fields"] == {"what_stood_out": "x"}
