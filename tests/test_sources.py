"""Sources on small files."""

import pytest
from pyspark.errors import ParseException
from pyspark.sql import functions as F

from vellumspark.operators import extract as ex
from vellumspark.operators import store as st
from vellumspark.sources import files


def test_scan_corpus(spark, tmp_path):
    for name, text in {"a.MD": "# T\nx", "b.htm": "<p>y</p>", "c.txt": "z", "d.pdf": "?"}.items():
        (tmp_path / name).write_text(text)
    good, rejects = files.scan_corpus(spark, str(tmp_path))
    assert {(r.format, r.text) for r in good.collect()} == {("markdown", "# T\nx"), ("html", "<p>y</p>"), ("text", "z")}
    assert [r.reason for r in rejects.collect()] == ["unsupported format: pdf"]


def test_read_records(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"id": 1, "t": "a"}\n{"id": "x"}\nnot json\n{"id": 2}\n')
    good, bad = files.read_records(spark, str(tmp_path), "id int, t string")
    assert sorted((r.id, r.t) for r in good.collect()) == [(1, "a"), (2, None)]
    assert sorted(r.raw for r in bad.collect()) == ["not json", '{"id": "x"}']


def test_scan_assets(spark, tmp_path):
    import hashlib

    (tmp_path / "fig-1.png").write_bytes(b"\x89PNG")
    row = files.scan_assets(spark, str(tmp_path)).first()
    digest = hashlib.sha256(b"\x89PNG").hexdigest()
    assert (row.sha256, row.image_id, row.local_uri) == (digest, "fig-1", f"local-asset://{digest}_fig-1.png")


def test_sql_reads_only(spark):
    import pytest

    files.register({"one": spark.range(1)})
    assert files.run_sql(spark, "SELECT id FROM one").first().json == '{"id":0}'
    with pytest.raises(ValueError):
        files.run_sql(spark, "DROP TABLE one")


def test_blobs_and_promotion(spark):
    df = spark.createDataFrame([(1, bytearray(b"abc")), (2, None)], "id int, raw binary")
    assert sorted(r.json for r in st.json_rows(df).collect()) == ['{"id":1,"raw":"<blob 3 bytes>"}', '{"id":2,"raw":null}']
    old = spark.createDataFrame([("a", "x", "keep")], "id string, name string, source string")
    new = spark.createDataFrame([("a", "y", "new"), ("b", "z", "new")], "id string, name string, source string")
    assert {tuple(r) for r in st.upsert(old, new, ["id"], ["name"]).collect()} == {("a", "y", "keep"), ("b", "z", "new")}
    twice = st.upsert(st.upsert(old, new, ["id"]), new, ["id"])
    assert {tuple(r) for r in twice.collect()} == {("a", "y", "new"), ("b", "z", "new")}


def test_to_sections(spark):
    blocks = spark.createDataFrame([("d", 0, "paragraph", "p"), ("d", 1, "heading", "H"), ("d", 2, "paragraph", "q")], "document_id string, sort_order int, block_type string, text string")
    sections, placed = ex.to_sections(blocks)
    assert {(r.id, r.title) for r in sections.collect()} == {("sec-d-0", "Default Section"), ("sec-d-1", "H")}
    assert [r.section_id for r in placed.orderBy("sort_order").select(F.col("section_id")).collect()] == ["sec-d-0", "sec-d-1", "sec-d-1"]


def test_ad_hoc_sql_runs_no_command(spark):
    spark.range(2).createOrReplaceTempView("two")
    assert files.run_sql(spark, "SELECT id FROM two; ").count() == 2
    assert files.run_sql(spark, "WITH x AS (SELECT 1 AS a) SELECT a FROM x").count() == 1
    for bad in ("WITH x AS (SELECT 1 AS a) INSERT INTO two SELECT * FROM x", "SELECT 1) ; DROP VIEW two; SELECT (2", "DROP VIEW two"):
        with pytest.raises((ValueError, ParseException)):
            files.run_sql(spark, bad)
