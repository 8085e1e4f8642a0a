"""Ingest queries against their SQL; reports, settings and catalogue on disk."""

import pytest
from pyspark.sql import functions as F

from plumbline import report
from plumbline.operators import corpus, evidence
from plumbline.plans import analysis, catalogue
from plumbline.settings import Settings, SettingsError
from plumbline.sources import files, ingest


@pytest.mark.parametrize("name", ["ingest_documents", "ingest_errors", "ingest_validate", "catalogue_snapshot"])
def test_ingest_query_against_sql(spark, sf, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want, got = db.execute(catalogue.ORACLE[name]).df(), catalogue.QUERIES[name](spark, sf).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert len(got) and sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))


def test_reports_carry_lines_and_columns(spark, tmp_path):
    sentence = "The committee reviewed every submitted document carefully before publishing the final independent report"
    subs = corpus.prepare(spark.createDataFrame([(0, f"First line\nthen \U0001f600 here: {sentence}")], "k long, t string"), "k", "t", "D").withColumn("line_offset", F.lit(4))
    refs = corpus.prepare(spark.createDataFrame([(0, sentence)], "k long, t string"), "k", "t", "B")
    people = spark.createDataFrame([(0, "R1", "One", 1)], "pos int, id string, name string, capacity int")
    a = analysis.analyse(subs, refs, people, Settings(), 1, 1)
    rows = evidence.located(a.evidence, a.cases, subs, refs)
    found = {(r["type"], r["sub_from"], r["ref_from"]) for r in rows.collect()}
    assert ("EXACT", "line 6, column 14", "line 1, column 1") in found
    reports = report.case_reports(a.cases, rows, a.assigned, 0.3)
    text = report.preview(reports, "PD-1-D0-B0").first()["report"]
    assert "Submission location: line 6, column 14 to line 6" in text and "Reviewer: R1 — One" in text and "GRAPH\n  An edge" in text and "not a verdict" in text
    lines = report.summary_lines(a.cases, a.assigned, 0.3)
    run = report.export_run(reports, lines, report.batch_header(a.stats, "gated", 0.5, 1), str(tmp_path / "reports"))
    again = report.export_run(reports, lines, "x", str(tmp_path / "reports"))
    assert run != again and "/run-" in run and not [p for p in (tmp_path / "reports").iterdir() if p.name.startswith(".writing")]
    stored = spark.read.parquet(f"{run}/reports").first()
    assert stored["report"] == text
    assert "Candidates: 1\nReduction: 0.00%\nMode: gated\nElapsed: 500.000 ms\nCases: 1" in files.read_report(spark, str(tmp_path), f"{run}/analysis-summary.txt")
    path = str(tmp_path / "assigned")
    for _ in range(2):
        report.write_assignments(a.assigned, path)
    assert spark.read.option("header", True).csv(path).first()["reviewerName"] == "One"


def test_report_files_and_archives(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.txt").write_text("the report — whole")
    (tmp_path / "deep" / "b.bin").write_text("no report")
    packed = files.compress_report(spark, str(tmp_path / "a.txt"), str(tmp_path / "deep" / "a.txt.huff"))
    assert files.read_report(spark, str(tmp_path), packed) == "the report — whole"
    assert open(files.decompress_report(spark, packed)).read() == "the report — whole"
    assert [r["path"].rsplit("/", 1)[1] for r in files.report_files(spark, str(tmp_path)).collect()][-1:] == ["a.txt"] and files.report_files(spark, str(tmp_path)).count() == 3
    with pytest.raises(ValueError):
        files.read_report(spark, str(tmp_path / "deep"), str(tmp_path / "a.txt"))
    with pytest.raises(ValueError):
        files.read_report(spark, str(tmp_path / "deep"), str(tmp_path / "deep" / ".." / "a.txt"))
    with pytest.raises(ValueError):
        files.decompress_report(spark, str(tmp_path / "a.txt"))
    with pytest.raises(ValueError):
        files.read_bytes(spark, str(tmp_path / "a.txt"), 3)
    with pytest.raises(FileNotFoundError):
        files.read_bytes(spark, str(tmp_path / "none.txt"))


def test_settings_are_replaced_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "engine.properties")
    assert files.load_settings_or_defaults(spark, path)[0] == Settings()
    files.save_settings(spark, path, Settings(max_evidence=3))
    files.save_settings(spark, path, Settings(max_evidence=5))
    assert files.load_settings_or_defaults(spark, path) == (Settings(max_evidence=5), None)
    monkeypatch.setattr(files, "format_settings", lambda s: "nonsense")
    with pytest.raises(SettingsError):
        files.save_settings(spark, path, Settings())
    assert files.load_settings_or_defaults(spark, path)[0].max_evidence == 5
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["engine.properties"]
    (tmp_path / "bad").write_text("maxEvidence=0\n")
    found, wrong = files.load_settings_or_defaults(spark, str(tmp_path / "bad"))
    assert found == Settings() and wrong


def test_catalogue_store(spark, tmp_path):
    path, schema = str(tmp_path / "index"), "doc_id string, doc_type string, path string"
    ids = lambda: sorted((r["doc_id"], r["path"]) for r in ingest.open_catalogue(spark, path).collect())
    assert ids() == []
    ingest.put_records(spark, path, spark.createDataFrame([("a", "SUBMISSION", "p"), ("b", "REFERENCE", "q\tr")], schema))
    ingest.put_records(spark, path, spark.createDataFrame([("a", "SUBMISSION", "p2")], schema))
    assert ids() == [("a", "p2"), ("b", "q\tr")]
    with pytest.raises(ValueError):  # an id twice in one snapshot
        ingest.put_records(spark, path, spark.createDataFrame([("c", "SUBMISSION", "x"), ("c", "SUBMISSION", "y")], schema))
    assert ids() == [("a", "p2"), ("b", "q\tr")]
    listing = spark.createDataFrame([("p2",)], "path string")
    assert [r["doc_id"] for r in ingest.missing_files(ingest.open_catalogue(spark, path), listing).collect()] == ["b"]
    ingest.remove_records(spark, path, spark.createDataFrame([("a",)], "doc_id string"))
    assert ids() == [("b", "q\tr")]
    files.rename(spark, path, f"{path}.old")  # a crash between the two moves
    assert ids() == [("b", "q\tr")]
    ingest.clear_catalogue(spark, path)
    assert ids() == []


def test_reload(spark, tmp_path):
    for folder, name in (("in", "a"), ("in", "b"), ("ref", "c")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{name}.txt").write_text(f"text of {name}")
    gone = spark.createDataFrame([("b",)], "doc_id string")
    docs, errors = ingest.reload_corpus(spark, [(str(tmp_path / "in"), "SUBMISSION"), (str(tmp_path / "ref"), "REFERENCE")], gone)
    assert sorted((r["doc_id"], r["doc_type"]) for r in docs.collect()) == [("a", "SUBMISSION"), ("c", "REFERENCE")] and errors.count() == 0


def test_malformed_records_are_isolated(spark, tmp_path):
    path, aside = str(tmp_path / "catalogue"), str(tmp_path / "aside")
    rows = spark.createDataFrame([(f"d{i}", "REFERENCE", f"/a\t{i}.txt") for i in range(1000)], "doc_id string, doc_type string, path string")
    ingest.save_catalogue(spark, path, rows)
    assert ingest.recover_catalogue(spark, path, aside).count() == 1000 and not (tmp_path / "aside").exists()
    lines = [r["value"] for r in spark.read.text(path).collect()]
    bad = ["RECORD\td7", "RECORD\t\tREFERENCE\t/x", "RECORD\tx\t\t/x", "noise", "", "RECORD\td5\tSUBMISSION\t/y"]
    lines = [x for x in lines if not x.startswith("RECORD\td7\t")] + bad
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)
    with pytest.raises(ValueError):
        ingest.open_catalogue(spark, path)
    got = ingest.recover_catalogue(spark, path, aside)
    assert {r["doc_id"] for r in got.collect()} == {f"d{i}" for i in range(1000) if i != 7}
    assert {tuple(r) for r in got.filter("doc_id in ('d5', 'd6')").collect()} == {("d5", "REFERENCE", "/a\t5.txt"), ("d6", "REFERENCE", "/a\t6.txt")}
    faults = {(r["line"], r["reason"]) for r in spark.read.parquet(aside).collect()}
    assert faults == set(zip(bad, ["wrong number of fields", "no id", "no type", "not a record", "not a record", "repeated id"], strict=True)) | {("COUNT\t1000", "another count")}
    assert ingest.open_catalogue(spark, path).count() == 999
    spark.createDataFrame([("RECORD\ta\tb\tc",)], "value string").write.text(str(tmp_path / "other"))
    with pytest.raises(ValueError):
        ingest.recover_snapshot(spark, str(tmp_path / "other"))
