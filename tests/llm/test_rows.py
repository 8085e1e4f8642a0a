"""Classes handed back to their rows, and empty tables of the scans."""

from pyspark.sql import functions as F

from plumbline.llm import license_join, pii_disclosure, rows


def test_with_class_equals_a_plain_join(spark, monkeypatch):
    monkeypatch.setattr(rows, "FOREMOST", 2)
    data = [(i, key) for i, key in enumerate("a" * 50 + "b" * 20 + "c" * 20 + "defg")]
    table = spark.createDataFrame(data, "doc_id long, k string")
    classes = table.groupBy("k").agg(F.count("*").alias("members"), F.min("doc_id").alias("least"))
    got = sorted(tuple(r) for r in rows.with_class(table, classes, "k").select("doc_id", "k", "least").collect())
    first = {}
    for i, key in data:
        first.setdefault(key, i)
    assert got == [(i, key, first[key]) for i, key in data]
    assert rows.with_class(table.limit(0), classes, "k").count() == 0


def test_scans_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, spans string")
    assert license_join.scan_licenses(none).count() == 0
    assert pii_disclosure.find_pii(none).count() == 0
