"""Case reports, batch summary, assignment export and compressed archives."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions import udfs as U
from plumbline.sources import files


def status(total: Column, reviewer: Column, threshold: float) -> Column:
    return F.coalesce(reviewer, F.when(total >= threshold, "AWAITING_ASSIGNMENT").otherwise("BELOW_THRESHOLD"))


def summary_lines(cases: DataFrame, assigned: DataFrame, threshold: float) -> DataFrame:
    """``(case_id, line)``: one line of the batch summary per case."""
    who = assigned.select(F.col("case_id").alias("__c"), "reviewer_id")
    joined = cases.join(who, F.col("case_id") == F.col("__c"), "left")
    line = F.concat_ws(" | ", "case_id", F.concat_ws(" <-> ", "sub_id", "ref_id"), X.percent(F.col("total")), "risk", status(F.col("total"), F.col("reviewer_id"), threshold))
    return joined.select("case_id", line.alias("line"))


def case_reports(cases: DataFrame, evidence: DataFrame, assigned: DataFrame, threshold: float) -> DataFrame:
    """``(case_id, name, report)``; evidence rows carry ``place`` and the line
    and column of their ends (``evidence.located``)."""
    item = F.format_string(
        "\n  Evidence %d — %s\n    Algorithm: %s\n    Similarity: %s\n    Submission location: %s to %s\n    Reference location: %s to %s\n    Excerpt: \"%s\"\n",
        F.col("place"), "type", "algorithm", X.percent(F.col("similarity")), "sub_from", "sub_to", "ref_from", "ref_to", X.single_line(F.col("excerpt")),
    )
    listed = evidence.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", item.alias("t")))), lambda s: s["t"]), "").alias("items"))
    who = assigned.select(F.col("case_id").alias("__c"), "reviewer_id", "reviewer_name")
    joined = cases.join(listed, "case_id", "left").join(who, F.col("case_id") == F.col("__c"), "left")
    reviewer = F.when(F.col("reviewer_id").isNotNull(), F.concat_ws(" — ", "reviewer_id", "reviewer_name")).otherwise(status(F.col("total"), F.col("reviewer_id"), threshold))
    linked = F.when(F.col("graph") > 0, F.concat(F.lit("  An edge of the similarity graph; its similarity and its neighbourhood give "), X.percent(F.col("graph")), F.lit(".\n"))).otherwise("  No edge above the graph's threshold.\n")
    report = F.concat(
        F.lit("DOCUMENT SIMILARITY REPORT\n\nCase: "), "case_id", F.lit("\nSubmission: "), "sub_id", F.lit("\nReference: "), "ref_id", F.lit("\nRisk: "), "risk", F.lit("\nComposite score: "), X.percent(F.col("total")),
        F.lit("\n\nCOMPONENTS\n  Exact phrases: "), X.percent(F.col("exact")), F.lit("\n  Shingles: "), X.percent(F.col("shingle")), F.lit("\n  Fuzzy alignment: "), X.percent(F.col("fuzzy")), F.lit("\n  Graph signal: "), X.percent(F.col("graph")),
        F.lit("\n\nEVIDENCE\n"), F.coalesce("items", F.lit("  none\n")), F.lit("\nGRAPH\n"), linked,
        F.lit("\nREVIEW\n  Reviewer: "), reviewer, F.lit("\n  Policy: automated results are evidence for human review, not a verdict.\n"),
    )
    return joined.select("case_id", X.safe_name(F.col("case_id")).alias("name"), report.alias("report"))


def batch_header(stats: DataFrame, mode: str, seconds: float, cases: int) -> str:
    """The counters above the summary's lines; ``stats`` is a single row."""
    row = stats.first()
    counters = (("Pairs", row["pairs"]), ("Candidates", row["candidates"]), ("Reduction", f"{row['reduction'] * 100:.2f}%"), ("Mode", mode), ("Elapsed", f"{seconds * 1000:.3f} ms"), ("Cases", cases))
    return "BATCH SUMMARY\n\n" + "".join(f"{name}: {value}\n" for name, value in counters)


def preview(reports: DataFrame, case_id: str) -> DataFrame:
    """The report of one case."""
    return reports.filter(F.col("case_id") == case_id)


def export_run(reports: DataFrame, lines: DataFrame, header: str, root: str) -> str:
    """A new folder ``run-<milliseconds>[-n]`` below ``root``, which appears
    when it is whole: ``reports`` (a row per case with its archive),
    ``summary`` (the lines, by case) and ``analysis-summary.txt`` (counters).
    Returns its path."""
    spark = reports.sparkSession
    name, n = f"{root.rstrip('/')}/run-{int(time.time() * 1000)}", 0
    while files.exists(spark, path := f"{name}-{n}" if n else name):
        n += 1
    hidden = f"{root.rstrip('/')}/.writing-{uuid.uuid4().hex}"
    try:
        reports.withColumn("archive", U.compress(F.encode("report", "UTF-8"))).write.parquet(f"{hidden}/reports")
        lines.orderBy("case_id").select("line").write.text(f"{hidden}/summary")
        files.write_bytes(spark, f"{hidden}/analysis-summary.txt", header.encode())
        files.rename(spark, hidden, path)
    except Exception:
        files.delete(spark, hidden)
        raise
    return path


def write_assignments(assigned: DataFrame, path: str) -> None:
    """The assignments as CSV; a former export is replaced as a whole."""
    rows = assigned.select(F.col("case_id").alias("caseId"), F.col("sub_id").alias("submissionId"), F.col("ref_id").alias("referenceId"), F.col("total").alias("score"), "risk", F.col("reviewer_id").alias("reviewerId"), F.col("reviewer_name").alias("reviewerName"))
    files.replace(assigned.sparkSession, path, lambda p: rows.write.option("header", True).option("escape", '"').csv(p), lambda p: None)
