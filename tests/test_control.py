"""Operations in the background: phases, one at a time, cancellation."""

import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline import scratch
from plumbline.operators.corpus import prepare
from plumbline.plans.analysis import analyse
from plumbline.plans.control import CANCELLED, FAILED, SUCCEEDED, Busy, Cancelled, Controller
from plumbline.settings import Settings


def tables(spark):
    root = Path(scratch.scratch_root(spark).removeprefix("file://"))
    return {p.name for p in root.iterdir()}


def slow(spark, seconds=60):
    """A table whose every row takes its time."""

    @F.udf("long")
    def wait(x):
        time.sleep(seconds)
        return x

    return spark.range(4).select(wait("id").alias("id"))


def test_a_cancelled_operation_leaves_no_table(spark):
    control, before, phases = Controller(spark), tables(spark), []
    first = threading.Event()

    def work(report):
        report("one", 1, 2)
        scratch.materialise(spark.range(10), "cancelled")
        first.set()
        scratch.materialise(slow(spark), "cancelled")
        report("two", 2, 2)

    running = control.submit("Slow work", work, lambda *p: phases.append(p))
    assert first.wait(60)
    with pytest.raises(Busy):
        control.submit("Other work", lambda report: None)
    began = time.monotonic()
    while control.tasks()[1] == 0 and time.monotonic() - began < 30:
        time.sleep(0.05)
    assert control.tasks()[1] > 0
    assert control.cancel(timeout=40)
    assert running.state == CANCELLED and phases == [("starting", 0, 1), ("one", 1, 2)]
    with pytest.raises(Cancelled):
        running.result()
    assert tables(spark) == before
    assert spark.range(5).count() == 5 and not control.cancel()
    assert control.submit("Next", lambda report: spark.range(7).count()).result(60) == 7


def test_other_jobs_are_left_alone(spark):
    control, started = Controller(spark), threading.Event()

    def work(report):
        started.set()
        slow(spark).collect()

    control.submit("Slow work", work)
    assert started.wait(60)
    got = []
    other = threading.Thread(target=lambda: got.append(spark.range(1000).repartition(3).count()))
    other.start()
    assert control.cancel(timeout=40)
    other.join(60)
    assert got == [1000]


def test_failure_and_close(spark):
    control, before = Controller(spark), tables(spark)

    def work(report):
        scratch.materialise(spark.range(3), "failed")
        raise KeyError("no such document")

    failed = control.submit("Failing", work)
    with pytest.raises(KeyError):
        failed.result(60)
    assert failed.state == FAILED and tables(spark) == before
    control.close()
    with pytest.raises(Busy):
        control.submit("Late", lambda report: None)


def test_phases_of_an_analysis(spark, sf):
    settings = Settings(enable_fuzzy=False)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    subs = scratch.materialise(prepare(docs, "doc_id", "text", "D"), "subs")
    who = spark.createDataFrame([(0, "R1", "One", 2)], "pos int, id string, name string, capacity int")
    control = Controller(spark)
    done = control.submit("Analysis", lambda report: analyse(subs, subs, who, settings, 20, 20, progress=report))
    found = done.result(300)
    assert done.state == SUCCEEDED
    assert [p[0] for p in done.phases] == ["starting", "validation", "preparation", "analysis", "indexing", "complete"]
    assert found.cases.count() >= 20
