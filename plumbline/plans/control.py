"""One operation at a time in the background, with its progress and its end.

The jobs of an operation carry a tag of their own, so cancelling it cancels them
and no other job of the session.  What it wrote to the scratch folder is deleted
unless it succeeds.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from plumbline.scratch import undone_on_error

Progress = Callable[[str, int, int], None]
Work = Callable[[Progress], Any]

RUNNING, SUCCEEDED, FAILED, CANCELLED = "running", "succeeded", "failed", "cancelled"


class Cancelled(Exception):
    """Raised within an operation at the next phase after it was cancelled."""


class Busy(RuntimeError):
    """Another operation is still running."""


@dataclass
class Operation:
    """A running or ended operation.  ``phases`` lists what it reported."""

    action: str
    tag: str
    state: str = RUNNING
    value: Any = None
    error: BaseException | None = None
    phases: list[tuple[str, int, int]] = field(default_factory=list)
    cancelling: threading.Event = field(default_factory=threading.Event)
    ended: threading.Event = field(default_factory=threading.Event)

    def result(self, timeout: float | None = None) -> Any:
        """Waits for the end; raises what the operation raised, ``Cancelled`` if
        it was cancelled, ``TimeoutError`` if it still runs."""
        if not self.ended.wait(timeout):
            raise TimeoutError(f"{self.action} is still running")
        if self.state == CANCELLED:
            raise Cancelled(self.action)
        if self.error is not None:
            raise self.error
        return self.value


class Controller:
    """Runs operations of one session, one at a time."""

    def __init__(self, spark: SparkSession, every: float = 0.1) -> None:
        self.spark = spark
        self.every = every
        self._lock = threading.Lock()
        self._current: Operation | None = None
        self._closed = False

    def submit(self, action: str, work: Work, listener: Progress | None = None) -> Operation:
        """Starts ``work``, which is given a function to report its phases with.
        Refused with ``Busy`` while another operation runs or after closing."""
        with self._lock:
            if self._closed:
                raise Busy("the controller is closed")
            if self._current is not None:
                raise Busy(f"{self._current.action} is still running")
            operation = self._current = Operation(action, f"plumbline-{uuid.uuid4().hex}")
        InheritableThread(target=self._execute, args=(operation, work, listener), daemon=True).start()
        return operation

    def tasks(self) -> tuple[int, int]:
        """Tasks done and in all, over the active stages of the operation."""
        operation, status = self._current, self.spark.sparkContext.statusTracker()
        if operation is None:
            return 0, 0
        jobs = map(status.getJobInfo, status.getJobIdsForGroup(operation.tag))
        stages = [status.getStageInfo(s) for job in jobs if job and job.status == "RUNNING" for s in job.stageIds]
        return sum(s.numCompletedTasks for s in stages if s), sum(s.numTasks for s in stages if s)

    def cancel(self, timeout: float | None = None) -> bool:
        """Cancels the operation and waits for its end; False if none runs.  A
        job that begins after the first request is cancelled by the next one."""
        operation = self._current
        if operation is None:
            return False
        operation.cancelling.set()
        waited = 0.0
        while not operation.ended.wait(self.every):
            self.spark.sparkContext.cancelJobsWithTag(operation.tag)
            waited += self.every
            if timeout is not None and waited > timeout:
                raise TimeoutError(f"{operation.action} has not ended")
        return True

    def close(self) -> None:
        """Accepts nothing more and cancels what runs."""
        with self._lock:
            self._closed = True
        self.cancel()

    def _execute(self, operation: Operation, work: Work, listener: Progress | None) -> None:
        def report(phase: str, done: int, of: int) -> None:
            if operation.cancelling.is_set():
                raise Cancelled(operation.action)
            operation.phases.append((phase, done, of))
            if listener is not None:
                listener(phase, done, of)

        context = self.spark.sparkContext
        context.addJobTag(operation.tag)  # both belong to this thread and end with it
        context.setJobGroup(operation.tag, operation.action)
        try:
            with undone_on_error(self.spark):
                report("starting", 0, 1)
                value = work(report)
                if operation.cancelling.is_set():
                    raise Cancelled(operation.action)
            operation.value, operation.state = value, SUCCEEDED
        except BaseException as e:  # whatever ended it is the operation's result
            operation.error = e
            operation.state = CANCELLED if operation.cancelling.is_set() else FAILED
        finally:
            with self._lock:
                self._current = None
            operation.ended.set()
