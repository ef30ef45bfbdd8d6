"""An in-process job service: submit a job specification, get a result or an error with a code."""

from __future__ import annotations

import json
import logging
import uuid
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from rillwork.errors import FailureKind, JobError, PermanentFailure, classify
from rillwork.functions.registry import FunctionRegistry, KeyValue
from rillwork.operators.dataset import Context
from rillwork.plans import compiler, jobspec
from rillwork.sources.text import Source, text_file

log = logging.getLogger("rillwork.jobs")
DEFAULT_TIMEOUT = 300.0


@dataclass(frozen=True)
class JobResult:
    """count jobs have no records; collect jobs have a list of them, which may be empty."""

    action: str
    records: list | None
    count: int

    def to_json(self) -> str:
        records = None if self.records is None else [{"key": r.key, "value": r.value} if isinstance(r, KeyValue) else r for r in self.records]
        return f'{{"action":{json.dumps(self.action)},"records":{compiler.encode(records)},"count":{self.count}}}'


def _event(name: str, **fields) -> None:
    log.info(json.dumps({"event": name, **fields}))


class JobService:
    """Each job has a lineage of its own; the registry, the source and the Spark session are shared."""

    def __init__(self, spark: SparkSession | None, registry: FunctionRegistry, source: Source = text_file, *, max_shuffles: int | None = 1, max_bytes: int = jobspec.MAX_BYTES):
        self.spark, self.registry, self.source = spark, registry, source
        self.max_shuffles, self.max_bytes = max_shuffles, max_bytes

    def submit(self, job: str | bytes | jobspec.JobSpec, timeout: float = DEFAULT_TIMEOUT) -> JobResult:
        """Blocks until the job has ended, or until the timeout cancels it."""
        if self.spark is None:
            raise JobError("unavailable", "no Spark session")
        try:
            spec = job if isinstance(job, jobspec.JobSpec) else jobspec.decode(job, self.max_bytes)
        except jobspec.TooLarge as e:
            raise JobError("request_too_large", str(e), FailureKind.PERMANENT) from e
        except PermanentFailure as e:
            raise JobError("invalid_request", str(e), FailureKind.PERMANENT) from e
        job_id = uuid.uuid4().hex
        _event("job_submitted", job=job_id, action=spec.action)
        box: dict = {}

        def run() -> None:
            sc = self.spark.sparkContext
            sc.setJobGroup(job_id, "rillwork job", interruptOnCancel=True)
            try:
                dataset = jobspec.build(Context(self.spark, self.registry, self.source, max_shuffles=self.max_shuffles), spec)
                if spec.action == "count":
                    box["result"] = JobResult("count", None, dataset.count())
                else:
                    box["result"] = JobResult("collect", dataset.collect(), 0)
            except BaseException as e:  # handed to the submitting thread
                box["error"] = e

        thread = InheritableThread(target=run, daemon=True)
        thread.start()
        thread.join(timeout)
        if thread.is_alive():
            self.spark.sparkContext.cancelJobGroup(job_id)
            _event("job_failed", job=job_id, kind=FailureKind.CANCELED.value)
            raise JobError("deadline", f"job exceeded its deadline of {timeout:g} s", FailureKind.CANCELED)
        if "error" in box:
            kind = classify(box["error"])
            _event("job_failed", job=job_id, kind=kind.value)
            raise JobError("job_failed", str(box["error"]), kind) from box["error"]
        _event("job_succeeded", job=job_id)
        return box["result"]
