"""Failure kinds, and how Spark's exceptions map to them."""

from __future__ import annotations

import enum

from pyspark.errors import PySparkException


class FailureKind(str, enum.Enum):
    PERMANENT = "permanent"
    EXECUTION = "execution"
    SHUFFLE_INPUT = "shuffle_input"
    CANCELED = "canceled"
    WORKER_LOST = "worker_lost"


class PermanentFailure(Exception):
    """A failure that no retry can mend.  User functions may raise it; the cause is kept."""


class PlanError(PermanentFailure, ValueError):
    """A lineage, stage plan or job that is refused before any data is read."""


class JobError(Exception):
    """A refused or failed job, with the code and status a service reports."""

    STATUS = {"invalid_request": 400, "not_found": 404, "method_not_allowed": 405, "conflict": 409, "request_too_large": 413, "job_failed": 422, "internal_error": 500, "unavailable": 503, "deadline": 504}

    def __init__(self, code: str, message: str, kind: FailureKind | None = None):
        super().__init__(message)
        self.code, self.message, self.kind = code, message, kind

    @property
    def status(self) -> int:
        return self.STATUS[self.code]

    def to_json(self) -> dict:
        return {"code": "job_failed" if self.code == "deadline" else self.code, "message": self.message}


_PERMANENT = ("PATH_NOT_FOUND", "ARITHMETIC_OVERFLOW", "USER_RAISED_EXCEPTION", "CAST_INVALID_INPUT", "CAST_OVERFLOW", "DATATYPE_MISMATCH", "UNRESOLVED_COLUMN", "FAILED_READ_FILE")


def classify(error: BaseException) -> FailureKind:
    """The kind of a failure; what is not known is an execution failure."""
    if isinstance(error, (PermanentFailure, FileNotFoundError, PermissionError)):
        return FailureKind.PERMANENT
    if isinstance(error, (KeyboardInterrupt, TimeoutError)):
        return FailureKind.CANCELED
    text = str(error)
    if isinstance(error, PySparkException):
        condition = error.getCondition() or ""
        if condition.split(".")[0] in _PERMANENT:
            return FailureKind.PERMANENT
    if "PermanentFailure" in text or any(f"[{c}" in text for c in _PERMANENT):
        return FailureKind.PERMANENT
    for marks, kind in ((("cancelled", "canceled"), FailureKind.CANCELED), (("FetchFailed", "MetadataFetchFailed"), FailureKind.SHUFFLE_INPUT), (("ExecutorLostFailure",), FailureKind.WORKER_LOST)):
        if any(m in text for m in marks):
            return kind
    return FailureKind.EXECUTION
