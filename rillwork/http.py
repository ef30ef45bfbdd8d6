"""An HTTP front end of the job service: POST /v1/jobs with a job specification; the answer is a result, or a code and a message."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from rillwork.errors import JobError
from rillwork.service import DEFAULT_TIMEOUT, JobService

JOBS = "/v1/jobs"


def make_server(service: JobService, host: str = "127.0.0.1", port: int = 0, timeout: float = DEFAULT_TIMEOUT) -> ThreadingHTTPServer:
    """A server that is bound and not yet serving; each request has a thread, and Spark schedules the jobs in order of arrival."""

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def answer(self, status: int, body: str) -> None:
            data = body.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            if status >= 400:
                self.send_header("Connection", "close")
                self.close_connection = True
            self.end_headers()
            self.wfile.write(data)

        def refuse(self, code: str, message: str) -> None:
            e = JobError(code, message)
            self.answer(e.status, json.dumps(e.to_json()))

        def handle_any(self) -> None:
            if self.path != JOBS:
                self.refuse("not_found", "no such path")
            elif self.command != "POST":
                self.refuse("method_not_allowed", "only POST is allowed")
            else:
                self.job()

        do_GET = do_POST = do_PUT = do_DELETE = do_PATCH = handle_any

        def job(self) -> None:
            size = self.headers.get("Content-Length", "")
            if not size.isdigit():
                self.refuse("invalid_request", "Content-Length is required")
            elif int(size) > service.max_bytes:
                self.refuse("request_too_large", "request exceeds size limit")
            else:
                try:
                    result = service.submit(self.rfile.read(int(size)), timeout)
                except JobError as e:
                    self.answer(e.status, json.dumps(e.to_json()))
                except Exception as e:  # a fault of the service itself
                    self.refuse("internal_error", str(e))
                else:
                    self.answer(200, result.to_json())

        def log_message(self, format, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def submit(url: str, job: bytes, timeout: float, max_bytes: int) -> str:
    """The result's JSON text; refusals raise JobError with the service's message."""
    request = urllib.request.Request(url.rstrip("/") + JOBS, data=job, headers={"Content-Type": "application/json"}, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            data = r.read(max_bytes + 1)
    except urllib.error.HTTPError as e:
        try:
            told = json.loads(e.read(max_bytes))
            raise JobError(told["code"], told["message"]) from None
        except (ValueError, KeyError):
            raise JobError("internal_error", f"the service answered {e.code}") from None
    except OSError as e:
        raise JobError("unavailable", f"{url}: {e}") from None
    if len(data) > max_bytes:
        raise JobError("request_too_large", "response exceeds size limit")
    return data.decode()
