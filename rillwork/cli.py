"""Command lines: ``local`` runs a job file, ``explain`` shows its plans without touching data, ``coordinator`` serves jobs over HTTP and
``submit`` sends one to it (without an address it runs the job in this process).

Results go to stdout, diagnostics to stderr."""

from __future__ import annotations

import argparse
import json
import sys

from rillwork import http, session
from rillwork.errors import JobError, PermanentFailure
from rillwork.functions.builtin import default_registry
from rillwork.functions.registry import FunctionRegistry
from rillwork.operators.dataset import Context
from rillwork.plans import jobspec
from rillwork.plans.compiler import JsonNumber, encode
from rillwork.plans.stages import explain_stage_plan
from rillwork.service import DEFAULT_TIMEOUT, JobService


def explain(data: bytes, registry: FunctionRegistry) -> str:
    spec = jobspec.decode(data)
    dataset = jobspec.build(Context(registry=registry), spec)
    return dataset.explain_lineage() + explain_stage_plan(dataset.plan_stages(spec.action))


def main(argv: list[str] | None = None, registry: FunctionRegistry | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rillwork", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("local", "submit", "explain"):
        p = commands.add_parser(name)
        p.add_argument("--job", required=True, help="path of a JSON job specification")
        if name != "explain":
            p.add_argument("--master", default=None, help="Spark master; by default that of the environment, or as many local cores as the source has partitions")
        if name == "local":
            p.add_argument("--max-stage-attempts", type=int, default=2)
        if name == "submit":
            p.add_argument("--coordinator", help="address of a coordinator, such as http://127.0.0.1:8080")
            p.add_argument("--request-timeout", type=float, default=DEFAULT_TIMEOUT)
            p.add_argument("--max-response-bytes", type=int, default=1 << 20)
    serve = commands.add_parser("coordinator")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8080)
    serve.add_argument("--job-timeout", type=float, default=DEFAULT_TIMEOUT)
    serve.add_argument("--master", default=None)
    args = parser.parse_args(argv)
    registry = registry or default_registry()
    if args.command == "coordinator":
        server = http.make_server(JobService(session.build(args.master), registry), args.host, args.port, args.job_timeout)
        print(f"serving on {server.server_address[0]}:{server.server_address[1]}", file=sys.stderr)
        server.serve_forever()
        return 0
    try:
        with open(args.job, "rb") as f:
            data = f.read()
        if args.command == "explain":
            sys.stdout.write(explain(data, registry))
            return 0
        spec = jobspec.decode(data)
        if getattr(args, "coordinator", None):
            told = json.loads(http.submit(args.coordinator, data, args.request_timeout, args.max_response_bytes), parse_float=JsonNumber)
            print(told["count"] if told["action"] == "count" else encode(told["records"]))
            return 0
        master = args.master or (f"local[{spec.num_partitions}]" if args.command == "local" else None)
        spark = session.build(master, **({"spark.stage.maxConsecutiveAttempts": str(args.max_stage_attempts)} if args.command == "local" else {}))
        result = JobService(spark, registry).submit(spec, getattr(args, "request_timeout", None))
        out = str(result.count) if result.action == "count" else encode(result.records)
        if len(out.encode()) > getattr(args, "max_response_bytes", sys.maxsize):
            raise JobError("request_too_large", "response exceeds size limit")
        print(out)
        return 0
    except (OSError, PermanentFailure, JobError) as e:
        print(f"rillwork {args.command}: {e}", file=sys.stderr)
        return 1
