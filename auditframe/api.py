"""Read access to run history as plain Python values, and the same over HTTP.

``python -m auditframe.api STORE --port 8000`` serves ``/health``, ``/runs``,
``/runs/{id}`` and ``/runs/{id}/tables``, ``/metrics``, ``/issues`` with the standard
library's server.  An unknown run or path is 404, a limit outside 1 to 500 is 422.
"""

from __future__ import annotations

import argparse
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

from .store import RunStore


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in df.collect()]


def list_runs(spark: SparkSession, store: str, connection_id: str | None = None, status: str | None = None, limit: int = 50) -> list[dict[str, Any]]:
    return _rows(RunStore(spark, store).load_runs(connection_id, status, limit))


def get_run_summary(spark: SparkSession, store: str, run_id: str) -> dict[str, Any]:
    return RunStore(spark, store).get_run_summary(run_id)


def list_tables_for_run(spark: SparkSession, store: str, run_id: str) -> list[str]:
    return RunStore(spark, store).list_tables(run_id)


def get_run_metrics(spark: SparkSession, store: str, run_id: str, table_name: str | None = None, dimension: str | None = None) -> list[dict[str, Any]]:
    return _rows(RunStore(spark, store).load_metrics(run_id, table_name, dimension))


def get_run_issues(spark: SparkSession, store: str, run_id: str, severity: str | None = None, table_name: str | None = None) -> list[dict[str, Any]]:
    return _rows(RunStore(spark, store).load_issues(run_id, severity, table_name))


def answer(spark: SparkSession, store: str, target: str) -> tuple[int, Any]:
    """(status, value) for a GET of the target."""
    url = urlsplit(target)
    path = [unquote(p) for p in url.path.split("/") if p]
    given = {k: v[-1] for k, v in parse_qs(url.query).items()}
    if path == ["health"]:
        return 200, {"status": "ok"}
    if path == ["runs"]:
        limit = given.get("limit", "50")
        if not limit.isdigit() or not 1 <= int(limit) <= 500:
            return 422, {"detail": "limit isn't within 1 and 500"}
        return 200, list_runs(spark, store, given.get("connection_id"), given.get("status"), int(limit))
    if len(path) not in (2, 3) or path[0] != "runs":
        return 404, {"detail": "no such path"}
    summary = get_run_summary(spark, store, path[1])
    if "error" in summary:
        return 404, {"detail": summary["error"]}
    if len(path) == 2:
        return 200, summary
    if path[2] == "tables":
        return 200, list_tables_for_run(spark, store, path[1])
    if path[2] == "metrics":
        return 200, get_run_metrics(spark, store, path[1], given.get("table_name"), given.get("dimension"))
    if path[2] == "issues":
        return 200, get_run_issues(spark, store, path[1], given.get("severity"), given.get("table_name"))
    return 404, {"detail": "no such path"}


def server(spark: SparkSession, store: str, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, value = answer(spark, store, self.path)
            body = json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def main() -> None:
    p = argparse.ArgumentParser(prog="auditframe.api")
    p.add_argument("store")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=8000)
    args = p.parse_args()
    server(SparkSession.builder.appName("auditframe").getOrCreate(), args.store, args.host, args.port).serve_forever()


if __name__ == "__main__":
    main()
