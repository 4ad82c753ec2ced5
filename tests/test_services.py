"""The parser's sessions: connections that stay open, retries out of a budget, and counts."""

import json
import threading
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from reelscope.functions.providers import parsed_queries
from reelscope.functions.services import Budget, Counts, HttpParser, Refused, Session

GOOD = json.dumps({"response": json.dumps({"context_before": [], "main_shot": "m", "context_after": [], "ocr_texts": []})}).encode()


@contextmanager
def service(status, closes=lambda n: False):
    """A server whose n-th request of a query (from 0) is answered by status(query, n); yields its address, requests by query, and connections."""
    asked, connections, lock = {}, [], threading.Lock()

    class Answers(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def setup(self):
            super().setup()
            connections.append(self.client_address)

        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            query = body["prompt"].rsplit("For the description: ", 1)[1].strip()
            with lock:
                n = asked[query] = asked.get(query, -1) + 1
                whole = sum(asked.values()) + len(asked)
            code = status(query, n)
            content = GOOD if code == 200 else b"no"
            self.send_response(code)
            if code == 429:
                self.send_header("Retry-After", "0")
            self.send_header("Content-Length", str(len(content)))
            self.end_headers()
            self.wfile.write(content)
            self.close_connection = closes(whole)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    server.daemon_threads = True
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://127.0.0.1:{server.server_port}/api/generate?x=1", asked, connections
    finally:
        server.shutdown()
        server.server_close()


def tasks_of(spark, n, parts=1):
    return spark.range(0, n, 1, parts).select(F.col("id").cast("string").alias("task_id"), F.concat(F.lit("query "), F.col("id").cast("string")).alias("description"))


def test_a_service_that_fails_twice(spark):
    with service(lambda query, n: 503 if n < 2 else 200) as (url, asked, connections):
        counts = Counts(spark)
        parser = HttpParser(url, "m", 10.0, threads=3, pause=0.01, budget=100.0, counts=counts)
        got = parsed_queries(tasks_of(spark, 20), parser).collect()
    assert len(got) == 20 and all(r["main_shot"] == "m" for r in got)
    assert set(asked.values()) == {2} and counts.all() == {"requests": 20, "retries": 40, "failures": 0}
    assert len(connections) <= 3


def test_a_service_that_never_answers(spark):
    with service(lambda query, n: 500) as (url, asked, _):
        counts = Counts(spark)
        got = parsed_queries(tasks_of(spark, 50), HttpParser(url, "m", 10.0, pause=0.001, budget=5.0, share=0.1, counts=counts)).collect()
    assert all(r["main_shot"] == r["original_query"] for r in got)
    assert counts.requests.value == counts.failures.value == len(asked) == 50 and counts.retries.value <= 10


def test_connections_outlive_batches(spark):
    """Batches of four queries in two partitions: connections are by thread and partition, not by request or batch."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        with service(lambda query, n: 200) as (url, asked, connections):
            got = parsed_queries(tasks_of(spark, 48, 2), HttpParser(url, "m", 10.0, threads=2)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(asked) == 48 and len(connections) <= 4


def test_an_idle_connection_that_was_closed_is_no_failure():
    with service(lambda query, n: 200, closes=lambda n: True) as (url, asked, connections):
        with HttpParser(url, "m", 10.0, threads=1, tries=1, budget=0.0).open() as parser:
            assert all(parser.parse(["a", "b", "c"])) and parser.seen["retries"] == 0
    assert len(asked) == len(connections) == 3


@pytest.mark.parametrize("code,tries", [(404, 1), (400, 1), (429, 3), (503, 3)])
def test_what_is_asked_again(code, tries):
    with service(lambda query, n: code) as (url, asked, _):
        assert HttpParser(url, "m", 10.0, tries=3, pause=0.001).parse(["q"]) == [None]
    assert asked == {"q": tries - 1}


def test_nobody_there():
    parser = HttpParser("http://127.0.0.1:9/none", "m", 0.5, tries=2, pause=0.001)
    assert parser.parse(["q", "r"]) == [None, None] and parser.parse([]) == []
    with pytest.raises(OSError):
        Session("http://127.0.0.1:9/none", 0.5).post(b"{}")


def test_waits_and_budget(monkeypatch):
    """Waits double up to the longest, or are what the service asks for."""
    from reelscope.functions import services

    waits = []

    class Busy:
        def __init__(self, url, timeout):
            self.n = 0

        def post(self, body):
            self.n += 1
            raise Refused(429, 3.0 if self.n == 3 else None)

        def close(self):
            pass

    monkeypatch.setattr(services.time, "sleep", waits.append)
    assert HttpParser("http://x/", "m", connect=Busy, threads=1, tries=6, pause=1.0, longest=4.0).parse(["q"]) == [None]
    assert len(waits) == 5 and 0.5 <= waits[0] <= 1 and 1 <= waits[1] <= 2 and waits[2] == 3.0 and all(2 <= w <= 4 for w in waits[3:])
    budget = Budget(1.0, 0.5)
    assert [budget.take(), budget.take()] == [True, False]
    budget.asked()
    assert not budget.take()
    budget.asked()
    assert budget.take() and not budget.take()
