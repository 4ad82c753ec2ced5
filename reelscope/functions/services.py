"""A query parser that asks a language model behind an HTTP endpoint."""

from __future__ import annotations

import http.client
import json
import random
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import urlsplit

from pyspark.accumulators import Accumulator
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: What the model is told. The four keys are fixed values: parsed queries have them.
INSTRUCTION = """Split a description of a moment in a video into parts for a search by time and by visible text.
Answer with one JSON object that has these keys and no other:
- "context_before": list of strings, what is seen before the moment, in order; [] if nothing is said of it
- "main_shot": string, the moment itself: its most distinctive action or thing
- "context_after": list of strings, what is seen after the moment, in order; [] if nothing is said of it
- "ocr_texts": list of strings, only what the description puts between quotation marks (" " or “ ”), letter by letter; [] without such marks, and never the name of a thing that is merely seen

For the description: Rain falls on a street. A bus with the words "Line 9" stops, then two children get off.
{"context_before": ["Rain falls on a street."], "main_shot": "A bus with the words \\"Line 9\\" stops", "context_after": ["two children get off"], "ocr_texts": ["Line 9"]}"""

#: Answers that another try may better: the service is busy, or something between is down.
_TRANSIENT = (408, 425, 429, 500, 502, 503, 504)


def prompt(query: str) -> str:
    return f"{INSTRUCTION}\n\nFor the description: {query}\n"


def prompt_of(query: Column) -> Column:
    """prompt() as an expression, for offline batches of a model."""
    return F.concat(F.lit(f"{INSTRUCTION}\n\nFor the description: "), query, F.lit("\n"))


class Refused(OSError):
    """An answer that is none: its status, and the seconds that the service asked to wait, if it did."""

    def __init__(self, status: int, wait: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.wait = status, wait


class Session:
    """Connections to one place, one a thread, kept alive from request to request and opened anew when they broke."""

    def __init__(self, url: str, timeout: float):
        self.at, self.timeout, self.own, self.all = urlsplit(url), timeout, threading.local(), []
        self.lock = threading.Lock()

    def _connection(self) -> http.client.HTTPConnection:
        if not hasattr(self.own, "connection"):
            kind = http.client.HTTPSConnection if self.at.scheme == "https" else http.client.HTTPConnection
            self.own.connection = kind(self.at.hostname, self.at.port, timeout=self.timeout)
            with self.lock:
                self.all.append(self.own.connection)
        return self.own.connection

    def post(self, body: bytes) -> bytes:
        """The answer to a body of JSON. A connection that the other side closed while it lay idle is opened again at once, and that is no retry."""
        path = (self.at.path or "/") + (f"?{self.at.query}" if self.at.query else "")
        connection = self._connection()
        used = connection.sock is not None
        try:
            try:
                connection.request("POST", path, body, {"Content-Type": "application/json"})
                answer = connection.getresponse()
            except (http.client.RemoteDisconnected, BrokenPipeError, ConnectionResetError):
                connection.close()
                if not used:
                    raise
                connection.request("POST", path, body, {"Content-Type": "application/json"})
                answer = connection.getresponse()
            content = answer.read()
        except (OSError, http.client.HTTPException) as error:
            connection.close()
            raise error if isinstance(error, OSError) else OSError(str(error)) from error
        if answer.status >= 300:
            wait = answer.headers.get("Retry-After", "")
            raise Refused(answer.status, float(wait) if wait.isdigit() else None)
        return content

    def close(self) -> None:
        for connection in self.all:
            connection.close()


class Budget:
    """Retries that a session may still take: some to begin with, and a share of one for each request, so that a service that is down is not asked many times over."""

    def __init__(self, first: float, share: float):
        self.left, self.share, self.lock = first, share, threading.Lock()

    def asked(self) -> None:
        with self.lock:
            self.left += self.share

    def take(self) -> bool:
        with self.lock:
            if self.left < 1:
                return False
            self.left -= 1
            return True


class Counts:
    """What parsers did over all workers: requests, retries, and queries that no answer came for. A task that is run again counts again."""

    def __init__(self, spark: SparkSession):
        self.requests, self.retries, self.failures = (spark.sparkContext.accumulator(0) for _ in range(3))

    def all(self) -> dict[str, int]:
        return {name: found.value for name, found in vars(self).items()}


def _strings(found: object) -> list[str]:
    """A list of strings, however the model wrote it."""
    if isinstance(found, str):
        return [found] if found else []
    return [str(x) for x in found if x is not None] if isinstance(found, list) else []


class HttpParser:
    """Asks url for each query, `threads` at a time, and reads the JSON that the answer's "response" holds.

    The body of a request has the fields of the common generate endpoint (fixed values): model, prompt, stream, format, options.
    A worker opens one session for all batches of its partition, whose connections stay open. A request that fails for the moment (no
    connection, no answer in time, or a status that says so) is asked again up to `tries` times in all, after a wait that doubles from `pause`
    seconds to `longest` and is shortened by chance, or as long as the service asks for, `longest` at most. All retries come out of one budget
    for the session: `budget` of them, and `share` of one more for each query. A query that gets no good answer is None, which the caller
    replaces by the whole query. An answer that is no such JSON is not asked for again: the model answers the same at temperature 0.

    connect(url, timeout) gives what has post(body) and close(); it goes to the workers with the parser. counts: see Counts.
    """

    def __init__(
        self, url: str, model: str, timeout: float = 30.0, threads: int = 5, connect: Callable[[str, float], Session] = Session, tries: int = 4, pause: float = 0.5, longest: float = 8.0,
        budget: float = 10.0, share: float = 0.2, counts: Counts | None = None,
    ):
        self.url, self.model, self.timeout, self.threads, self.connect = url, model, timeout, threads, connect
        self.tries, self.pause, self.longest, self.budget, self.share, self.counts = tries, pause, longest, budget, share, counts

    def open(self) -> OpenParser:
        """The parser at work in one partition, to be closed at its end."""
        return OpenParser(self)

    def parse(self, queries: list[str]) -> list[dict | None]:
        with self.open() as own:
            return own.parse(queries)


class OpenParser:
    """An HttpParser with its session, its threads and its budget."""

    def __init__(self, how: HttpParser):
        self.how, self.session, self.budget = how, how.connect(how.url, how.timeout), Budget(how.budget, how.share)
        self.pool, self.seen, self.lock = ThreadPoolExecutor(how.threads), {"requests": 0, "retries": 0, "failures": 0}, threading.Lock()

    def __enter__(self) -> OpenParser:
        return self

    def __exit__(self, *_) -> None:
        self.pool.shutdown()
        self.session.close()

    def _count(self, name: str) -> None:
        with self.lock:
            self.seen[name] += 1

    def answer(self, body: bytes) -> bytes:
        """The answer to one request, tried as often as the parser and its budget allow; the last failure is raised."""
        self.budget.asked()
        for turn in range(self.how.tries):
            self._count("retries" if turn else "requests")
            try:
                return self.session.post(body)
            except OSError as error:
                refused = isinstance(error, Refused)
                if (refused and error.status not in _TRANSIENT) or turn + 1 == self.how.tries or not self.budget.take():
                    raise
                asked = error.wait if refused else None
            longest = min(self.how.longest, self.how.pause * 2**turn)
            time.sleep(random.uniform(longest / 2, longest) if asked is None else min(asked, self.how.longest))
        raise OSError("no try was allowed")

    def one(self, query: str) -> dict | None:
        how = self.how
        body = {"model": how.model, "prompt": prompt(query), "stream": False, "format": "json", "options": {"temperature": 0.0}}
        try:
            found = json.loads(json.loads(self.answer(json.dumps(body).encode()))["response"])
            lists = {k: _strings(found.get(k)) for k in ("context_before", "context_after", "ocr_texts")}
            return {**lists, "main_shot": found["main_shot"] if isinstance(found.get("main_shot"), str) else query}
        except (OSError, ValueError, KeyError, TypeError, AttributeError):
            self._count("failures")
            return None

    def parse(self, queries: list[str]) -> list[dict | None]:
        """The parts of each query, in their order. The counts go to the accumulators here, as only a task's own thread may add to them."""
        found = list(self.pool.map(self.one, queries))
        if self.how.counts:
            for name, n in self.seen.items():
                total: Accumulator = getattr(self.how.counts, name)
                total.add(n)
                self.seen[name] = 0
        return found
