"""Clients of services over HTTP: vectors of texts, and summaries. Where a service is, its model and the variable that holds its key are parameters.

Requests run some at a time within a task, and at most at the rate that is the task's share of what the service allows.
Replies may come in any order; results are in the order of what was asked. Certificates are always verified.
"""

from __future__ import annotations

import json
import os
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from . import connectors

# Limits where a service names none, headers that name them, settings of requests.
REQUESTS_A_MINUTE, TOKENS_A_MINUTE = 500, 150_000
HEADERS = ("x-ratelimit-limit-requests", "x-ratelimit-limit-tokens")
EMBEDDING_TIMEOUT, SUMMARY_TIMEOUT = 30, 60
OUTPUT_TOKENS, TEMPERATURE = 8000, 0.3

#: Characters of a token, about.
CHARS = 4


@dataclass(frozen=True)
class Limits:
    requests: float = REQUESTS_A_MINUTE
    tokens: float = TOKENS_A_MINUTE

    @property
    def concurrent(self) -> int:
        return connectors.concurrency(self.requests, self.tokens)

    @staticmethod
    def of(headers) -> Limits:
        """What the headers of a reply say; a header that is missing or no number counts as the default."""

        def number(name: str, default: float) -> float:
            try:
                return float(headers.get(name))
            except (TypeError, ValueError):
                return default

        return Limits(number(HEADERS[0], REQUESTS_A_MINUTE), number(HEADERS[1], TOKENS_A_MINUTE))


class ServiceError(RuntimeError):
    """A reply that is no success; `status` is 0 if there was none."""

    def __init__(self, status: int, text: str):
        super().__init__(f"service error {status}: {text}")
        self.status = status

    def __reduce__(self):
        return ServiceError, (self.status, str(self).split(": ", 1)[1])

    @property
    def again(self) -> bool:
        return self.status in (0, 429) or self.status >= 500


class _Pace:
    """Lets requests begin no faster than a share of the limits."""

    def __init__(self, limits: Limits, tasks: int):
        self.limits, self.tasks, self.lock, self.next = limits, tasks, threading.Lock(), 0.0

    def wait(self, chars: int) -> None:
        least = 60 * self.tasks * max(1 / self.limits.requests, chars / CHARS / self.limits.tokens)
        with self.lock:
            begin = max(time.monotonic(), self.next)
            self.next = begin + least
        time.sleep(max(0.0, begin - time.monotonic()))


class _Service:
    """`key_variable`: the environment variable of the key, read where a request is made, so that no plan or log holds it."""

    timeout = EMBEDDING_TIMEOUT

    def __init__(self, url: str, model: str, key_variable: str | None = None, limits: Limits | None = None, tasks: int = 1, pause: float = 1.0):
        self.url, self.model, self.key_variable, self.limits, self.tasks, self.pause = url, model, key_variable, limits or Limits(), max(1, tasks), pause
        self.pace = _Pace(self.limits, self.tasks)

    @property
    def name(self) -> str:
        return self.model

    @property
    def workers(self) -> int:
        """Requests at a time, of this task."""
        return max(1, self.limits.concurrent // self.tasks)

    def _with(self, **changed):
        """The same service with other settings; a pace of its own."""
        other = object.__new__(type(self))
        other.__dict__.update(self.__dict__, **changed)
        other.pace = _Pace(other.limits, other.tasks)
        return other

    def shared(self, tasks: int):
        """What each of so many tasks uses: its share of the rate."""
        return self._with(tasks=max(1, tasks))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "pace"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.pace = _Pace(self.limits, self.tasks)

    def _once(self, body: bytes):
        head = {"Content-Type": "application/json"}
        if self.key_variable:
            if not os.environ.get(self.key_variable):
                raise ValueError(f"{self.key_variable} is not set")
            head["Authorization"] = f"Bearer {os.environ[self.key_variable]}"
        self.pace.wait(len(body))
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, body, head, method="POST"), timeout=self.timeout) as reply:
                return json.loads(reply.read()), reply.headers
        except urllib.error.HTTPError as e:
            raise ServiceError(e.code, e.read(500).decode("utf-8", "replace")) from None
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            raise ServiceError(0, str(e)) from None

    def post(self, value: dict):
        """(reply, headers); asks again after a refusal for the rate, a failure of the service, or no reply."""
        body = json.dumps(value).encode()
        return connectors.with_retries(lambda: self._once(body), lambda e: isinstance(e, ServiceError) and e.again, pause=self.pause)

    def _all(self, call, parts: Sequence) -> list:
        """What `call` says of each part, in their order, some at a time."""
        if len(parts) < 2 or self.workers == 1:
            return [call(p) for p in parts]
        with ThreadPoolExecutor(min(self.workers, len(parts))) as pool:
            return list(pool.map(call, parts))


class EmbeddingClient(_Service):
    """Sends {model, input}, reads {data: [{index, embedding}]}."""

    def __init__(self, url: str, model: str, dim: int = connectors.DIM, **more):
        super().__init__(url, model, **more)
        self.dim = dim

    def _send(self, texts: Sequence[str]) -> list[tuple[int, list[float]]]:
        return [(d["index"], d["embedding"]) for d in self.post({"model": self.model, "input": list(texts)})[0]["data"]]

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        size = connectors.REQUEST_TEXTS
        vectors = [v for part in self._all(lambda p: connectors.in_requests(p, self._send), [texts[i : i + size] for i in range(0, len(texts), size)]) for v in part]
        if any(len(v) != self.dim for v in vectors):
            raise ValueError(f"vectors of {({len(v) for v in vectors})} numbers, not {self.dim}")
        return vectors

    def one(self, text: str) -> list[float]:
        return self([text])[0]

    def probed(self) -> EmbeddingClient:
        """The client with the limits that the headers of a small request's reply name."""
        return self._with(limits=Limits.of(self.post({"model": self.model, "input": ["test"]})[1]))


class SummaryClient(_Service):
    """Sends a prompt as {contents: [{parts: [{text}]}]}, reads the JSON array in the first candidate's text; names that were not asked for are left out."""

    timeout = SUMMARY_TIMEOUT

    def _ask(self, prompt: str) -> list[tuple[str, str]]:
        asked = {"contents": [{"parts": [{"text": prompt}]}], "generationConfig": {"maxOutputTokens": OUTPUT_TOKENS, "temperature": TEMPERATURE}}
        reply = self.post(asked)[0]
        candidates = reply.get("candidates") or [{}]
        parts = (candidates[0].get("content") or {}).get("parts") or [{}]
        return connectors.parse_reply(parts[0].get("text") or "")

    def functions(self, batch: Sequence[dict]) -> list[tuple[str, str]]:
        names = {f["name"] for f in batch}
        return [(n, s) for n, s in self._ask(connectors.function_prompt(batch)) if n in names]

    def entries(self, batch: Sequence[dict]) -> list[tuple[str, str]]:
        paths = {e["path"] for e in batch}
        return [(n, s) for n, s in self._ask(connectors.entry_prompt(batch)) if n in paths]
