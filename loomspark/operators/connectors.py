"""Embedders and summarizers: protocols, deterministic defaults that need no network, and what real ones share."""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
from collections.abc import Callable, Sequence
from typing import Protocol

# The request limits of the data model.
DIM = 1536
REQUEST_TEXTS = 100
ATTEMPTS = 3
SUMMARY_BATCH = 50
PROMPT_CHARS = 1500


class Embedder(Protocol):
    dim: int

    def __call__(self, texts: Sequence[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Signed feature hashing of words and their three-letter pieces, scaled to length 1: equal texts have equal vectors everywhere."""

    def __init__(self, dim: int = DIM):
        self.dim = dim

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        return [self.one(t) for t in texts]

    def one(self, text: str) -> list[float]:
        v = [0.0] * self.dim
        for w in re.findall(r"\w+", text.lower()):
            for piece in {w, *(f"<{w}>"[i : i + 3] for i in range(len(w)))}:
                h = int.from_bytes(hashlib.md5(piece.encode(), usedforsecurity=False).digest()[:8], "big")
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in v))
        return [x / norm for x in v] if norm else v


class FirstSentence:
    """Extractive summaries: a doc's first sentence, else the symbols."""

    def functions(self, batch: Sequence[dict]) -> list[tuple[str, str]]:
        return [(f["name"], self._first(f["body"])) for f in batch]

    def entries(self, batch: Sequence[dict]) -> list[tuple[str, str]]:
        return [(e["path"], ", ".join(e["symbols"][:5])) for e in batch]

    @staticmethod
    def _first(text: str) -> str:
        line = next((x.strip() for x in text.split("\n") if x.strip()), "")
        return re.split(r"(?<=[.!?])\s", line)[0][:120]


def with_retries(call: Callable[[], object], again: Callable[[Exception], bool], attempts: int = ATTEMPTS, pause: float = 1.0, sleep=time.sleep):
    """Calls again after failures that allow it, waiting twice as long each time."""
    for n in range(attempts):
        try:
            return call()
        except Exception as e:  # noqa: BLE001
            if n + 1 == attempts or not again(e):
                raise
            sleep(pause * 2**n)


def in_requests(texts: Sequence[str], send: Callable[[Sequence[str]], Sequence[tuple[int, list[float]]]], size: int = REQUEST_TEXTS) -> list[list[float]]:
    """Sends texts in requests; replies (index, vector) may come in any order, but none may be missing."""
    out: list[list[float]] = []
    for i in range(0, len(texts), size):
        part = texts[i : i + size]
        reply = sorted(send(part))
        if [k for k, _ in reply] != list(range(len(part))):
            raise ValueError(f"{len(reply)} vectors for {len(part)} texts")
        out += [v for _, v in reply]
    return out


def concurrency(requests_per_minute: float, tokens_per_minute: float) -> int:
    """Requests at a time that a service's limits allow: 5 to 50."""
    best = requests_per_minute / 140
    if tokens_per_minute < 1_000_000:
        best = min(best, tokens_per_minute / 8000 / 30)
    return int(max(5, min(50, best)))


def batch_size(concurrent: int) -> int:
    return max(500, min(2000, concurrent * 20))


def dealt(rows, service):
    """(rows, service): over as many tasks as a service takes requests at a time, each with its share of the rate; as they are, if there is no service."""
    if not hasattr(service, "shared"):
        return rows, service
    tasks = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, service.limits.concurrent))
    return rows.repartition(tasks), service.shared(tasks)


def function_prompt(batch: Sequence[dict]) -> str:
    """Numbered functions with their sizes, what is known of their callees, and their bodies, cut."""
    parts = []
    for i, f in enumerate(batch, 1):
        known = "".join(f"\n  - {n}: {s}" for n, s in sorted(f.get("calls", {}).items()))
        parts.append(f"{i}. {f['name']} ({len(f['body'].splitlines())} lines)" + (f"\nCalls:{known}" if known else "") + f"\n{f['body'][:PROMPT_CHARS]}")
    return "Summarise each function in one short sentence. Reply with a JSON array of {name, summary}.\n\n" + "\n\n".join(parts)


def entry_prompt(batch: Sequence[dict]) -> str:
    parts = [f"{i}. [{e['kind']}] {e['path']}: {', '.join(e['symbols'])}" for i, e in enumerate(batch, 1)]
    return "Summarise each entry in a few words. Reply with a JSON array of {name, summary}.\n\n" + "\n".join(parts)


def parse_reply(text: str) -> list[tuple[str, str]]:
    """The (name, summary) pairs of the JSON array that stands in a reply."""
    a, b = text.find("["), text.rfind("]")
    if a < 0 or b < a:
        raise ValueError("no JSON array in the reply")
    return [(x["name"], x["summary"]) for x in json.loads(text[a : b + 1])]
