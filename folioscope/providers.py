"""Model calls as plain functions, with deterministic offline defaults. Real services are passed in their place.

An embedder turns texts into vectors, a backend turns a system and a user prompt into an answer, a reranker scores texts for
a question. They run inside tasks, batch by batch; a client that can't be pickled is made once per worker by `per_worker`.
"""

from __future__ import annotations

import hashlib
import json
import logging
import math
import re
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[list[str]], list[list[float]]]
Reranker = Callable[[str, list[str]], "list[float] | dict"]
Backend = Callable[[str, str], str]
log = logging.getLogger(__name__)
_clients: dict[str, Any] = {}
_probes: dict[str, tuple[bool, str | None]] = {}


class TooLong(RuntimeError):
    """A text that the embedding model can't take as a whole; splitting it helps, trying again doesn't."""


def per_worker(name: str, make: Callable[[], Any]) -> Any:
    """The client of this name in this process, made at first use."""
    if name not in _clients:
        _clients[name] = make()
    return _clients[name]


def reset_clients() -> None:
    _clients.clear()
    _probes.clear()


def hashing_embedder(dims: int = 96, most: int | None = None) -> Embedder:
    """Words and word pairs hashed with signs into `dims` numbers of length 1; the same everywhere. Texts of more than `most`
    words are too long, as for a model with a bounded context."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            words = re.findall(r"[a-z0-9]+", text.lower())
            if most is not None and len(words) > most:
                raise TooLong(f"{len(words)} words, at most {most}")
            v = [0.0] * dims
            for item in [*words, *map(" ".join, zip(words, words[1:]))]:
                h = int.from_bytes(hashlib.blake2b(item.encode(), digest_size=8).digest(), "little")
                v[h % dims] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out

    return embed


def with_retries(call: Callable, attempts: int = 3, waits: tuple[float, ...] = (1.0, 2.0, 4.0), sleep: Callable[[float], None] = time.sleep) -> Callable:
    """The same call, tried again after a pause when it fails; a text that is too long fails at once."""

    def run(*args):
        for n in range(attempts):
            try:
                return call(*args)
            except TooLong:
                raise
            except Exception:  # noqa: BLE001 (any failure of an outside service)
                if n + 1 == attempts:
                    raise
                if waits:
                    sleep(waits[min(n, len(waits) - 1)])

    return run


def probe(name: str, check: Callable[[], str | None]) -> tuple[bool, str | None]:
    """(works, warning) of a service, asked once per process; check returns a warning or raises."""
    if name not in _probes:
        try:
            warning = check()
        except Exception as problem:  # noqa: BLE001
            warning = str(problem)
        _probes[name] = (warning is None, warning)
    return _probes[name]


def probe_embedder(embedder: Embedder, dims: int) -> tuple[bool, str | None]:
    """Whether the embedder answers, and with vectors of `dims` numbers."""
    try:
        got = embedder(["a short text"])
    except Exception as problem:  # noqa: BLE001
        return False, str(problem)
    size = len(got[0]) if got else 0
    return (True, None) if size == dims else (False, f"the embedder gives {size} numbers, {dims} are expected")


def embed(rows: DataFrame, key: str, text: str, embedder: Embedder, dims: int, batch: int = 512) -> DataFrame:
    """key, vector, in batches. A vector of another width than dims is an error; null text counts as empty."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in range(0, len(pdf), batch):
                part = pdf.iloc[s : s + batch]
                vectors = embedder([t if isinstance(t, str) else "" for t in part["t"]])
                if any(len(v) != dims for v in vectors):
                    raise ValueError(f"the embedder must give {dims} numbers")
                yield pd.DataFrame({"k": part["k"].to_numpy(), "vector": vectors})

    return rows.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, vector array<float>").withColumnRenamed("k", key)


def embed_question(embedder: Embedder, text: str, instruction: str | None = None) -> list[float]:
    """The vector of a question, with what the model wants to be told before it, if anything."""
    return embedder([(instruction or "") + text if (instruction or "").strip() else text])[0]


def answer(system: str, user: str, backends: list[Backend]) -> str:
    """The answer of the first backend that gives one; empty if all fail."""
    for backend in backends:
        try:
            if text := backend(system, user):
                return text
        except Exception as problem:  # noqa: BLE001
            log.warning("a backend failed: %s", problem)
    return ""


def ask(rows: DataFrame, key: str, system: str, user: str, backends: list[Backend]) -> DataFrame:
    """key, raw: the answer to each row's prompt (column `user`); a row whose backends all fail has none and is left out."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = [answer(system, u, backends) if isinstance(u, str) else "" for u in pdf["u"]]
            out = pd.DataFrame({"k": pdf["k"], "raw": raw})
            yield out[out["raw"] != ""]

    return rows.select(F.col(key).alias("k"), F.col(user).alias("u")).mapInPandas(run, f"k {kind}, raw string").withColumnRenamed("k", key)


def in_portions(rows: DataFrame, key: str, size: int, work: Callable[[DataFrame], DataFrame], commit: Callable[[DataFrame], None]) -> int:
    """Portions of about `size` rows, by a hash of the key, worked on and committed one after the other, so that what is done
    stays done if a later one fails. Returns how many portions there were."""
    n = max(1, -(-rows.count() // size))
    for i in range(n):
        commit(work(rows.filter(F.pmod(F.xxhash64(key), F.lit(n)) == i)))
    return n


def _sentences(user: str) -> tuple[list[str], list[str]]:
    body, _, tail = user.rpartition("\n\nEntities:\n")
    names = [line[2:] for line in tail.split("\n\n")[0].split("\n") if line.startswith("- ")]
    return re.split(r"(?<=[.!?])\s+", body.removeprefix("Text:\n")), names


def offline_relations(system: str, user: str) -> str:
    """A backend without a model: entities that one sentence names are related by the first predicate there is."""
    sentences, names = _sentences(user)
    predicates = user.rpartition("\n\nPredicates: ")[2].split(", ") if "\n\nPredicates: " in user else []
    found = []
    for sentence in sentences:
        low = sentence.lower()
        here = sorted((low.index(w), n) for n in names if (w := n.replace("_", " ")) in low)
        found += [{"subject": a, "predicate": predicates[0], "object": b, "confidence": 0.5} for (_, a), (_, b) in zip(here, here[1:]) if predicates]
    return json.dumps({"relations": found})


def offline_claims(system: str, user: str) -> str:
    """A backend without a model: every sentence that names an entity is a claim about it."""
    sentences, names = _sentences(user)
    found = []
    for sentence in sentences:
        low = sentence.lower()
        here = sorted((low.index(w), n) for n in names if (w := n.replace("_", " ")) in low)
        if here:
            found.append({"claim_text": sentence, "subject": here[0][1], "object": here[1][1] if len(here) > 1 else None, "claim_type": "assertion", "confidence": 0.5})
    return json.dumps({"claims": found})


def scores_of(payload: Any, n: int) -> list[tuple[int, float]]:
    """(place, score) pairs of a reranker's answer: a list of scores, or an object whose `results` have index and
    relevance_score. Items of other types or out of range are left out."""
    if isinstance(payload, dict):
        items = payload.get("results")
        rows = [(x.get("index"), x.get("relevance_score")) for x in items if isinstance(x, dict)] if isinstance(items, list) else []
    else:
        rows = list(enumerate(payload))
    good = lambda i, s: isinstance(i, int) and not isinstance(i, bool) and 0 <= i < n and isinstance(s, (int, float)) and not isinstance(s, bool)
    return [(i, float(s)) for i, s in rows if good(i, s)]


def rerank(question: str, candidates: list[tuple[str, str]], reranker: Reranker | None) -> tuple[list[str], bool, list[str]]:
    """(ids in the new order, whether it was applied, warnings). Without a reranker, or if it fails, the order stays."""
    ids = [i for i, _ in candidates]
    if reranker is None:
        return ids, False, ["no reranker is set: dense order kept"]
    try:
        scores = scores_of(reranker(question, [t for _, t in candidates]), len(ids))
    except Exception as problem:  # noqa: BLE001
        return ids, False, [f"reranking failed: {problem}"]
    if not scores:
        return ids, False, ["the reranker gave no usable score: dense order kept"]
    return [ids[i] for i, _ in sorted(scores, key=lambda x: -x[1])], True, []
