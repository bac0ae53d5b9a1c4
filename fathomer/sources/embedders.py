"""Embedders: models that turn texts into vectors, called in batches by workers."""

from __future__ import annotations

import hashlib
import json
import os
import random
import re
import time
import urllib.error
import urllib.request
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

BATCH = 2000


class Embedder(Protocol):
    """A model; instances are sent to workers, so they hold settings, not connections."""

    model: str
    dims: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Permanent(RuntimeError):
    """A failure that trying again does not mend."""


@dataclass
class HashingEmbedder:
    """The default without a server: tokens hashed into a unit vector, always alike."""

    dims: int = 256
    model: str = "hashing"

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out, known = [], _Places(self.dims)
        for text in texts:
            found = _TOKEN.findall(_HUMP.sub(r"\1 \2", text).lower())
            counts = np.bincount(np.fromiter(map(known.__getitem__, found), np.int64, len(found)), minlength=2 * self.dims)
            vector = (counts[self.dims :] - counts[: self.dims]).astype(float)
            norm = float(np.sqrt((vector**2).sum()))
            out.append((vector / norm if norm else vector).tolist())
        return out


_TOKEN = re.compile(r"[^\W_]+")
_HUMP = re.compile(r"([a-z0-9])([A-Z])")


class _Places(dict):
    """Where each token counts: its place, and ``dims`` more where it adds; each token of a batch is hashed once."""

    def __init__(self, dims: int) -> None:
        super().__init__()
        self.dims = dims

    def __missing__(self, token: str) -> int:
        h = int.from_bytes(hashlib.md5(token.encode(), usedforsecurity=False).digest()[:4], "big")
        place = self[token] = h % self.dims + self.dims * (h >> 31)
        return place


@dataclass
class ZeroEmbedder:
    """Stands for having no model: vectors of zeros, which indexing does not store."""

    dims: int = 1
    model: str = "none"

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return [[0.0] * self.dims for _ in texts]


def _post(url: str, body: dict, headers: dict[str, str] | None = None, timeout: float = 30.0) -> dict | list:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **(headers or {})})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
            return json.load(answer)
    except urllib.error.HTTPError as problem:
        text = f"{url}: {problem.code} {problem.read()[:300]!r}"
        raise (Permanent if 400 <= problem.code < 500 and problem.code != 429 else RuntimeError)(text) from problem


def _counted(vectors: list, texts: Sequence[str]) -> list:
    if len(vectors) != len(texts):
        raise RuntimeError(f"{len(vectors)} vectors for {len(texts)} texts")
    return vectors


@dataclass
class OllamaEmbedder:
    url: str = "http://localhost:11434"
    model: str = "bge-m3"
    dims: int = 1024

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return _counted(_post(f"{self.url}/api/embed", {"model": self.model, "input": list(texts)})["embeddings"], texts)


@dataclass
class TeiEmbedder:
    url: str = "http://localhost:8080"
    model: str = "all-MiniLM-L6-v2"
    dims: int = 384

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        return _counted(_post(f"{self.url}/embed", {"inputs": list(texts), "truncate": True}), texts)


@dataclass
class OpenAIEmbedder:
    """Any server with the ``/v1/embeddings`` interface; answers are put in order by index."""

    url: str
    model: str
    dims: int
    key: str = ""

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        headers = {"Authorization": f"Bearer {self.key}"} if self.key else {}
        data = _post(f"{self.url.rstrip('/')}/v1/embeddings", {"model": self.model, "input": list(texts)}, headers)["data"]
        found: dict[int, list[float]] = {}
        for item in data:
            i, vector = item["index"], item["embedding"]
            if i in found or not 0 <= i < len(texts) or len(vector) != self.dims:
                raise RuntimeError(f"bad embedding at index {i}: {len(vector)} numbers")
            found[i] = vector
        return _counted([found[i] for i in sorted(found)], texts)


@dataclass
class BedrockEmbedder:
    """A hosted model that takes one text a call; needs boto3."""

    model: str = "amazon.titan-embed-text-v2:0"
    dims: int = 1024
    region: str = "us-east-1"
    max_bytes: int = 28_000
    #: Calls at a time.
    concurrent: int = 8

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        try:
            import boto3
        except ImportError as problem:
            raise Permanent("boto3 is not installed") from problem
        client = boto3.client("bedrock-runtime", region_name=self.region)

        def one(text: str) -> list[float]:
            short = text.encode()[: self.max_bytes].decode("utf-8", "ignore")
            body = json.dumps({"inputText": short, "dimensions": self.dims, "normalize": True})
            return json.loads(client.invoke_model(modelId=self.model, body=body)["body"].read())["embedding"]

        with ThreadPoolExecutor(self.concurrent) as pool:
            return list(pool.map(one, texts))


@dataclass
class Retrying:
    """Tries again, waiting ``wait`` seconds doubled each time, give or take a quarter."""

    inner: Embedder
    retries: int = 3
    wait: float = 0.1
    sleep: Callable[[float], None] = time.sleep

    @property
    def model(self) -> str:
        return self.inner.model

    @property
    def dims(self) -> int:
        return self.inner.dims

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        for attempt in range(self.retries + 1):
            try:
                return self.inner.embed(texts)
            except Permanent:
                raise
            except Exception:
                if attempt == self.retries:
                    raise
                self.sleep(self.wait * 2**attempt * random.uniform(0.75, 1.25))  # noqa: S311
        raise AssertionError


@dataclass
class Caching:
    """Remembers the vectors of the last ``size`` queries, first in, first out."""

    inner: Embedder
    size: int = 512
    _known: OrderedDict = field(default_factory=OrderedDict)

    def __call__(self, query: str) -> list[float]:
        if query not in self._known:
            vector = self.inner.embed([query])[0]
            if len(self._known) >= self.size:
                self._known.popitem(last=False)
            self._known[query] = vector
        return list(self._known[query])


def cache_trace(spark: SparkSession, queries: Sequence, *, size: int = 512) -> DataFrame:
    """``step, query, asked``: how many queries had reached the model after each step."""
    asked: list[str] = []

    class Counting(HashingEmbedder):
        def embed(self, texts: Sequence[str]) -> list[list[float]]:
            asked.extend(texts)
            return super().embed(texts)

    cached, rows = Caching(Counting(4), size=size), []
    for step, query in enumerate(queries, 1):
        cached(str(query))
        rows.append((step, query, len(asked)))
    return spark.createDataFrame(rows, "step long, query long, asked long")


def answers(url: str, timeout: float = 1.0) -> bool:
    """Whether a server answers at an address."""
    try:
        with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
            return answer.status == 200
    except (OSError, ValueError):
        return False


def detect(settings: dict[str, str] | None = None) -> Embedder:
    """An embedder by settings (default: the environment).

    Without a backend, or with ``auto``, a text-embeddings server is looked for,
    then an Ollama server, each at its set or default address; without either the
    hashing embedder serves.
    """
    s = os.environ if settings is None else settings
    backend = s.get("FATHOMER_EMBED_BACKEND", "")
    if backend in ("", "auto"):
        url = s.get("FATHOMER_EMBED_URL")
        found = [name for name, base, path in (("tei", TeiEmbedder.url, "/health"), ("ollama", OllamaEmbedder.url, "/api/tags")) if answers((url or base).rstrip("/") + path)]
        backend = found[0] if found else "hashing"
    if backend == "openai":
        return Retrying(OpenAIEmbedder(s["FATHOMER_EMBED_URL"], s["FATHOMER_EMBED_MODEL"], int(s["FATHOMER_EMBED_DIMS"]), s.get("FATHOMER_EMBED_KEY", "")))
    if backend == "bedrock":
        return Retrying(BedrockEmbedder(region=s.get("AWS_REGION", "us-east-1")), retries=5, wait=0.5)
    if backend == "tei":
        return Retrying(TeiEmbedder(s.get("FATHOMER_EMBED_URL", TeiEmbedder.url)))
    if backend == "ollama":
        return Retrying(OllamaEmbedder(s.get("FATHOMER_EMBED_URL", OllamaEmbedder.url), s.get("FATHOMER_EMBED_MODEL", OllamaEmbedder.model)))
    if backend == "none":
        return ZeroEmbedder()
    if backend == "hashing":
        return HashingEmbedder()
    raise ValueError(f"unknown embedding backend {backend!r}")


def embed_rows(rows: DataFrame, embedder: Embedder, *, batch: int = BATCH, in_flight: int = 2) -> DataFrame:
    """``symbol_id, model, dims, vector`` for ``rows`` (``symbol_id, text``).

    Each task keeps ``in_flight`` batches under way.  A batch that fails is tried
    text by text; texts that fail alone are left out, and a later backfill finds
    them missing.
    """

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                yield part.iloc[at : at + batch]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: deque = deque()
        with ThreadPoolExecutor(in_flight) as pool:
            for some in batches(parts):
                waiting.append(pool.submit(_embedded, some["symbol_id"].tolist(), some["text"].tolist(), embedder))
                if len(waiting) >= in_flight:
                    yield waiting.popleft().result()
            while waiting:
                yield waiting.popleft().result()

    return rows.select("symbol_id", "text").mapInPandas(run, f"symbol_id {rows.schema['symbol_id'].dataType.simpleString()}, model string, dims int, vector array<float>")


def _embedded(ids: list, texts: list[str], embedder: Embedder) -> pd.DataFrame:
    try:
        vectors: list = embedder.embed(texts)
    except Exception:
        vectors = []
        for text in texts:
            try:
                vectors.append(embedder.embed([text])[0])
            except Exception:
                vectors.append(None)
    rows = [(i, embedder.model, len(v), np.asarray(v, np.float32)) for i, v in zip(ids, vectors, strict=True) if v is not None]
    return pd.DataFrame(rows, columns=["symbol_id", "model", "dims", "vector"])
