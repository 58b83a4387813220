"""Embedding: backends, a deterministic hashing embedder, a cache for query vectors, and bulk embedding of tables."""

from __future__ import annotations

import hashlib
import json
import threading
import urllib.error
import urllib.request
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.columns import content_id, let, words


@runtime_checkable
class EmbeddingBackend(Protocol):
    def encode(self, texts: list[str]) -> list[list[float]]: ...

    def encode_batched(self, texts: list[str], batch_size: int = 64) -> list[list[float]]: ...


class _Batched:
    def encode_batched(self, texts: list[str], batch_size: int = 64) -> list[list[float]]:
        if batch_size < 1:
            raise ValueError("batch_size must be at least 1")
        return [v for i in range(0, len(texts), batch_size) for v in self.encode(texts[i : i + batch_size])]


def hashed_vector(text: Column | str, dim: int = 64) -> Column:
    """Word counts in `dim` buckets by hash, scaled to unit length; all zero for a text without words."""
    bucket = lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")
    count = lambda held: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: (F.size(held) - F.size(F.array_remove(held, d))).cast("double"))
    size = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    scaled = lambda c: let(size(c), lambda z: F.transform(c, lambda x: F.when(z > 0, x / z).otherwise(F.lit(0.0))))
    return let(F.transform(words(text), bucket), lambda held: let(count(held), scaled))


class HashingBackend(_Batched):
    """The same vectors as hashed_vector, for single texts on the driver."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dim
            for w in text.lower().split():
                v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % self.dim] += 1
            size = sum(x * x for x in v) ** 0.5
            out.append([x / size if size else 0.0 for x in v])
        return out


class ModelBackend(_Batched):
    """A sentence-transformers model, if that package is installed; loaded at first use."""

    def __init__(self, model: str = "all-MiniLM-L6-v2"):
        self.model, self._loaded = model, None

    def encode(self, texts: list[str]) -> list[list[float]]:
        if self._loaded is None:
            from sentence_transformers import SentenceTransformer

            self._loaded = SentenceTransformer(self.model)
        return [list(map(float, v)) for v in self._loaded.encode(list(texts))]

    def __getstate__(self):
        return {"model": self.model, "_loaded": None}


def _post(url: str, body: dict, headers: dict[str, str], timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read())
    except urllib.error.URLError as e:
        raise ConnectionError(f"{url}: {e}") from e
    except json.JSONDecodeError as e:
        raise ValueError(f"{url} sent no JSON") from e


class OllamaBackend(_Batched):
    def __init__(self, model: str = "nomic-embed-text", base_url: str = "http://localhost:11434", timeout: float = 30):
        self.model, self.base_url, self.timeout = model, base_url.rstrip("/"), timeout

    def encode(self, texts: list[str]) -> list[list[float]]:
        answer = _post(f"{self.base_url}/api/embed", {"model": self.model, "input": list(texts)}, {}, self.timeout)
        if len(answer.get("embeddings", ())) != len(texts):
            raise ValueError("answer without an embedding of every text")
        return answer["embeddings"]


class OpenAIBackend(_Batched):
    def __init__(self, model: str = "text-embedding-3-small", base_url: str = "https://api.openai.com/v1", api_key: str = "", timeout: float = 30):
        self.model, self.base_url, self.api_key, self.timeout = model, base_url.rstrip("/"), api_key, timeout

    def encode(self, texts: list[str]) -> list[list[float]]:
        headers = {"Authorization": f"Bearer {self.api_key}"} if self.api_key else {}
        rows = _post(f"{self.base_url}/embeddings", {"model": self.model, "input": list(texts)}, headers, self.timeout).get("data")
        if not isinstance(rows, list) or len(rows) != len(texts):
            raise ValueError("answer without an embedding of every text")
        return [r["embedding"] for r in sorted(rows, key=lambda r: r["index"])]


class VLLMBackend(OpenAIBackend):
    def __init__(self, model: str, base_url: str = "http://localhost:8000/v1", api_key: str = "", timeout: float = 30):
        super().__init__(model, base_url, api_key, timeout)


class EmbeddingCache:
    """Least recently used vectors by text, for queries on the driver. Size 0 keeps nothing."""

    def __init__(self, size: int = 1024):
        self.size, self.hits, self.misses = size, 0, 0
        self._held: OrderedDict[str, list[float]] = OrderedDict()
        self._lock = threading.Lock()

    @staticmethod
    def _key(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def __len__(self) -> int:
        return len(self._held)

    def get(self, text: str) -> list[float] | None:
        with self._lock:
            key = self._key(text)
            found = self._held.get(key)
            if found is None:
                self.misses += 1
            else:
                self.hits += 1
                self._held.move_to_end(key)
            return found

    def put(self, text: str, vector: list[float]) -> None:
        with self._lock:
            if self.size > 0:
                self._held[self._key(text)] = vector
                self._held.move_to_end(self._key(text))
                while len(self._held) > self.size:
                    self._held.popitem(last=False)

    def get_or_compute(self, texts: list[str], compute: Callable[[list[str]], list[list[float]]]) -> list[list[float]]:
        found = {t: self.get(t) for t in dict.fromkeys(texts)}
        missing = [t for t, v in found.items() if v is None]
        if missing:
            for t, v in zip(missing, compute(missing)):
                found[t] = v
                self.put(t, v)
        return [found[t] for t in texts]

    def clear(self) -> None:
        with self._lock:
            self._held.clear()
            self.hits = self.misses = 0


def embedded(rows: DataFrame, backend: EmbeddingBackend, text: str = "text", batch_size: int = 64, distinct: bool = True) -> DataFrame:
    """rows with a column `embedding`. Each distinct text is embedded once; the backend reaches each worker once."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(backend.encode_batched(texts.tolist(), batch_size))

    if isinstance(backend, HashingBackend):
        return rows.withColumn("embedding", hashed_vector(text, backend.dim).cast("array<float>"))
    if not distinct:
        return rows.withColumn("embedding", encode(text))
    vectors = rows.where(F.col(text).isNotNull()).groupBy(content_id(text).alias("_key")).agg(F.first(text).alias("_text")).select("_key", encode("_text").alias("embedding"))
    return rows.withColumn("_key", content_id(text)).join(vectors, "_key", "left").drop("_key")
