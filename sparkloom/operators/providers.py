"""Embedding, reranking and completion providers behind small interfaces.

Models are external: a provider either computes a deterministic stand-in or talks to a server. Servers are reached by
`post(url, body, headers) -> dict`, a parameter, so that a test needs no network. Providers are made once for each
worker and must be picklable before first use.
"""

from __future__ import annotations

import json
import zlib
from collections import OrderedDict
from collections.abc import Callable
from typing import Protocol

import numpy as np

QUERY_PREFIX = "search_query: "
Post = Callable[[str, dict, dict], dict]


class EmbeddingProvider(Protocol):
    """Turns texts into vectors."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def post_json(url: str, body: dict, headers: dict) -> dict:
    """One request over HTTP."""
    import urllib.request

    data = json.dumps(body).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=60) as answer:
        return json.loads(answer.read())


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v * v).sum())
    return v / n if n else v


class HashingProvider:
    """Deterministic stand-in for a model: signed feature hashing of tokens, length 1."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [_unit(sum(self.tokens(t), np.zeros(self.dimensions))).tolist() for t in texts]

    def tokens(self, text: str) -> list[np.ndarray]:
        """A vector for each token."""
        out = []
        for w in text.lower().split():
            h, v = zlib.crc32(w.encode("utf-8", "surrogatepass")), np.zeros(self.dimensions)
            v[h % self.dimensions] = 1 if h & 0x80000000 else -1
            out.append(v)
        return out


class PooledProvider:
    """Mean of the vectors of a text's first most_tokens tokens, of length 1; model.tokens(text) gives the vectors.

    prefix goes in front of queries only (embed_query).
    """

    def __init__(self, model, most_tokens: int = 512, prefix: str = QUERY_PREFIX):
        self.model, self.most_tokens, self.prefix = model, most_tokens, prefix

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self._pooled(t) for t in texts]

    def embed_query(self, text: str) -> list[float]:
        return self._pooled(self.prefix + text)

    def embed_tokens(self, text: str) -> list[list[float]]:
        return [_unit(np.asarray(v, float)).tolist() for v in self.model.tokens(text)[: self.most_tokens]]

    def _pooled(self, text: str) -> list[float]:
        found = self.model.tokens(text)[: self.most_tokens]
        return _unit(np.mean(found, 0)).tolist() if found else []


#: Modes of local models: tokens read, and dimensions of the vectors.
MODES = {"fast": (512, 384), "balanced": (512, 768), "code": (8192, 768)}


def local_provider(mode: str, make: Callable[[int], object] = HashingProvider) -> PooledProvider:
    """The provider of a mode; make(dimensions) gives its token model."""
    most, dimensions = MODES[mode]
    return PooledProvider(make(dimensions), most)


class EndpointProvider:
    """An embeddings endpoint of the usual form: {model, input} in, data[].{index, embedding} out."""

    def __init__(self, url: str, model: str, key: str | None = None, post: Post = post_json):
        self.url, self.model, self.key, self.post = url, model, key, post

    def embed(self, texts: list[str]) -> list[list[float]]:
        headers = {"Authorization": f"Bearer {self.key}"} if self.key else {}
        rows = self.post(self.url, {"model": self.model, "input": texts}, headers)["data"]
        if len(rows) != len(texts):
            raise ValueError(f"{len(rows)} vectors for {len(texts)} texts")
        return [r["embedding"] for r in sorted(rows, key=lambda r: r.get("index", 0))]


class LocalServer:
    """A local model server: vectors, token vectors, scores of texts for a query, and whether it is up."""

    def __init__(self, url: str = "http://127.0.0.1:8765", post: Post = post_json):
        self.url, self.post = url.rstrip("/"), post

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self.post(f"{self.url}/embeddings", {"input": texts}, {})["embeddings"]

    def embed_tokens(self, texts: list[str]) -> list[list[list[float]]]:
        return self.post(f"{self.url}/colbert_embeddings", {"input": texts}, {})["embeddings"]

    def scores(self, query: str, texts: list[str]) -> list[float]:
        """For search.rerank()."""
        found = self.post(f"{self.url}/rerank", {"query": query, "documents": texts}, {})["results"]
        out = [0.0] * len(texts)
        for r in found:
            out[r["index"]] = float(r["score"])
        return out

    def up(self) -> bool:
        try:
            return self.post(f"{self.url}/health", {}, {}).get("status") == "ok"
        except OSError:
            return False


class EndpointReranker:
    """A reranking endpoint of the usual form: {model, query, documents} in, results[].{index, relevance_score} out."""

    def __init__(self, url: str, model: str, key: str, post: Post = post_json):
        self.url, self.model, self.key, self.post = url, model, key, post

    def scores(self, query: str, texts: list[str]) -> list[float]:
        body = {"model": self.model, "query": query, "documents": texts, "top_n": len(texts)}
        out = [0.0] * len(texts)
        for r in self.post(self.url, body, {"Authorization": f"Bearer {self.key}"})["results"]:
            out[r["index"]] = float(r["relevance_score"])
        return out


#: Reranking services in the order they are tried: name, endpoint, model.
RERANKERS = [
    ("jina", "https://api.jina.ai/v1/rerank", "jina-reranker-v2-base-multilingual"),
    ("cohere", "https://api.cohere.ai/v1/rerank", "rerank-english-v3.0"),
]


def reranker(keys: dict[str, str], post: Post = post_json) -> Callable[[str, list[str]], list[float]] | None:
    """The scorer of the first service that a key is given for; None, for search.rerank() to leave the order, without one."""
    for name, url, model in RERANKERS:
        if keys.get(name):
            return EndpointReranker(url, model, keys[name], post).scores
    return None


class CachedProvider:
    """Keeps the vectors of the last `most` different texts."""

    def __init__(self, inner: EmbeddingProvider, most: int = 10_000):
        self.inner, self.most = inner, most
        self.known: OrderedDict[str, list[float]] = OrderedDict()

    def embed(self, texts: list[str]) -> list[list[float]]:
        fresh = [t for t in dict.fromkeys(texts) if t not in self.known]
        found = dict(zip(fresh, self.inner.embed(fresh))) if fresh else {}
        out = [found[t] if t in found else self.known[t] for t in texts]
        for t, v in zip(texts, out):
            self.known[t] = v
            self.known.move_to_end(t)
        while len(self.known) > self.most:
            self.known.popitem(last=False)
        return out


def provider(name: str, **options) -> EmbeddingProvider:
    """By the name in the settings: hashing, local or openai."""
    made = {"hashing": HashingProvider, "local": lambda mode="balanced", **o: local_provider(mode, **o), "openai": EndpointProvider}
    if name not in made:
        raise ValueError(f"unknown provider {name}")
    return made[name](**options)


def query_vector(own: EmbeddingProvider, text: str) -> list[float]:
    """A provider's vector of a query, by its own way for queries where it has one."""
    return own.embed_query(text) if hasattr(own, "embed_query") else own.embed([text])[0]
