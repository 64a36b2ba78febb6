"""Personal data: base patterns, and a skip-chain conditional random field that adds what they miss.

Base: email, ip, card and phone patterns with their checks, leftmost and not overlapping within a kind. They are
searched in time linear in the text, whatever it holds. A fifth kind, secret, has no base pattern: its seeds are values
that a text assigns to a name such as token, key or password. Seeds are added spans, never base ones.

The field has a node for each token (run of other than white space) with a digit or an @; every other token is
outside by definition of the model. Every document takes part. Neighbouring nodes are joined by chain edges, and each
node by a skip edge to the previous one of the document with the same key, however far apart they are; a key of any
number of tokens costs one edge for each. Tokens without letters that follow one another are one number: where it has
seven digits or more, the key is its last seven and the token's place counted from its end, so a number is found again
with other groups in front. Any other token's key is its letters and digits, lower-cased. Damped loopy belief
propagation, run for all documents of a batch at once in numpy, gives each node a distribution over outside and the
kinds. Nodes that a base span or a seed covers are clamped to its kind. Runs of other nodes that get one kind with a
probability of at least `confident` are added, without the punctuation around them; base spans always stay.

The weights are learned here by pseudo-likelihood, with base spans and seeds as labels, from the nodes of at most
sample_docs documents of at most sample_chars characters that hold nodes (those of the least hash of their id, then of
their text). Everything else covers all documents and whole tokens.

Null texts count as empty and have no spans. Rows are independent: repeated rows repeat their result. Columns of docs
with the names of results are replaced, others pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.batches import slices

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HAS = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_SECRET = re.compile(r"""(?i)(?<![a-z])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[ \t]*[=:][ \t]*["']?([A-Za-z0-9+/_=-]{16,})""")
ALL_KINDS = (*KINDS, "secret")
Span = tuple[int, int, int]  # start, index of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, before, at = 0, 0, text.find("@")
    while at >= 0:
        head = text[max(free, before) : at]
        n = len(head) - len(head.rstrip(_LOCAL))
        if n and (m := _DOMAIN.match(text, at + 1)):
            yield at - n, m.end()
            free = m.end()
        before = at + 1
        at = text.find("@", max(at + 1, free))


def _byte(digits: str) -> bool:
    """Whether ASCII digits, however many, are a number of at most 255."""
    value = digits.lstrip("0")
    return len(value) < 3 or len(value) == 3 and value <= "255"


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        parts, at, i = run[0].split("."), run.start(), 0
        starts = []
        for p in parts:
            starts.append(at)
            at += len(p) + 1
        while i + 3 < len(parts):
            if all(parts[i : i + 4]):
                if all(_byte(p) for p in parts[i : i + 4]):
                    yield starts[i], starts[i + 3] + len(parts[i + 3])
                i += 4
            else:
                i += 1


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns in order of start, then kind."""
    if not text or not _HAS.search(text):
        return []
    out = [(a, 0, b) for a, b in _emails(text)] + [(a, 1, b) for a, b in _ips(text)]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def seeds(text: str) -> list[Span]:
    """Values of at least 16 characters with a digit that are assigned to the name of a secret."""
    return [(m.start(1), 4, m.end(1)) for m in _SECRET.finditer(text) if _HAS.search(m[1])]


FEATURES = 30
_EDGE = " .,;:!?\"'()[]{}<>*#$%&|"


def _features(token: str, before: str, after: str) -> np.ndarray:
    x = np.zeros(FEATURES)
    number = "".join(c for c in token if "0" <= c <= "9")
    digits, bare = len(number), token.strip(_EDGE)
    x[0] = 1
    x[1] = "@" in token
    x[2] = "@" in token and "." in token.rpartition("@")[2].strip(".,;:!?")
    x[3] = token.startswith(("+", "(+"))
    x[4] = "(" in token
    x[5 + min(digits, 7) // 2] = 1  # 0-1, 2-3, 4-5, 6 and more
    x[9] = bare.count(".") == 3
    x[10] = bare.count(".") in (1, 2)
    x[11] = "-" in token
    x[12] = 12 <= digits <= 19
    x[13] = digits == 4
    x[14] = any(c.isalpha() for c in token)
    x[15] = digits == len(token)
    x[16] = before.startswith("+")
    x[17] = any(c.isdigit() for c in before)
    x[18] = any(c.isdigit() for c in after)
    x[19] = before.isdigit() and len(before) == 4
    x[20] = after.isdigit() and len(after) == 4
    x[21] = before.startswith("(")
    x[22] = after.startswith("(")
    x[23] = "/" in token or ":" in token
    x[24] = 12 <= digits <= 19 and luhn(number)
    x[25] = x[9] and all(p.isascii() and p.isdigit() and len(p) <= 3 and _byte(p) for p in bare.split("."))
    x[26] = len(bare) >= 16 and x[14]
    x[27] = len(bare) >= 16 and x[14] and bare.isalnum()
    x[28] = before[-1:] in ("=", ":")
    x[29] = 9 <= digits <= 15 and not x[14]
    return x


class Graph:
    """Nodes, edges, features and labels (-1: none) of one document."""

    def __init__(self, text: str, spans: list[Span]):
        self.at: list[tuple[int, int]] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        rows, tokens, before, waiting, follows = [], [], "", "", False
        for m in _TOKEN.finditer(text):
            token = m[0]
            if waiting:
                rows.append(_features(tokens[-1], waiting[0], token))
            if _HAS.search(token):
                if follows:
                    self.chain.append((len(self.at) - 1, len(self.at)))
                self.at.append(m.span())
                tokens.append(token)
                waiting, follows = (before,), True
            else:
                waiting, follows = "", False
            before = token
        if waiting:
            rows.append(_features(tokens[-1], waiting[0], ""))
        last: dict = {}
        for i, key in enumerate(self._keys(tokens)):
            if key in last:
                self.skip.append((last[key], i))
            if key:
                last[key] = i
        self.x = np.array(rows) if rows else np.zeros((0, FEATURES))
        self.label = np.full(len(tokens), -1)
        starts = np.array([a for a, _ in self.at])
        ends = np.array([b for _, b in self.at])
        for a, k, b in spans:
            self.label[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = k

    def _keys(self, tokens: list[str]) -> list:
        keys: list = ["".join(c for c in t.lower() if c.isalnum()) for t in tokens]
        joined = {b for _, b in self.chain}
        plain = [not any(c.isalpha() for c in t) for t in tokens]
        i = 0
        while i < len(tokens):
            end = i + 1
            while end < len(tokens) and plain[i] and plain[end] and end in joined:
                end += 1
            digits = "".join(c for t in tokens[i:end] for c in t if "0" <= c <= "9") if plain[i] else ""
            if len(digits) >= 7:
                keys[i:end] = [(digits[-7:], end - j) for j in range(i, end)]
            i = end
        return keys

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of nodes, and whether each is a skip edge."""
        pairs = np.array(self.chain + self.skip, dtype=np.int64).reshape(-1, 2)
        return pairs, np.arange(len(pairs)) >= len(self.chain)


def fit(graphs: list[Graph], steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> dict:
    """Weights of the nodes (features by label), and of agreement along chain and skip edges, by pseudo-likelihood."""
    k = len(ALL_KINDS) + 1
    x = np.concatenate([g.x for g in graphs] or [np.zeros((0, FEATURES))])
    y = np.concatenate([g.label for g in graphs] or [np.zeros(0, np.int64)]).astype(int) + 1
    node, edge = np.zeros((FEATURES, k)), np.zeros(2)
    if not len(x):
        return {"node": node, "edge": edge}
    around = np.zeros((2, len(x), k))
    base = 0
    for g in graphs:
        pairs, skip = g.edges()
        for (a, b), s in zip(pairs + base, skip):
            around[int(s), a, y[b]] += 1
            around[int(s), b, y[a]] += 1
        base += len(g.label)
    around = np.minimum(around, 2)
    target = np.eye(k)[y]
    for _ in range(steps):
        score = x @ node + np.tensordot(edge, around, 1)
        p = np.exp(score - score.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        miss = (target - p) / len(x)
        node += rate * (x.T @ miss - decay * node)
        edge += rate * ((around * miss).sum((1, 2)) - decay * edge)
    return {"node": node, "edge": np.maximum(edge, 0)}


def marginals(x: np.ndarray, label: np.ndarray, pairs: np.ndarray, skip: np.ndarray, model: dict, rounds: int = 12, damping: float = 0.3) -> np.ndarray:
    """Loopy belief propagation over all nodes at once; clamped where label >= 0."""
    k = len(ALL_KINDS) + 1
    score = x @ model["node"]
    clamped = label >= 0
    score[clamped] = -50.0
    score[clamped, label[clamped] + 1] = 0
    score -= score.max(1, keepdims=True)
    if len(pairs):
        to = np.concatenate([pairs[:, 1], pairs[:, 0]])
        source = np.concatenate([pairs[:, 0], pairs[:, 1]])
        back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        gain = np.expm1(model["edge"][np.concatenate([skip, skip]).astype(int)])[:, None]
        message = np.zeros((len(to), k))
        for _ in range(rounds):
            belief = score.copy()
            np.add.at(belief, to, message)
            out = belief[source] - message[back]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.log(out.sum(1, keepdims=True) + gain * out)  # agreement has the edge's weight, disagreement none
            new -= new.max(1, keepdims=True)
            message = damping * message + (1 - damping) * new
        score = score.copy()
        np.add.at(score, to, message)
    p = np.exp(score - score.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(texts: list[str], bases: list[list[Span]], model: dict, confident: float = 0.9) -> list[list[Span]]:
    """What seeds and the field add to the base spans of each text."""
    added: list[list[Span]] = [[] for _ in texts]
    graphs = []
    for i, (t, b) in enumerate(zip(texts, bases)):
        if t and _HAS.search(t):
            added[i] = seeds(t)
            graphs.append((i, Graph(t, [*added[i], *b])))
    if not graphs:
        return added
    first = np.cumsum([0, *(len(g.label) for _, g in graphs)])
    edges = [g.edges() for _, g in graphs]
    pairs = np.concatenate([p + at for (p, _), at in zip(edges, first)])
    p = marginals(np.concatenate([g.x for _, g in graphs]), np.concatenate([g.label for _, g in graphs]), pairs, np.concatenate([s for _, s in edges]), model)
    kinds, sure = p.argmax(1) - 1, p.max(1) >= confident
    for (i, g), at in zip(graphs, first):
        kind = kinds[at : at + len(g.label)]
        new = np.flatnonzero(sure[at : at + len(g.label)] & (kind >= 0) & (g.label < 0))
        follows = {b for _, b in g.chain}
        runs: list[list[int]] = []
        for n in new.tolist():
            if runs and runs[-1][-1] == n - 1 and n in follows and kind[n] == kind[n - 1]:
                runs[-1].append(n)
            else:
                runs.append([n])
        for run in runs:
            a, b = g.at[run[0]][0], g.at[run[-1]][1]
            part = texts[i][a:b]
            a, b = a + len(part) - len(part.lstrip(_EDGE)), b - len(part) + len(part.rstrip(_EDGE))
            if a < b:
                added[i].append((a, int(kind[run[0]]), b))
    return added


def shown(spans: list[Span]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{a}:{b}" for a, k, b in spans)


def trained(docs: DataFrame, sample_docs: int = 2000, sample_chars: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> dict:
    """The model. What reaches the driver is at most sample_docs texts of at most sample_chars characters."""
    order = [F.xxhash64(F.col(doc_id).cast("string")).alias("h"), F.xxhash64(text).alias("t")]
    with_nodes = docs.where(F.col(text).rlike("[0-9@]") & (F.length(text) <= sample_chars)).select(*order, F.col(text).alias("text"))
    last = with_nodes.select("h", "t").orderBy("h", "t").limit(sample_docs).agg(F.max(F.struct("h", "t"))).first()[0]
    if last is None:
        return fit([])
    inside = (F.col("h") < last.h) | ((F.col("h") == last.h) & (F.col("t") <= last.t))
    rows = sorted(with_nodes.where(inside).limit(sample_docs).collect())  # beyond the limit only rows that equal the last
    return fit([Graph(r.text, [*seeds(r.text), *base_spans(r.text)]) for r in rows])


def find(docs: DataFrame, model: dict | None = None, confident: float = 0.9, doc_id: str = "doc_id", text: str = "text", masked: bool = False) -> DataFrame:
    """docs with n_email, n_ip, n_card, n_phone, base_sha256, spans and n_spans; without the text, or with it masked.

    Masked: each maximal run of overlapping spans becomes the kind of its first in capitals and brackets.
    """
    model = model or trained(docs, doc_id=doc_id, text=text)
    made = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"]
    docs = docs.drop(*[c for c in docs.columns if c in made])
    keep = [f for f in docs.schema.fields if masked or f.name != text]
    at, names = docs.columns.index(text), [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            bases = [base_spans(t) for t in texts]
            spans = [sorted({*b, *a}) for b, a in zip(bases, added_spans(texts, bases, model, confident))]
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n in names}
            if masked:
                columns[text] = pa.array([mask(t, s) if s else raw for t, s, raw in zip(texts, spans, batch.column(at).to_pylist())], pa.string())
            for k, kind in enumerate(KINDS):
                columns[f"n_{kind}"] = pa.array([sum(x[1] == k for x in b) for b in bases], pa.int64())
            columns["base_sha256"] = pa.array([hashlib.sha256(shown(b).encode()).hexdigest() for b in bases], pa.string())
            columns["spans"] = pa.array([shown(s) for s in spans], pa.string())
            columns["n_spans"] = pa.array([len(s) for s in spans], pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    schema = docs.select(*names).schema
    for kind in KINDS:
        schema = schema.add(f"n_{kind}", "long")
    return docs.mapInArrow(run, schema.add("base_sha256", "string").add("spans", "string").add("n_spans", "long"))


def mask(text: str, spans: list[Span]) -> str:
    out, at, i = [], 0, 0
    while i < len(spans):
        a, k, b = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < b:
            i += 1
            b = max(b, spans[i][2])
        out += [text[at:a], f"[{ALL_KINDS[k].upper()}]"]
        at, i = b, i + 1
    return "".join(out) + text[at:]
