"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of each whole text are computed from its bytes and words in numpy. Trees are grown level by level on
histograms of binned statistics, in the driver, from at most sample_rows labelled documents (those with the least
crc32 of their id among the labelled ones allowed in); what reaches the driver is one small row for each of them. A
fitted model is a handful of flat arrays (statistic, threshold, children, value); scoring walks all rows of a batch
down one tree after another in numpy.

Null and empty texts have the statistics of no words, and a score. Documents are independent: repeated rows repeat
their score. Labels that are null, and labels without a document, teach nothing; without both classes the score is
the share of label 1, or 0.5. Of several labels of a document, and of several documents of one id, each pair is an
example; if that makes more than sample_rows, those of the least hash of their statistics are taken. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.batches import slices

STATISTICS = 28


def statistics(text: str) -> np.ndarray:
    """The statistics of one text."""
    x = np.zeros(STATISTICS)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return x
    count = np.bincount(raw, minlength=256)
    n = len(raw)
    share = lambda a: count[a].sum() / n
    words = text.split()
    lines = [y for y in text.split("\n") if y.strip()]
    n_words = len(words)
    kinds = set(words)
    lengths = np.fromiter(map(len, words), np.int64, n_words) if n_words else np.zeros(1, np.int64)
    line_lengths = np.fromiter(map(len, lines), np.int64, len(lines)) if lines else np.zeros(1, np.int64)
    p = count[count > 0] / n
    x[0] = np.log1p(n_words)
    x[1] = np.log1p(n)
    x[2], x[3], x[4] = lengths.mean(), lengths.std(), lengths.max()
    x[5] = len(kinds) / max(1, n_words)
    x[6] = share(np.frombuffer(b"#*$%&|<>", np.uint8))
    x[7] = share(np.arange(48, 58))
    x[8] = share(np.arange(65, 91))
    x[9] = share(np.arange(97, 123))
    x[10] = share(np.arange(128, 256))
    x[11] = share(np.frombuffer(b".!?", np.uint8))
    x[12] = share(np.frombuffer(b",;:", np.uint8))
    x[13] = share(np.frombuffer(b"()[]{}/\\=_+-\"'@~^`", np.uint8))
    x[14] = share(np.array([32, 9, 10, 13]))
    x[15] = -(p * np.log2(p)).sum()
    x[16] = np.log1p(len(lines))
    x[17], x[18] = line_lengths.mean(), line_lengths.std()
    x[19] = len(set(lines)) / max(1, len(lines))
    x[20] = sum(y.rstrip().endswith((".", "!", "?")) for y in lines) / max(1, len(lines))
    pairs = list(zip(words, words[1:]))
    x[21] = len(set(pairs)) / max(1, len(pairs))
    triples = list(zip(words, words[1:], words[2:]))
    x[22] = len(set(triples)) / max(1, len(triples))
    x[23] = sum(w.isupper() for w in kinds) / max(1, len(kinds))
    x[24] = sum(not any(c.isalpha() for c in w) for w in kinds) / max(1, len(kinds))
    x[25] = (lengths <= 3).mean()
    x[26] = (lengths >= 12).mean()
    x[27] = np.log1p((words and max(np.unique(lengths, return_counts=True)[1])) or 0) - np.log1p(n_words)
    return x


class Trees:
    """A fitted model as flat arrays; children of a leaf are itself."""

    def __init__(self, start: float, roots, feature, threshold, left, right, value, depth: int):
        self.start, self.roots, self.depth = start, np.array(roots, np.int32), depth
        self.feature, self.left, self.right = (np.array(a, np.int32) for a in (feature, left, right))
        self.threshold, self.value = np.array(threshold, float), np.array(value, float)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row."""
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 20, ridge: float = 1.0) -> Trees:
    """Boosted trees for labels 0 and 1 under log loss."""
    n = len(y)
    share = min(max(y.mean() if n else 0.5, 1e-6), 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    roots, feature, threshold, left, right, value = [], [], [], [], [], []
    if n < 2 * least or y.min() == y.max():
        return Trees(start, roots, [0], [0], [0], [0], [0.0], depth)
    m = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)  # bin b: up to edge b
    total = np.full(n, start)
    cell = binned + np.arange(m) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)

        def leaf(rows_g, rows_h):
            feature.append(0), threshold.append(np.inf), value.append(rate * rows_g / (rows_h + ridge))
            left.append(len(left)), right.append(len(right))
            return len(left) - 1

        root = leaf(g.sum(), h.sum())
        roots.append(root)
        node = np.full(n, root)
        level = [root]
        for _ in range(depth):
            place = {v: i for i, v in enumerate(level)}
            own = np.full(len(left), -1)
            own[level] = range(len(level))
            at = own[node]
            live = at >= 0
            key = (at[live, None] * (m * bins) + cell[live]).ravel()
            shape = (len(level), m, bins)
            hist = [np.bincount(key, w, len(level) * m * bins).reshape(shape).cumsum(2) for w in (np.repeat(g[live], m), np.repeat(h[live], m), np.ones(len(key)))]
            gl, hl, cl = hist
            gt, ht, ct = gl[..., -1:], hl[..., -1:], cl[..., -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(cl < least) | (ct - cl < least)] = -np.inf
            fresh = []
            for v, i in place.items():
                best = int(gain[i].argmax())
                j, b = divmod(best, bins)
                if not gain[i, j, b] > 1e-6 or b >= len(edges[j]):
                    continue
                feature[v], threshold[v] = j, float(edges[j][b])
                a = leaf(gl[i, j, b], hl[i, j, b])
                c = leaf(gt[i, j, 0] - gl[i, j, b], ht[i, j, 0] - hl[i, j, b])
                left[v], right[v] = a, c
                here = node == v
                node[here] = np.where(binned[here, j] <= b, a, c)
                fresh += [a, c]
            level = fresh
            if not level:
                break
        total += np.array(value)[node]
    return Trees(start, roots, feature, threshold, left, right, value, depth)


def remainder(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3; of a null id as of an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3))


def trained(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Trees:
    """A model from the labels whose remainder is not 1; sample_rows at most, so they can be broadcast."""
    chosen = (
        labels.where(F.col(label).isNotNull() & (remainder(F.col(doc_id)) != 1))
        .select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("_y"))
        .orderBy(F.crc32(F.col("_id").cast("string")), "_id", "_y")
        .limit(sample_rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            x = [statistics(t or "").astype("<f8").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary())], names=["y", "x"])

    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_id").select("_y", "_t").mapInArrow(run, "y double, x binary")
    rows = sorted((bytes(r.x), r.y) for r in rows.orderBy(F.xxhash64("x"), "x", "y").limit(sample_rows).collect())
    x = np.array([np.frombuffer(r[0], "<f8") for r in rows]).reshape(-1, STATISTICS)
    return fit(x, np.array([r[1] for r in rows]))


def scored(docs: DataFrame, model: Trees, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out (remainder 1), score and predicted for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            score = model.score(np.array([statistics(t or "") for t in batch.column(2).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[doc_id, "held_out", "score", "predicted"])

    rows = docs.select(doc_id, (remainder(F.col(doc_id)) == 1).alias("held_out"), text)
    return rows.mapInArrow(run, f"{doc_id} long, held_out boolean, score double, predicted int")
