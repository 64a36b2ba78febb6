"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The vocabulary (pieces, scores, kinds) is read from a model file; nothing is trained. A file of merges has ranks for
scores, of which log scores follow by Zipf's law, so its texts are cut otherwise than by merging. A text gets the white-space
marker U+2581 for each space and one in front. Among all ways to cut it into pieces, the one of the highest sum of
scores is taken; of equal ones the first found with earlier starts, that is, longer last pieces. A character that no
piece reaches costs the least score less 10 and becomes its byte pieces (or the unknown id where a vocabulary has no
byte pieces). Decoding joins the pieces and bytes, turns markers into spaces and drops the one in front.

In a vocabulary whose pieces hold markers only at their front, no piece crosses from another character to a marker,
so the best cut of a text is the best cuts of its chunks (markers and what follows up to the next). Chunks are
looked up in a bounded cache; the new ones of a batch are solved together, place by place, in numpy. If a vocabulary
has other pieces, the whole text is one chunk.

Null and empty texts have no pieces. A literal U+2581 in a text is decoded as a space, as the format has it; any other
valid text is restored exactly.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkloom.llm.batches import slices

MARK = "▁"
_MARK = MARK.encode()
_CHUNK = re.compile(" +[^ ]*|[^ ]+")
SLICE = 1 << 21  # bytes of text that a worker handles at once


class DoubleArray:
    """A trie over byte strings: the child of state s by byte b is base[s] + b + 1 where check there is s."""

    def __init__(self, keys: list[bytes]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        size = 1 << 12
        self.base, self.check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        self.value = np.full(size, -1, np.int32)
        used = np.zeros(size, bool)
        used[0] = True
        free = 1
        todo = [(0, 0, len(order), 0)]  # state, range of keys, depth
        while todo:
            state, a, b, depth = todo.pop()
            while a < b and len(keys[order[a]]) == depth:
                self.value[state] = order[a]
                a += 1
            if a == b:
                continue
            parts, at = [], a
            while at < b:
                byte, end = keys[order[at]][depth], at
                while end < b and keys[order[end]][depth] == byte:
                    end += 1
                parts.append((byte, at, end))
                at = end
            want = np.array([p[0] + 1 for p in parts])
            at, width = free, 256
            while True:
                while at + width + 600 >= len(used):
                    used = self._grow(used)
                bases = np.flatnonzero(~used[at : at + width]) + at - want[0]  # places free for the first child
                bases = bases[bases >= 0]
                fits = np.flatnonzero(~used[bases[:, None] + want].any(1)) if len(bases) else bases
                if len(fits):
                    base = int(bases[fits[0]])
                    break
                at, width = at + width, min(width * 2, 1 << 14)
            self.base[state] = base
            used[base + want] = True
            self.check[base + want] = state
            while used[free]:
                free += 1
            free = max(free, base + int(want[0]) - (1 << 14))  # far behind the last place the gaps are few and small
            while used[free]:
                free += 1
            todo += [(base + byte + 1, x, y, depth + 1) for byte, x, y in parts]

    def _grow(self, used: np.ndarray) -> np.ndarray:
        n = len(used)
        self.base = np.concatenate([self.base, np.zeros(n, np.int32)])
        self.check = np.concatenate([self.check, np.full(n, -1, np.int32)])
        self.value = np.concatenate([self.value, np.full(n, -1, np.int32)])
        return np.concatenate([used, np.zeros(n, bool)])


def log_scores(scores: list[float], plain: list[int]) -> list[float]:
    """The log scores of a vocabulary. A file of merges has their ranks, as negative whole numbers, in place of log
    probabilities; those of Zipf's law are taken then: the piece of rank r has a probability of 1 / (r * H), H being
    the sum of all 1 / r. Nothing is fitted."""
    own = np.array([scores[i] for i in plain])
    if not len(own) or not (own == np.round(own)).all():
        return scores
    out = list(scores)
    rank = 1 + np.argsort(np.argsort(-own, kind="stable"), kind="stable")
    for i, x in zip(plain, -np.log(rank) - np.log((1 / rank).sum())):
        out[i] = float(x)
    return out


class Vocabulary:
    """Pieces of a model file with the trie, the solved chunks, and the bytes of each id."""

    def __init__(self, path: str, cache: int = 150_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.setup(pieces, log_scores([model.get_score(i) for i in range(n)], plain), plain, {int(pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}, model.unk_id(), cache)

    @classmethod
    def of(cls, pieces: list[str], scores: list[float], bytes_from: int | None = None, unknown: int = 0, cache: int = 150_000) -> Vocabulary:
        """A vocabulary of given pieces, all plain but the unknown one; bytes_from: the id of the first of 256 byte pieces."""
        self = cls.__new__(cls)
        own = {} if bytes_from is None else {b: bytes_from + b for b in range(256)}
        self.setup(pieces, scores, [i for i in range(len(pieces)) if i != unknown and i not in own.values()], own, unknown, cache)
        return self

    def setup(self, pieces, scores, plain, byte_ids, unknown, cache) -> None:
        self.pieces = pieces
        keys = [pieces[i].encode() for i in plain]
        self.trie = DoubleArray(keys)
        self.plain, self.score = np.array(plain, np.int64), np.array([scores[i] for i in plain], np.float64)
        self.unknown_score = (self.score.min() if plain else 0.0) - 10
        self.byte_ids = np.array([byte_ids.get(b, unknown) for b in range(256)], np.int64)
        self.has_bytes, self.unknown = bool(byte_ids), unknown
        self.split = not any(MARK in p.lstrip(MARK) for p in (pieces[i] for i in plain))
        raw = [b""] * len(pieces)
        for i in plain:
            raw[i] = pieces[i].encode().replace(_MARK, b" ")
        for b, i in byte_ids.items():
            raw[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_n = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_n) - self.raw_n
        self.is_byte = np.zeros(len(pieces), bool)
        self.is_byte[list(byte_ids.values())] = True
        self.most = cache
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.at, self.n = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def solve(self, chunks: list[str]) -> list[np.ndarray]:
        """The ids of each chunk (spaces stand for markers)."""
        raw = [c.replace(" ", MARK).encode() for c in chunks]
        out: list = [None] * len(raw)
        order = np.argsort([len(r) for r in raw], kind="stable")
        at = 0
        while at < len(order):  # chunks of like length together, about 4 MB of places at once
            end = at + 1
            while end < len(order) and (len(raw[order[end]]) + 1) * (end - at + 1) <= 1 << 18 and len(raw[order[end]]) <= 2 * len(raw[order[at]]) + 8:
                end += 1
            for i, ids in zip(order[at:end], self._viterbi([raw[i] for i in order[at:end]])):
                out[i] = ids
            at = end
        return out

    def _viterbi(self, raw: list[bytes]) -> Iterator[np.ndarray]:
        n = np.array([len(r) for r in raw])
        long = int(n.max(initial=0))
        if len(raw) < 8 and long > 256:
            yield from map(self._one, raw)
            return
        text = np.zeros((len(raw), long + 4), np.int32)
        for i, r in enumerate(raw):
            text[i, : len(r)] = np.frombuffer(r, np.uint8)
        best = np.full((len(raw), long + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((len(raw), long + 1), np.int32)
        piece = np.full((len(raw), long + 1), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for place in range(long):
            rows = np.flatnonzero((n > place) & (best[:, place] > -np.inf))
            if not len(rows):
                continue
            lead = text[rows, place]
            width = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            single = np.zeros(len(raw), bool)
            state, live, depth = np.zeros(len(rows), np.int32), rows, 0
            char = np.zeros(len(raw), np.int32)
            char[rows] = width
            while len(live):
                inside = place + depth < n[live]
                live, state = live[inside], state[inside]
                to = base[state] + text[live, place + depth] + 1
                ok = check[to] == state
                live, state = live[ok], to[ok]
                if not len(live):
                    break
                depth += 1
                v = value[state]
                hit = v >= 0
                at, v = live[hit], v[hit]
                single[at[char[at] == depth]] = True
                score = best[at, place] + self.score[v]
                better = score > best[at, place + depth]
                at, v, score = at[better], v[better], score[better]
                best[at, place + depth], back[at, place + depth], piece[at, place + depth] = score, place, v
            rest = ~single[rows]
            rows, to = rows[rest], place + width[rest]
            score = best[rows, place] + self.unknown_score
            better = score > best[rows, to]
            rows, to = rows[better], to[better]
            best[rows, to], back[rows, to], piece[rows, to] = score[better], place, -1
        # all chunks' paths are followed at once, from their ends
        end, found = n.copy(), []
        live = np.flatnonzero(end > 0)
        while len(live):
            e = end[live]
            found.append((live, back[live, e], e, piece[live, e]))
            end[live] = back[live, e]
            live = live[end[live] > 0]
        if not found:
            for _ in raw:
                yield np.zeros(0, np.int32)
            return
        row, start, stop, which = (np.concatenate([f[i] for f in found]) for i in range(4))
        order = np.lexsort((start, row))
        row, start, stop, which = row[order], start[order], stop[order], which[order]
        count = np.where(which >= 0, 1, (stop - start) if self.has_bytes else 1)
        ids = np.repeat(np.where(which >= 0, self.plain[np.maximum(which, 0)], self.unknown), count)
        if self.has_bytes and (which < 0).any():
            inside = np.arange(len(ids)) - np.repeat(np.cumsum(count) - count, count)
            fallback = np.repeat(which < 0, count)
            ids[fallback] = self.byte_ids[text[np.repeat(row, count)[fallback], (np.repeat(start, count) + inside)[fallback]]]
        yield from np.split(ids.astype(np.int32), np.cumsum(np.bincount(row, weights=count, minlength=len(raw)).astype(np.int64))[:-1])

    def _one(self, raw: bytes) -> np.ndarray:
        """One long chunk, place by place."""
        n = len(raw)
        best, back, piece = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for place in range(n):
            here = best[place]
            if here == float("-inf"):
                continue
            lead = raw[place]
            width, single, state = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0), False, 0
            for end in range(place, n):
                to = int(base[state]) + raw[end] + 1
                if check[to] != state:
                    break
                state = to
                v = int(value[state])
                if v >= 0:
                    single |= end + 1 - place == width
                    if here + self.score[v] > best[end + 1]:
                        best[end + 1], back[end + 1], piece[end + 1] = here + self.score[v], place, v
            if not single and here + self.unknown_score > best[place + width]:
                best[place + width], back[place + width], piece[place + width] = here + self.unknown_score, place, -1
        out: list[int] = []
        while n:
            a, v = back[n], piece[n]
            out += [int(self.plain[v])] if v >= 0 else [int(self.byte_ids[b]) for b in reversed(raw[a:n])] if self.has_bytes else [self.unknown]
            n = a
        return np.array(out[::-1], np.int32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has."""
        if len(self.known) > self.most:
            self.clear()
        parts: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                own = " " + t.replace(MARK, " ")
                before = len(parts)
                parts += _CHUNK.findall(own) if self.split else [own]
                counts[i] = len(parts) - before
        known = self.known
        fresh = list({p for p in parts if p not in known})
        if fresh:
            fresh.sort()
            solved = self.solve(fresh)
            first = len(self.at)
            known.update(zip(fresh, range(first, first + len(fresh))))
            n = np.array([len(s) for s in solved], np.int64)
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(n) - n])
            self.n = np.concatenate([self.n, n])
            self.ids = np.concatenate([self.ids, *solved])
        which = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
        ids = gathered(self.ids, self.at[which], self.n[which])
        total = np.concatenate([[0], np.cumsum(self.n[which])])
        ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, total[ends[1:]] - total[ends[:-1]]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids; bytes that are no UTF-8 become U+FFFD."""
        raw = gathered(self.raw, self.raw_at[ids], self.raw_n[ids]).tobytes()
        total = np.concatenate([[0], np.cumsum(self.raw_n[ids])])
        ends = total[np.concatenate([[0], np.cumsum(counts)])]
        cut = [raw[a:b] for a, b in zip(ends, ends[1:])]
        return [(x[1:] if x[:1] == b" " else x).decode("utf-8", "replace") for x in cut]


def gathered(pool: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """pool[at[i]:at[i] + n[i]] for all i, end to end."""
    return pool[np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())]


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, loaded once for each worker."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def _int_lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids))


def encode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """docs with ids (array of int); a column ids in docs is replaced."""
    docs = docs.drop("ids")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model_path)
        for batch in slices(batches, at, SLICE):
            ids, counts = own.encode(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, _int_lists(ids, counts)], names=[*batch.schema.names, "ids"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """rows with the text of their ids; null ids count as none."""
    rows = rows.drop(text)
    at = rows.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model_path)
        for whole in batches:
            for start in range(0, whole.num_rows, 200):
                batch = whole.slice(start, 200)
                column = batch.column(at)
                counts = np.array([len(x) if x.is_valid else 0 for x in column], np.int64)
                values = column.flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.decode(values, counts), pa.string())], names=[*batch.schema.names, text])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())]))


def round_trip(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """docs with ids, and with the text decoded from them in place of the text; both in one pass of one worker."""
    docs = docs.drop("ids")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model_path)
        for batch in slices(batches, at, SLICE):
            ids, counts = own.encode(batch.column(at).to_pylist())
            columns = [*batch.columns, _int_lists(ids, counts)]
            columns[at] = pa.array(own.decode(ids, counts), pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "ids"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def digests(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document: doc_id, n_tokens, n_bytes (byte pieces), ids_crc32 (of little-endian 32-bit ids), restored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(model_path)
        for batch in slices(batches, 1, SLICE):
            texts = batch.column(1).to_pylist()
            ids, counts = own.encode(texts)
            out = np.split(ids, np.cumsum(counts)[:-1])
            same = [(a or "") == b for a, b in zip(texts, own.decode(ids, counts))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array([int(own.is_byte[x].sum()) for x in out], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in out], pa.int64()),
                    pa.array(same),
                ],
                names=[doc_id, "n_tokens", "n_bytes", "ids_crc32", "restored"],
            )

    return docs.select(doc_id, text).mapInArrow(run, f"{doc_id} long, n_tokens long, n_bytes long, ids_crc32 long, restored boolean")
