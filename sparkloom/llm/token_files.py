"""Token-ID output: Arrow IPC files of equal-length sequences and masks.

The documents, in ascending order of their id, are encoded, each followed by the end id, and laid end to end. Each
shard holds a consecutive range of documents and cuts its ids into sequences of seq_len; the last sequence of a
shard is padded. A shard is two Arrow files: tokens-NNNNN.arrow with fixed-size-list columns ids (uint16 where the
vocabulary fits, else uint32) and mask (bool, one bit a place; false: padding) in record batches of batch_sequences rows, so
sequence s is row s % batch_sequences of batch s // batch_sequences, read from a memory map without a copy; and
docs-NNNNN.arrow with doc_id, start (in the shard) and n_tokens.

Files are written under another name and renamed, so a task that runs again after a lost executor replaces them
with the same bytes. The driver gets one row for each shard.

Null texts count as empty (the end id alone). Null ids come first; equal ids are ordered by their text's hash and
text. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.batches import bounded_batches, slices
from sparkloom.llm.shingles import eights, mix

_TOKENIZERS: dict = {}


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def _encoder(path: str) -> Encoder:
    """The encoder of a worker process, with its cache."""
    if ("encoder", path) not in _TOKENIZERS:
        _TOKENIZERS["encoder", path] = Encoder(path)
    return _TOKENIZERS["encoder", path]


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def cuts(data: np.ndarray) -> np.ndarray:
    """The places of single spaces between solid characters in UTF-8 bytes.

    Solid are U+0021 to U+007E and U+00A1 to U+07FF: none is white space to any pattern. A byte-level BPE tokenizer's
    pattern always begins a new piece at such a space, so no token crosses it.
    """
    at = np.flatnonzero(data[2:-1] == 0x20) + 2 if len(data) > 3 else np.zeros(0, np.int64)
    last, lead, ahead, second = data[at - 1], data[at - 2], data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
    plain = lambda b: (b >= 0x21) & (b <= 0x7E)
    two = lambda a, b: (b >= 0x80) & (((a >= 0xC3) & (a <= 0xDF)) | ((a == 0xC2) & (b > 0xA0))) & (b < 0xC0)
    return at[(plain(last) | two(lead, last)) & (plain(ahead) | two(ahead, second))]


class Encoder:
    """Encodes texts with the library; chunks between safe cuts that were met before are looked up.

    A chunk of up to 15 bytes is known by those bytes and their number, in two words, in an open-addressing table of
    2^bits places; a longer one, up to `longest`, by its bytes in a dict. Both start anew when the table is half full
    or the ids take 2^(bits + 2) places. Chunks beyond `longest` are not kept.

    The string of an added token in a text becomes that token's id, as in the library. It holds no white space and takes
    none beside it, so no cut falls inside; with a tokenizer whose added tokens do, texts are not cut.
    """

    def __init__(self, path: str, bits: int = 20, longest: int = 64):
        self.tokenizer, self.bits, self.longest = _tokenizer(path), bits, longest
        words, added = self.tokenizer.get_vocab(with_added_tokens=False), self.tokenizer.get_added_tokens_decoder()
        self.size = np.zeros(max([*words.values(), *added]) + 1, np.int64)  # bytes of each token: byte-level tokens have a character for each
        self.size[list(words.values())] = [len(w) for w in words]
        self.size[list(added)] = [len(t.content.encode()) for t in added.values()]
        self.cut = not any(t.lstrip or t.rstrip or t.single_word or t.normalized or len(t.content.split()) != 1 or t.content != t.content.strip() for t in added.values())
        self.clear()

    def clear(self) -> None:
        n = 1 << self.bits
        self.low, self.high, self.place = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.full(n, -1, np.int32)
        self.long: dict[bytes, int] = {}
        self.pool, self.used, self.stored = np.zeros(1 << 20, np.uint32), 0, 0
        self.at, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low ^ mix(high)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each chunk, or -1."""
        mask, out = (1 << self.bits) - 1, np.full(len(low), -1, np.int64)
        slot, live = self._slots(low, high), np.arange(len(low))
        while len(live):
            own = self.place[slot]
            hit = (own >= 0) & (self.low[slot] == low[live]) & (self.high[slot] == high[live])
            out[live[hit]] = own[hit]
            go = (own >= 0) & ~hit
            live, slot = live[go], (slot[go] + 1) & mask
        return out

    def _insert(self, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot, live = self._slots(low, high), np.arange(len(low))
        while len(live):
            free = self.place[slot] < 0
            self.place[slot[free]] = number[live[free]]  # of several for one place the last stays
            won = free & (self.place[slot] == number[live])
            self.low[slot[won]], self.high[slot[won]] = low[live[won]], high[live[won]]
            live, slot = live[~won], (slot[~won] + 1) & mask

    def _store(self, chunks: list[bytes], joined: np.ndarray) -> np.ndarray:
        """Encodes chunks into the pool; their numbers.

        joined marks chunks with a safe cut at both ends: they are laid end to end and encoded as one text, and the
        bytes of the tokens show where each ends. The others are encoded one by one.
        """
        n = np.zeros(len(chunks), np.int64)
        solid, rest = np.flatnonzero(joined), np.flatnonzero(~joined)
        parts = [solid[a : a + 1000] for a in range(0, len(solid), 1000)]
        pool = []
        for part, e in zip(parts, self.tokenizer.encode_batch_fast([b"".join([chunks[i] for i in part]).decode() for part in parts], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(chunks[i]) for i in part]), "right")
            n[part] = np.diff(ends, prepend=0)
            pool.append(ids)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([chunks[i].decode() for i in rest], add_special_tokens=False)):
            n[i] = len(e.ids)
            pool.append(np.array(e.ids, np.uint32))
        order = np.concatenate([solid, rest])
        at = np.zeros(len(chunks), np.int64)
        at[order] = self.used + np.cumsum(n[order]) - n[order]
        ids = np.concatenate(pool) if pool else np.zeros(0, np.uint32)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        while self.stored + len(chunks) > len(self.at):
            self.at, self.n = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.n))
        number = self.stored + np.arange(len(chunks))
        self.at[number], self.n[number] = at, n
        self.stored += len(chunks)
        return number

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has."""
        if self.stored > 1 << (self.bits - 1) or self.used > 1 << (self.bits + 2):
            self.clear()
        raw = [t.encode() for t in texts]
        whole = b"".join(raw)
        data = np.frombuffer(whole, np.uint8)
        ends = np.cumsum([len(r) for r in raw]) if raw else np.zeros(0, np.int64)
        bounds = np.concatenate([[0], ends])
        safe = np.zeros(len(data) + 1, bool)
        safe[cuts(data) if self.cut else []] = True
        safe[bounds] = safe[np.maximum(bounds - 1, 0)] = False  # a space at a text's end is not between characters
        begins = safe.copy()
        begins[bounds[:-1][np.diff(bounds) > 0]] = True
        start = np.flatnonzero(begins)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        end = np.append(start[1:], len(data))
        size = end - start
        which = np.full(len(start), -1, np.int64)
        short = np.flatnonzero(size <= 15)
        view = eights(np.concatenate([data, np.zeros(8, np.uint8)]))
        kept = lambda n: np.where(n >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.clip(n, 0, 7) * 8).astype(np.uint64)) - np.uint64(1))
        low = view[start[short]] & kept(size[short])
        high = view[np.minimum(start[short] + 8, len(data))] & kept(size[short] - 8) | size[short].astype(np.uint64) << np.uint64(56)
        which[short] = self._find(low, high)
        new = np.flatnonzero(which[short] < 0)
        new = new[np.lexsort((high[new], low[new]))]
        differs = np.concatenate([[True], (low[new][1:] != low[new][:-1]) | (high[new][1:] != high[new][:-1])]) if len(new) else np.zeros(0, bool)
        first = new[differs]
        rest = np.flatnonzero(size > 15)
        chunks = [whole[a:b] for a, b in zip(start[rest].tolist(), end[rest].tolist())]
        unknown = {c: i for i, c in zip(rest.tolist(), chunks) if c not in self.long}
        rows = np.concatenate([short[first], np.array(list(unknown.values()), np.int64)])
        if len(rows):
            number = self._store([whole[a:b] for a, b in zip(start[rows].tolist(), end[rows].tolist())], safe[start[rows]] & safe[end[rows]])
            which[short[new]] = number[: len(first)][np.cumsum(differs) - 1]
            self._insert(low[first], high[first], number[: len(first)])
            self.long.update(zip(unknown, number[len(first) :].tolist()))
        which[rest] = [self.long[c] for c in chunks]
        for c in unknown:
            if len(c) > self.longest:
                del self.long[c]
        n = self.n[which].astype(np.int64)
        ids = self.pool[np.repeat(self.at[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        summed = np.concatenate([[0], np.cumsum(n)])
        own = summed[np.searchsorted(start, bounds)]
        return ids, np.diff(own)


class _Shard:
    """Writes the two files of a shard."""

    def __init__(self, path: str, shard: int, attempt: int, seq_len: int, batch_sequences: int, dtype):
        self.fs, root = _filesystem(path)
        self.fs.create_dir(root, recursive=True)
        self.final = [f"{root}/{kind}-{shard:05d}.arrow" for kind in ("tokens", "docs")]
        self.temporary = [f"{x}.{attempt}.tmp" for x in self.final]
        self.sinks = [self.fs.open_output_stream(x) for x in self.temporary]
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema({"ids": pa.list_(kind, seq_len), "mask": pa.list_(pa.bool_(), seq_len)})
        self.docs_schema = pa.schema({"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64()})
        self.tokens = pa.ipc.new_file(self.sinks[0], self.schema)
        self.docs = pa.ipc.new_file(self.sinks[1], self.docs_schema)
        self.seq_len, self.step, self.dtype = seq_len, seq_len * batch_sequences, dtype
        self.buffer, self.filled, self.total, self.n_docs = np.zeros(self.step, dtype), 0, 0, 0
        self.index: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.index.append((doc_id, self.total, len(ids)))
        self.total += len(ids)
        self.n_docs += 1
        at = 0
        while at < len(ids):
            n = min(self.step - self.filled, len(ids) - at)
            self.buffer[self.filled : self.filled + n] = ids[at : at + n]
            self.filled, at = self.filled + n, at + n
            if self.filled == self.step:
                self._write()
        if len(self.index) >= 10_000:
            self._write_index()

    def _write(self) -> None:
        n = -(-self.filled // self.seq_len) * self.seq_len
        mask = np.arange(n) < self.filled
        self.buffer[self.filled : n] = 0
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (self.buffer[:n], mask)]
        self.tokens.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.filled = 0

    def _write_index(self) -> None:
        columns = [pa.array(x, pa.int64()) for x in zip(*self.index)]
        self.docs.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.docs_schema))
        self.index = []

    def close(self) -> None:
        if self.filled:
            self._write()
        if self.index:
            self._write_index()
        for writer, sink in zip((self.tokens, self.docs), self.sinks):
            writer.close()
            sink.close()
        for a, b in zip(self.temporary, self.final):
            self.fs.move(a, b)


def write(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int = 0,
    seq_len: int = 2048,
    batch_sequences: int = 64,
    shards: int | None = None,
    shard_bytes: int = 1 << 28,
    doc_id: str = "doc_id",
    text: str = "text",
) -> list[dict]:
    """Writes docs under path (a folder that all executors reach); returns the manifest, one entry for each shard.

    Without a number of shards there are as many as shuffle partitions, or more where a shard would be of more than
    about shard_bytes of text.
    """
    spark = docs.sparkSession
    if shards is None:
        size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))
    vocabulary = max(_tokenizer(tokenizer_path).get_vocab_size(with_added_tokens=True), end_id + 1)
    dtype = np.uint16 if vocabulary <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        encoder, shard = _encoder(tokenizer_path), None
        end = np.array([end_id], np.uint32)
        for batch in slices(batches, 1, 1 << 22):
            shard = shard or _Shard(path, context.partitionId(), context.taskAttemptId(), seq_len, batch_sequences, dtype)
            ids, counts = encoder.encode(batch.column(1).to_pylist())
            for key, own in zip(batch.column(0).to_pylist(), np.split(ids, np.cumsum(counts)[:-1])):
                shard.add(key, np.concatenate([own, end]))
        if shard:
            shard.close()
            yield pa.RecordBatch.from_pydict({"shard": [context.partitionId()], "n_tokens": [shard.total], "n_docs": [shard.n_docs]}, schema=found)

    found = pa.schema({"shard": pa.int64(), "n_tokens": pa.int64(), "n_docs": pa.int64()})
    ordered = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(shards, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text")
    )
    with bounded_batches(spark):
        rows = sorted(ordered.mapInArrow(run, "shard long, n_tokens long, n_docs long").collect())
    manifest, base = [], 0
    for r in rows:
        manifest.append({"shard": r.shard, "base": base, "n_tokens": r.n_tokens, "n_docs": r.n_docs})
        base += r.n_tokens
    fs, root = _filesystem(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"seq_len": seq_len, "end_id": end_id, "dtype": np.dtype(dtype).name, "shards": manifest}).encode())
    return manifest


class Reader:
    """Random access to the sequences, masks and documents of a shard; local files are memory maps."""

    def __init__(self, path: str, shard: int):
        fs, root = _filesystem(path)
        name = lambda kind: f"{root}/{kind}-{shard:05d}.arrow"
        opened = [pa.memory_map(name(k)) if fs.type_name == "local" else fs.open_input_file(name(k)) for k in ("tokens", "docs")]
        self.file, docs = (pa.ipc.open_file(x) for x in opened)
        self.docs = docs.read_all()
        self.seq_len = self.file.schema.field("ids").type.list_size
        self.step = self.seq_len * (self.file.get_batch(0).num_rows if self.file.num_record_batches else 1)
        self._last: tuple = (-1, None)

    def _batch(self, i: int) -> pa.RecordBatch:
        if self._last[0] != i:
            self._last = (i, self.file.get_batch(i))
        return self._last[1]

    def sequence(self, s: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (an array) and mask (an Arrow array of bits) of sequence s, as views of the file."""
        rows = self.step // self.seq_len
        batch, at = self._batch(s // rows), s % rows * self.seq_len
        ids, mask = (batch.column(c).values.slice(at, self.seq_len) for c in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask

    def parts(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views that hold the ids from start to start + n."""
        while n > 0:
            i, at = divmod(start, self.step)
            view = self._batch(i).column(0).values.to_numpy(zero_copy_only=True)[at : at + n]
            yield view
            start, n = start + len(view), n - len(view)


def read(spark: SparkSession, path: str, manifest: list[dict]) -> DataFrame:
    """From the files, for each document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = Reader(path, row["shard"])
                for docs in reader.docs.to_batches():
                    crc = []
                    for start, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist()):
                        c = 0
                        for view in reader.parts(start, n):
                            c = zlib.crc32(view.astype("<u4").tobytes(), c)
                        crc.append(c)
                    starts = docs.column("start").to_numpy() + row["base"]
                    yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array(starts), docs.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)
    rows = spark.createDataFrame([(m["shard"], m["base"]) for m in manifest], "shard long, base long")
    return rows.repartition(len(manifest)).mapInArrow(run, schema)
