"""Chat formatting: conversations as one marked-up text each, with the loss mask over the assistant's texts.

Template, for each turn: <|im_start|>ROLE\\nTEXT<|im_end|>\\n. Control strings inside roles and texts are escaped
reversibly: each backslash is doubled, and a backslash is put after the first character of each control string
(also of those that other templates use); a line feed in a role gets a backslash before it.

The bytes are assembled by column: the lengths of headers, contents and trailers give the offsets, and numpy
scatters the pools of headers and contents into one preallocated buffer, which becomes the Arrow column.

A conversation is one row unless it exceeds max_bytes; then it is several rows, numbered by part, in order, so a
conversation of any length needs bounded memory. The rows of a conversation stream through one task in order; the
digests of a conversation are sequential by definition.

Null texts and roles count as empty. Rows go by turn (null first), ties by role and text; repeated rows are repeated
turns. A null conv_id is a conversation of its own. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = b"<|im_start|>", b"<|im_end|>\n"
_CONTROL = re.compile(rb"<(?=\||/?s>)|\[(?=/?INST\])")
_ESCAPED = re.compile(rb"\\(.)", re.DOTALL)
_TURN = re.compile(rb"<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
SCHEMA = "conv_id long, part long, formatted string, loss_spans array<struct<start:long,end:long>>"


def escape(raw: bytes) -> bytes:
    return _CONTROL.sub(lambda m: m[0] + b"\\", raw.replace(b"\\", b"\\\\"))


def unescape(raw: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1", raw) if b"\\" in raw else raw


def _pool(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes laid end to end, and the length of each."""
    return np.frombuffer(b"".join(values), np.uint8), np.array([len(v) for v in values], np.int64)


def _scatter(out: np.ndarray, pool: np.ndarray, lengths: np.ndarray, to: np.ndarray, source: np.ndarray | None = None) -> None:
    """Copies segment i of pool (from source[i], by default end to end) to out[to[i]:to[i] + lengths[i]]."""
    before = np.cumsum(lengths) - lengths
    inside = np.arange(lengths.sum(), dtype=np.int64) - np.repeat(before, lengths)
    taken = pool if source is None else pool[np.repeat(source, lengths) + inside]
    out[np.repeat(to, lengths) + inside] = taken


def assemble(conv: np.ndarray, roles: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The buffer, each turn's offset with the end last, the content's start and end in it, and which are the assistant's."""
    number = {k: i for i, k in enumerate(dict.fromkeys(roles))}
    which = np.fromiter(map(number.__getitem__, roles), np.int64, len(roles))
    heads, head_n = _pool([START + escape(k.encode()).replace(b"\n", b"\\\n") + b"\n" for k in number])
    contents, n = _pool([escape(t.encode()) for t in texts])
    head_from, hn = (np.cumsum(head_n) - head_n)[which], head_n[which]
    size = hn + n + len(END)
    offsets = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(offsets[-1], np.uint8)
    start = offsets[:-1] + hn
    _scatter(out, heads, hn, offsets[:-1], head_from)
    _scatter(out, contents, n, start)
    tail = np.frombuffer(END, np.uint8)
    out[(start + n)[:, None] + np.arange(len(END))] = tail
    return out, offsets, start, start + n, which == number.get("assistant", -1)


def _rows(table: pa.Table, parts: dict) -> pa.RecordBatch:
    """One row for each run of equal conv_id in table; parts: the last conversation's id and number of rows so far."""
    ids = table.column("conv_id").combine_chunks()
    key = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
    null = ids.is_null().to_numpy(zero_copy_only=False)
    out, offsets, start, end, own = assemble(key, table.column("role").to_pylist(), table.column("text").to_pylist())
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (null[1:] != null[:-1])]))
    bounds = np.concatenate([first, [len(key)]])
    cuts = offsets[bounds]
    formatted = pa.Array.from_buffers(pa.large_utf8(), len(first), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(out)])
    group = np.repeat(np.arange(len(first)), np.diff(bounds))
    mine = np.flatnonzero(own)
    spans = pa.StructArray.from_arrays([pa.array(x[mine] - cuts[group[mine]]) for x in (start, end)], ["start", "end"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(mine, bounds).astype(np.int32)), spans)
    names = [None if null[i] else int(key[i]) for i in first]
    number = [0] * len(names)
    if parts.get("some") and parts["id"] == names[0]:
        number[0] = parts["n"]
    parts |= {"some": True, "id": names[-1], "n": number[-1] + 1}
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(number, pa.int64()), formatted.cast(pa.string()), lists], names=["conv_id", "part", "formatted", "loss_spans"])


def format_conversations(rows: DataFrame, max_bytes: int = 1 << 24) -> DataFrame:
    """rows (conv_id, turn, role, text) as conv_id, part, formatted, loss_spans (byte offsets in formatted, end exclusive)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict = {}
        waiting: list[pa.RecordBatch] = []
        size = 0
        for whole in batches:
            step = max(1, min(whole.num_rows, whole.num_rows * max_bytes // max(1, whole.nbytes)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                ids = batch.column("conv_id").to_pylist()
                cut = len(ids)
                while cut and ids[cut - 1] == ids[-1]:
                    cut -= 1
                if cut or (waiting and waiting[-1].column("conv_id")[0].as_py() != ids[0]):
                    table = pa.Table.from_batches([*waiting, batch.slice(0, cut)])
                    if table.num_rows:
                        yield _rows(table, parts)
                    waiting, size = [], 0
                waiting.append(batch.slice(cut))
                size += batch.nbytes * (len(ids) - cut) // max(1, len(ids))
                if size > max_bytes:
                    yield _rows(pa.Table.from_batches(waiting), parts)
                    waiting, size = [], 0
        if waiting:
            yield _rows(pa.Table.from_batches(waiting), parts)

    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    ordered = (
        rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", empty("role"), empty("text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )
    return ordered.mapInArrow(run, SCHEMA)


def parsed(formatted: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(role, text) of each turn, unescaped."""
    for m in _TURN.finditer(formatted):
        yield unescape(m[1]), unescape(m[2])


def digests(formatted: DataFrame) -> DataFrame:
    """Read back from format_conversations' rows, in their order and partitions: the digests of each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        now: dict = {}

        def close():
            if now:
                done.append((now["id"], now["turns"], now["all"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["size"]))

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] == 0:
                    close()
                    now = {"id": row["conv_id"], "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "size": 0}
                raw = row["formatted"].encode()
                now["size"] += len(row["formatted"])
                for role, text in parsed(raw):
                    now["turns"] += 1
                    now["all"].update(role + b"\n" + text + b"\n")
                for span in row["loss_spans"]:
                    text = unescape(raw[span["start"] : span["end"]])
                    now["chars"] += len(text.decode())
                    now["loss"].update(text)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), found.types)], schema=found)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), found.types)], schema=found)

    found = pa.schema({"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()})
    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
