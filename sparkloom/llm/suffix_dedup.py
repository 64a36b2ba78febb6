"""Suffix-array dedup: removing bytes covered by strings of `length` bytes that start anywhere else too.

Which suffixes are sorted. Every window of `length` bytes has an anchor: the place of its least-hashed gram of `gram`
bytes (leftmost of equal ones). The choice depends on the window's bytes alone, so equal windows have equal grams at
equal offsets: a window whose gram occurs once in the corpus is not repeated, and its suffix need not be sorted. The
windows that one anchor serves are consecutive; their bytes are the anchor's span. Spans that are equal in all
respects (by the 128 bits of two hashes) are one class with a count, pre-aggregated before any exchange, and each
class of a gram that occurs twice or more sends one suffix, from the anchor on, with the bytes before the anchor, to
the sort.

The sort. Each task sorts its suffixes and writes, for each partition of the grams, front-coded runs: of each suffix
the length of the prefix it shares with the one before, and the rest. Partitions are as many as the measured bytes
need, and a partition's runs are merged by a loser tree whose nodes keep the length of the prefix that the loser
shares with the winner: of two candidates the one that shares more with the last output is less, and only of equal
lengths are bytes compared, from that length on.

The verdict. The common-prefix lengths that come out with the order decide. Neighbours that share a gram are a group;
two windows with l bytes before the anchor are equal when their suffixes share length - l bytes (the least of the
prefix lengths between them) and what stands before their anchors shares l bytes (likewise, in the order of those
bytes read backwards). So for each l both orders fall into blocks, and windows in the same two blocks are equal.

A gram of more than most_classes classes is not left to one group: windows with at most half of their spare bytes
before the anchor go by a hash of the bytes they have after it in common, the others by a hash of those before it. Where
these groups have more than most_classes classes still (a passage a little shorter than `length` in very many texts), their
windows are counted by their whole bytes, which no task needs to hold together.

Verdicts go back to the members of the classes, the covered bytes are merged for each document, and the rest of the
text is kept.

Null texts count as empty; texts shorter than `length` keep all. Rows are documents: repeated rows repeat each other,
whatever their ids. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.batches import bounded_batches, numbered, slices
from sparkloom.llm.shingles import U, eights, mix
from sparkloom.session import discard, written

PIECE = 1 << 20  # windows of a text that are handled at once


class Hashes:
    """Hashes of the substrings of data of `least` bytes or more: those of 2^k bytes at every place come from two of
    half the length, joined by mix, so no sum or polynomial of the bytes is involved."""

    def __init__(self, data: np.ndarray, lengths: tuple[int, ...]):
        self.level: dict[int, np.ndarray] = {}
        wanted = {1 << (n.bit_length() - 1) for n in lengths}
        size = 8 if min(wanted) >= 8 else 1
        h = mix(eights(data)[: max(0, len(data) - 7)] if size == 8 else data.astype(np.uint64) + U(1))
        while True:
            if size in wanted:
                self.level[size] = h
            if size >= max(wanted):
                break
            h = mix(h[:-size] * U(0x9E3779B97F4A7C15) + h[size:]) if len(h) > size else h[:0]
            size *= 2

    def of(self, start: np.ndarray, size: np.ndarray | int, base: int) -> np.ndarray:
        """Of `size` bytes from start; base is one of the lengths given, size is from base to 4 times its power of 2."""
        power = 1 << (base.bit_length() - 1)
        h = self.level[power]
        out = mix(np.zeros(len(start), np.uint64) + (size.astype(np.uint64) if isinstance(size, np.ndarray) else U(size)))
        most = int(np.max(size, initial=0))
        for step in range(0, most, power):
            out = mix(out * U(0x9E3779B97F4A7C15) + h[start + np.minimum(step, size - power)])
        return out


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(v) - width + 1
    pad = -len(v) % width
    blocks = np.concatenate([v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For texts laid end to end in data (their ends in ends): gram hash, class hash, first window, number of windows,
    and offset of the anchor in the first window, of each anchor."""
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    n = len(data) - length + 1
    if n <= 0:
        return none
    hashes = Hashes(data, (gram, length))
    at = np.arange(len(data) - gram + 1)
    h = hashes.of(at, gram, gram)
    place = U((1 << 21) - 1)
    v = (h & ~place) | at.astype(np.uint64)
    least = (_sliding_least(v, length - gram + 1) & place).astype(np.int64)
    p = np.arange(n)
    ok = p + length <= ends[np.searchsorted(ends, p, "right")]
    change = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (ok[1:] != ok[:-1])]))
    change = np.union1d(change, np.searchsorted(p, ends[ends < n]))
    stop = np.append(change[1:], n)
    use = ok[change]
    first, stop = change[use], stop[use]
    a = least[first]
    count, offset = stop - first, a - first
    cls = mix(hashes.of(first, count - 1 + length, length) + mix((count * 4096 + offset).astype(np.uint64)))
    return h[a], cls, first, count, offset


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts laid end to end, their ends, which text each is and where in it; long texts in overlapping pieces."""
    held, own, base, size = [], [], [], 0

    def out():
        return np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(x) for x in held]), np.array(own), np.array(base)

    for i, t in enumerate(texts):
        if len(t) < length:
            continue
        for s in range(0, len(t) - length + 1, PIECE):
            part = t[s : s + PIECE + length - 1]
            if held and size + len(part) >= 2 * PIECE - 2 * length:
                yield out()
                held, own, base, size = [], [], [], 0
            held.append(part)
            own.append(i)
            base.append(s)
            size += len(part)
    if held:
        yield out()


def _all_anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """rows (rid, text) as rid, kg (gram hash), cls, start, n, off."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, PIECE):
            rid = batch.column(0).to_numpy()
            for data, ends, own, base in _pieces([(t or "").encode() for t in batch.column(1).to_pylist()], length):
                kg, cls, first, n, off = anchors(data, ends, length, gram)
                which = np.searchsorted(ends, first, "right")
                start = first - np.concatenate([[0], ends[:-1]])[which] + base[which]
                columns = [rid[own[which]], kg.view(np.int64), cls.view(np.int64), start, n.astype(np.int32), off.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rid", "kg", "cls", "start", "n", "off"])

    return rows.mapInArrow(run, "rid long, kg long, cls long, start long, n int, off int")


def shared_prefix(x: bytes, y: bytes, known: int) -> int:
    """The length of the common prefix, of which `known` bytes are known."""
    most = min(len(x), len(y))
    low, high, step = known, most, 16
    while low < high:  # x and y agree up to low, and differ within high or agree there too
        mid = min(low + step, high)
        if x[low:mid] == y[low:mid]:
            low, step = mid, step * 2
        elif mid - low == 1:
            return low
        else:
            high, step = mid - 1 if x[low : mid - 1] == y[low : mid - 1] else mid, max(1, (mid - low) // 2)
            if high == mid - 1:
                return high
    return low


def front_coded(suffixes: list[tuple[bytes, bytes]]) -> bytes:
    """A sorted run of (suffix, payload): shared length, length of the rest, length of the payload, rest, payload."""
    out, before = [], b""
    for s, payload in suffixes:
        k = shared_prefix(before, s, 0)
        out += [k.to_bytes(3, "little"), (len(s) - k).to_bytes(3, "little"), len(payload).to_bytes(3, "little"), s[k:], payload]
        before = s
    return b"".join(out)


def decoded(run: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(shared length, suffix, payload) of a front-coded run."""
    at, before, whole = 0, b"", memoryview(run)
    number = lambda i: int.from_bytes(whole[i : i + 3], "little")
    while at < len(run):
        k, n, m = number(at), number(at + 3), number(at + 6)
        at += 9
        before = before[:k] + bytes(whole[at : at + n])
        yield k, before, bytes(whole[at + n : at + n + m])
        at += n + m


def merged(runs: list[Iterator[tuple[int, bytes, bytes]]]) -> Iterator[tuple[int, bytes, bytes]]:
    """(length shared with the suffix before, suffix, payload) of all runs in order, by a loser tree."""
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    # a candidate: (shared with the last output, suffix, payload, run); None: its run has ended
    now = [next(r, None) for r in runs]
    heads: list = [None if x is None else (0, x[1], x[2], i) for i, x in enumerate(now)] + [None] * (leaves - len(runs))
    losers: list = [None] * leaves

    def play(a, b):
        """(winner, loser); the loser keeps the length it shares with the winner."""
        if a is None or b is None:
            return (b, a) if a is None else (a, b)
        if a[0] != b[0]:
            return (a, b) if a[0] > b[0] else (b, a)
        k = shared_prefix(a[1], b[1], a[0])
        if a[1][k : k + 1] <= b[1][k : k + 1]:
            return a, (k, *b[1:])
        return b, (k, *a[1:])

    level = heads
    size = leaves
    while size > 1:
        level, half = [play(level[i], level[i + 1]) for i in range(0, size, 2)], size // 2
        for i, (_, loser) in enumerate(level):
            losers[half + i] = loser
        level, size = [w for w, _ in level], half
    best = level[0]
    while best is not None:
        yield best[0], best[1], best[2]
        i = best[3]
        x = next(runs[i], None)
        best = None if x is None else (x[0], x[1], x[2], i)
        node = (leaves + i) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


Entry = tuple[bytes, bytes, int, int, int]  # suffix, bytes before the anchor, members, and the windows asked for


def repeated(group: list[Entry], shared: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For classes of one gram in order of their suffixes, and the length of the prefix that each shares with the one
    before (the first is not read): of each class the repeated windows that are asked for, as runs (first, number)."""
    if len(group) == 1:
        (_, _, members, lo, hi) = group[0]
        return [[(lo, hi - lo)] if members > 1 else []]
    back = [g[1][::-1] for g in group]
    if len(group) == 2 and group[0][2] == group[1][2] == 1:  # the most usual case, without arrays
        few, most = length - shared[1], shared_prefix(back[0], back[1], 0)
        low = max(few, *(len(b) - g[4] + 1 for b, g in zip(back, group)))
        high = min(most, *(len(b) - g[3] for b, g in zip(back, group)))
        return [[(len(b) - high, high - low + 1)] if high >= low else [] for b in back]
    m = len(group)
    order = sorted(range(m), key=back.__getitem__)
    lcp = np.array(shared)
    lcs = np.array([0, *(shared_prefix(back[a], back[b], 0) for a, b in zip(order, order[1:]))])
    off = np.array([len(b) for b in back])
    least, most = off - np.array([g[4] for g in group]) + 1, off - np.array([g[3] for g in group])  # bytes before the anchor
    weight = np.array([min(g[2], 2) for g in group])
    masks = [np.zeros(g[4] - g[3], bool) for g in group]
    step = max(1, (1 << 20) // m)
    for first in range(int(least.min()), int(most.max()) + 1, step):
        before = np.arange(first, min(first + step, int(most.max()) + 1))[:, None]
        right = np.cumsum(lcp < length - before, 1)
        left = np.empty_like(right)
        left[:, order] = np.cumsum(lcs < before, 1)
        row, which = np.nonzero((before >= least) & (before <= most))
        _, same = np.unique((row * (m + 1) + right[row, which]) * (m + 1) + left[row, which], return_inverse=True)
        hit = np.bincount(same, weight[which])[same] > 1
        row, which = row[hit] + first, which[hit]
        for i in np.unique(which):
            masks[i][off[i] - row[which == i] - group[i][3]] = True
    out = []
    for g, mask in zip(group, masks):
        edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]])))
        out.append([(g[3] + a, b - a) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())])
    return out


def _name(kg: int, cls: int, members: int, lo: int, hi: int) -> bytes:
    """What the sort carries beside a suffix: the class, whether it repeats, and the windows asked for."""
    parts = (kg.to_bytes(8, "big", signed=True), cls.to_bytes(8, "big", signed=True), min(members, 2).to_bytes(1, "big"))
    return b"".join(parts) + lo.to_bytes(4, "big") + hi.to_bytes(4, "big")


def _halves(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """rows (text, items) of hot classes as kg, cls, members, lo, hi, key, before, suffix: the windows lo to hi of a class
    have the bytes in common that key is a hash of (those that have more than half before the anchor what is before it,
    the others what follows it); before and suffix are the class's bytes before and from the anchor on."""
    half = (length - gram) // 2
    schema = pa.schema([("kg", pa.int64()), ("cls", pa.int64()), ("members", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("key", pa.int64()), ("before", pa.binary()), ("suffix", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, 1 << 22):
            out: list[tuple] = []
            size = 0
            for text, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = (text or "").encode()
                for x in items:
                    a, end = x["start"] + x["off"], x["start"] + x["n"] - 1 + length
                    before, suffix = raw[x["start"] : a], raw[a:end]
                    cut = min(max(0, x["off"] - half), x["n"])
                    for lo, hi, tag, common in ((0, cut, b"b", before[-half - 1 :]), (cut, x["n"], b"a", suffix[: length - half])):
                        if lo < hi:
                            digest = hashlib.blake2b(tag + x["kg"].to_bytes(8, "big", signed=True) + common, digest_size=8).digest()
                            out.append((x["kg"], x["cls"], x["members"], lo, hi, int.from_bytes(digest, "big", signed=True), before, suffix))
                            size += len(before) + len(suffix) + 200
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return rows.select("text", "items").mapInArrow(run, "kg long, cls long, members long, lo int, hi int, key long, before binary, suffix binary")


def split_halves(halves: DataFrame, most_classes: int) -> tuple[DataFrame, DataFrame]:
    """_halves() whose key has at most most_classes classes, which one task may compare, and those whose key has more."""
    many = halves.groupBy("key").count().where(F.col("count") > most_classes).select("key")
    return halves.join(many, "key", "left_anti"), halves.join(many, "key", "left_semi")


def _windows(halves: DataFrame, length: int) -> DataFrame:
    """kg, cls, members, window, digest: each window asked for, with 128 bits of a hash of its whole bytes."""
    schema = pa.schema([("kg", pa.int64()), ("cls", pa.int64()), ("members", pa.int32()), ("window", pa.int32()), ("digest", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out: list[tuple] = []
                for kg, cls, members, lo, hi, before, suffix in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    span = before + suffix
                    out += [(kg, cls, min(members, 2), w, hashlib.blake2b(span[w : w + length], digest_size=16).digest()) for w in range(lo, hi)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    rows = halves.select("kg", "cls", "members", "lo", "hi", "before", "suffix")
    return rows.mapInArrow(run, "kg long, cls long, members int, window int, digest binary")


def _counted(halves: DataFrame, length: int, broadcast_digests: int) -> DataFrame:
    """Verdicts as of _verdicts() on the windows of halves: one is repeated where another has its digest.

    Windows are hashed twice and not written: to count them, when partial aggregation leaves each digest once for a task,
    and to keep those found twice. The digests of these are broadcast up to a number, and joined by a shuffle beyond.
    """
    often = written(_windows(halves, length).groupBy("digest").agg(F.sum("members").alias("c")).where("c > 1").select("digest"), "often")
    hit = _windows(halves, length).join(F.broadcast(often) if often.count() <= broadcast_digests else often, "digest", "left_semi")
    at = hit.groupBy("kg", "cls").agg(F.sort_array(F.collect_set("window")).alias("w"))  # at most length - gram + 1 of a class
    firsts = F.filter("w", lambda x: ~F.array_contains("w", x - 1))
    lasts = F.filter("w", lambda x: ~F.array_contains("w", x + 1))
    runs = at.select("kg", "cls", F.explode(F.arrays_zip(firsts.alias("first"), lasts.alias("last"))).alias("run"))
    verdicts = written(runs.select("kg", "cls", F.col("run")["first"].alias("first"), (F.col("run")["last"] - F.col("run")["first"] + 1).alias("windows")), "counted")
    discard(often)
    return verdicts


def _suffix_runs(rows: DataFrame, length: int, partitions: int) -> DataFrame:
    """rows (text, items) of documents with classes to send, or _halves(), as part, run: sorted and front-coded runs of
    the group's key and the suffix, each with its payload."""
    hot = "key" in rows.columns

    def from_texts(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes]]:
        for text, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = (text or "").encode()
            for x in items:
                a, end = x["start"] + x["off"], x["start"] + x["n"] - 1 + length
                yield x["kg"].to_bytes(8, "big", signed=True) + raw[a:end], _name(x["kg"], x["cls"], x["members"], 0, x["n"]) + raw[x["start"] : a]

    def from_halves(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes]]:
        for kg, cls, members, lo, hi, key, before, suffix in zip(*(c.to_pylist() for c in batch.columns)):
            yield key.to_bytes(8, "big", signed=True) + suffix, _name(kg, cls, members, lo, hi) + before

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        size = 0

        def out():
            for part, found in held.items():
                found.sort()
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "run": pa.array([front_coded(found)], pa.binary())})
            held.clear()

        for batch in batches if hot else slices(batches, 0, 1 << 22):
            for s, payload in (from_halves if hot else from_texts)(batch):
                held.setdefault(int.from_bytes(s[:8], "big") % partitions, []).append((s, payload))
                size += len(s) + len(payload) + 200
            if size > 1 << 26:
                yield from out()
                size = 0
        yield from out()

    columns = ["kg", "cls", "members", "lo", "hi", "key", "before", "suffix"] if hot else ["text", "items"]
    return rows.select(*columns).mapInArrow(run, "part int, run binary")


def _verdicts(runs: DataFrame, length: int, gram: int, partitions: int) -> DataFrame:
    """kg, cls and the runs of repeated windows (first, number) of each class."""
    schema = pa.schema({"kg": pa.int64(), "cls": pa.int64(), "first": pa.int32(), "windows": pa.int32()})

    def judged(parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        group: list[tuple] = []
        shared: list[int] = []

        def close():
            entries = [(s, p[25:], p[16], int.from_bytes(p[17:21], "big"), int.from_bytes(p[21:25], "big")) for s, p in group]
            for (_, p), found in zip(group, repeated(entries, shared, length)):
                kg, cls = (int.from_bytes(p[i : i + 8], "big", signed=True) for i in (0, 8))
                out.extend((kg, cls, a, n) for a, n in found)
            group.clear()
            shared.clear()

        for k, s, payload in merged([decoded(p) for p in parts]):
            if group and k < 8 + gram:
                close()
            group.append((s, payload))
            shared.append(k - 8)
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out.clear()
        if group:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part != now and held:
                    yield from judged(held)
                    held = []
                now = part
                held.append(blob)
        if held:
            yield from judged(held)

    ordered = runs.repartition(partitions, "part").sortWithinPartitions("part")
    return ordered.mapInArrow(run, "kg long, cls long, first int, windows int")


def _covered(rows: DataFrame, length: int) -> DataFrame:
    """rows (rid, start, windows) as rid and the merged covered bytes (two flat lists)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, spans = None, []
        done: list[tuple] = []
        for batch in batches:
            for rid, a, n in zip(*(c.to_pylist() for c in batch.columns)):
                if rid != now:
                    if spans:
                        done.append((now, spans))
                    now, spans = rid, []
                end = a + n - 1 + length
                if spans and a <= spans[-1]:
                    spans[-1] = max(spans[-1], end)
                else:
                    spans += [a, end]
            if len(done) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.list_(pa.int64()))], names=["rid", "cuts"])
                done = []
        if spans:
            done.append((now, spans))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.list_(pa.int64()))], names=["rid", "cuts"])

    return rows.repartition("rid").sortWithinPartitions("rid", "start").select("rid", "start", "windows").mapInArrow(run, "rid long, cuts array<long>")


def repeated_bytes(
    docs: DataFrame,
    length: int = 400,
    gram: int = 128,
    doc_id: str = "doc_id",
    text: str = "text",
    broadcast_rows: int = 1_000_000,
    most_classes: int = 1000,
    broadcast_digests: int = 500_000,
    part_bytes: int = 1 << 25,
) -> tuple[DataFrame, DataFrame]:
    """docs as _rid, doc_id, text; and rid, cuts (start, end, start, end, ... of the bytes to remove) of those that have any."""
    if length - gram + 1 > 4000 or gram < 1 or gram > length:
        raise ValueError("gram must be from length - 3999 to length")
    rows = numbered(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id").select("_rid", "doc_id", "text")
    with bounded_batches(docs.sparkSession):
        found = written(_all_anchors(rows.select(F.col("_rid").alias("rid"), "text"), length, gram), "anchors")
        first = F.min(F.struct("rid", "start", "n", "off")).alias("r")
        classes = found.groupBy("kg", "cls").agg(F.count("*").alias("members"), first)
        often = classes.groupBy("kg").agg(F.sum("members").alias("c"), F.count("*").alias("d")).where("c > 1")
        classes = classes.join(often.select("kg", (F.col("d") > most_classes).alias("hot")), "kg")
        item = F.struct("kg", "cls", "members", F.col("r.start").alias("start"), F.col("r.n").alias("n"), F.col("r.off").alias("off"), "hot")
        items = written(classes.groupBy("r.rid").agg(F.collect_list(item).alias("items"), F.sum("r.n").alias("windows"), F.max("hot").alias("hot")), "items")
        documents, total, hot = items.agg(F.count("*"), F.sum(F.col("windows") + F.size("items") * (length + 100)), F.coalesce(F.max("hot"), F.lit(False))).first()
        partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // part_bytes))
        wanted = items.select("rid")
        if documents <= broadcast_rows:
            wanted = F.broadcast(wanted)
        texts = rows.select(F.col("_rid").alias("rid"), "text")
        chosen = texts.join(wanted, "rid", "left_semi").join(items, "rid")
        runs = _suffix_runs(chosen.withColumn("items", F.filter("items", lambda x: ~x["hot"])), length, partitions)
        scratch = []
        if hot:  # grams with too many classes for one task
            mine = items.where("hot").withColumn("items", F.filter("items", lambda x: x["hot"]))
            theirs = F.broadcast(mine.select("rid")) if documents <= broadcast_rows else mine.select("rid")
            scratch.append(written(_halves(texts.join(theirs, "rid", "left_semi").join(mine, "rid"), length, gram), "halves"))
            few, many = split_halves(scratch[0], most_classes)
            runs = runs.unionByName(_suffix_runs(few, length, partitions))
            scratch.append(_counted(many, length, broadcast_digests))
        scratch.append(written(_verdicts(runs, length, gram, partitions), "verdicts"))
        verdicts = scratch[-1].unionByName(scratch[1]) if hot else scratch[-1]
        back = found.select("rid", "kg", "cls", "start").join(verdicts, ["kg", "cls"])
        cuts = written(_covered(back.select("rid", (F.col("start") + F.col("first")).alias("start"), "windows"), length), "cuts")
    discard(found, items, *scratch)
    return rows, cuts


def deduplicated(
    docs: DataFrame,
    length: int = 400,
    gram: int = 128,
    doc_id: str = "doc_id",
    text: str = "text",
    broadcast_cuts: int = 4_000_000,
    keep: bool = True,
    **options,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with keep, kept (the bytes that stay; a cut may split a character).

    The cuts are broadcast to the texts where they are broadcast_cuts numbers at most, and joined by a shuffle beyond.
    """
    rows, cuts = repeated_bytes(docs, length, gram, doc_id, text, **options)
    if (cuts.agg(F.sum(F.size("cuts") + 2)).first()[0] or 0) <= broadcast_cuts:
        cuts = F.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 22):
            out: list[tuple] = []
            for t, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw, c = (t or "").encode(), c or []
                edges = [0, *c, len(raw)]
                left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(raw), len(raw) - len(left), len(c) // 2, hashlib.sha256(left).hexdigest(), left))
            columns = [pa.array(x) for x in zip(*out)][: 5 if keep else 4]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(columns) + 1])

    joined = rows.join(cuts, F.col("_rid") == F.col("rid"), "left").select("doc_id", "text", "cuts")
    kind = dict(rows.dtypes)["doc_id"]
    with bounded_batches(docs.sparkSession):  # written, for the bound to hold whenever the result is read
        return written(joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep else "")), "kept")
