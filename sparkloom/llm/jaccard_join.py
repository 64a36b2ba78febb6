"""N-gram Jaccard join with PartEnum signatures, and the components of its links.

Two documents link when den * |A & B| >= num * |A | B| for their sets of word shingles. Sizes are cut into bands. A
pair whose smaller set has a size in band i differs in at most k elements, k following from the band's upper bound, so
instance i of the signature scheme serves it: the feature domain is partitioned by a hash into n1 groups of n2 = 2
parts; at most k differences leave some group with one at most; so of the subsets of n2 - 1 parts of that group, one
agrees in full. A set emits, for the instance of its band and for that of the band below where a partner could be in
it, one signature for each group and subset: the hash of its elements there.

There are `spare` groups more than needed, so a linked pair agrees in 1 + spare signatures at least. Each set leaves
out its `spare` most frequent ones, by a global order of frequency and hash: of the agreeing signatures of a pair the
least frequent is left out by neither, since else all 1 + spare would be. So signatures over few elements, or over a
passage that many unrelated documents share, go, and no link is lost.

Equal sets are one node, the row of least number, and only nodes emit signatures. The first pass counts each signature
(pre-aggregated on the map side); a Bloom filter of fixed size, built of the shared ones, thins the second pass before
an exact join with them. The least node with a signature leads it, and each leader is a family: the nodes with a
signature that it leads. A linked pair has a common leader, and is compared in the family of the least one they have;
a family whose nodes all have another one as their least compares nothing and goes. So families reach no further than
signatures do: they are not chained to each other.

A family that one block holds is one unit of work. A larger one is cut by the logarithm of the sets' sizes, so that
only the same and the next cut can hold partners, and each cut is dealt to blocks of a bounded number of documents and
elements; a unit is a pair of blocks that can hold partners. A unit counts intersections as matrix products, in smaller
parts, and puts out a spanning forest of its links and the number of links of each set, never the pairs. No candidate
is dropped.

Documents without words, or null texts, have no shingles and link with nothing. A null id has a null component and
links with nothing. Rows of equal id are documents of their own, which share a component where they link. Columns
other than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.batches import bounded_batches, numbered, slices
from sparkloom.llm.graphs import components
from sparkloom.llm.shingles import U, mix, shingle_sets
from sparkloom.session import discard, written

PARTS = 2  # n2; a group may differ in one element, so subsets are of n2 - 1 parts
_SUBSETS = [list(c) for c in combinations(range(PARTS), PARTS - 1)]


def band_end(low: int, num: int, den: int) -> int:
    """The last size of the band that begins at low: wide enough for a partner to be in the same band or the next."""
    return max(low, low * 7 // 5, low * den // num)


@lru_cache(65536)
def instances(size: int, num: int, den: int) -> list[tuple[int, int]]:
    """(instance, k) for the signatures of a set of a size."""
    low, band, out, below = 1, 0, [], None
    while size:
        high = band_end(low, num, den)
        if low <= size <= high:
            if below and size * num <= below[1] * den:
                out.append((below[0], below[1] * (den - num) // num))
            return [x for x in [*out, (band, high * (den - num) // num)] if x[1]]
        below = (band, high)
        low, band = high + 1, band + 1
    return []


def spare_groups(k: int) -> int:
    return 1 + k // 10


def signatures(h: np.ndarray, num: int, den: int) -> list[tuple[int, np.ndarray]]:
    """(instance, PartEnum signatures) of a set of hashes."""
    return [(i, _emitted(h, k, i)) for i, k in instances(len(h), num, den)]


def _emitted(h: np.ndarray, k: int, instance: int) -> np.ndarray:
    groups = k // 2 + 1 + spare_groups(k)
    cells = groups * PARTS
    cell = ((mix(h + U(0xA0761D6478BD642F)) >> U(32)) * U(cells) >> U(32)).astype(np.int64)
    value = mix(h ^ U(0xE7037ED1A0B428DB))
    low = np.bincount(cell, (value & U(0xFFFFFFFF)).astype(np.float64), cells).astype(np.uint64)
    high = np.bincount(cell, (value >> U(32)).astype(np.float64), cells).astype(np.uint64)
    total = (low + (high << U(32))).reshape(groups, PARTS)
    sums = np.stack([total[:, s].sum(1, dtype=np.uint64) for s in _SUBSETS], 1).ravel()
    number = np.arange(len(sums), dtype=np.uint64) + U(instance << 32)
    return mix(sums + mix(number))


def profiles(rows: DataFrame, k: int) -> DataFrame:
    """rows (_rid, doc_id, text) as _rid, doc_id, n (size of the set), f1 and f2 (its fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 1 << 20):
            h, n = shingle_sets(batch.column(2).to_pylist(), k)
            f1, f2 = fingerprints(h, n)
            columns = [*batch.columns[:2], pa.array(n.astype(np.int64)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["_rid", "doc_id", "n", "f1", "f2"])

    return rows.mapInArrow(run, "_rid long, doc_id long, n long, f1 long, f2 long")


def fingerprints(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(n)
    one, two = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ U(s)), dtype=np.uint64)]) for s in (0x8BB84B93962EACC9, 0x2D358DCCAA6C78A5))
    return tuple(mix(x[ends] - x[ends - n]) for x in (one, two))


def emitted(nodes: DataFrame, k: int, num: int, den: int, named: bool = True) -> DataFrame:
    """(sig, node, band), or (sig) alone, for the signatures of nodes (node, text); no node has a signature twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 1 << 20):
            h, n = shingle_sets(batch.column(1).to_pylist(), k)
            own = [(node, band, x) for node, e, m in zip(batch.column(0).to_pylist(), np.cumsum(n), n) for band, x in signatures(h[e - m : e], num, den)]
            columns = [pa.array(np.concatenate([np.zeros(0, np.uint64), *(x for _, _, x in own)]).view(np.int64))]
            if named:
                size = [len(x) for _, _, x in own]
                columns += [pa.array(np.repeat(np.array([x[i] for x in own], t), size)) for i, t in ((0, np.int64), (1, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["sig", "node", "band"][: len(columns)])

    return nodes.select("node", "text").mapInArrow(run, "sig long, node long, band int" if named else "sig long")


def _maybe(sigs: DataFrame, shared: DataFrame, most: int) -> DataFrame:
    """The rows of sigs that a Bloom filter of shared may hold: at most `most` blocks of four words, broadcast."""
    blocks = 1
    size = shared.count()
    while blocks < most and blocks * 16 < size:
        blocks *= 2
    block = F.shiftrightunsigned("sig", 40).bitwiseAND(F.lit(blocks - 1)).cast("int")
    masks = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("sig", 6 * w).bitwiseAND(F.lit(63)).cast("int")) for w in range(4)]
    bloom = shared.groupBy(block.alias("block")).agg(*[F.bit_or(m).alias(f"w{w}") for w, m in enumerate(masks)])
    test = F.lit(True)
    for w, m in enumerate(masks):
        test = test & (F.col(f"w{w}").bitwiseAND(m) != 0)
    return sigs.withColumn("block", block).join(F.broadcast(bloom), "block").where(test).select("sig", "node", "band")


def _spares(num: int, den: int, bands: int = 64) -> Column:
    """By number of band, how many signatures a set leaves out; 64 bands reach to sets of 2^31 elements."""
    low, out = 1, []
    for _ in range(bands):
        high = band_end(low, num, den)
        out.append(spare_groups(high * (den - num) // num))
        low = high + 1
    return F.array(*map(F.lit, out))


def candidates(nodes: DataFrame, k: int, num: int, den: int, bloom_blocks: int = 1 << 18) -> DataFrame:
    """node, own: of nodes (node, text) with a signature that others keep too, the sorted leaders of such signatures."""
    shared = emitted(nodes, k, num, den, named=False).groupBy("sig").agg(F.count("*").alias("often"))
    shared = written(shared.where("often > 1"), "shared")
    rows = _maybe(emitted(nodes, k, num, den), shared.select("sig"), bloom_blocks).join(shared, "sig")
    rank = F.row_number().over(Window.partitionBy("node", "band").orderBy(F.desc("often"), "sig"))
    kept = rows.withColumn("rank", rank).where(F.col("rank") > F.element_at(_spares(num, den), F.col("band") + 1))
    kept = written(kept.select("sig", "node"), "kept")
    leaders = kept.groupBy("sig").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("sig", "a")
    own = written(kept.join(leaders, "sig").groupBy("node").agg(F.sort_array(F.collect_set("a")).alias("own")), "leaders")
    discard(shared, kept)
    return own


def linked(sets: list[np.ndarray], num: int, den: int, left: int) -> np.ndarray:
    """Which pairs of sets link, as a matrix; if left is not 0, only pairs of one of the first `left` and another count."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), sizes)
    _, element, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[element] > 1
    owner, element = owner[shared], element[shared]
    _, element = np.unique(element, return_inverse=True)
    common = np.zeros((m, m), np.float64)
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    width = max(1, min(2048, (1 << 22) // max(1, m)))
    for a in range(0, int(element[-1]) + 1 if len(element) else 0, width):
        x, y = np.searchsorted(element, [a, a + width])
        part = np.zeros((m, width), np.float32)
        part[owner[x:y], element[x:y] - a] = 1
        common += part @ part.T
    common = common.astype(np.int64)
    out = den * common >= num * (sizes[:, None] + sizes[None, :] - common)
    np.fill_diagonal(out, False)
    if left:
        out[:left, :left] = False
        out[left:, left:] = False
    return out


def _forest(mask: np.ndarray) -> np.ndarray:
    """The least index that each row reaches."""
    label = np.arange(len(mask))
    for i in range(len(mask)):
        if label[i] != i:
            continue
        todo = [i]
        while todo:
            near = np.flatnonzero(mask[todo].any(0) & (label > i))
            near = near[label[near] == near]
            label[near] = i
            todo = near.tolist()
    return label


def _cut(sizes: list[int], docs: int, elements: int) -> list[tuple[int, int]]:
    """Consecutive ranges of at most so many sets and elements (one set at least)."""
    out, at, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > at and (i - at >= docs or total + n > elements):
            out.append((at, i))
            at, total = i, 0
        total += n
    return [*out, (at, len(sizes))] if sizes else out


def _unit(family: int, group: list[tuple], num: int, den: int, docs: int, elements: int) -> tuple[list, list, list]:
    """group: (side, node, n, copies, own, set), all pairs of which are to be compared, or, if side 1 occurs, those of
    the two sides; pairs with a common leader below the family's are another's. The nodes that have links, one node
    each reaches, and their number of links."""
    group.sort(key=lambda r: (r[0], r[2], r[1]))
    sets = [np.frombuffer(r[5], np.uint64) for r in group]
    lower = [(i, x) for i, r in enumerate(group) for x in r[4] if x < family]
    place = {x: j for j, x in enumerate(dict.fromkeys(x for _, x in lower))}
    led = np.zeros((len(group), len(place)), np.float32)
    if lower:
        led[[i for i, _ in lower], [place[x] for _, x in lower]] = 1
    led = led[:, led.sum(0) > 1]
    sizes = [len(x) for x in sets]
    copies = np.array([r[3] for r in group], np.int64)
    left = sum(r[0] == 0 for r in group)
    one = _cut(sizes[:left], docs, elements)
    two = [(a + left, b + left) for a, b in _cut(sizes[left:], docs, elements)]
    label, weight = np.arange(len(group)), np.zeros(len(group), np.int64)

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for x, (a, b) in enumerate(one):
        for c, d in two or one[x:]:
            small, large = sorted(((sizes[a], sizes[b - 1]), (sizes[c], sizes[d - 1])))
            if small[1] * den < large[0] * num:  # sorted by size: no pair can link
                continue
            rows = np.r_[a:b] if (a, b) == (c, d) else np.r_[a:b, c:d]
            mask = linked([sets[i] for i in rows], num, den, 0 if (a, b) == (c, d) else b - a)
            if led.shape[1]:
                mask &= ~(led[rows] @ led[rows].T > 0)
            weight[rows] += mask @ copies[rows]
            for i, m in enumerate(_forest(mask)):
                y, z = sorted((root(rows[i]), root(rows[m])))
                label[z] = y
    keep = np.flatnonzero(weight)
    return [group[i][1] for i in keep], [group[root(i)][1] for i in keep], weight[keep].tolist()


def _verified(units: DataFrame, num: int, den: int, docs: int, elements: int) -> DataFrame:
    """units (family, bin, kind, i, j, side, node, n, copies, own, set) as a, b (links of a spanning forest) and a's links."""
    names = ["a", "b", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        out: list[list] = [[], [], []]

        def close():
            if len(group) > 1:
                for o, x in zip(out, _unit(key[0], group, num, den, docs, elements)):
                    o.extend(x)

        for batch in slices(batches, 10):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:5] != key:
                    close()
                    key, group = row[:5], []
                group.append(row[5:])
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=names)
                out = [[], [], []]
        close()
        yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=names)

    by = ["family", "bin", "kind", "i", "j"]
    ordered = units.repartition(*by).sortWithinPartitions(*by)
    return ordered.select(*by, "side", "node", "n", "copies", "own", "set").mapInArrow(run, "a long, b long, links long")


def _placed(members: DataFrame, num: int, den: int, block_docs: int, block_elements: int, broadcast_ids: int) -> DataFrame:
    """members (node, family, n) with bin, block, and the numbers of blocks of the bin and its neighbours.

    A family of one block is one unit. Of a larger one, bin is the logarithm of n to the base of den / num, rounded
    down: sets that link are in the same bin (kind 0) or in neighbouring ones (kind 1, named by the lower one).
    """
    blocks = F.ceil(F.greatest(F.count("*") / block_docs, F.sum("n") / block_elements)).cast("int")
    large = written(members.groupBy("family").agg(blocks.alias("whole")).where("whole > 1").select("family"), "large")
    hint = F.broadcast if large.count() <= broadcast_ids else (lambda df: df)
    width = math.log(den / num) * (1 + 1e-9) if num < den else 1e-9
    members = members.withColumn("bin", F.floor(F.log("n") / width).cast("int"))
    bins = members.join(hint(large), "family", "left_semi").groupBy("family", "bin").agg(blocks.alias("blocks"))
    for name, step in (("below", 1), ("above", -1)):
        other = bins.select("family", (F.col("bin") + step).alias("bin"), F.col("blocks").alias(name))
        bins = bins.join(other, ["family", "bin"], "left")
    bins = written(bins.fillna(0), "bins")
    hint = F.broadcast if bins.count() <= broadcast_ids else (lambda df: df)
    members = members.join(hint(bins), ["family", "bin"], "left")
    members = members.withColumn("bin", F.when(F.col("blocks").isNull(), 0).otherwise(F.col("bin"))).fillna({"blocks": 1, "below": 0, "above": 0})
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    return members.select("node", "family", "bin", block.alias("block"), "blocks", "below", "above")


def _units(sets: DataFrame) -> DataFrame:
    """Sets (node, n, copies, own, places, set), once for each unit they are in."""

    def unit(bin_: Column, kind: int, i: Column, j: Column, side: Column) -> Column:
        return F.struct(bin_.alias("bin"), F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))

    def each(n: str, f) -> Column:
        return F.transform(F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>")), f)

    zero, one, here, block = F.lit(0), F.lit(1), F.col("bin"), F.col("block")
    own = each("blocks", lambda o: unit(here, 0, F.least(block, o), F.greatest(block, o), F.when(block <= o, zero).otherwise(one)))
    up = each("above", lambda o: unit(here, 1, block, o, zero))
    down = each("below", lambda o: unit(here - 1, 1, o, block, one))
    each_place = sets.select("node", "n", "copies", "own", "set", F.inline("places"))
    units = F.explode(F.concat(own, up, down)).alias("u")
    return each_place.select("node", "family", "n", "copies", "own", "set", units).select("node", "family", "n", "copies", "own", "set", "u.*")


def join(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    block_docs: int = 2000,
    block_elements: int = 4_000_000,
    part_docs: int = 500,
    part_elements: int = 1_000_000,
    broadcast_ids: int = 1_000_000,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """For each row of docs: doc_id, n_shingles, component_id, n_links (linked documents, equal sets included).

    Blocks (what a unit gets) and parts (what is multiplied at once) are bounded by documents and elements. Tables of
    at most broadcast_ids nodes or families are broadcast; beyond, the nodes' texts are written once, by a shuffle join.
    """
    num, den = percent, 100
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = numbered(rows, "doc_id").select("_rid", "doc_id", "text")
    with bounded_batches(spark):
        profile = written(profiles(rows, words), "profiles")
        known = profile.where("n > 0 AND doc_id IS NOT NULL")
        reps = written(known.groupBy("n", "f1", "f2").agg(F.min("_rid").alias("node"), F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "reps")
        few = reps.count() <= broadcast_ids
        texts = rows.select(F.col("_rid").alias("node"), "text")
        nodes = texts.join(F.broadcast(reps.select("node")) if few else reps.select("node"), "node")
        if not few:
            nodes = written(nodes, "nodes")
        own = candidates(nodes, words, num, den)
        sized = own.join(reps.select("node", "n", "copies"), "node")
        members = sized.select("node", "n", F.get("own", F.lit(0)).alias("f"), F.explode("own").alias("family"))
        busy = members.groupBy("family").agg(F.min("f").alias("x"), F.max("f").alias("y"), F.count("*").alias("m"))
        busy = written(busy.where("m > 1 AND (x <> y OR x = family)").select("family"), "busy")
        members = members.join(F.broadcast(busy) if busy.count() <= broadcast_ids else busy, "family", "left_semi")
        places = _placed(members.drop("f"), num, den, block_docs, block_elements, broadcast_ids)
        place = "array<struct<family:long,bin:int,block:int,blocks:int,below:int,above:int>>"
        places = places.groupBy("node").agg(F.collect_list(F.struct("family", "bin", "block", "blocks", "below", "above")).alias("places"))
        places = written(places.join(sized, "node"), "places")
        if (places.agg(F.sum(F.size("places") + F.size("own"))).first()[0] or 0) <= broadcast_ids:
            places = F.broadcast(places)

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1, 1 << 20):
                h, n = shingle_sets(batch.column(1).to_pylist(), words)
                ends = np.cumsum(n)
                found = pa.array([h[e - m : e].tobytes() for e, m in zip(ends, n)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], found], names=["node", "n", "copies", "own", "places", "set"])

        chosen = nodes.join(places, "node").select("node", "text", "n", "copies", "own", "places")
        units = _units(chosen.mapInArrow(sets, f"node long, n long, copies long, own array<long>, places {place}, set binary"))
        found = written(_verified(units, num, den, part_docs, part_elements), "links")
        classes = written(components(found.select("a", "b")), "classes")
        discard(own)
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    own = reps.join(classes, "node", "left").join(links, reps.node == links.a, "left").withColumn("component", F.coalesce("component", "node"))
    least = own.groupBy("component").agg(F.min("rep").alias("component_id"))
    own = own.join(least, "component").select("n", "f1", "f2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return profile.join(own, ["n", "f1", "f2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"),
    )
