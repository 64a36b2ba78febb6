"""The operators of the training-data subpackage against brute force, exact round trips and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import batches, chat, decontaminate, graphs, jaccard_join, pii, quality_model, quality_rules, sentencepieces, shingles, suffix_dedup, token_files, url_filter
from sparkloom.llm import queries as Q
from sparkloom.session import scratch_path

SF = "/root/testdata/sf0.001"
tokenizers_path = pytest.importorskip("public_tokenizers").path
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n", "a", "é 日本 😀", "x" * 3000, "word " * 500, "word " * 500, "0" * 500 + "@" * 50, "a\x00b \\ </s><|im_end|>"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, repeats, junk, ties; ids null and repeated."""
    rows = [(i if i else None, t, None, None, None) for i, t in enumerate(ODD)] + [(5, "again and again", "en", "s", 1), (5, "again and again", "en", "s", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = Q.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(Q.oracle_sql()[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


# ---- 1 token files


def test_token_files(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizers_path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in Q.op1_token_files(spark, SF).collect()}
    start = 0
    for doc in sorted(texts):
        ids = np.array([*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 0], "<u4")
        assert got[doc] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_token_files_odd(spark, odd, empty):
    path = scratch_path(spark, "t")
    manifest = token_files.write(odd, path, tokenizers_path("byte_bpe_50k.json"), seq_len=16, batch_sequences=4, shards=3)
    rows = token_files.read(spark, path, manifest).collect()
    assert len(rows) == len(ODD) + 2 and sum(r.n_tokens for r in rows) == sum(m["n_tokens"] for m in manifest)
    reader = token_files.Reader(path, manifest[0]["shard"])
    ids, mask = reader.sequence(0)
    assert len(ids) == len(mask) == 16 and not ids.flags.owndata  # a view of the file
    assert token_files.read(spark, path, token_files.write(empty, scratch_path(spark, "t"), tokenizers_path("byte_bpe_50k.json"))).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" ab\n\t.é½ 日'1"), max_size=40), max_size=5))
def test_encoder_equals_library(parts):
    path = tokenizers_path("byte_bpe_50k.json")
    encoder = token_files._encoder(path)
    ids, n = encoder.encode(parts)
    want = [e.ids for e in encoder.tokenizer.encode_batch(parts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])][: len(parts)] == want


# ---- 2 Jaccard join


def brute_components(texts, words, percent):
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    comp = {d: d for d in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    links = Counter()
    for a, b in combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            comp[y] = x
    return {d: (len(s), find(d), links[d]) for d, s in sets.items()}


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_jaccard_join_variants(spark, words, percent):
    """A family of variants of one text with different numbers of edits, beside others that share a passage."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefg", k=5))
    base, passage = [word() for _ in range(120)], [word() for _ in range(40)]
    texts = {}
    for i in range(160):
        own = list(base) if i < 110 else [word() for _ in range(rng.randint(1, 60))] + passage
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 8])):
            own[rng.randrange(len(own))] = word()
        texts[i * 3 - 50] = " ".join(own)
    texts |= {1000: "A b", 1001: "a B", 1002: "a", 1003: "", 1004: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.join(df, words, percent, block_docs=40, part_docs=15).collect()}
    assert got == brute_components(texts, words, percent)


def test_jaccard_join_odd(spark, odd, empty):
    rows = jaccard_join.join(odd).collect()
    assert len(rows) == len(ODD) + 2
    by = {r.doc_id: r for r in rows}
    assert by[8].component_id == by[7].component_id == 7 and by[1].n_shingles == 0
    assert jaccard_join.join(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(0, 2**32), st.sampled_from([(90, 100), (80, 100), (70, 100)]))
def test_signatures_are_necessary(size, seed, rule):
    """A linked pair agrees in 1 + spare signatures of some instance, unless the sets are equal."""
    num, den = rule
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 2**63, size * 2).astype(np.uint64))
    a, b = set(pool[:size].tolist()), set(pool[:size].tolist())
    while True:
        c = set(b)
        c.discard(rng.choice(sorted(c))) if rng.random() < 0.5 and c else c.add(int(rng.choice(pool)))
        if not c or den * len(a & c) < num * len(a | c):
            break
        if c == b:
            break
        b = c
    if a == b:
        return
    x, y = (dict(jaccard_join.signatures(np.array(sorted(s), np.uint64), num, den)) for s in (a, b))
    low, k_of = 1, {}
    for i in range(64):
        high = jaccard_join.band_end(low, num, den)
        k_of[i] = high * (den - num) // num
        low = high + 1
    assert any(len(set(x[i].tolist()) & set(y[i].tolist())) >= 1 + jaccard_join.spare_groups(k_of[i]) for i in set(x) & set(y))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7)]
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    for options in ({}, {"broadcast_nodes": 5, "hub": 1}):  # nodes with more neighbours than `hub` are joined apart
        got = {r.node: r.component for r in graphs.components(spark.createDataFrame(edges, "a long, b long"), **options).collect()}
        assert got == {x: c for x, c in label.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 3 suffix dedup


def brute_removed(texts, length):
    raw = {d: (t or "").encode() for d, t in texts.items()}
    seen = Counter(b[i : i + length] for b in raw.values() for i in range(len(b) - length + 1))
    out = {}
    for d, b in raw.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[d] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum()), hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize(("length", "gram"), [(400, 128), (40, 12), (9, 3), (5, 5)])
def test_suffix_dedup(spark, length, gram):
    rng = random.Random(length)
    part = lambda n: "".join(rng.choices("abé \n", k=n))
    shared = [part(rng.randint(length // 2, 3 * length)) for _ in range(6)]
    texts = {i: "".join(rng.choice([part(rng.randint(0, 2 * length)), rng.choice(shared), "z" * rng.randint(0, 2 * length)]) for _ in range(rng.randint(0, 6))) for i in range(60)}
    texts |= {100: None, 101: "", 102: texts[3], 103: texts[4][3:], 104: ("ab" * length), 105: "x" * (length - 1)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    stored = scratch_path(spark, "d")
    df.write.parquet(stored)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(spark.read.parquet(stored), length, gram, keep=False).collect()}
    assert got == brute_removed(texts, length)


def test_suffix_dedup_odd(spark, odd, empty):
    rows = suffix_dedup.deduplicated(odd).collect()
    assert len(rows) == len(ODD) + 2
    assert {r.doc_id: r.n_removed for r in rows}[8] == 2500 and all(len(r.kept) == r.n_bytes - r.n_removed for r in rows)
    assert suffix_dedup.deduplicated(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=12), max_size=8), max_size=6))
def test_loser_tree(lists):
    runs = [suffix_dedup.front_coded(sorted((s, b"p") for s in own)) for own in lists]
    got = list(suffix_dedup.merged([suffix_dedup.decoded(r) for r in runs]))
    want = sorted(s for own in lists for s in own)
    assert [s for _, s, _ in got] == want
    for (k, s, _), before in zip(got[1:], want):
        assert k == suffix_dedup.shared_prefix(before, s, 0)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=80), st.binary(max_size=80), st.integers(0, 80))
def test_shared_prefix(x, y, n):
    a, b = x[:n] + y, x[:n] + x
    want = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
    assert suffix_dedup.shared_prefix(a, b, 0) == want == suffix_dedup.shared_prefix(a, b, min(n, want))


# ---- 4 decontamination


def brute_hits(text, items, size):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    doc = find(text)
    hit, ids = set(), set()
    for item, t in items:
        w = find(t)
        for win in {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else ():
            for i in range(len(doc) - len(win) + 1):
                if tuple(doc[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    ids.add(str(item))
    return len(doc), len(hit), sorted(ids)


def test_decontamination(spark):
    rng = random.Random(4)
    some = lambda n: " ".join(rng.choices("ab cd é9 x Y".split(), k=n))
    items = [(1, some(14)), (2, "cd ab cd"), (3, "X"), (4, None), (5, ""), (20, "x y " * 8), (6, some(14))]
    docs = [(i, some(rng.randint(0, 60)) + " " + rng.choice([items[0][1], "cd, ab; CD", "", items[6][1] * 2])) for i in range(60)] + [(99, None), (98, "")]
    stored = scratch_path(spark, "d")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(stored)
    frame = spark.createDataFrame(items, "item_id long, text string")
    for limit in (200_000, 0):
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.judged(spark.read.parquet(stored), frame, broadcast_windows=limit).collect()}
        assert got == {d: brute_hits(t, items, 10) for d, t in docs}
    none = decontaminate.judged(spark.read.parquet(stored), frame.where("item_id = 4"))
    assert none.count() == len(docs) and none.where("n_hit > 0").count() == 0


def test_decontamination_odd(spark, odd, empty):
    items = spark.createDataFrame([(None, "again and again"), (1, "word " * 12)], "item_id long, text string")
    rows = decontaminate.judged(odd.withColumn("n_words", F.lit("clash")), items).collect()
    assert len(rows) == len(ODD) + 2 and sum(r.n_hit > 0 for r in rows) == 4
    assert decontaminate.judged(empty, items).count() == 0


# ---- 5 personal data


def brute_spans(text):
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(kinds):
        for m in re.finditer(p, text):
            digits = "".join(c for c in m[0] if c in "0123456789")
            fine = [True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else True, 12 <= len(digits) <= 19 and pii.luhn(digits), 9 <= len(digits) <= 15][k]
            if fine:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("a.@-+ 0123456789()é\n"), max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_pii_on_documents(spark, texts):
    for r in Q.op5_pii(spark, SF).collect():
        base = brute_spans(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in base) for i in range(4))
        assert r.base_sha256 == hashlib.sha256(pii.shown(base).encode()).hexdigest()
        assert set(pii.shown(base).split(",")) <= set(r.spans.split(","))


def test_skip_chain_adds_a_repeated_number():
    rng = random.Random(1)
    number = lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    train = [f"call +1 {number()} now or mail a.b{i}@host.example.com on 12 may" for i in range(60)]
    model = pii.fit([pii.Graph(t, pii.base_spans(t)) for t in train])
    text = "Office +1 (728) 555-9761 open. " + "Nothing here. " * 50 + "Again: 555-9761 is the one; 12 apples."
    base = pii.base_spans(text)
    added = pii.added_spans([text], [base], model, confident=0.5)[0]
    assert [text[a:b] for a, _, b in added] == ["555-9761"]
    assert pii.mask(text, sorted({*base, *added})).count("[PHONE]") == 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"12.@+- a", "²", "③", "٣", "1.2.3.", "00255", "0" * 4400, "999", " = "]), max_size=14).map("".join))
def test_pii_of_digits_of_all_kinds(text):
    want = []
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            want.append((m.start(), 1, m.end()))
    spans = pii.base_spans(text)
    assert [s for s in spans if s[1] == 1] == want
    pii.Graph(text, spans)


def test_pii_unusual_digits(spark):
    rows = [(0, "see 1.2.3.² here"), (1, "1.2.3." + "0" * 5000), (2, "③.1.2.3 and ٣.٣.٣.٣"), (3, "x@y.z " + "9" * 5000)]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].n_ip for i in range(4)] == [0, 1, 0, 0] and got[3].n_email == 1


def test_token_files_with_added_tokens(spark):
    from tokenizers import Tokenizer

    end, path = "<|endoftext|>", scratch_path(spark, "t")
    texts = [f"a {end} b", end, f"{end}{end}", f" {end}", f"{end} ", f"x{end}y {end}  z\n{end}", f"plain words {end}" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    manifest = token_files.write(docs, path, tokenizers_path("byte_bpe_50k.json"))
    tokenizer = Tokenizer.from_file(tokenizers_path("byte_bpe_50k.json"))
    for r in token_files.read(spark, path, manifest).collect():
        ids = np.array([*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


def test_pii_odd(spark, odd, empty):
    rows = pii.find(odd.withColumn("spans", F.lit(1)), masked=True).collect()
    assert len(rows) == len(ODD) + 2 and rows[0].text is None
    assert pii.find(empty).count() == 0


# ---- 6 quality rules


def test_quality_rules_odd(spark, odd, empty):
    by = {r.doc_id: r for r in quality_rules.judged(odd).collect()}
    assert by[7].n_repeat_words == 500 and by[7].base_failed and not by[7].kept and by[6].n_words == 1
    assert quality_rules.judged(empty).count() == 0


def test_line_frequency(spark):
    line = "subscribe to our letter and follow us on every network we know of today please"
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    own = lambda i: "\n".join(" ".join(word() for _ in range(12)) for _ in range(4 + i))
    rows = [(i, f"{own(i)}\n{line}", "en", "s", 0) for i in range(30)]
    copy = own(50)
    rows += [(200 + i, copy, "en", "s", 0) for i in range(40)]  # a family of copies is no boilerplate
    long = "\n".join(f"{line} {w}" for w in "abcdefghijkl")
    rows += [(300 + i, long + "\n" + "\n".join(f"tail {i} {k}" for k in range(i)), "en", "s", 0) for i in range(12)]
    got = {r.doc_id: r.kept for r in quality_rules.judged(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i] for i in range(30)) and all(got[200 + i] for i in range(40))
    assert not got[300] and not got[301]  # hardly anything but lines that 12 documents of different length have


def test_line_frequency_counts_documents(spark):
    shared = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60))
    own = lambda i: f"only {chr(97 + i)} has this"
    rows = [(i, f"{own(i)}\n{shared}", "en", "s", 0) for i in range(11)]  # unrelated, all of two lines
    rows += [(100 + i, f"{own(i)}\n{shared}", "en", "t", 0) for i in range(10)]  # at the limit
    rows += [(200 + i, f"{own(i % 10)}\n\n{shared.upper()} ", "en", "u", 0) for i in range(40)]  # ten texts in copies
    rows += [(300 + i, f"page {i}\n{shared}", "en", "v", 0) for i in range(11)]  # a template: only numbers differ
    got = {r.doc_id: r.kept for r in quality_rules.judged(spark.createDataFrame(rows, DOCS)).collect()}
    assert not any(got[i] for i in range(11)) and not any(got[300 + i] for i in range(11))
    assert all(got[100 + i] for i in range(10)) and all(got[200 + i] for i in range(40))


def test_frequent_lines_are_removed(spark):
    import corpus_pipeline

    line = "Subscribe to our letter No 7"
    rng = random.Random(5)
    own = lambda: [" ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(12)) for _ in range(5)]
    rows, want = [], {}
    for i in range(11):
        a = own()
        rows.append((i, "\n".join([line.upper(), *a[:2], "", line, *a[2:], f"  {line} "]), "en", "s", 0))
        want[i] = "\n".join([*a[:2], "", *a[2:]])
    rows += [(20 + i, "\n".join([*own(), line]), "en", "t", 0) for i in range(10)]  # at the limit
    want |= {r[0]: r[1] for r in rows[11:]}
    docs = spark.createDataFrame(rows, DOCS)
    assert {r.doc_id: r.text for r in quality_rules.judged(docs).collect()} == want
    path = scratch_path(spark, "q")
    docs.write.parquet(path)
    got = corpus_pipeline.quality(spark, spark.read.parquet(path), SF).collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_repeated_words_paths(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices("abcd", k=rng.randint(0, 30)))) for i in range(200)]
    for r in quality_rules.measures(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        w = r.text.split()
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
        assert r.n_repeat_words == len(hit)


# ---- 7 quality model


def test_quality_model_held_out(spark):
    scored = Q.op7_quality_model(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.9


def test_quality_model_odd(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_model.trained(odd, none)
    rows = quality_model.scored(odd, model).collect()
    assert len(rows) == len(ODD) + 2 and {r.score for r in rows} == {0.5}
    assert quality_model.scored(empty, model).count() == 0


def test_trees_learn_a_conjunction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 5))
    y = ((x[:, 1] > 0.5) & (x[:, 3] < 0.4)).astype(float)
    model = quality_model.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.97


# ---- 8 chat


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("a\\<|>/s[]INSTim_end\n"), max_size=40))
def test_escape(text):
    raw = text.encode()
    coded = chat.escape(raw)
    assert chat.unescape(coded) == raw
    assert not any(c in coded for c in (b"<|", b"</s>", b"<s>", b"[INST]", b"[/INST]"))


def test_chat(spark):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a\nb"]), rng.choice([None, "", "hi </s>", "x" * 50, "é\\n<|im_end|>\n"])) for c in [1, 2, 3, None] for t in range(rng.randint(1, 40))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for most in (1 << 24, 200):
        formatted = chat.format_conversations(df, most)
        got = {r.conv_id: r for r in chat.digests(formatted).collect()}
        for c in [1, 2, 3, None]:
            own = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
            said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
            loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
            assert (got[c].n_turns, got[c].turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
            assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_conversations(df.where("false"))).count() == 0


# ---- 9 sentencepiece


def brute_viterbi(vocabulary, text):
    t = ("▁" + text.replace(" ", "▁")) if text else ""
    score = {vocabulary.pieces[i]: s for i, s in zip(vocabulary.plain.tolist(), vocabulary.score.tolist())}
    best = [0.0] + [float("-inf")] * len(t)
    for b in range(1, len(t) + 1):
        for a in range(max(0, b - 20), b):
            s = score.get(t[a:b], vocabulary.unknown_score if b - a == 1 else None)
            if s is not None:
                best[b] = max(best[b], best[a] + s)
    return best[-1]


def path_score(vocabulary, ids):
    """The score of ids; runs of byte pieces count once for each character."""
    score = dict(zip(vocabulary.plain.tolist(), vocabulary.score.tolist()))
    total = 0.0
    for i in ids:
        if i in score:
            total += score[i]
        elif int(vocabulary.pieces[i][3:5], 16) & 0xC0 != 0x80:
            total += vocabulary.unknown_score
    return total


@pytest.mark.parametrize("text", ["Hello  wörld\n x y 😀", "theained larequetre", "", " ", "日本語 ✓ \x00", "a" * 600 + "日" * 100, "internationalization of the thing"])
def test_viterbi(text):
    v = sentencepieces.vocabulary(tokenizers_path("piece_bpe_32k.model"))
    ids, n = v.encode([text])
    assert v.decode(ids, n) == [text]
    assert path_score(v, ids.tolist()) == pytest.approx(brute_viterbi(v, text))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abc é"), max_size=25), min_size=1, max_size=12))
def test_viterbi_small_vocabulary(parts):
    pieces = ["<unk>", "▁", "a", "b", "▁a", "ab", "abc", "bc", "c", "▁ab", "ca"]
    v = sentencepieces.Vocabulary.of(pieces, [0, -2, -3, -3.5, -2.5, -4, -4.5, -5, -3, -4, -6])
    ids, n = v.encode(parts)
    for own, text in zip(np.split(ids, np.cumsum(n)[:-1]), parts):
        total = sum(v.score[v.plain.tolist().index(i)] if i else v.unknown_score for i in own.tolist())
        assert total == pytest.approx(brute_viterbi(v, text))


def test_sentencepieces_odd(spark, odd, empty):
    rows = Q.sentencepieces.digests(odd, tokenizers_path("piece_bpe_32k.model")).collect()
    assert len(rows) == len(ODD) + 2 and all(r.restored for r in rows)
    back = sentencepieces.decode(sentencepieces.encode(odd.withColumn("ids", F.lit(1)), tokenizers_path("piece_bpe_32k.model")), tokenizers_path("piece_bpe_32k.model"))
    assert all((r.text or "") == r.decoded for r in back.collect())
    assert sentencepieces.round_trip(empty, tokenizers_path("piece_bpe_32k.model")).count() == 0


# ---- 10 urls


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/EN/x?y#z", "http://example.com", "http://x.net/es/", "http://net/fr/#a", "http://notnet/es/", "http://www.example.com/en/1", "http://example.com/en/", "http://l.org/p?q", "http://a.net/es/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(1, "", "clash")], "page_id long, url string, rule string")
    listed = spark.createDataFrame([("https://L.org/p#x",), (None,)], "url string").where("url IS NOT NULL")
    rules = url_filter.rules_table(spark, [*Q.URL_RULES, (None, "/", "block")])
    for most in (100_000, 0):
        got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, rules, listed, max_blocks=1, broadcast_entries=most).orderBy("page_id").collect()]
        by = {g[0]: g[1:] for g in got}
        assert len(got) == len(urls) + 1
        assert by[0] == by[1] == by[2] == ("", "", None, "allow") and by[3] == ("", "", None, "allow")
        assert by[4] == ("a.example.com", "/EN/x", "com/", "allow") and by[5] == ("example.com", "", None, "allow")
        assert by[6][2:] == ("net/es/", "block") and by[7][2:] == ("net/fr/", "block") and by[8][2:] == (None, "allow")
        assert by[9][2:] == ("www.example.com/en/", "allow") and by[10][2:] == ("example.com/en/", "block") and by[11][2:] == (None, "block")
    assert url_filter.filter_urls(df, rules.where("false")).where("verdict = 'block'").count() == 0


# ---- pipeline


def test_pipeline_against_brute_force(spark, texts):
    import corpus_pipeline

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    kept = {r[0] for r in con.sql(f"SELECT doc_id FROM ({Q.oracle_sql()['op6_quality_rules']}) WHERE kept").fetchall()}
    classes = brute_components({d: texts[d] for d in kept}, 5, 80)
    kept = {d for d in kept if classes[d][1] == d}
    items = con.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    kept = {d for d in kept if not brute_hits(texts[d], items, 10)[1]}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == kept
    v = sentencepieces.vocabulary(tokenizers_path("piece_bpe_32k.model"))
    for d, r in got.items():
        base = brute_spans(texts[d])
        assert not any(k in (0, 1) for _, k, _ in brute_spans(r.text))
        if not base:
            assert r.text == texts[d]
        ids, n = v.encode([r.text])
        assert r.ids == ids.tolist() and r.n_tokens == len(r.ids)


def test_pipeline_stages_odd(spark, odd, empty):
    import corpus_pipeline

    for docs in (odd.withColumn("extra", F.lit(1)), empty):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = scratch_path(spark, "p")
            docs.write.parquet(path)
            out = stage(spark, spark.read.parquet(path), SF)
            if i < 4:
                assert out.columns == docs.columns
            assert out.count() <= docs.count()


def test_word_hashes():
    h, doc = shingles.word_hashes(["Ab  c", "", "aB\tc\n", "É é"])
    assert doc.tolist() == [0, 0, 2, 2, 3, 3] and h[0] == h[2] and h[1] == h[3] and h[4] != h[5]


# ---- texts made to collide, very long texts, clashing names, rows told apart


def thue_morse(n, a, b):
    """Two texts that agree in every sum over bytes times powers modulo 2^64, from some length on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_colliding_texts(spark):
    from tokenizers import Tokenizer

    x, y = thue_morse(2048, "a", "b")
    v, w = thue_morse(512, "v", "z")
    tail = "q" * 100
    texts = {1: x, 2: y, 3: v + tail, 4: w + tail, 5: f"{x} {v}", 6: f"{y} {w}", 7: f"some {x[:14]} {y[:14]} words", 8: None}
    path = scratch_path(spark, "d")
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    tokenizer = Tokenizer.from_file(tokenizers_path("byte_bpe_50k.json"))
    out = scratch_path(spark, "t")
    got = {r.doc_id: r.ids_crc32 for r in token_files.read(spark, out, token_files.write(df, out, tokenizers_path("byte_bpe_50k.json"))).collect()}
    assert got == {d: zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for d, t in texts.items()}
    joined = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.join(df, 3, 90).collect()}
    assert joined == brute_components(texts, 3, 90) and joined[2][1] == 2
    for length, gram in ((400, 128), (64, 16)):
        cut = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(df, length, gram, keep=False).collect()}
        assert cut == brute_removed(texts, length)


def test_span_hashes():
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.integers(0, 3, 4000).astype(np.uint8), np.zeros(8, np.uint8)])
    start = rng.integers(0, 3000, 500)
    end = start + rng.integers(0, 900, 500)
    h = shingles.span_hashes(data, start, end)
    byte = [data[a:b].tobytes() for a, b in zip(start, end)]
    assert len(set(h.tolist())) == len(set(byte))
    assert len({(x, y) for x, y in zip(h.tolist(), byte)}) == len(set(byte))
    fast = suffix_dedup.Hashes(data, (12, 40))
    for n, base in ((12, 12), (15, 12), (40, 40), (75, 40)):
        own = fast.of(np.arange(3000), n, base)
        assert len(set(own.tolist())) == len({data[i : i + n].tobytes() for i in range(3000)})


@pytest.mark.parametrize("most_classes", [1, 2, 1000])
def test_suffix_dedup_of_hot_grams(spark, most_classes):
    """One passage inside many different surroundings: with few classes allowed, windows go by what they have in common."""
    rng = random.Random(most_classes)
    part = lambda n: "".join(rng.choices("abc", k=n))
    core, left, right = part(70), [part(60) for _ in range(4)], [part(60) for _ in range(4)]
    texts = {i: part(rng.randint(0, 50)) + rng.choice(left)[rng.randint(0, 59) :] + core + rng.choice(right)[: rng.randint(0, 60)] + part(rng.randint(0, 50)) for i in range(80)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for length, gram in ((100, 20), (60, 30)):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(df, length, gram, keep=False, most_classes=most_classes, broadcast_digests=length % 100, part_bytes=2000).collect()}
        assert got == brute_removed(texts, length)


def test_suffix_dedup_bounds_its_groups(spark, monkeypatch):
    """3,000 documents that share 390 bytes, and a few that share 420 with one of them: no group of a task has more classes
    than the bound, and the result is that of brute force."""
    rng = random.Random(39)
    part = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    core = part(390)
    texts = {i: part(rng.randint(20, 300)) + core + part(rng.randint(20, 300)) for i in range(3000)}
    for i in range(5):
        at = texts[i].index(core)
        texts[3000 + i] = part(50) + texts[i][at - 15 : at + 405] + part(50)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    seen = []
    split = suffix_dedup.split_halves

    def noted(halves, most):
        few, many = split(halves, most)
        sizes = [[r["count"] for r in x.groupBy("key").count().collect()] for x in (few, many)]
        seen.append((max(sizes[0], default=0), max(sizes[1], default=0)))
        return few, many

    monkeypatch.setattr(suffix_dedup, "split_halves", noted)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(df, keep=False).collect()}
    assert got == brute_removed(texts, 400)
    assert sum(x[1] > 0 for x in got.values()) == 10
    assert len(seen) == 1 and seen[0][0] <= 1000 and seen[0][1] > 1000


def test_suffix_dedup_query_against_brute_force(spark, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in Q.op3_suffix_dedup(spark, SF).collect()}
    assert got == brute_removed(texts, 400)


def counted_removed(texts, length):
    """brute_removed() for larger tables: windows are told apart by a 64-bit hash, joined from halves."""
    raw = [(t or "").encode() for t in texts.values()]
    ends = np.cumsum([len(b) for b in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)

    def joined(a, b):
        x = a * np.uint64(0xD6E8FEB86659FD93) + b
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F)
        return x ^ (x >> np.uint64(29))

    h, size, n = np.random.default_rng(1).integers(0, 2**64, 256, np.uint64)[data], 1, len(data) - length + 1
    while 2 * size <= length:
        h, size = joined(h[:-size], h[size:]), 2 * size
    h = joined(h[:n], h[length - size : length - size + n])
    whole = np.flatnonzero(np.arange(n) + length <= ends[np.searchsorted(ends, np.arange(n), "right")])
    _, same, times = np.unique(h[whole], return_inverse=True, return_counts=True)
    hit = whole[times[same] > 1]
    gone = np.cumsum(np.bincount(hit, minlength=len(data) + 1) - np.bincount(hit + length, minlength=len(data) + 1))[:-1] > 0
    out = {}
    for d, b, end in zip(texts, raw, ends):
        own = gone[end - len(b) : end]
        left = np.frombuffer(b, np.uint8)[~own].tobytes()
        out[d] = (len(b), int(own.sum()), int((np.diff(np.concatenate([[False], own]).astype(int)) == 1).sum()), hashlib.sha256(left).hexdigest())
    return out


def test_suffix_dedup_query_against_counted_windows(spark, texts):
    assert counted_removed(texts, 400) == brute_removed(texts, 400)
    large = "/root/testdata/sf0.1"
    want = counted_removed(dict(duckdb.sql(f"SELECT doc_id, text FROM '{large}/documents.parquet'").fetchall()), 400)
    assert len(want) == 10_000
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in Q.op3_suffix_dedup(spark, large).collect()} == want


def test_suffix_dedup_goes_by_bytes_and_not_by_words(spark):
    """A shared passage of over 50 words stays where it has 399 bytes and goes where it has 400; n_bytes is that of the whole text either way."""
    rng = random.Random(51)
    passage = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(80))[:n]
    short, long = passage(399), passage(400)
    assert len(short.split()) > 50
    texts = {1: f"one <{short}> end", 2: f"two ({short}) end", 3: f"three <{long}> end", 4: f"four ({long}) end"}
    rows = {r.doc_id: r for r in suffix_dedup.deduplicated(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert {d: r.n_bytes for d, r in rows.items()} == {d: len(t) for d, t in texts.items()}
    assert {d: r.n_removed for d, r in rows.items()} == {1: 0, 2: 0, 3: 400, 4: 400}
    assert bytes(rows[1].kept).decode() == texts[1] and bytes(rows[4].kept) == b"four () end"


def test_suffix_dedup_of_benchmark_passages(spark):
    """The passages of `benchmark` of over 50 words, which recur in documents, have under 400 bytes: the contract's length leaves them, 256 bytes take them whole."""
    large = "/root/testdata/sf0.1"
    passages = [t for (t,) in duckdb.sql(f"SELECT text FROM '{large}/benchmark.parquet'").fetchall() if len(t.split()) > 50]
    texts = {d: t or "" for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{large}/documents.parquet'").fetchall()}
    holders = {p: [d for d, t in texts.items() if p in t] for p in passages}
    holders = {p: found for p, found in holders.items() if len({texts[d] for d in found}) > 1}
    assert holders and all(256 <= len(p.encode()) < 400 for p in passages)
    docs = spark.createDataFrame([(d, texts[d]) for d in {d for found in holders.values() for d in found}], "doc_id long, text string")
    at = {n: {r.doc_id: r for r in suffix_dedup.deduplicated(docs, n, gram=64).collect()} for n in (256, 400)}
    for p, found in holders.items():
        assert all(at[256][d].n_removed >= len(p.encode()) and p.encode() not in bytes(at[256][d].kept) for d in found)
    left = [d for d, r in at[400].items() if r.n_removed == 0]
    assert len(left) > len(at[400]) / 2 and all(bytes(at[400][d].kept).decode() == texts[d] for d in left)


@pytest.fixture(scope="module")
def long_docs(spark):
    """Texts of over 1 MB: one of 2^20 words and more, its near copy, one without spaces, and short ones."""
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(5000)]
    big = " ".join(rng.choices(words, k=(1 << 20) + 5000))
    rows = [(1, big, "en", "s", len(big)), (2, big + " one more", "en", "s", len(big) + 9), (3, "y" * 1_200_000 + "4111111111111111", "en", "s", 0), (4, "short one", "en", "s", 9), (5, None, None, None, None)]
    path = scratch_path(spark, "long")
    spark.createDataFrame(rows, DOCS).write.parquet(path)
    return spark.read.parquet(path), {r[0]: r[1] or "" for r in rows}


def test_very_long_texts(spark, long_docs):
    import base64

    import public_tokenizers
    import tiktoken

    df, texts = long_docs
    # the same vocabulary in another library, which takes a text of this length in one piece
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizers_path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = scratch_path(spark, "t")
    got = {r.doc_id: r.ids_crc32 for r in token_files.read(spark, out, token_files.write(df, out, tokenizers_path("byte_bpe_50k.json"))).collect()}
    for d in (1, 2, 4):
        assert got[d] == zlib.crc32(np.array([*other.encode_ordinary(texts[d]), 0], "<u4").tobytes())
    classes = {r.doc_id: r.component_id for r in jaccard_join.join(df, 3, 90).collect()}
    assert classes[2] == 1 and classes[3] == 3 and classes[4] == 4
    cut = {r.doc_id: r for r in suffix_dedup.deduplicated(df, keep=False).collect()}
    assert cut[1].n_removed == cut[1].n_bytes and cut[2].n_bytes - cut[2].n_removed == 9 and cut[3].n_removed == 1_200_000 and cut[4].n_removed == 0
    items = spark.createDataFrame([(7, " ".join(texts[1].split()[600_000:600_012]))], "item_id long, text string")
    hit = {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.judged(df, items).collect()}
    assert hit[1] == ((1 << 20) + 5000, 12) and hit[2][1] == 12 and hit[4] == (2, 0)
    spans = {r.doc_id: r for r in pii.find(df).collect()}
    assert spans[3].n_card == 1 and spans[3].spans == "card:1200000:1200016" and spans[1].n_spans == 0
    by = {r.doc_id: r for r in quality_rules.judged(df).collect()}
    w = texts[1].split()
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = np.zeros(len(w), bool)
    for i, g in enumerate(zip(w, w[1:], w[2:])):
        if grams[g] > 1:
            hit[i : i + 3] = True
    assert by[1].n_words == len(w) and by[1].n_repeat_words == hit.sum() and by[3].n_words == 1
    model = quality_model.trained(df, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality_model.scored(df, model).count() == 5
    assert all(r.restored for r in sentencepieces.digests(df, tokenizers_path("piece_bpe_32k.model")).collect())


CLASH = ["_rid", "_h", "_packed", "_sorted", "_same", "_at", "_removed", "_gone", "_words", "_lines", "_line", "_host", "_doc", "_key", "_left", "in", "ids", "cuts", "node", "family", "sig", "rid", "start", "kept", "n_words", "spans", "items", "score", "_id", "_t", "_ws", "c", "host", "path", "key", "hit"]


def test_clashing_names(spark, texts):
    """Columns named like anything made inside: those of results are replaced, the others come out as they went in."""
    rows = list(texts.items())[:60]
    plain = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    odd = plain.select("*", *[F.lit(f"x{c}").alias(c) for c in CLASH])
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    same = lambda a, b, names: sorted(map(str, a.select(*names).collect())) == sorted(map(str, b.select(*names).collect()))
    a, b = quality_rules.judged(odd), quality_rules.judged(plain)
    assert same(a, b, b.columns) and a.where("_h <> 'x_h' OR _at <> 'x_at' OR host <> 'xhost'").count() == 0
    a, b = decontaminate.judged(odd, items), decontaminate.judged(plain, items)
    assert same(a, b, ["doc_id", "n_words", "n_hit", "items"]) and a.where("_ws <> 'x_ws' OR c <> 'xc'").count() == 0
    a, b = pii.find(odd), pii.find(plain)
    assert same(a, b, ["doc_id", "base_sha256", "spans", "n_spans"]) and a.where("key <> 'xkey'").count() == 0
    assert same(jaccard_join.join(odd), jaccard_join.join(plain), ["doc_id", "component_id", "n_links"])
    assert same(suffix_dedup.deduplicated(odd, keep=False), suffix_dedup.deduplicated(plain, keep=False), ["doc_id", "kept_sha256"])
    model = quality_model.trained(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert same(quality_model.scored(odd, model), quality_model.scored(plain, model), ["doc_id", "score"])
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    wide = pages.select("*", *[F.lit(f"x{c}").alias(c) for c in CLASH])
    rules = url_filter.rules_table(spark, Q.URL_RULES)
    a, b = url_filter.filter_urls(wide, rules), url_filter.filter_urls(pages, rules)
    assert same(a, b, ["page_id", "host", "path", "rule", "verdict"]) and a.where("key <> 'xkey' OR hit <> 'xhit'").count() == 0
    talk = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    extra = talk.select("*", *[F.lit("x").alias(c) for c in ("part", "formatted", "loss_spans")])
    assert same(chat.format_conversations(extra), chat.format_conversations(talk), ["conv_id", "formatted"])


def test_rows_are_told_apart(spark):
    """Rows without a usable id keep their own result, however the input is dealt when it is read again."""
    rows = [(i % 7 if i % 5 else None, f"word{i} " * 3 + "shared passage of words that is long enough to be found again in many of these texts " * (i % 3)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    number = batches.numbered(df)
    assert number.select("_rid").distinct().count() == 90 == number.count()
    assert batches.numbered(df.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).where("_rid <> doc_id").count() == 0
    got = sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.deduplicated(df, 40, 10, keep=False).collect())
    want = brute_removed({i: t for i, (_, t) in enumerate(rows)}, 40)
    assert got == sorted((n, r) for n, r, _, _ in want.values())
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    jaccard_join.join(df.limit(5))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


# ---- the methods themselves


@pytest.mark.parametrize("skip", [[], [(0, 3)], [(0, 2), (1, 3)]])
def test_marginals_against_enumeration(skip):
    """Belief propagation is exact on trees; with loops and the weights of a fitted model it is near."""
    from itertools import product

    rng = np.random.default_rng(len(skip))
    k, n = len(pii.ALL_KINDS) + 1, 4
    x = rng.normal(size=(n, pii.FEATURES)) * 0.3
    model = {"node": rng.normal(size=(pii.FEATURES, k)) * 0.5, "edge": np.array([0.4, 0.9])}
    chain = [(0, 1), (1, 2)] if skip == [(0, 3)] else [(0, 1), (1, 2), (2, 3)]
    label = np.array([-1, 2, -1, -1])
    pairs = np.array(chain + skip)
    is_skip = np.arange(len(pairs)) >= len(chain)
    got = pii.marginals(x, label, pairs, is_skip, model, rounds=40)
    score = x @ model["node"]
    want = np.zeros((n, k))
    for y in product(range(k), repeat=n):
        if y[1] != 3:
            continue
        weight = sum(score[i, c] for i, c in enumerate(y)) + sum(model["edge"][int(s)] for (a, b), s in zip(pairs, is_skip) if y[a] == y[b])
        for i, c in enumerate(y):
            want[i, c] += np.exp(weight)
    want /= want.sum(1, keepdims=True)
    assert np.abs(got - want).max() < (1e-3 if len(pairs) < n else 0.05)


def test_field_adds_repetitions_at_the_default_confidence():
    rng = random.Random(2)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    token = lambda: "".join(rng.choices("0123456789abcdef", k=40))
    train = []
    for i in range(300):
        a, key = f"{digits(3)} {digits(4)} {digits(4)}", token()
        train.append(f"call +49 {a} or write to x{i}@mail.example.org before 12 may, 3 of {digits(5)} items")
        train.append(f"version {i % 9}. token = \"{key}\" holds and in line {i} again +49 {a} as said")
    model = pii.fit([pii.Graph(t, [*pii.seeds(t), *pii.base_spans(t)]) for t in train])
    key = token()
    text = f"Ring +49 151 2345 6789 today. token = \"{key}\" " + "Nothing here. " * 40 + f"Later: 0151 2345 6789 and once more {key}, in 12 rows."
    base = pii.base_spans(text)
    added = {text[a:b]: pii.ALL_KINDS[k] for a, k, b in pii.added_spans([text], [base], model)[0]}
    assert added.get(key) == "secret" and any(k == "phone" and "2345 6789" in t for t, k in added.items())
    assert "12" not in added and [text[a:b] for a, _, b in base] == ["+49 151 2345 6789"]
    clean = "In 1999 there were 12 of 4500 houses, 3.5 percent (see page 41), version 3."
    assert pii.added_spans([clean], [[]], model) == [[]]


def test_long_tokens_have_keys_of_their_own():
    head = "a1" * 150
    graph = pii.Graph(f"{head}x9 and {head}y9 and {head}x9", [])
    assert graph.skip == [(0, 2)]


def test_trees_against_plain_traversal_and_search():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, (300, 4)).astype(float)
    y = ((x[:, 2] > 4) ^ (rng.random(300) < 0.2)).astype(float)
    model = quality_model.fit(x, y, trees=7, depth=3, least=5)

    def walk(row):
        total = model.start
        for node in model.roots:
            while model.left[node] != node:
                node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
            total += model.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(model.score(x), [walk(r) for r in x])
    stump = quality_model.fit(x, y, trees=1, depth=1, least=5, ridge=1.0)
    p = y.mean()
    g, h = y - p, np.full(len(y), p * (1 - p))
    gain = {}
    for j in range(4):
        for t in np.unique(x[:, j])[:-1]:
            a = x[:, j] <= t
            if min(a.sum(), (~a).sum()) >= 5:
                gain[j, t] = sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (a, ~a))
    best = max(gain.values())
    root = stump.roots[0]
    assert gain[int(stump.feature[root]), stump.threshold[root]] == pytest.approx(best)


def test_quality_model_examples_are_bounded(spark):
    docs = spark.createDataFrame([(i % 10, f"text {i} of many words") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    a, b = (quality_model.trained(d, labels, sample_rows=50) for d in (docs, docs.repartition(7)))
    assert np.array_equal(a.value, b.value) and np.array_equal(a.threshold, b.threshold)


def test_chat_roles_with_nul_and_long_ones(spark):
    rows = [(c, t, role, "hi") for c, role in enumerate(["user\x00", "user", "r" * 1_000_000, "\x00", ""]) for t in range(2)] + [(c, 0, "user", "x") for c in range(100, 1000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.turns_sha256 for r in chat.digests(chat.format_conversations(df)).collect()}
    for c in range(5):
        said = "".join(f"{r[2]}\n{r[3]}\n" for r in rows if r[0] == c)
        assert got[c] == hashlib.sha256(said.encode()).hexdigest()


def test_viterbi_on_documents(spark, texts):
    """The best score of every tenth document, by a plain Viterbi over its chunks."""
    v = sentencepieces.vocabulary(tokenizers_path("piece_bpe_32k.model"))
    assert np.exp(v.score).sum() == pytest.approx(1)
    known = {}
    for d in sorted(texts)[::10]:
        ids, n = v.encode([texts[d]])
        assert v.decode(ids, n) == [texts[d]]
        want = 0.0
        for chunk in sentencepieces._CHUNK.findall(" " + texts[d]) if texts[d] else []:
            if chunk not in known:
                known[chunk] = brute_viterbi(v, chunk[1:]) if chunk.startswith(" ") and chunk != " " else path_score(v, v.solve([chunk])[0].tolist())
            want += known[chunk]
        assert path_score(v, ids.tolist()) == pytest.approx(want)


def test_listed_urls(spark):
    urls = ["http://a.net/x?ref=1", "http://a.net/x", "http://a.net/X", "http://b.net/es/?ref=2", "http://c.org/y"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = pages.where("url LIKE '%ref=%'").select("url")
    many = [*Q.URL_RULES, *((f"h{i}.org", "/", "block") for i in range(300))]
    for options in ({}, {"max_blocks": 1}, {"max_blocks": 1, "broadcast_entries": 0, "salts": 3}):
        got = [r.verdict for r in url_filter.filter_urls(pages, url_filter.rules_table(spark, many), listed, **options).orderBy("page_id").collect()]
        assert got == ["block", "block", "allow", "block", "allow"]  # one block of the filter passes most, the join corrects it
    found = Q.op10_url_filter(spark, "/root/testdata/sf0.01")
    assert found.where("verdict = 'block' AND rule IS NULL").count() > 0


def test_lines_of_a_thousand_documents_of_one_length(spark):
    line = "the same words stand in the last line of every page of this host and say nothing more"
    word = lambda i, j: "".join(chr(97 + int(c)) for c in f"{i * 7 + j}")
    rows = [(i, " ".join(word(i, j) for j in range(60)) + "\n" + line, "en", "s", 0) for i in range(1000)]
    got = quality_rules.judged(spark.createDataFrame(rows, DOCS)).where(F.endswith("text", F.lit(line))).count()
    assert got == 0


def test_repeated_windows_by_full_hashes(spark):
    """The path for long documents, on short ones: the packed path's results are the same."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices("abcde", k=rng.randint(0, 40)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = scratch_path(spark, "w")
    quality_rules.measures(df).write.parquet(path)
    whole = " ".join(rng.choices("abcdefghijklmnop", k=(1 << 20) + 10))
    w = whole.split()
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = np.zeros(len(w), bool)
    for i, g in enumerate(zip(w, w[1:], w[2:])):
        if grams[g] > 1:
            hit[i : i + 3] = True
    row = quality_rules.measures(spark.createDataFrame([(1, whole)], "doc_id long, text string")).first()
    assert row.n_repeat_words == hit.sum()
