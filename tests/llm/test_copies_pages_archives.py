"""SimHash, embeddings, components, WARC, html extraction, the queries and the pipeline."""

import gzip
import hashlib
import math
import random
import time
from collections import Counter
from html import escape

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tests.test_oracles import TABLES, compare
from trawlkit.llm import decontaminate, embeddings, html, prints, similar, simhash, warc
from trawlkit.llm.components import components, spanning_forest
from trawlkit.llm.queries import ORACLES, QUERIES


def grouped(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# components


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
@settings(max_examples=200, deadline=None)
def test_forest(pairs):
    a, b = (np.array([p[i] for p in pairs], dtype=np.int64) for i in (0, 1))
    x, y = spanning_forest(a, b)
    expected = grouped(pairs, {n for p in pairs for n in p})
    assert dict(zip(x.tolist(), y.tolist())) == {n: r for n, r in expected.items() if n != r}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(200, 260)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)] + [(7, 7)]
    rng.shuffle(pairs)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: r for n, r in grouped(pairs, {n for p in pairs for n in p}).items() if n != r}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError):
        components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"), max_rounds=1)


# SimHash


def brute_print(text, k=3):
    w = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(alphabet="aB é \t\x0b\x85\xa0", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprints([text, None, text + " x"]).tolist() == [brute_print(text), 0, brute_print(text + " x")]


@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=9), st.integers(1, 8))
@settings(max_examples=400, deadline=None)
def test_a_near_pair_keeps_some_chain(x, flips, bits):
    m = bits + 1
    y = x
    for f in flips:
        y ^= 1 << f
    near = (x ^ y).bit_count() <= bits
    cut, masks = simhash.bounds(m), simhash.chain_masks(m)
    found = False
    for start in range(m):
        seg = lambda v: v >> cut[start] & ((1 << cut[start + 1] - cut[start]) - 1)
        if seg(x) == seg(y):
            found |= len(simhash.ring_pairs(np.array([x], np.uint64), np.array([y], np.uint64), np.array([start]), bits, m, masks)) == 1
    assert found == near


def texts_with_copies(n=150, seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    texts = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.choice((0, 0, 1, 5))):
            near = base[:]
            near[rng.randrange(len(near))] = rng.choice(words)
            texts.append(" ".join(rng.choice((near, base))))
    return texts + [None, "", "  "]


@pytest.mark.parametrize("bits,group_rows", [(3, 20_000), (3, 7), (6, 50)])
def test_simhash_groups(spark, bits, group_rows):
    texts = texts_with_copies()
    docs = spark.createDataFrame([(i + 10, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    prints = [brute_print(t) for t in texts]
    pairs = [(i + 10, j + 10) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= bits]
    expected = grouped(pairs, range(10, 10 + len(texts)))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs, bits=bits, group_rows=group_rows).collect()}
    assert got == {i: (f"{prints[i - 10]:016x}", expected[i]) for i in expected}


def test_keep_one(spark):
    rows = [(3, "a b c d"), (1, "A b c d"), (1, "A b c d"), (2, "other words entirely here"), (None, "null id of its own kind"), (5, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, _fp string")
    got = similar.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, "A b c d"), (2, "other words entirely here"), (None, "null id of its own kind"), (4, "")], key=str)
    assert similar.keep_one(docs.limit(0)).count() == 0 and simhash.simhash_groups(docs.limit(0)).count() == 0


@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=80), max_size=5), st.sampled_from((1, 2, 3, 5)), st.sampled_from((7, 64, 1000)))
@settings(max_examples=150, deadline=None)
def test_shingles_and_majorities(texts, k, run):
    hashes, counts = prints.shingle_sets(texts, k)
    true = [{b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in texts]
    found = [{*s.tolist()} for s in np.split(hashes, np.cumsum(counts)[:-1])][: len(texts)] if texts else []
    assert [len(s) for s in found] == counts.tolist() == [len(s) for s in true]
    assert all(len(a & b) == len(x & y) for a, x in zip(found, true) for b, y in zip(found, true))
    kept, prints.RUN_HASHES = prints.RUN_HASHES, run
    try:
        got = prints.majority(hashes, counts).tolist()
    finally:
        prints.RUN_HASHES = kept
    assert got == [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in s) > len(s)) for s in found]


@given(st.integers(0, 2**256 - 1), st.lists(st.integers(0, 255), max_size=50), st.integers(0, 63), st.sampled_from((5, 6)))
@settings(max_examples=300, deadline=None)
def test_chain_budgets(x, flips, start, lead):
    plan = similar.RingPlan(4, lead, 1)
    y = x
    for f in flips:
        y ^= 1 << f
    word = lambda v: [v >> 64 * j & (1 << 64) - 1 for j in range(4)]
    diff = np.array([word(x ^ y)], dtype=np.uint64)
    seg = [((x ^ y) >> 4 * i & 15).bit_count() for i in range(64)]
    chain = [seg[(start + j) % 64] for j in range(64)]
    if any(chain[:lead]):
        return
    within = all(sum(chain[:n]) <= n * 40 // 64 for n in range(lead + 1, 65))
    assert (len(similar.chain_survivors(diff, np.array([start]), plan)) == 1) == within


def five_words(text):
    w = text.translate({i: i + 32 for i in range(65, 91)}).split(" ")
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def alike_pairs(texts, least=0.8):
    """All pairs at ``least`` or more: such sets share one of the rarest shingles of either, as many as may be missing and one more."""
    sets, often, holders = [five_words(t) for t in texts], Counter(), {}
    for s in sets:
        often.update(s)
    for i, s in enumerate(sets):
        for x in sorted(s, key=lambda x: (often[x], x))[: len(s) - math.ceil(least * len(s)) + 1]:
            holders.setdefault(x, []).append(i)
    met = {(i, j) for h in holders.values() for a, i in enumerate(h) for j in h[:a]}
    return [(i, j) for i, j in met if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]


def some_texts(seed=7):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(3000)]
    line = " ".join(rng.choice(words) for _ in range(12))
    texts = [" ".join([*(rng.choice(words) for _ in range(100)), *[line] * 20]) for _ in range(6)]  # alike by counts, not as sets
    for _ in range(12):  # chains of small changes, whose ends are less alike than 0.8
        base = [rng.choice(words) for _ in range(200)]
        for _ in range(8):
            texts.append(" ".join(base))
            at = rng.randrange(180)
            base[at : at + 2] = [rng.choice(words), rng.choice(words)]
    for _ in range(40):  # some 0.6 to 0.9
        base = [rng.choice(words) for _ in range(200)]
        texts.append(" ".join(base))
        for _ in range(rng.randint(3, 9)):
            base[rng.randrange(200)] = rng.choice(words)
        texts.append(" ".join(base))
    return texts


@pytest.mark.parametrize("options", [{"key_rows": 3, "root_rows": 4}, {"plan": similar.RingPlan(8, 7, 1)}])
def test_keep_one_links_exactly(spark, options):
    texts = some_texts()
    pairs = alike_pairs(texts)
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id for r in similar.keep_one(docs, **options).collect()}
    whole = {*grouped(pairs, range(len(texts))).values()}
    assert whole <= got and {*range(6)} <= got  # nothing less alike is linked
    assert len(got) <= len(whole) + 6


def test_a_large_root_is_compared_whole(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(3000)]
    base = [rng.choice(words) for _ in range(150)]
    texts = []
    for _ in range(120):
        near = base[:]
        for _ in range(rng.randint(0, 5)):
            near[rng.randrange(150)] = rng.choice(words)
        texts.append(" ".join(near))
    sets = [five_words(t) for t in texts]
    pairs = [(i, j) for i in range(120) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    whole = {*grouped(pairs, range(120)).values()}
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    for rows in (9, 2000):
        assert {r.doc_id for r in similar.keep_one(docs, root_rows=rows).collect()} == whole


@pytest.mark.parametrize("key_rows", [3, similar.KEY_ROWS])
def test_rings_against_brute_force(spark, key_rows):
    plan, rng = similar.PLAN, np.random.default_rng(3)
    rows = [rng.integers(0, 2**64, plan.words, np.uint64) for _ in range(200)]
    rows += [np.bitwise_xor.reduce([r, *(np.eye(plan.words, dtype=np.uint64)[b // 64] << np.uint64(b % 64) for b in rng.integers(0, 256, rng.integers(5, 60)))]) for r in rows[:60] for _ in range(4)]
    rows += [np.array([rows[0][0], *rng.integers(0, 2**64, plan.words - 1, np.uint64)], np.uint64) for _ in range(60)]  # meet under many keys, and are not near
    f = np.stack(rows)
    one, other = np.triu_indices(len(f), 1)
    ring = np.unpackbits((f[one] ^ f[other]).view(np.uint8), axis=1, bitorder="little")
    near = np.zeros(len(one), dtype=bool)
    for start in plan.starts:
        met = np.flatnonzero(~np.roll(ring, -start * similar.SEGMENT_BITS, axis=1)[:, : similar.SEGMENT_BITS * plan.lead].any(1))
        near[met[similar.chain_survivors(f[one[met]] ^ f[other[met]], np.full(len(met), start), plan)]] = True
    prints = spark.createDataFrame([(i, *r.view(np.int64).tolist()) for i, r in enumerate(rows)], "node long, " + ", ".join(f"f{j} long" for j in range(plan.words)))
    got = [(r.a, r.b) for r in similar.near_rings(prints, plan, key_rows).collect()]
    assert grouped(got, range(len(f))) == grouped([*zip(one[near].tolist(), other[near].tolist())], range(len(f)))


def test_chance_meetings_are_not_met_again():
    rng = np.random.default_rng(8)
    key = np.repeat(np.arange(300), rng.integers(1, 80, 300))
    ahead = rng.integers(0, 2**64, len(key), np.uint64)
    for i in np.flatnonzero(rng.random(len(key)) < 0.1)[1:]:
        ahead[i] = ahead[i - 1] ^ np.uint64(int(rng.integers(0, 2**64, dtype=np.uint64)) & (1 << int(rng.integers(0, 64))))
    plan = similar.PLAN
    keeps = lambda d: all((int(d) & ((1 << 4 * (n - plan.lead)) - 1)).bit_count() <= n * plan.limit // plan.segments for n in range(plan.lead + 1, plan.lead + 17))
    with_partner = {i for k in range(300) for at in [np.flatnonzero(key == k).tolist()] for i in at if any(j != i and keeps(ahead[i] ^ ahead[j]) for j in at)}
    rows = pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.arange(len(key))), pa.array(ahead.view(np.int64))], names=["key", "node", "ahead"])
    got = [n for b in similar._partnered(plan)(rows.slice(at, 700) for at in range(0, len(key), 700)) for n in b.column(1).to_pylist()]
    assert sorted(got) == sorted(with_partner) and 100 < len(got) < len(key) / 3


def test_unrelated_texts_change_no_candidate(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(3000)]
    texts = []
    for _ in range(300):  # about 0.8 alike
        base = [rng.choice(words) for _ in range(120)]
        texts.append(" ".join(base))
        for at in rng.sample(range(120), 3):
            base[at] = rng.choice(words)
        texts.append(" ".join(base))
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    others = spark.range(1000, 135_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit(c), F.col("id")) for c in "abcdef")).alias("text"))
    alone = {r.doc_id for r in similar.keep_one(docs).collect()}
    kept = similar.keep_one(docs.union(others))
    assert {r.doc_id for r in kept.filter("doc_id < 1000").collect()} == alone


def test_keep_one_recall_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("text is not null")
    rows = docs.select("doc_id", "text").collect()
    texts = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        texts.setdefault(" ".join(prints.text_words(r.text) and [w.decode() for w in prints.text_words(r.text)]), r.doc_id)
    ids = [*texts.values()]
    pairs = [(ids[i], ids[j]) for i, j in alike_pairs([*texts])]
    got = {r.doc_id for r in similar.keep_one(docs).collect()}
    whole = {*grouped(pairs, ids).values()}
    assert whole <= got  # none is dropped without a link
    assert len(ids) - len(got) >= 0.9 * (len(ids) - len(whole)) and len(pairs) > 40


# embeddings


def vectors(seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(25):
        center = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 14))):
            rows.append((center + 0.1 * rng.standard_normal(16)).tolist())
    rows += rows[:12]
    return [(i + 1, v, i % 3) for i, v in enumerate(rows)]


@pytest.mark.parametrize("list_rows", [4000, 6])
def test_vector_groups(spark, list_rows):
    rows = vectors()
    odd = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [math.nan] * 16, 1), (9004, [1.0] * 15 + [None], 1), (9005, [1.0] * 16, None), (9006, [math.inf] + [1.0] * 15, 1), (9007, [], 1), (9008, [1.0, 0.5], 1), (9009, [2.0, 1.0], 1), (9010, [1e-200, 1e-200], 2), (9011, [1e200, 1e200], 2)]
    nulls = [(None, [3.0, 0.0, 0.0], 2)] * 2
    df = spark.createDataFrame(rows + odd + nulls, "vec_id long, embedding array<double>, label int")
    pairs = []
    usable = rows + odd[7:]
    for i, (a, u, k) in enumerate(usable):
        for b, v, l in usable[:i]:
            if k == l and len(u) == len(v):
                u2, v2 = np.array(u) / max(map(abs, u)), np.array(v) / max(map(abs, v))
                if u2 @ v2 / np.linalg.norm(u2) / np.linalg.norm(v2) >= 0.93:
                    pairs.append((a, b))
    true = {i: sum(i in p for p in pairs) for i, *_ in rows + odd}
    got = {r.vec_id: r for r in embeddings.vector_groups(df, list_rows=list_rows).collect()}
    null = got.pop(None)
    assert null.n_links == 1 and null.component_id is None and null.kept and len(got) == len(rows) + len(odd)
    found = sum(r.n_links for r in got.values())
    assert all(got[i].n_links <= n for i, n in true.items()) and found >= 0.9 * sum(true.values())
    if found == sum(true.values()):
        roots = grouped(pairs, true)
        assert {i: r.component_id for i, r in got.items()} == roots and all(r.kept == (i == roots[i]) for i, r in got.items())
    assert all(got[i].n_links == 0 and got[i].kept for i in range(9001, 9008)) and got[9011].n_links == 1
    assert embeddings.vector_groups(df.limit(0)).count() == 0


def recall_of(df, got):
    """Share of the true links found; none is found that is not true."""
    rows = df.filter(embeddings.usable("embedding", "label")).collect()
    true = found = 0
    for label in {r.label for r in rows}:
        group = [r for r in rows if r.label == label]
        x = np.array([r.embedding for r in group], dtype=float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        links = (x @ x.T >= 0.93).sum(1) - 1
        true += links.sum()
        found += sum(min(got[r.vec_id], n) for r, n in zip(group, links))
        assert all(got[r.vec_id] <= n for r, n in zip(group, links))
    return found / max(true, 1), true


@pytest.mark.parametrize("table", ["sf0.1", "check_s"])
def test_recall_against_brute_force(spark, table):
    df = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet")
    recall, true = recall_of(df, {r.vec_id: r.n_links for r in embeddings.vector_groups(df).collect()})
    assert recall >= 0.9 or not true


@pytest.mark.parametrize("plan", [embeddings.index_plan(1000), embeddings.index_plan(1 << 24)])
def test_recall_at_the_threshold(spark, plan):
    """Pairs of a cosine just above 0.93, for the plans of small and of large tables."""
    rng = np.random.default_rng(plan.pivots)
    x, z = rng.standard_normal((2, 800, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = 0.932 * x + math.sqrt(1 - 0.932**2) * z
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate((x, y)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    recall, true = recall_of(df, {r.vec_id: r.n_links for r in embeddings.vector_groups(df, plan=plan).collect()})
    assert true >= 1600 and recall >= 0.9


def test_lists_of_candidates_are_exact():
    """Every pair that shares enough pivots is met in the list of its first two, and in no other."""
    rng = np.random.default_rng(5)
    plan = embeddings.IndexPlan(16, 6, 4)
    perm = np.array([rng.permutation(16)[:6] for _ in range(60)], dtype=np.uint16)
    lists = embeddings.list_pairs(plan, perm)
    met = []
    for pair in np.unique(lists).tolist():
        at = np.flatnonzero((lists == pair).any(1))
        met += [(at[i], at[j]) for x, y in embeddings._blocks(perm[at], np.zeros(len(at)), False, plan, pair) for i, j in zip(x, y)]
    place = [{v: k for k, v in enumerate(p.tolist())} for p in perm]
    close = lambda p, q: len(p.keys() & q.keys()) >= 4 and sum(abs(p[v] - q[v]) for v in p.keys() & q.keys()) <= 3 * len(p.keys() & q.keys())
    assert sorted(met) == [(i, j) for i in range(60) for j in range(i + 1, 60) if close(place[i], place[j])]


# WARC


@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunks_round_trip(payload, size):
    assert warc.dechunked(warc.chunked(payload, size)) == payload
    assert warc.dechunked(warc.chunked(payload, size)[:-1]) is None


def test_reassembly_checks():
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"hello world")
    a, b, c = block[:20], block[20:50], block[50:]
    assert warc.payload_of([(3, len(block), c), (1, None, a), (2, None, b)]) == b"hello world"
    assert warc.payload_of([(1, None, a), (3, len(block), c)]) is None  # a segment is missing
    assert warc.payload_of([(1, None, a), (2, None, b), (2, None, b), (3, len(block), c)]) is None
    assert warc.payload_of([(1, None, a), (2, None, b), (3, len(block) + 1, c)]) is None  # wrong total
    assert warc.dechunked(b"5;x=1\r\nhello\r\n0\r\nTrailer: y\r\n\r\n") == b"hello" and warc.dechunked(b"zz\r\n") is None


def test_records_of_any_bytes():
    def record(body):
        return b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"

    bodies = [b"a\r\n\r\nWARC/1.1\r\n\r\nb", b"", bytes(range(256))]
    plain = b"".join(map(record, bodies))
    members = b"".join(gzip.compress(record(b)) for b in bodies)
    for data in (plain, gzip.compress(plain), members):
        assert [(b, whole) for _, b, whole in warc.records(data)] == [(b, True) for b in bodies]


def test_keys_in_record_ids():
    for key in ("5", "a:b", "x\r\nWARC-Type: response", "é/%41", "None", "", None):
        assert warc.key_of(f"<{warc.record_key(key, 7)}>") == key and "\r" not in warc.record_key(key, 7)
    assert warc.key_of("<urn:uuid:1>") == "<urn:uuid:1>" and warc.key_of(None) is None


def http_record(body, kind="response", **fields):
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in fields.items())
    return (f"WARC/1.1\r\nWARC-Type: {kind}\r\n{head}Content-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"


def test_damaged_archives_never_raise():
    good = http_record(b"HTTP/1.1 200 OK\r\n\r\nbody", WARC_Record_ID="<a>")
    bad_length = good.replace(b"Content-Length: 23", b"Content-Length: many")
    odd_header = good.replace(b"<a>", b"<\xff\xfe>")
    rows = [*warc.file_rows(good + bad_length + good + odd_header, True)]
    assert [r["payload"] for r in rows] == [b"body", None, b"body", b"body"] and rows[1]["payload_bytes"] == -1
    cut = [*warc.file_rows(good + good[:-10], True)]
    assert [r["payload"] for r in cut] == [b"body", None]
    packed = gzip.compress(good)
    assert [r["payload"] for r in warc.file_rows(packed + b"\0" * 700 + packed, True)] == [b"body"] * 2  # padding
    broken = packed[:-12] + b"\x99" * 12
    assert [r["payload"] for r in warc.file_rows(packed + broken + packed, True)].count(b"body") >= 2
    assert [*warc.file_rows(b"WARC/1.1 and nothing else", True)][0]["payload"] is None and [*warc.file_rows(b"", True)] == []


@given(st.binary(max_size=400), st.integers(0, 400), st.integers(0, 255))
@settings(max_examples=200, deadline=None)
def test_any_bytes_are_read(noise, at, byte):
    data = bytearray(http_record(b"HTTP/1.1 200 OK\r\n\r\nbody", WARC_Record_ID="<a>") * 3)
    data[min(at, len(data) - 1)] = byte
    packed = bytearray(gzip.compress(bytes(data)))
    packed[min(at, len(packed) - 1)] = byte
    for found in (noise, bytes(data) + noise, bytes(packed) + noise, gzip.compress(noise) + noise):
        for row in warc.file_rows(found, True):
            assert row["kind"] in ("response", "revisit", "continuation", "unreadable")


def test_archive_round_trip(spark, tmp_path):
    long = "é€𝄞" * 9000 + "\r\n\r\nWARC/1.1\r\n\r\n"
    rows = [(1, "https://a.com/x y", "p" * 99), (2, None, "p" * 99), (3, "u", long), (4, "u", long), (5, "u", None), (6, "u", ""), (7, "u", "q" * 100), (8, "u", "q" * 100), (8, "u", "q" * 100), (None, "u", "n" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"key": F.lit("clash"), "digest": F.lit("clash"), "row": F.lit(1)})
    # segments joined where they are read, in the shuffle, and across files
    for i, (held, records) in enumerate([(1 << 24, 8000), (0, 8000), (1 << 24, 3)]):
        path = f"file://{tmp_path}/w{i}"
        warc.write_archive(pages, path, segment_bytes=1000, chunk_bytes=100, file_records=records)
        got = warc.read_archive(spark, path, keep_payload=True, held_bytes=held).collect()
        assert len(got) == len(rows) and all(r.valid for r in got)
        assert sorted((r.payload.decode() for r in got if r.kind == "response")) == sorted(["p" * 99, "p" * 99, long, "", "", "q" * 100, "n" * 200])
    raw = b"".join(gzip.open(p).read() for p in tmp_path.glob("w0/part-*"))
    assert raw.count(b"WARC-Type: continuation") > 50
    report = {(r.page_id, r.record_type, r.refers_to) for r in warc.archive_report(pages).collect()}
    assert report == {(1, "response", None), (2, "response", None), (3, "response", None), (4, "revisit", 3), (5, "response", None), (6, "response", None), (7, "response", None), (8, "revisit", 7), (None, "response", None)}
    assert warc.archive_report(pages.limit(0)).count() == 0
    assert next(r.payload_digest for r in warc.archive_report(pages).collect() if r.page_id == 4) == hashlib.sha256(long.encode()).hexdigest()


def test_a_revisit_is_as_good_as_its_response(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\n\r\nbody"
    name = hashlib.sha256(b"body").hexdigest()
    stored = http_record(body, WARC_Record_ID="<a>", WARC_Payload_Digest=f"sha-256:{name}")
    false = http_record(body, WARC_Record_ID="<b>", WARC_Payload_Digest=f"sha-256:{'0' * 64}")
    again = [http_record(b"", "revisit", WARC_Record_ID=f"<{c}>", WARC_Payload_Digest=f"sha-256:{d}") for c, d in (("c", name), ("d", "0" * 64))]
    part = http_record(body[:5], WARC_Record_ID="<e>", WARC_Segment_Number=1)
    (tmp_path / "part-0").write_bytes(stored + false + b"".join(again) + part)
    got = {r.key: r for r in warc.read_archive(spark, f"file://{tmp_path}").collect()}
    assert {k: (r.valid, r.payload_bytes, r.refers) for k, r in got.items()} == {"<a>": (True, 4, None), "<b>": (False, -1, None), "<c>": (True, 4, "<a>"), "<d>": (False, -1, None), "<e>": (False, -1, None)}


def test_the_query_writes_continuations(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = warc.scratch_path(spark, "archive")
    warc.write_archive(pages, path)
    text = spark.read.option("wholetext", True).text(path).agg(F.sum(F.regexp_count("value", F.lit("WARC-Type: continuation"))).alias("n")).first()
    assert text.n >= pages.count() // 2


# html

PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><a>Menu</a></nav><div class="cookie-notice">ok?</div>
<article class="post"><h1>Head &amp; tail</h1><p>One <b>bold</b>
 and&nbsp;more<p>Two<script>if (a < b) "</p>"</script><form>x<input></form><aside>side</aside><div id="comments"><p>me too</div><ul><li>a<li>b</ul></article>
<div class="sidebar">s</div><footer>&copy; us</footer></body></html>"""


def test_article():
    text = lambda page: html.article_blocks(html.blocks(page))
    assert text(PAGE) == ["Head & tail", "One bold and more", "Two", "a", "b"]
    assert text("<p>loose") is None and text("") == [] and text("<div class=ad>x") == []
    assert text("<main><p>m<nav>n</nav></main><p>out") == ["m"]


@pytest.mark.parametrize(
    "page,expected",
    [
        ("<article><p>Text <button>Share</button> more</p></article>", ["Text more"]),
        ("<article><p>a <span class='ad'>Buy now</span> b<noscript>enable js</noscript></p><p>c<span id=newsletter>mail</span></p></article>", ["a b", "c"]),
        ("<article>a <svg><text>drawn</text></svg>b<label>name</label><select><option>o</select></article>", ["a b"]),
        ("<article class='post social'><p>kept</p></article>", ["kept"]),
        ("<article><div class='content no-sidebar'><p>kept</p></div></article>", ["kept"]),
        ("<body><article>teaser</article><main>" + "long text " * 20 + "</main></body>", ["teaser", ("long text " * 20).strip()]),
        ("<article><div class='social'>all of it</div></article>", ["all of it"]),
        ("<article><p>a</p><div class='post-comments'><p>reader</p></div><p>b</article>", ["a", "b"]),
        ("<div class='widget'><article>inside</article></div>", ["inside"]),
        ("<aside><article>teaser</article></aside><article>own</article>", ["own"]),
        ("<article><ul><li>a<ul><li>b<li>c</ul><li>d</ul><table><tr><td>e<td>f<tr><td>g</table></article>", list("abcdefg")),
    ],
)
def test_what_articles_keep(page, expected):
    assert html.article_blocks(html.blocks(page)) == expected


@pytest.mark.parametrize("page", ["<div>" * 30_000, "<!--" * 50_000, "<p " * 50_000, "<a b='" * 50_000, "&" * 50_000, "<script>" * 20_000, "</x>" * 50_000, "<p>" * 50_000, "<div>" * 20_000 + "<li></li>" * 20_000, "<div>" * 20_000 + "<article></article>" * 20_000, "<span class=ad>x" * 20_000, "<ul><li>" * 20_000])
def test_hostile_pages(page):
    began = time.time()
    html.blocks(page)
    assert time.time() - began < 2


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=7), st.integers(1, 4), st.integers(2, 3))
@settings(max_examples=300, deadline=None)
def test_repeated_windows_are_brute_force(pages, depth, least):
    streams = [html.token_hashes("h", p) for p in pages]
    holders = {}
    for p in pages:
        for i in range(len(p) - depth + 1):
            holders.setdefault(tuple(p[i : i + depth]), set()).add(tuple(p))
    expected = [[i for i in range(len(p) - depth + 1) if len(holders[tuple(p[i : i + depth])]) >= least] for p in pages]
    found = html.repeated_starts(streams, ["".join(p) for p in pages], depth, least)
    assert [f.tolist() for f in found] == expected
    assert len({html.window_hashes(s, depth)[i] for s, p in zip(streams, pages) for i in range(len(p) - depth + 1)}) == len(holders)


@given(st.lists(st.integers(0, 3), max_size=40))
def test_common_prefixes(a):
    order = decontaminate.suffix_array(np.array(a, dtype=np.int64))
    common = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    assert html.common_prefixes(np.array(a, dtype=np.int64), order).tolist() == [0 if not k else common(a[order[k - 1] :], a[order[k] :]) for k in range(len(a))]


@pytest.mark.parametrize("shard_tokens", [250_000, 40])
def test_suffix_array_removes_what_pages_share(spark, shard_tokens):
    shared = "all of this text is on every page of the host again"
    rows = [(i, f"https://h.com/{i}", f"<div>{shared}</div><div>{i}th page says {i * 7} things of its own kind {i}</div>") for i in range(6)]
    rows += [(90, "https://h.com/c", rows[0][2]), (91, "https://other.com/", f"<div>{shared}</div>"), (92, None, None), (93, "https://h.com/a", f"<article>{shared}</article>")]
    near = [f"an article of no mark that two pages show alike, but for the word {x} in it" for x in ("one", "two")]
    rows += [(94 + i, f"https://twice.com/{i}", f"<p>{t}") for i, t in enumerate(near)]
    long = " ".join(f"w{i}" for i in range(30_000))
    rows += [(96, "https://long.com/", f"<p>{long}"), (97, "no url", "<p>of no host")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("clash"), "text": F.lit("clash"), "row": F.lit(1), "key": F.lit(2)})
    got = {r.page_id: r.text for r in html.main_text(pages, shard_tokens=shard_tokens).collect()}
    assert [got[i] for i in range(6)] == [f"{i}th page says {i * 7} things of its own kind {i}" for i in range(6)]
    assert got[90] == got[0] and got[91] == shared and got[92] == "" and got[93] == shared
    assert [got[94], got[95]] == near and got[96] == long and got[97] == "of no host"
    assert html.main_text(pages.limit(0)).count() == 0


def test_suffix_array_decides_where_articles_are_not_named(spark, sf_dir):
    """The tables' own pages with their marks taken off and a menu of their host put on: the array finds the menus."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    true = {r.page_id: r for r in html.main_text(pages).collect()}
    menu = "<div>Home About us Our products Prices News Press Jobs Contact Imprint Terms of use</div>"
    bare = [(r.page_id, "https://one.example.com/", menu + "".join(f"<p>{escape(line)}</p>" for line in r.text.split("\n"))) for r in true.values() if r.text]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(bare, "page_id long, url string, html string")).collect()}
    assert len(got) > 20 and not any("Our products Prices" in t for t in got.values())
    # some of these texts share passages of their own, which the array cannot tell from menus
    assert sum(got[i] == true[i].text for i in got) >= 0.8 * len(got)


# queries and pipeline


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, sf_dir, name):
    compare(spark, duck, sf_dir, QUERIES[name], ORACLES[name])


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, kept = docs, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stage(spark, before, sf_dir)
        if k < 4:
            assert kept.columns == docs.columns and kept.count() <= before.count()
            kept = kept.cache()
            if name == "near_duplicates":
                ids = {r.doc_id for r in kept.select("doc_id").collect()}
                texts = {r.text for r in kept.select("text").collect()}
                assert len(ids) == kept.count() == len(texts)  # no exact copies are left
            before = kept
    rows = kept.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))
    assert sum(r.taken for r in rows) == pytest.approx(sum(r["size"] for r in rows), rel=0.01) and len(rows) == before.count()


def test_pipeline_of_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
