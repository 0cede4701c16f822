"""Language ID, mixing, token counts, toxicity, PII and decontamination against brute force and held-out rows."""

import hashlib
import random
import re
import time
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trawlkit.llm import decontaminate, langid, mixing, pii, tokencount, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"
#: nulls, blanks, repeated rows, clashing extra columns, a very long text
ODD = [
    (1, None, None, None, None, 0.5), (2, "", "en", "a", 0, None), (3, " \n\t ", "en", "a", 3, None), (4, "12 34 !!", "en", "b", 8, None),
    (5, "same words here", "en", "a", 15, 1.0), (5, "same words here", "en", "a", 15, 1.0), (None, "the null id", "en", "a", 11, None), (6, "word " * 60_000, "en", "b", 300_000, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def docs_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# language ID


def test_language_held_out(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    rows = langid.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and np.mean([r.lang == r.lang_pred for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_ignores_lang_of_held_out_rows(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    masked = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.col("lang")))
    assert langid.language_report(docs).orderBy("doc_id").collect() == langid.language_report(masked).orderBy("doc_id").collect()


def test_language_defined_cases(odd, empty):
    got = {r.doc_id: r.lang_pred for r in langid.language_report(odd).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == ["und"] * 4 and got[6] == "en"
    assert langid.language_report(odd).count() == len(ODD) and langid.language_report(empty).count() == 0
    kept = langid.keep_known(odd)
    assert kept.columns == odd.columns and kept.count() == 4
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.language_report(unlabelled).collect()} == {"und"}


def test_svm_separates():
    x = np.array([[1, 0], [0.9, 0.1], [0, 1], [0.1, 0.8]])
    w = langid.linear_svm(x, np.array([True, True, False, False]), cost=10)
    assert ((np.c_[x, np.ones(4)] @ w) > 0).tolist() == [True, True, False, False]
    assert langid.family_of("pt-BR") == "romance" and langid.family_of("xx") == "=xx"


@pytest.mark.parametrize("seed", range(4))
def test_svm_is_the_best_one(seed):
    """Brute force: the primal objective cannot be lowered by a plain subgradient descent from the solution or from zero."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((30, 3))
    y = x @ [1.0, -0.5, 0.2] + 0.4 * rng.standard_normal(30) > 0
    w = langid.linear_svm(x, y, cost=1.0, passes=2000)
    one, sign = np.c_[x, np.ones(30)], np.where(y, 1.0, -1.0)
    cost = np.where(y, 30 / (2 * y.sum()), 30 / (2 * (~y).sum()))
    loss = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - sign * (one @ v))).sum()
    best = loss(w)
    for v in (w.copy(), np.zeros(4)):
        for k in range(4000):
            inside = sign * (one @ v) < 1
            v = v - (0.5 / (k + 10)) * (v - (cost * sign * inside) @ one)
            assert loss(v) >= best - 1e-3 * best
    assert loss(v) <= 1.02 * best


# mixing


@given(st.lists(st.integers(0, 2000), min_size=1, max_size=8), st.integers(0, 5))
@settings(max_examples=100, deadline=None)
def test_targets(sizes, shift):
    weights = [(5, 2, 1)[(i + shift) % 3] for i in range(len(sizes))]
    got = mixing.targets(sizes, weights)
    assert sum(got) == pytest.approx(sum(sizes)) and all(t <= 3 * s + 1e-6 for t, s in zip(got, sizes))


@given(st.integers(1, 500), st.integers(0, 9))
@settings(max_examples=60, deadline=None)
def test_permutation(n, lap):
    index, laps = np.arange(n), np.full(n, lap)
    forth = mixing.permute(index, n, 7, 3, laps)
    assert sorted(forth) == list(range(n)) and (mixing.permute(forth, n, 7, 3, laps, inverse=True) == index).all()


@given(st.integers(1, 5000), st.integers(1, 64), st.floats(0, 3))
@settings(max_examples=100, deadline=None)
def test_plan_takes_exactly_the_target(size, block, ratio):
    s = mixing.Source("a", 0, 1, size, ratio * size).plan(block, 1)
    taken = 0
    for k in range(s.slots):
        b = int(mixing.permute(np.array([k % s.blocks]), s.blocks, 1, 0, np.array([k // s.blocks]))[0])
        length = min(block, size - b * block)
        taken += min(length, s.last) if k == s.slots - 1 else length
    assert taken == min(round(ratio * size), 3 * size)


def test_shares_add_up():
    s = mixing.Source("a", 2, 1, 10, 10, 100, 1234, 5)
    parts = [mixing._shares(s, j, 7, 0) for j in range(7)]
    assert parts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:])) and sum(n for _, n in parts) == 1234


def test_mix(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    rows = mixing.mix_report(docs).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    by = rows.groupby("source").agg(size=("size", "sum"), all=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by["all"]).all() and (abs(by.taken - by.target) <= 1).all() and (rows.taken <= 3 * rows["size"]).all()
    again = mixing.mix_report(docs.repartition(7)).toPandas()
    key = lambda d: sorted(map(tuple, d[["doc_id", "size", "taken"]].values.tolist()))
    assert key(rows) == key(again)
    text = mixing.mixed_text(docs).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).toPandas().set_index("source")
    assert text.n.to_dict() == by.taken.to_dict()


@pytest.mark.parametrize("most", [3, 1, 5])
def test_taken_is_what_the_mix_holds(spark, most):
    """Brute force: every word names its document and place, so the mix itself tells what it took."""
    rng = random.Random(most)
    rows = [(i, " ".join(f"{i}_{k}" for k in range(rng.choice((0, 1, 7, 40, 90)))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    options = {"most": most, "block": 16, "weights": (1, 9, 9)}
    report = {r.doc_id: r for r in mixing.mix_report(docs, **options).collect()}
    words = [w for r in mixing.mixed_text(docs, **options).collect() for w in r.text.split()]
    taken = {i: 0 for i, *_ in rows}
    for w in words:
        taken[int(w.split("_")[0])] += 1
    assert {i: r.taken for i, r in report.items()} == taken
    times = {w: words.count(w) for w in {*words}}
    assert max(times.values()) <= most and all(r.target <= most * r.source_size + 1e-9 for r in report.values())
    assert most == 1 or any(r.target > 1.5 * r.source_size for r in report.values())


def test_words_ahead_of_ranges_of_buckets(spark, sf_dir):
    sized = docs_of(spark, sf_dir).select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    found = mixing.sources(sized)
    one, many = (sorted((r.src, r.at, r.doc_id) for r in mixing.placed(sized, found, 2, n).collect()) for n in (4096, 3))
    assert one == many


def test_mix_defined_cases(odd, empty):
    rows = mixing.mix_report(odd).collect()
    assert len(rows) == len(ODD) and mixing.mix_report(empty).count() == 0
    got = {r.doc_id: r for r in rows}
    assert got[1]["size"] == 0 and got[1].taken == 0 and got[1].source_size == 0 and got[6]["size"] == 60_000


# token counts

PIECES = {"▁": -1.0, "▁a": -1.5, "a": -2.0, "ab": -2.2, "▁ab": -3.0, "b": -2.5, "ba": -2.4, "abba": -9.0}


def best_cut(word, pieces):
    """Brute force: (score, tokens) over all cuts, unknown characters by their bytes."""
    best = None
    for cuts in product((0, 1), repeat=len(word) - 1):
        parts, at = [], 0
        for i, c in enumerate((*cuts, 1), 1):
            if c:
                parts.append(word[at:i])
                at = i
        if any(p not in pieces and len(p) > 1 for p in parts):
            continue
        n = [1 if p in pieces and pieces[p] > -20 * len(p.encode()) else len(p.encode()) for p in parts]
        s = sum(pieces.get(p, -20.0 * len(p.encode())) for p in parts)
        if best is None or (s, -sum(n)) > (best[0] + 1e-12, -best[1]):
            best = (s, sum(n))
    return best


@given(st.text(alphabet="abé", min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_trie_is_brute_force(word):
    counter = tokencount.TrieCounter(PIECES)
    score, _ = best_cut("▁" + word, PIECES)
    node = counter.root
    counter.tokens(word)
    for c in "▁" + word:
        node = node[0][c]
    assert node[1] == pytest.approx(score)
    assert counter.tokens(word) == counter._array("▁" + word)


def test_prefixes_are_scored_once():
    counter = tokencount.TrieCounter(PIECES)
    counter.count("abba abab abb abba")
    assert counter.scored == len({w[:i] for w in ("▁abba", "▁abab", "▁abb") for i in range(1, len(w) + 1)})
    small = tokencount.TrieCounter(PIECES, max_nodes=3)
    assert small.count("abba abab abb abba") == counter.count("abba abab abb abba")


def test_texts_without_blanks_enter_the_trie():
    counter = tokencount.TrieCounter(PIECES)
    long = "abba" * 600
    assert counter.tokens(long) == counter._array("▁" + long) and counter.nodes > 2400
    assert tokencount.TrieCounter(PIECES, trie_chars=50).tokens(long) == counter.tokens(long)


def test_token_counts(spark, sf_dir, odd, empty):
    pieces = tokencount.read_pieces()
    counter = tokencount.TrieCounter(pieces)
    docs = docs_of(spark, sf_dir).limit(40)
    for r in tokencount.token_counts(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r.n_tokens == sum(counter._array("▁" + w) for w in r.text.split()) and r.n_pretokens == len(r.text.split())
    got = {r.doc_id: r for r in tokencount.token_counts(odd).collect()}
    assert got[1].n_tokens == 0 and got[3].n_tokens == 0 and got[6].n_pretokens == 60_000 and tokencount.token_counts(empty).count() == 0


# toxicity


def toxic_corpus(n=400, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(80)]
    texts, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(rng.randint(1, 9))]
        bad = i % 4 == 0
        if bad:
            sentences[rng.randrange(len(sentences))] += " " + rng.choice(["vileword", "nastily", "vilewords"])
        texts.append(". ".join(sentences) + ".")
        labels.append(bad)
    return texts, labels


def test_multiple_instance_learning():
    texts, labels = toxic_corpus()
    model = toxicity.fit(texts[:300], labels[:300])
    scorer = toxicity.Scorer(model)
    for text, y in zip(texts[300:], labels[300:]):
        score, found = scorer.score(text)
        assert (score >= 0.5) == y and 0 <= score <= 1
        if y:
            start, end, _ = max(found, key=lambda s: s[2])
            assert re.search("vile|nast", text[start:end])
    # many clean sentences add nothing
    assert scorer.score(". ".join(t for t, y in zip(texts, labels) if not y))[0] < 0.5


def test_scores_are_a_noisy_or():
    """Brute force: one less the chance that neither the leak nor any sentence is toxic."""
    texts, labels = toxic_corpus()
    model = toxicity.fit(texts[:300], labels[:300])
    scorer = toxicity.Scorer(model)
    for text in texts[300:]:
        clean = 1 - model.leak
        for a, b in toxicity.sentence_spans(text):
            total = sum(model.word(w) for w in {*toxicity._WORD.findall(text[a:b].lower())})
            if total > 0:
                clean *= 1 - 1 / (1 + np.exp(-(model.bias + total)))
        assert scorer.score(text)[0] == pytest.approx(1 - clean)


def test_toxicity_report(spark, odd, empty):
    texts, labels = toxic_corpus()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)] + [(0, None), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity_report(docs, marks).collect()
    assert len(rows) == len(texts) and np.mean([r.predicted == labels[r.doc_id] for r in rows if r.held_out]) >= 0.95
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.toxicity_report(odd, none).collect()} == {0.0}
    assert toxicity.toxicity_report(empty, marks).count() == 0 and toxicity.toxicity_report(odd, marks).count() == len(ODD)


# PII

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def good(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in s.split(".")), "card": lambda: 16 <= len(d) <= 19 and pii.luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()

    return [(k, *m.span()) for k in pii.KINDS for m in re.finditer(PATTERNS[k], text) if good(k, m[0])]


@given(st.text(alphabet="ab@.1 -+2()3%_é\n4", max_size=60))
@settings(max_examples=500, deadline=None)
def test_base_spans_are_brute_force(text):
    assert pii.base_spans(text) == brute_spans(text)


@pytest.mark.parametrize("text", ["a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 200_000, "+1((" * 50_000, "a@" * 100_000, "(at)" * 50_000, "1 " * 100_000])
def test_hostile_texts_are_linear(text):
    base = pii.base_spans(text)
    pii.candidates(text, base)


def test_pii_report(spark, sf_dir, odd, empty):
    docs = docs_of(spark, sf_dir)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pii.pii_report(docs).collect():
        base = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.listed(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == s[0] for s in base) for k in pii.KINDS]
        assert {*filter(None, pii.listed(base).split(","))} <= {*filter(None, r.spans.split(","))}
    got = pii.pii_report(odd).collect()
    assert len(got) == len(ODD) and {r.base_sha256 for r in got} == {hashlib.sha256(b"").hexdigest()} and pii.pii_report(empty).count() == 0


def test_weak_supervision_adds_and_rejects(spark):
    rows = [(i, f"mail joe{i}@a.com or call +1 (415) 555-26{i:02d} now") for i in range(30)] + [(100, "call me on (415) 555-2671"), (101, "9870157079875996 is no number"), (102, "joe (at) example (dot) com")]
    got = {r.doc_id: r.spans for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "phone:11:25" and got[101] == "" and got[102].startswith("email:0:")
    clean = pii.redacted(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")))
    first = clean.filter("doc_id = 1").first()
    assert first.text == "mail <EMAIL> or call <PHONE> now" and first.n_chars == len(first.text)
    assert clean.filter("doc_id = 101").first().text == "9870157079875996 is no number"


def brute_posteriors(items, rounds=50):
    """Expectation-maximisation item by item: votes of one kind, by plain loops."""
    post = [(v.count(1) + 1) / (len(v) - v.count(2) + 2) for v in items]
    for _ in range(rounds):
        right = []
        for j in range(len(items[0])):
            said = [(v[j], p) for v, p in zip(items, post) if v[j] != 2]
            for_one = (sum(p for x, p in said if x == 1) + 9) / (sum(p for _, p in said) + 10)
            for_none = (sum(1 - p for x, p in said if x == 0) + 9) / (sum(1 - p for _, p in said) + 10)
            right.append((for_one, for_none))
        new = []
        for v in items:
            one = none = 1.0
            for x, (r1, r0) in zip(v, right):
                if x != 2:
                    one, none = one * (r1 if x == 1 else 1 - r1), none * (1 - r0 if x == 1 else r0)
            new.append(one / (one + none))
        post = new
    return post


def test_reliabilities_are_brute_force():
    rng = random.Random(9)
    items = [tuple(rng.choice((0, 1, 2)) if rng.random() < 0.4 else good if rng.random() < 0.9 else 1 - good for _ in range(5)) for good in [rng.random() < 0.5 for _ in range(400)]]
    items = [tuple(int(x) for x in v) for v in items]
    counts = {v: float(items.count(v)) for v in {*items}}
    got = pii.reliabilities([("email", v, n) for v, n in sorted(counts.items())])
    assert all(got["email", v] == pytest.approx(p, abs=1e-5) for v, p in zip(items, brute_posteriors(items)))


def test_candidates_are_brute_force():
    rng = random.Random(2)
    parts = ["joe (at) example (dot) com", "a@b.com", "415-555-2671", "+1 415-555-2671", "4111-1111-1111-1112", "4111 1111 1111 1111", "10.0.0.1", "x", ", "]
    for _ in range(200):
        text = " ".join(rng.choice(parts) for _ in range(12))
        base = pii.base_spans(text)
        expected, taken = [(k, a, b, True) for k, a, b in base], [(a, b) for _, a, b in base]
        for kind, pattern in pii._LOOSE:
            for m in pattern.finditer(text):
                if not any(a < m.end() and m.start() < b for a, b in taken):
                    expected.append((kind, *m.span(), False))
                    taken.append(m.span())
        assert pii.candidates(text, base) == expected


def test_many_spans_in_a_text():
    text = "415-555-2671 and a@b.com " * 20_000
    began = time.time()
    assert len(pii.candidates(text, pii.base_spans(text))) == 40_000 and time.time() - began < 5


# decontamination


def leak_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute_leaks(text, items, window):
    w, hit, found = leak_words(text), set(), set()
    for item, t in items:
        x = leak_words(t)
        n = min(window, len(x))
        for i in range(len(x) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == x[i : i + n]:
                    hit.update(range(p, p + n))
                    found.add(item)
    return len(w), sorted(hit), found


@given(st.lists(st.text(alphabet="aB é-", max_size=30), max_size=5), st.lists(st.text(alphabet="ab é ", max_size=14), max_size=4))
@settings(max_examples=200, deadline=None)
def test_shards_are_brute_force(texts, items):
    named = [(str(i), t) for i, t in enumerate(items)]
    test = decontaminate.TestSet(named, 3)
    for text, (hit, found, longest) in zip(texts, decontaminate.scan_shard(test, [decontaminate.words(t) for t in texts])):
        n, expected, whom = brute_leaks(text, named, 3)
        assert hit == expected and found == whom and len(decontaminate.words(text)) == n
        assert (longest[0] > 0) == bool(hit)


@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array(a):
    assert decontaminate.suffix_array(np.array(a, dtype=np.int64)).tolist() == sorted(range(len(a)), key=lambda i: a[i:])


def test_longest_match_may_begin_inside_another():
    s, t = [b"s%d" % i for i in range(10)], [b"t%d" % i for i in range(40)]
    for shared in (9, 10):
        items = [("a", b" ".join([b"x", *s[:shared]]).decode()), ("b", b" ".join([*s[:shared], *t]).decode())]
        found = decontaminate.scan_shard(decontaminate.TestSet(items, 10), [[b"y", b"x", *s[:shared], *t]])
        assert found[0][2] == (shared + 40, "b", 0, 2)


def test_longest_match(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, f"x y {passage} z"), (2, "w1 w2 w3"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([("a", f"p q {passage} r"), (None, None)], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.leak_report(docs, bench).collect()}
    assert (got[1].longest_words, got[1].longest_item, got[1].longest_item_at, got[1].longest_at) == (30, "a", 2, 2)
    assert not got[2].contaminated and got[3].n_words == 0
    assert [r.doc_id for r in decontaminate.decontaminate(docs, bench).orderBy("doc_id").collect()] == [2, 3]


def test_blocks_of_items_agree(spark, sf_dir, odd, empty):
    docs, bench = docs_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one = decontaminate.leak_report(docs, bench).orderBy("doc_id").collect()
    many = decontaminate.leak_report(docs, bench, block_words=300, shard_words=500, pass_blocks=3).orderBy("doc_id").collect()
    assert [r[:6] for r in one] == [r[:6] for r in many] and any(r.contaminated for r in one)
    assert decontaminate.leak_report(odd, bench).count() == len(ODD) and decontaminate.leak_report(empty, bench).count() == 0
    assert decontaminate.leak_report(odd, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.decontaminate(odd, bench).columns == odd.columns
