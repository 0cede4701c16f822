"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's chance of offending is a logistic function of the marked words in
it; a document's is the noisy-or of its sentences and of a constant leak, which
takes up labels that no sentence explains:

    P(document) = 1 - (1 - leak) * product over sentences (1 - P(sentence))

A sentence without a marked word cannot offend, so the length of a clean text
adds nothing. Features are the lower-cased words and their prefixes of four and
five letters, which catch inflected and compound forms. Those kept are more
frequent in toxic documents than chance allows (likelihood ratio, false
discovery rate ``fdr``); weights come from gradient ascent on the documents'
likelihood.

The training sample is bounded: at most ``max_toxic`` toxic and ``max_clean``
other labelled documents, those with the smallest hashes of their id; equal
texts count once. Scoring covers every row and the whole text.

Defined cases: null and empty texts score the leak; with no usable labels, or
labels of one kind only, the leak is the share of toxic labels and no sentence
offends; several labels of one document are toxic if one is; null labels are
left out; repeated rows get equal scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlkit.llm.common import crc_mod, frugal, hash_order

MAX_TOXIC, MAX_CLEAN = 2_000, 6_000
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_CACHE_WORDS = 300_000


def features(word: str) -> tuple[str, ...]:
    """Of a lower-cased word: itself and, beyond their lengths, its prefixes of 4 and 5 letters."""
    n = len(word)
    return (word,) if n <= 4 else (word, word[:4] + "-") if n == 5 else (word, word[:4] + "-", word[:5] + "-")


@dataclass
class Model:
    leak: float = 0.0
    bias: float = -4.0
    weights: dict[str, float] = field(default_factory=dict)

    def word(self, word: str) -> float:
        """A word counts once, by the feature of it that tells most (``weights`` is in that order)."""
        if not hasattr(self, "_rank"):
            self._rank = {f: i for i, f in enumerate(self.weights)}
        marks = [f for f in features(word) if f in self._rank]
        return self.weights[min(marks, key=self._rank.__getitem__)] if marks else 0.0


def sentence_spans(text: str) -> Iterator[tuple[int, int]]:
    for m in _SENTENCE.finditer(text):
        yield m.span()


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def weight(self, word: str) -> float:
        w = self.known.get(word)
        if w is None:
            if len(self.known) >= _CACHE_WORDS:
                self.known.clear()
            w = self.known[word] = self.model.word(word)
        return w

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score and its offending sentences: (start, end, chance), in code points."""
        m = self.model
        if not text or not m.weights:
            return m.leak, []
        get, known = self.weight, self.known
        seen = {*_WORD.findall(text.lower())}
        if not any([known[w] if w in known else get(w) for w in seen]):
            return m.leak, []
        clean, found = 1.0 - m.leak, []
        for start, end in sentence_spans(text):
            total = sum(map(get, {*_WORD.findall(text[start:end].lower())}))
            if total > 0:
                p = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, m.bias + total))))
                clean *= 1.0 - p
                found.append((start, end, p))
        return 1.0 - clean, found


def _significant(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int, fdr: float) -> list[str]:
    """Features that toxic documents have more often than others, by the likelihood-ratio test."""
    share = n_toxic / (n_toxic + n_clean)
    tested = []
    for f, a in toxic.items():
        b = clean.get(f, 0)
        if a < 3 or a / (a + b) <= share:
            continue
        n = a + b
        g = 2 * (a * math.log(a / (n * share)) + (b * math.log(b / (n * (1 - share))) if b else 0.0))
        tested.append((math.exp(-min(g, 1400.0) / 2), f))
    tested.sort()
    count = len(tested)
    best = max((i + 1 for i, (p, _) in enumerate(tested) if p <= fdr * (i + 1) / max(count, 1)), default=0)
    return [f for _, f in tested[:best]]


def fit(texts: list[str], toxic: list[bool], *, fdr: float = 1e-3, steps: int = 400, prior: float = 0.002) -> Model:
    n, n_toxic = len(texts), sum(toxic)
    share = n_toxic / n if n else 0.0
    model = Model(leak=min(share, 0.49))
    if not n_toxic or n_toxic == n:
        return model
    counts = (Counter(), Counter())
    for text, y in zip(texts, toxic):
        counts[y].update({f for w in {*_WORD.findall(text.lower())} for f in features(w)})
    # a marker speaks for toxicity if most documents with it are toxic
    marked = [f for f in _significant(counts[True], counts[False], n_toxic, n - n_toxic, fdr) if counts[True][f] > counts[False][f]]
    if not marked:
        return model
    index = {f: i for i, f in enumerate(marked)}
    rows, cols, of = [], [], []
    for d, text in enumerate(texts):
        for start, end in sentence_spans(text):
            hit = {min(index[f] for f in features(w) if f in index) for w in {*_WORD.findall(text[start:end].lower())} if any(f in index for f in features(w))}
            if hit:
                rows += [len(of)] * len(hit)
                cols += hit
                of.append(d)
    r, c, of = np.array(rows), np.array(cols), np.array(of)
    y = np.array(toxic, dtype=float)
    w, b, a = np.full(len(marked), 3.0), -1.0, math.log(0.05 / 0.95)
    moment, speed = np.zeros(len(marked) + 2), np.zeros(len(marked) + 2)
    for step in range(1, steps + 1):
        z = b + np.bincount(r, weights=w[c], minlength=len(of))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        leak = 1 / (1 + math.exp(-a))
        log_clean = np.log1p(-leak) + np.bincount(of, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n)
        chance = np.clip(-np.expm1(log_clean), 1e-9, 1 - 1e-9)
        # d loglik / d log_clean: toxic -> -(1 - chance) / chance, clean -> 1
        slope = np.where(y > 0, -(1 - chance) / chance, 1.0)
        dz = -p * slope[of]
        grad = np.concatenate((np.bincount(c, weights=dz[r], minlength=len(marked)) - prior * n * w / len(marked), [dz.sum() - prior * n * (b + 2)], [-leak * slope.sum()])) / n
        moment = 0.9 * moment + 0.1 * grad
        speed = 0.999 * speed + 0.001 * grad * grad
        move = 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.999**step)) + 1e-8)
        w = np.maximum(w + move[:-2], 0.0)
        b, a = b + move[-2], a + move[-1]
    return Model(min(1 / (1 + math.exp(-a)), 0.49), float(b), {f: float(x) for f, x in zip(marked, w)})


def train(docs: DataFrame, labels: DataFrame, *, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, **options) -> Model:
    """Learns from labelled rows whose crc32(doc_id) mod 5 is not 0."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic") > 0).alias("y")).withColumn("order", hash_order("doc_id"))
    picked = [r for y, most in ((True, max_toxic), (False, max_clean)) for r in known.filter(F.col("y") == y).orderBy("order", "doc_id").limit(most).collect()]
    if not picked:
        return Model()
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r.doc_id, r.y) for r in picked], f"doc_id {dict(labels.dtypes)['doc_id']}, y boolean")  # bounded by max_toxic + max_clean
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(ids), "doc_id").groupBy("text").agg(F.max("y").alias("y")).toLocalIterator()
    found = sorted((r.text, r.y) for r in rows)
    return fit([t for t, _ in found], [y for _, y in found], **options)


def with_toxicity(docs: DataFrame, model: Model, *, text: str = "text", keep_text: bool = True, score: str = "score", spans: str = "offending") -> DataFrame:
    """``docs`` with the score and the offending sentences (start, end, chance)."""
    at = docs.columns.index(text)
    keep = [i for i in range(len(docs.columns)) if keep_text or i != at]
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            found = [scorer.score(t.as_py()) for t in batch.column(at)]
            out = [pa.array([s for s, _ in found], type=pa.float64()), pa.array([[{"start": a, "end": b, "chance": p} for a, b, p in x] for _, x in found], type=kind)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *out], names=[*(batch.schema.names[i] for i in keep), score, spans])

    fields = [f"`{docs.schema[i].name}` {docs.schema[i].dataType.simpleString()}" for i in keep]
    return docs.mapInArrow(frugal(run), ", ".join([*fields, f"`{score}` double", f"`{spans}` array<struct<start:int,end:int,chance:double>>"]))


def toxicity_report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, then the offending sentences' number and worst place."""
    found = with_toxicity(docs.select("doc_id", "text"), train(docs, labels, **options), keep_text=False)
    worst = F.array_max(F.transform("offending", lambda x: F.struct(x["chance"].alias("chance"), (-x["start"]).alias("start"), x["end"].alias("end"))))
    return found.select(
        "doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.size("offending").cast("long").alias("n_offending"), (-worst["start"]).alias("worst_start"), worst["end"].alias("worst_end"),
    )
