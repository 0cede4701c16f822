"""Language identification in two steps: the family, then linear SVMs for each pair of languages in it.

Features are counts of byte trigrams of the lower-cased letters, hashed to
``BUCKETS`` places, square-rooted and scaled to length 1; the whole text
counts. Families are separated by one-versus-rest linear SVMs; inside the
predicted family every pair of languages has a linear SVM of its own, and they
vote, ties broken by the summed margins, then by name. All are trained by dual
coordinate descent.

The training sample is bounded: at most ``per_lang`` documents of a language
and ``max_docs`` in all, those with the smallest hashes of their id. Counting
languages and predicting cover all rows.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
with no labelled rows everything is ``und``; one learned language is always
predicted; repeated rows get equal predictions; a null ``doc_id`` counts as
the empty text where folds are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlkit.llm.common import crc_mod, frugal, hash_order

BUCKETS, PER_LANG, MAX_DOCS = 4096, 500, 20_000
UND = "und"
_FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi fo",
    "romance": "fr es it pt ro ca gl oc la an ast",
    "slavic": "ru uk be bg sr mk pl cs sk sl hr bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indic": "hi bn mr gu pa ur ne si",
    "semitic": "ar he mt am",
    "austronesian": "id ms tl jv su",
    "cjk": "zh ja ko yue",
}
FAMILY_OF = {lang: family for family, langs in _FAMILIES.items() for lang in langs.split()}
_ASCII = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def family_of(lang: str) -> str:
    """The language's family; a language that is not listed is a family of its own."""
    return FAMILY_OF.get(lang.lower().replace("_", "-").split("-")[0], f"={lang}")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def profile(text: str) -> np.ndarray:
    """Counts of hashed trigrams over letters; runs of anything else are one blank."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_ASCII).split()) + b" "
    a = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(BUCKETS, dtype=np.float32)
    h = (a[:-2] * np.uint32(2654435761) + a[1:-1] * np.uint32(40503) * np.uint32(65599) + a[2:] * np.uint32(2246822519)) >> np.uint32(20)
    return np.bincount(h, minlength=BUCKETS).astype(np.float32)


def scaled(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts)
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, passes: int = 25, seed: int = 0) -> np.ndarray:
    """Weights, bias last, of an L2-regularised hinge-loss SVM by dual coordinate descent; classes weigh alike."""
    x = np.concatenate((x, np.ones((len(x), 1), dtype=x.dtype)), axis=1).astype(np.float64)
    y = np.where(y, 1.0, -1.0)
    top = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    norm = (x * x).sum(1)
    alpha, w = np.zeros(len(y)), np.zeros(x.shape[1])
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(y)):
            grad = y[i] * (w @ x[i]) - 1
            new = min(max(alpha[i] - grad / norm[i], 0.0), top[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    family_w: np.ndarray | None = None  #: [family, bucket + 1], absent with fewer than two families
    langs: dict[str, list[str]] = field(default_factory=dict)
    pair_w: dict[str, tuple[list[tuple[int, int]], np.ndarray]] = field(default_factory=dict)
    steep: float = 4.0

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        if not self.families:
            return [UND] * len(x), np.zeros(len(x))
        one = np.concatenate((x, np.ones((len(x), 1), dtype=x.dtype)), axis=1)
        if self.family_w is None:
            chosen, sure = np.zeros(len(x), dtype=int), np.ones(len(x))
        else:
            margin = one @ self.family_w.T
            chosen = margin.argmax(1)
            p = 1 / (1 + np.exp(-self.steep * margin))
            sure = p[np.arange(len(x)), chosen] / np.maximum(p.sum(1), 1e-12)
        langs: list[str] = [UND] * len(x)
        for f, family in enumerate(self.families):
            at = np.flatnonzero(chosen == f)
            names = self.langs[family]
            if len(names) == 1 or not len(at):
                for i in at:
                    langs[i] = names[0]
                continue
            pairs, w = self.pair_w[family]
            margin = one[at] @ w.T
            votes, strength, weakest = np.zeros((len(at), len(names))), np.zeros((len(at), len(names))), np.ones((len(at), len(names)))
            for j, (a, b) in enumerate(pairs):
                m = margin[:, j]
                votes[:, a] += m >= 0
                votes[:, b] += m < 0
                p = 1 / (1 + np.exp(-self.steep * m))
                strength[:, a] += m
                strength[:, b] -= m
                weakest[:, a] = np.minimum(weakest[:, a], p)
                weakest[:, b] = np.minimum(weakest[:, b], 1 - p)
            best = (votes + 0.49 * np.tanh(strength) / 1.0).argmax(1)
            for i, k in zip(at, best):
                langs[i] = names[k]
            sure[at] = sure[at] * weakest[np.arange(len(at)), best]
        return langs, np.clip(sure, 0.0, 1.0)


def fit(langs: list[str], counts: np.ndarray) -> Model:
    model = Model()
    if not langs:
        return model
    x, names = scaled(counts), np.array(langs)
    family = np.array([family_of(n) for n in langs])
    model.families = sorted(set(family))
    if len(model.families) > 1:
        model.family_w = np.stack([linear_svm(x, family == f) for f in model.families])
    for f in model.families:
        model.langs[f] = sorted(set(names[family == f]))
        pairs = [*combinations(range(len(model.langs[f])), 2)]
        if pairs:
            w = []
            for a, b in pairs:
                one = np.isin(names, [model.langs[f][a], model.langs[f][b]])
                w.append(linear_svm(x[one], names[one] == model.langs[f][a]))
            model.pair_w[f] = (pairs, np.stack(w))
    return model


def training_sample(rows: DataFrame, per_lang: int = PER_LANG, max_docs: int = MAX_DOCS) -> tuple[list[str], np.ndarray]:
    """Profiles of a bounded, hash-chosen sample of ``rows`` (doc_id, text, lang)."""
    counts = rows.groupBy("lang").count().orderBy("lang").limit(max_docs // 2).collect()
    if not counts:
        return [], np.zeros((0, BUCKETS), dtype=np.float32)
    each = max(2, min(per_lang, max_docs // len(counts)))
    spark = rows.sparkSession
    share = spark.createDataFrame([(r.lang, min((1 << 63) - 1, int(min(1.0, (2 * each + 20) / r["count"]) * (1 << 63)))) for r in counts], "lang string, upto long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lang, order, text in zip(*(c.to_pylist() for c in b.columns)):
                if has_letter(text):
                    p = profile(text)
                    at = np.flatnonzero(p)
                    out.append((lang, order, at.astype("<u2").tobytes() + p[at].astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["lang", "order", "profile"])

    picked = rows.withColumn("order", hash_order("doc_id")).join(F.broadcast(share), "lang").filter("order <= upto").select("lang", "order", "text")
    found: dict[str, list[tuple[int, bytes]]] = {}
    for r in picked.mapInArrow(frugal(run), "lang string, order long, profile binary").toLocalIterator():
        held = found.setdefault(r.lang, [])
        held.append((r.order, bytes(r.profile)))
        if len(held) >= 4 * each:
            held.sort()
            del held[each:]
    langs, profiles = [], []
    for lang in sorted(found):
        for _, raw in sorted(found[lang])[:each]:
            n = len(raw) // 6
            p = np.zeros(BUCKETS, dtype=np.float32)
            p[np.frombuffer(raw[: 2 * n], dtype="<u2")] = np.frombuffer(raw[2 * n :], dtype="<f4")
            langs.append(lang)
            profiles.append(p)
    return langs, np.stack(profiles) if profiles else np.zeros((0, BUCKETS), dtype=np.float32)


def train(docs: DataFrame, *, per_lang: int = PER_LANG, max_docs: int = MAX_DOCS) -> Model:
    """Learns from the rows of ``docs`` with a language whose crc32(doc_id) mod 3 is not 1."""
    rows = docs.select("doc_id", "text", "lang").filter((crc_mod(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull())
    return fit(*training_sample(rows, per_lang, max_docs))


def with_language(docs: DataFrame, model: Model, *, text: str = "text", keep_text: bool = True, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and a score from 0 to 1."""
    at = docs.columns.index(text)
    keep = [i for i in range(len(docs.columns)) if keep_text or i != at]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            for first in range(0, batch.num_rows, 512):
                texts = batch.column(at).slice(first, 512).to_pylist()
                good = [i for i, t in enumerate(texts) if has_letter(t)]
                here, sure = [UND] * len(texts), np.zeros(len(texts))
                if good:
                    named, s = held.value.predict(scaled(np.stack([profile(texts[i]) for i in good])))
                    for i, lang in zip(good, named):
                        here[i] = lang
                    sure[good] = s
                langs += here
                scores += sure.tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(langs, type=pa.string()), pa.array(scores, type=pa.float64())], names=[*(batch.schema.names[i] for i in keep), pred, score])

    fields = [f"`{docs.schema[i].name}` {docs.schema[i].dataType.simpleString()}" for i in keep]
    return docs.mapInArrow(frugal(run), ", ".join([*fields, f"`{pred}` string", f"`{score}` double"]))


def language_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = train(docs, **options)
    found = with_language(docs.select("doc_id", "text"), model, keep_text=False)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, *, least: float = 0.0, **options) -> DataFrame:
    """``docs`` without those whose language is undetermined or scored below ``least``; ``lang`` becomes the prediction."""
    pred, score = "_pred", "_score"
    while pred in docs.columns or score in docs.columns:
        pred, score = pred + "_", score + "_"
    found = with_language(docs, train(docs, **options), pred=pred, score=score)
    kept = found.filter((F.col(pred) != UND) & (F.col(score) >= least))
    return kept.select(*(F.col(pred).alias("lang") if c == "lang" else F.col(c) for c in docs.columns))
