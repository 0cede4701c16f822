"""Personal data by weak supervision.

Base spans follow fixed patterns and always stay. Looser candidates (a phone
number without its plus sign, a card number that fails its check digit or is
short of digits, an obfuscated address) are judged by labelers that vote or
abstain: patterns, gazetteers of mail hosts, domain endings, issuers and calling
codes, and the context's own cues for and against. Expectation-maximisation
over the vote patterns of all candidates, base spans included, estimates each
labeler's reliability, and its posteriors train the final span classifier, a
logistic regression on the span's shape and context. A candidate the classifier
accepts and that overlaps no base span or earlier accepted one is added.

Votes and features are small and discrete, so the corpus is summed up exactly
in counts per pattern of votes (four kinds of 3^5) and per key of features (four
kinds of 21 by 64); texts are read once and never shuffled.

Defined cases: null text is empty; an empty text has no spans, and the hash of
the empty string; no candidates at all leave the base spans; repeated rows get
equal spans.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlkit.llm.common import drop_saved, frugal, saved

KINDS = ("email", "ip", "card", "phone")

# base spans

_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match always begins a run of digits: what is before it is no digit
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, in time linear in the text."""
    begin = 0
    at = text.find("@")
    while at >= 0:
        run = text[begin:at]
        start = begin + len(run.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            begin = m.end()
        else:
            begin = at + 1
        at = text.find("@", begin)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# candidates, labelers, features

# possessive runs: no candidate pattern can try a run twice
_LOOSE = (
    ("email", re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]++\s?(?:\(at\)|\[at\]|\{at\})\s?[A-Za-z0-9-]++(?:\s?(?:\(dot\)|\[dot\]|\.)\s?[A-Za-z0-9-]++)++", re.I)),
    ("card", re.compile(r"(?<![\w.+-])[0-9]{4}(?:[\x20-]?[0-9]{3,6}){2,3}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![\w-])")),
)
_CUES = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|reach|address|correo|courriel|kontakt)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|addr|login|client|from)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|pay|payment|carte|karte|tarjeta)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|cell|fax|whatsapp|dial|telefon|t[ée]l[ée]phone|tel[ée]fono)\b", re.I),
}
_AGAINST = re.compile(r"\b(?:isbn|issn|order|invoice|serial|sku|version|page|token|hash|sha|md5|id|ref)\b", re.I)
# gazetteers: free-mail hosts, endings of domains, issuers' number ranges (ISO/IEC 7812), calling codes (ITU E.164)
_MAIL_HOSTS = frozenset("gmail googlemail yahoo ymail hotmail outlook live msn proton protonmail icloud me mac gmx aol mail web t-online freenet orange laposte wanadoo free libero tiscali virgilio yandex rambler qq 163 126 naver daum zoho fastmail tutanota hey example".split())
_ENDINGS = frozenset("com org net edu gov mil int info biz name io co ai app dev eu uk de fr es it nl be ch at pl se no dk fi pt gr cz hu ro ru ua tr il in cn jp kr tw hk sg au nz ca us mx br ar cl pe za ng ke eg ie".split())
_CALLING = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 211 212 213 216 218 220 221 222 223 224 225 226 227 228 229 230 231 232 233 234 235 236 237 238 239 240 241 242 243 244 245 248 249 250 251 252 253 254 255 256 257 258 260 261 262 263 264 265 266 267 268 269 "
    "290 291 297 298 299 350 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 378 380 381 382 383 385 386 387 389 420 421 423 500 501 502 503 504 505 506 507 508 509 590 591 592 593 594 595 596 597 598 599 670 672 673 674 675 676 677 678 679 680 681 682 683 685 686 687 688 689 690 691 692 850 852 853 855 856 880 886 960 961 962 963 964 965 966 967 968 970 971 972 973 974 975 976 977 992 993 994 995 996 998".split()
)
_ISSUER = re.compile(r"(?:4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|35(?:2[89]|[3-8])|30[0-5]|3[68]|6011|64[4-9]|65|62|50|5[6-9]|6[37])")


def _listed_number(span: str, digits: str) -> bool:
    """Whether a number begins as some country's do, or as an area code of the plan that has none."""
    if span.startswith("+"):
        return any(digits[:n] in _CALLING for n in (1, 2, 3))
    return len(digits) == 10 and digits[0] in "23456789" and digits[3] in "23456789"


def _special_address(span: str) -> bool:
    """Loopback, private, reserved and other addresses that name no one."""
    try:
        return not ipaddress.ip_address(".".join(p.lstrip("0") or "0" for p in span.split("."))).is_global
    except ValueError:
        return True


def _listed_mail(span: str) -> bool:
    words = [w for w in re.split(r"[^a-z0-9-]+", re.split(r"@|\bat\b", span.lower())[-1]) if w and w != "dot"]
    return bool(words) and (words[-1] in _ENDINGS or bool(_MAIL_HOSTS.intersection(words)))


_CONTEXT = 40
#: labelers in order; a vote is 1 (personal), 0 (not), 2 (abstains)
LABELERS = ("pattern", "gazetteer", "cue", "against", "shape")


def votes(kind: str, span: str, before: str, after: str) -> tuple[int, ...]:
    digits = _NOT_DIGIT.sub("", span)
    if kind == "email":
        pattern = 1 if _DOMAIN.search(span) and "@" in span else 2
        gazetteer = 1 if _listed_mail(span) else 2
        shape = 1 if "." in span or "dot" in span.lower() else 0
    elif kind == "ip":
        pattern, gazetteer = 1, 0 if _special_address(span) else 2
        shape = 0 if digits == span.replace(".", "")[:4] else 1
    elif kind == "card":
        pattern = 1 if 16 <= len(digits) <= 19 and luhn(digits) else 0
        gazetteer = 1 if _ISSUER.match(digits) else 2
        shape = 1 if re.fullmatch(r"[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}", span) else 2
    else:
        pattern = 1 if span.startswith("+") else 2
        gazetteer = 1 if _listed_number(span, digits) else 2
        shape = 1 if 10 <= len(digits) <= 13 else 0
    near = before + " " + after
    return pattern, gazetteer, 1 if _CUES[kind].search(near) else 2, 0 if _AGAINST.search(before) else 2, shape


def features(kind: str, span: str, before: str, after: str) -> str:
    """The span classifier's discrete features, as one short key."""
    digits = len(_NOT_DIGIT.sub("", span))
    check = kind == "card" and luhn(_NOT_DIGIT.sub("", span))
    flags = (bool(_CUES[kind].search(before + " " + after)), bool(_AGAINST.search(before)), check, span[:1] == "+", "@" in span, any(c in span for c in " -()"))
    return f"{KINDS.index(kind)}|{min(digits, 20)}|{''.join('1' if f else '0' for f in flags)}"


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, bool]]:
    """Base spans and the loose ones that overlap none of any kind, in order of place."""
    found = [(k, a, b, True) for k, a, b in base]
    if "(" in text or "[" in text or "{" in text or _DIGIT.search(text):
        taken: list[tuple[int, int]] = []  # disjoint and in order
        for a, b in sorted((a, b) for _, a, b in base):
            if taken and a < taken[-1][1]:
                taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
            else:
                taken.append((a, b))
        for kind, pattern in _LOOSE:
            if kind == "email" and "at" not in text.lower():
                continue
            for m in pattern.finditer(text):
                at = bisect.bisect_left(taken, (m.end(),))
                if not at or taken[at - 1][1] <= m.start():
                    found.append((kind, *m.span(), False))
                    taken.insert(at, m.span())
    return found


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


# reliabilities and classifier


def reliabilities(patterns: list[tuple[str, tuple[int, ...], float]], rounds: int = 50) -> dict[tuple[str, tuple[int, ...]], float]:
    """Posterior that a span is personal, per (kind, votes), by EM over counts (kind, votes, count)."""
    out = {}
    for kind in {k for k, _, _ in patterns}:
        rows = [(v, n) for k, v, n in patterns if k == kind]
        v = np.array([r[0] for r in rows])
        n = np.array([r[1] for r in rows], dtype=float)
        # begin with the majority; even odds and the prior of nine right votes in ten keep one class from taking all
        post = ((v == 1).sum(1) + 1) / ((v != 2).sum(1) + 2)
        for _ in range(rounds):
            log = np.zeros((len(v), 2))
            for j in range(v.shape[1]):
                said = v[:, j]
                right1 = ((n * post)[said == 1].sum() + 9) / ((n * post)[said != 2].sum() + 10)
                right0 = ((n * (1 - post))[said == 0].sum() + 9) / ((n * (1 - post))[said != 2].sum() + 10)
                log[:, 1] += np.select([said == 1, said == 0], [np.log(right1), np.log(1 - right1 + 1e-9)], 0.0)
                log[:, 0] += np.select([said == 1, said == 0], [np.log(1 - right0 + 1e-9), np.log(right0)], 0.0)
            post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        out |= {(kind, tuple(x)): float(p) for x, p in zip(v.tolist(), post)}
    return out


def _encode(key: str) -> np.ndarray:
    kind, digits, flags = key.split("|")
    x = np.zeros(len(KINDS) * 30 + 1)
    at = int(kind) * 30
    x[at + int(digits)] = 1
    for i, f in enumerate(flags):
        x[at + 21 + i] = f == "1"
    x[at + 28] = 1
    return x


def span_classifier(counts: list[tuple[str, float, float]], steps: int = 60, ridge: float = 1.0) -> dict[str, float]:
    """Probability per feature key, from (key, count, mean posterior), by Newton steps of a logistic regression."""
    if not counts:
        return {}
    x = np.stack([_encode(k) for k, _, _ in counts])
    # the logarithm keeps one very frequent shape from fixing all weights
    n = np.log1p(np.array([c for _, c, _ in counts]))
    p = np.array([q for _, _, q in counts])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - q)) - ridge * w
        hess = (x * (n * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return {k: float(1 / (1 + np.exp(-np.clip(_encode(k) @ w, -30, 30)))) for k, _, _ in counts}


# Spark

_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("key", pa.string())]))
_FOUND_SQL = "array<struct<kind:string,start:int,end:int,base:boolean,votes:string,key:string>>"


def with_candidates(docs: DataFrame, *, text: str = "text", keep_text: bool = False, name: str = "spans") -> DataFrame:
    at = docs.columns.index(text)
    keep = [i for i in range(len(docs.columns)) if keep_text or i != at]

    def one(t: str | None):
        if not t:
            return []
        out = []
        for kind, a, b, base in candidates(t, base_spans(t)):
            around = t[a:b], t[max(0, a - _CONTEXT) : a], t[b : b + _CONTEXT]
            out.append({"kind": kind, "start": a, "end": b, "base": base, "votes": "".join(map(str, votes(kind, *around))), "key": features(kind, *around)})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array([one(t.as_py()) for t in batch.column(at)], type=_FOUND)], names=[*(batch.schema.names[i] for i in keep), name])

    fields = [f"`{docs.schema[i].name}` {docs.schema[i].dataType.simpleString()}" for i in keep]
    return docs.mapInArrow(frugal(run), ", ".join([*fields, f"`{name}` {_FOUND_SQL}"]))


def learn(found: DataFrame, *, name: str = "spans") -> dict[str, float]:
    """Acceptance per feature key, from the candidates of all documents.

    Two sums reach the driver, whose rows are bounded by what labelers and
    features can say: a row for each vote pattern, then one for each key.
    """
    each = found.select(F.explode(name).alias("s")).select("s.kind", "s.votes", "s.key").groupBy("kind", "votes", "key").agg(F.count("*").alias("n"))
    each = saved(each, "votes")
    patterns = each.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()
    post = reliabilities([(r.kind, tuple(map(int, r.votes)), r.n) for r in sorted(patterns, key=lambda r: (r.kind, r.votes))])
    known = found.sparkSession.createDataFrame([(k, "".join(map(str, v)), p) for (k, v), p in post.items()], "kind string, votes string, post double")
    keys = each.join(F.broadcast(known), ["kind", "votes"]).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("post")).alias("s")).collect()
    drop_saved(each)
    return span_classifier([(r.key, float(r.n), r.s / r.n) for r in sorted(keys, key=lambda r: r.key)])


def accepted(found: DataFrame, accept: dict[str, float], *, name: str = "spans", least: float = 0.5) -> DataFrame:
    """``found`` with its spans narrowed to base ones and candidates the classifier accepts."""
    good = [k for k, p in sorted(accept.items()) if p >= least]
    return found.withColumn(name, F.filter(name, lambda s: s["base"] | s["key"].isin(good)))


def _in_order(spans):
    place = F.array(*map(F.lit, KINDS))
    return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(F.array_position(place, s["kind"]).alias("p"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))


def pii_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = saved(with_candidates(docs.select("doc_id", "text")), "spans")
    kept = accepted(found, learn(found), **options)
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return kept.select("doc_id", *counts, F.sha2(F.array_join(_in_order(base), ","), 256).alias("base_sha256"), F.array_join(_in_order(F.col("spans")), ",").alias("spans"))


def redacted(docs: DataFrame, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by its kind in angle brackets; overlapping spans go as one. A column ``n_chars`` follows."""
    name = "_spans"
    while name in docs.columns:
        name += "_"
    marked = saved(with_candidates(docs, text=text, keep_text=True, name=name), "spans")
    kept = accepted(marked, learn(marked, name=name), name=name, least=least)
    at = docs.columns.index(text)
    size_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def one(t: str | None, spans: list[dict]) -> str | None:
        if not spans:
            return t
        out, upto = [], 0
        for s in sorted(spans, key=lambda s: (s["start"], -s["end"], KINDS.index(s["kind"]))):
            if s["start"] >= upto:
                out += [t[upto : s["start"]], f"<{s['kind'].upper()}>"]
            upto = max(upto, s["end"])
        return "".join([*out, t[upto:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([one(t.as_py(), s.as_py()) if len(s) else t.as_py() for t, s in zip(b.column(at), b.column(b.num_columns - 1))], type=pa.string())
            cols = {at: new}
            if size_at >= 0:
                old = b.column(size_at)
                cols[size_at] = pc.if_else(pc.equal(b.column(at), new), old, pc.utf8_length(new).cast(old.type))
            yield pa.RecordBatch.from_arrays([cols.get(i, b.column(i)) for i in range(b.num_columns - 1)], names=b.schema.names[:-1])

    return kept.mapInArrow(frugal(run), docs.schema)
