"""Near-duplicate vectors by a pivot-permutation index.

Reference vectors (pivots) are drawn from the data, from a bounded sample by
hash; their number grows with the root of the number of vectors
(:func:`index_plan`). A vector is described by its permutation, the ordered list
of its nearest pivots. Two vectors are candidates if they share at least
``shared`` of them and if the places of the shared ones differ by no more than
half the permutation's length on average. Permutations are read as sets under
one order of the pivots: vectors that share ``shared`` pivots have their first
two shared ones within the first ``nearest - shared + 2`` of both. So a vector
enters an inverted list for each pair of those, and the list of a pair's first two
shared pivots alone counts it.

The lists hold permutations, not vectors. Each list tells which of its vectors
have a candidate at all; only those meet again with their vectors, and only
candidate pairs get a cosine, in double precision.

Equal vectors of one label are one class, compared once. A list longer than
``list_rows`` is split into blocks and the pairs of blocks go to different
tasks. Pairs never leave a task: it returns the number of links of each class
and a spanning forest.

Only vectors of equal label and equal length are compared. Links that the index
misses are lost recall, measured in the tests; no link below the threshold is
reported.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite
components, or whose label is null, links with nothing; repeated rows link with
each other; null keys are rows like others; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlkit.llm.common import blocked, frugal, group_edges, hash_order, saved, whole_groups
from trawlkit.llm.components import components, smallest_of_group, spanning_forest

COSINE, LIST_ROWS = 0.93, 4_000
_STEP, _PAIRS = 1024, 50_000


@dataclass(frozen=True)
class IndexPlan:
    pivots: int
    nearest: int  #: pivots in a permutation
    shared: int  #: pivots that candidates have in common

    @property
    def prefix(self) -> int:
        return self.nearest - self.shared + 2


def index_plan(vectors: int) -> IndexPlan:
    """256 pivots up to 2^20 vectors, then four times as many for each 16 times the vectors, with longer permutations."""
    steps = min(4, max(0, math.ceil(math.log(max(vectors, 1) / (1 << 20), 16))))
    return IndexPlan(256 << 2 * steps, 10 + 2 * steps, 5)


def usable(vector: str, label: str):
    """Whether a row can link at all."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & F.col(label).isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


class Pivots:
    """Pivots per vector length; lengths that the sample lacks get random directions."""

    def __init__(self, sample: list[list[float]], count: int, seed: int = 0):
        self.count, self.seed = count, seed
        self.by_length: dict[int, np.ndarray] = {}
        for n in {len(v) for v in sample}:
            self.by_length[n] = self._full(n, np.array([v for v in sample if len(v) == n][:count], dtype=np.float64))

    def _full(self, n: int, own: np.ndarray) -> np.ndarray:
        more = np.random.default_rng([self.seed, n]).standard_normal((self.count - len(own), n))
        return unit_rows(np.concatenate((own.reshape(-1, n), more)))

    def nearest(self, unit: np.ndarray, k: int) -> np.ndarray:
        """[row, place]: the numbers of the ``k`` nearest pivots, nearest first."""
        n = unit.shape[1]
        if n not in self.by_length:
            self.by_length[n] = self._full(n, np.zeros((0, n)))
        return np.argsort(-(unit @ self.by_length[n].T), axis=1, kind="stable")[:, :k].astype(np.uint16)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    # scaled by the largest part first, so that no square overflows
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _describe(pivots, plan: IndexPlan):
    """Rows (key, label, lab, vector) with a digest of the vector, its length and its permutation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.array(v.as_py(), dtype=np.float64) for v in batch.column(3)]
            lengths = np.array([len(v) for v in vectors], dtype=np.int64)
            perms = np.zeros((batch.num_rows, plan.nearest), dtype=np.uint16)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                perms[at] = pivots.value.nearest(unit_rows(np.stack([vectors[i] for i in at])), plan.nearest)
            digests = [hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest() for v in vectors]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, type=pa.binary()), pa.array(lengths), pa.array([p.tobytes() for p in perms], type=pa.binary())], names=["key", "label", "lab", "vector", "digest", "length", "perm"])

    return run


def list_pairs(plan: IndexPlan, perm: np.ndarray) -> np.ndarray:
    """[row, list]: the inverted lists of permutations, each named by two pivots."""
    low = np.sort(perm.astype(np.int64), axis=1)[:, : plan.prefix]
    a, b = np.triu_indices(plan.prefix, 1)
    return low[:, a] * plan.pivots + low[:, b]


def _listed(plan: IndexPlan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = list_pairs(plan, _perms(batch.column(1), plan.nearest))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([*lists], type=pa.list_(pa.int64()))], names=["cls", "perm", "lab", "length", "lists"])

    return run


def _perms(column, nearest: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, nearest)


def candidates(x: np.ndarray, y: np.ndarray, plan: IndexPlan, pair: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the permutations ``x`` and ``y`` that are candidates and whose first two shared pivots are ``pair``."""
    values, at = np.unique(np.concatenate((x, y)), return_inverse=True)
    marks = np.zeros((len(x) + len(y), len(values)), dtype=np.float32)
    np.put_along_axis(marks, at.reshape(len(marks), -1), 1, axis=1)
    i, j = np.nonzero(marks[: len(x)] @ marks[len(x) :].T >= plan.shared)
    place = np.arange(plan.nearest)
    apart = np.abs(place[:, None] - place[None, :])
    for lo in range(0, len(i), _PAIRS):
        p, q = i[lo : lo + _PAIRS], j[lo : lo + _PAIRS]
        equal = x[p][:, :, None] == y[q][:, None, :]
        near = 2 * (equal * apart).sum((1, 2)) <= plan.nearest * equal.sum((1, 2))
        first = np.partition(np.where(equal.any(2), x[p].astype(np.int64), plan.pivots), 1, axis=1)[:, :2]
        good = near & (first[:, 0] * plan.pivots + first[:, 1] == pair)
        yield p[good], q[good]


def _blocks(perm: np.ndarray, own: np.ndarray, cross: bool, plan: IndexPlan, pair: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs within a list, each once."""
    for i in range(0, len(perm), _STEP):
        for j in range(i, len(perm), _STEP):
            for x, y in candidates(perm[i : i + _STEP], perm[j : j + _STEP], plan, pair):
                x, y = x + i, y + j
                good = x < y
                if cross:
                    good &= own[x] != own[y]
                if good.any():
                    yield x[good], y[good]


_PLACE = ["lab", "length", "pair", "bx", "by"]


def _groups(batch: pa.RecordBatch, plan: IndexPlan):
    """(slice, pair, own, whether blocks differ, cls, permutations) of each list in ``batch``: the columns of _PLACE, own, cls, perm first."""
    cols = [np.ascontiguousarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(7)]
    perm = _perms(batch.column(7), plan.nearest)
    cuts = [*np.flatnonzero(group_edges(cols[:5])).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:]):
        if hi - lo > 1:
            yield slice(lo, hi), cols[2][lo], cols[5][lo:hi], cols[3][lo] != cols[4][lo], cols[6][lo:hi], perm[lo:hi]


def _marks(plan: IndexPlan):
    """(lab, length, pair, cls) of the vectors that have a candidate in a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, 5):
            keep = np.zeros(batch.num_rows, dtype=bool)
            for where, pair, own, cross, _, perm in _groups(batch, plan):
                for x, y in _blocks(perm, own, cross, plan, pair):
                    keep[where.start + x] = keep[where.start + y] = True
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([kept.column(i) for i in (0, 1, 2, 6)], names=["lab", "length", "pair", "cls"])

    return run


def _verify(cosine: float, plan: IndexPlan):
    """Forest links (a, b, 0) and link counts (cls, null, n) from lists with vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, 5):
            copies = np.ascontiguousarray(batch.column(8).to_numpy(zero_copy_only=False))
            counts = np.zeros(batch.num_rows, dtype=np.int64)
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            for where, pair, own, cross, cls, perm in _groups(batch, plan):
                unit = unit_rows(np.array(batch.column(9)[where.start : where.stop].to_pylist(), dtype=np.float64))
                for x, y in _blocks(perm, own, cross, plan, pair):
                    good = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
                    x, y = x[good], y[good]
                    np.add.at(counts, where.start + x, copies[where][y])
                    np.add.at(counts, where.start + y, copies[where][x])
                    p, q = spanning_forest(cls[x], cls[y])
                    a.append(p)
                    b.append(q)
            if not a:
                continue
            p, q = spanning_forest(np.concatenate(a), np.concatenate(b))
            ids, at = np.unique(np.ascontiguousarray(batch.column(6).to_numpy(zero_copy_only=False)), return_inverse=True)
            n = np.bincount(at, weights=counts).astype(np.int64)
            ids, n = ids[n > 0], n[n > 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((p, ids))), pa.array([*q.tolist(), *[None] * len(ids)], type=pa.int64()), pa.array(np.concatenate((np.zeros(len(p), dtype=np.int64), n)))], names=["a", "b", "n"])

    return run


def vector_groups(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, plan: IndexPlan | None = None, list_rows: int = LIST_ROWS) -> DataFrame:
    """One row per vector: the key, n_links, component_id, kept."""
    spark = rows.sparkSession
    plan = plan or index_plan(rows.count())
    rows = rows.select(F.col(key).alias("key"), F.col(vector).alias("vector"), F.col(label).alias("label"), usable(vector, label).alias("good"))
    usables = rows.filter("good").select("key", "label", F.xxhash64(F.col("label").cast("string")).alias("lab"), "vector")
    drawn = [r.vector for r in usables.orderBy(hash_order("key")).select("vector").limit(2 * plan.pivots).collect()]
    found = spark.sparkContext.broadcast(Pivots([*map(list, dict.fromkeys(map(tuple, drawn)))], plan.pivots))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in usables.schema.fields)
    described = saved(usables.mapInArrow(frugal(_describe(found, plan)), f"{schema}, digest binary, length long, perm binary"), "described")
    # equal vectors of a label are one class; lists are told apart by the label's text
    same = described.groupBy("label", "digest").agg(F.min("key").alias("rep"), F.count("*").alias("copies"), F.first("lab").alias("lab"), F.first("length").alias("length"), F.first("perm").alias("perm"))
    classes = saved(same.withColumn("cls", F.monotonically_increasing_id()), "classes")
    lists = classes.select("cls", "perm", "lab", "length").mapInArrow(_listed(plan), "cls long, perm binary, lab long, length long, lists array<long>")
    listed = lists.select("lab", "length", F.explode("lists").alias("pair"), "cls", "perm")
    dealt = lambda df, *more: blocked(df, _PLACE[:3], "cls", list_rows).select(*_PLACE, "own", "cls", "perm", *more).repartition(*_PLACE).sortWithinPartitions(*_PLACE)
    marks = saved(dealt(listed).mapInArrow(_marks(plan), "lab long, length long, pair long, cls long").distinct(), "marks")
    wanted = classes.join(marks.select("cls").distinct(), "cls").select("cls", "label", "digest", "perm", "copies")
    held = described.select("label", "digest", "vector").join(wanted, ["label", "digest"]).groupBy("cls").agg(*(F.first(c).alias(c) for c in ("perm", "copies", "vector")))
    links = saved(dealt(marks.join(held, "cls"), "copies", "vector").mapInArrow(_verify(cosine, plan), "a long, b long, n long"), "vlinks")
    counts = links.filter("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    roots = components(links.filter("b is not null").select("a", "b")).withColumnRenamed("node", "cls")
    member = classes.join(counts, "cls", "left").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    known = smallest_of_group(member, "rep", "component").select("label", "digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component")
    linked = described.select("key", "label", "digest").join(known, ["label", "digest"]).select("key", "n_links", F.col("component").alias("component_id"))
    alone = rows.filter("not good").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return linked.unionByName(alone).select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))
