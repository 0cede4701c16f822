"""Near-duplicate texts by similarity: SimHash candidates by pigeonring filtering, then exact confirmation.

Two texts are linked if their distinct five-word shingles have a Jaccard
similarity of at least ``SIMILARITY``. Candidates come from SimHashes of
``64 * words`` bits over distinct two-word shingles, cut into segments of four
bits that form a ring. A row is dealt to one key for each start of a chain: the
bits of the chain's first ``lead`` segments. Rows that meet under a key grow the
chain segment by segment; the differences of its first ``l`` segments together
may not exceed ``l * limit / segments`` for any ``l``, and the last step is the
full Hamming check. The ring is the same for every table (:data:`PLAN`), so
whether two texts are a candidate depends on them alone; recall is measured in
the tests (0.9 at least of the pairs at 0.8 or more). Rows are dealt with the 64
bits that follow their key. Only rows that have a partner within the budgets of
those are met again with whole sketches, so that chance meetings, which grow
with the square of the texts, cost a comparison of one word and are not shuffled.

Candidates join texts to roots, the components of their links. Only texts with
a candidate are read again, for the hashes of their shingles; pairs of a root
whose sketches are near are compared exactly unless their texts are linked
already. A root of more than one task's worth of sets is first compared with its
own smallest text, dealt out over salted keys; only what that leaves loose meets
the others, in blocks. Thus a group that holds a third of all rows is linear
work. Links never leave a task as pairs: it returns a spanning forest.

Defined cases: null text is empty; texts without words are copies of each
other; texts of equal words (A-Z lower-cased) are copies; a text of fewer than
five words is one shingle; repeated rows stay once; ties keep the smallest
``doc_id``; a null ``doc_id`` is never the smallest of a group unless all are
null; an empty table gives an empty result. The documents are read three times
and must be the same each time; columns of any name may come along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlkit.llm.common import frugal, group_edges, saved, scope, whole_groups
from trawlkit.llm.components import components, smallest_of_group, spanning_forest
from trawlkit.llm.prints import shingle_sets, sketches, text_words

SIMILARITY, SHINGLE, SKETCH_SHINGLE = 0.8, 5, 2
SEGMENT_BITS = 4
#: Bits in which the sketches of a candidate pair may differ, for each 64 bits.
LIMIT = 10
#: Rows of a sample, one in so many, that tell which keys have many.
SAMPLE = 64
#: Rows under one key, sets (rows and bytes) of one root that a task compares.
KEY_ROWS, ROOT_ROWS, ROOT_BYTES = 5_000, 500, 16 << 20
#: Groups of up to so many rows are compared together, larger ones row by row.
_SMALL = 32


@dataclass(frozen=True)
class RingPlan:
    words: int  #: 64-bit words of a sketch
    lead: int  #: segments that a key holds
    stride: int  #: segments from one chain's start to the next

    @property
    def segments(self) -> int:
        return 64 * self.words // SEGMENT_BITS

    @property
    def limit(self) -> int:
        return LIMIT * self.words

    @property
    def starts(self) -> range:
        return range(0, self.segments, self.stride)


#: Of the plans measured, one of high recall with few keys a row. It must not follow the number of texts: each plan finds other candidates.
PLAN = RingPlan(4, 5, 2)


def chain_survivors(diff: np.ndarray, start: np.ndarray, plan: RingPlan) -> np.ndarray:
    """Indexes of the rows of ``diff`` (differing bits of a pair) whose chain from ``start`` keeps within every budget and whose bits do altogether."""
    left = np.arange(len(diff))
    word, shift = np.divmod(start.astype(np.int64) * SEGMENT_BITS, 64)
    held = np.zeros(len(diff), dtype=np.int64)
    per_word = 64 // SEGMENT_BITS
    for k in range(plan.words):
        r = shift[left].astype(np.uint64)
        turned = diff[left, (word[left] + k) % plan.words] >> r
        turned |= np.where(r > 0, diff[left, (word[left] + k + 1) % plan.words] << (np.uint64(64) - np.maximum(r, np.uint64(1))), np.uint64(0))
        for j in range(per_word):
            n = per_word * k + j + 1
            if n <= plan.lead:
                continue
            mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> np.uint64(64 - SEGMENT_BITS * (j + 1))
            good = held + np.bitwise_count(turned & mask) <= n * plan.limit // plan.segments
            if not good.all():
                left, turned, held = left[good], turned[good], held[good]
            if not len(left):
                return left
        held = held + np.bitwise_count(turned)
    return left


def budget_keepers(ahead: np.ndarray, plan: RingPlan) -> np.ndarray:
    """Indexes of the rows of ``ahead`` (differing bits of a pair after the chain's lead) that keep within the budgets of those segments."""
    left = np.arange(len(ahead))
    for n in range(plan.lead + 1, min(plan.lead + 64 // SEGMENT_BITS, plan.segments) + 1):
        mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> np.uint64(64 - SEGMENT_BITS * (n - plan.lead))
        left = left[np.bitwise_count(ahead[left] & mask) <= n * plan.limit // plan.segments]
        if not len(left):
            break
    return left


def _bits_from(names: list[str], at: int) -> Column:
    """The 64 bits of the ring that begin with bit ``at``."""
    word, shift = divmod(at % (64 * len(names)), 64)
    bits = F.shiftrightunsigned(F.col(names[word]), shift)
    return bits.bitwiseOR(F.shiftleft(F.col(names[(word + 1) % len(names)]), 64 - shift)) if shift else bits


def ring_keys(names: list[str], plan: RingPlan) -> list[Column]:
    """(key, ahead) for each start of a chain: its number and the bits of its first segments, then the 64 bits that follow."""
    width = SEGMENT_BITS * plan.lead
    out = []
    for i, start in enumerate(plan.starts):
        at = start * SEGMENT_BITS
        key = _bits_from(names, at).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(i << width))
        out.append(F.struct(key.alias("key"), _bits_from(names, at + width).alias("ahead")))
    return out


def with_sketch(docs: DataFrame, words: int) -> DataFrame:
    """``docs`` with column ``text`` replaced by ``f0``, ``f1``, ... (the sketch's words) and ``digest``, which names the sequence of words."""
    at = docs.columns.index("text")
    keep = [i for i in range(len(docs.columns)) if i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_words(t.as_py()) for t in batch.column(at)]
            digests = pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in texts], type=pa.binary())
            bits = sketches(*shingle_sets(texts, SKETCH_SHINGLE), words).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *(pa.array(bits[:, j]) for j in range(words)), digests], names=[*(batch.schema.names[i] for i in keep), *(f"f{j}" for j in range(words)), "digest"])

    fields = [f"`{docs.schema[i].name}` {docs.schema[i].dataType.simpleString()}" for i in keep]
    return docs.mapInArrow(frugal(run), ", ".join([*fields, *(f"f{j} long" for j in range(words)), "digest binary"]))


def with_set(texts: DataFrame) -> DataFrame:
    """``texts`` with column ``text`` replaced by ``set``, the hashes of its distinct five-word shingles."""
    at = texts.columns.index("text")
    keep = [i for i in range(len(texts.columns)) if i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, counts = shingle_sets([text_words(t.as_py()) for t in batch.column(at)], SHINGLE)
            sets = pa.array([s.tobytes() for s in np.split(hashes, np.cumsum(counts)[:-1])][: batch.num_rows], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), sets], names=[*(batch.schema.names[i] for i in keep), "set"])

    return texts.mapInArrow(frugal(run), ", ".join(f"`{texts.schema[i].name}` {texts.schema[i].dataType.simpleString()}" for i in keep) + ", set binary")


def alike(x: bytes, y: bytes, similarity: float) -> bool:
    """Whether two sets of hashes are at least so alike (Jaccard); two empty ones are."""
    few, many = sorted((len(x) // 8, len(y) // 8))
    if not many or few < similarity * many:
        return not many
    both = np.concatenate((np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common >= similarity * (few + many - common)


def _forest(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch | None:
    if not a:
        return None
    x, y = spanning_forest(np.concatenate(a), np.concatenate(b))
    return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def _numbers(batch: pa.RecordBatch, upto: int) -> list[np.ndarray]:
    return [np.ascontiguousarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(upto)]


def _under_keys(plan: RingPlan):
    """Forests of the near pairs under each key; rows are (key, bx, by, own, node, sketch) sorted by the first three."""
    width = SEGMENT_BITS * plan.lead

    def pairs_of_small(group, start, own, cross, node, f, a, b):
        for gap in range(1, min(_SMALL, len(group))):
            at = np.flatnonzero(group[:-gap] == group[gap:])
            if not len(at):
                break
            at = at[~cross[at] | (own[at] != own[at + gap])]
            near = at[chain_survivors(f[at] ^ f[at + gap], start[at], plan)]
            if len(near):
                a.append(node[near])
                b.append(node[near + gap])

    def pairs_of_large(start, own, cross, node, f, a, b):
        label = np.arange(len(node))
        for i in range(len(node) - 1):
            others = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
            if cross:
                others = others[own[others] != own[i]]
            near = others[chain_survivors(f[others] ^ f[i], np.full(len(others), start), plan)]
            if len(near):
                a.append(np.full(len(near), node[i]))
                b.append(node[near])
                label[np.isin(label, label[near])] = label[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, 3):
            key, bx, by, own, node, *f = _numbers(batch, 5 + plan.words)
            f = np.stack(f, axis=1).view(np.uint64)
            start = (key >> width) * plan.stride
            cross = bx != by
            edges = group_edges([key, bx, by])
            group = np.cumsum(edges)
            first = np.append(np.flatnonzero(edges), len(key))
            size = np.diff(first)
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            small = np.repeat(size <= _SMALL, size)
            pairs_of_small(group[small], start[small], own[small], cross[small], node[small], f[small], a, b)
            for g in np.flatnonzero(size > _SMALL).tolist():
                s = slice(first[g], first[g + 1])
                pairs_of_large(start[s.start], own[s], cross[s.start], node[s], f[s], a, b)
            if (found := _forest(a, b)) is not None:
                yield found

    return run


def _partnered(plan: RingPlan):
    """The rows (key, node) that have a partner under their key within the budgets ahead; rows are (key, node, ahead) sorted by the first."""

    def of_small(group, ahead, met):
        for gap in range(1, min(_SMALL, len(group))):
            at = np.flatnonzero(group[:-gap] == group[gap:])
            if not len(at):
                break
            near = at[budget_keepers(ahead[at] ^ ahead[at + gap], plan)]
            met[near] = met[near + gap] = True

    def of_large(ahead, met):
        for i in range(len(met)):
            if not met[i]:
                near = budget_keepers(ahead ^ ahead[i], plan)
                if len(near) > 1:
                    met[near] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, 1):
            key, node, ahead = _numbers(batch, 3)
            ahead = ahead.view(np.uint64)
            edges = group_edges([key])
            group = np.cumsum(edges)
            first = np.append(np.flatnonzero(edges), len(key))
            size = np.diff(first)
            met = np.zeros(len(key), dtype=bool)
            small = np.flatnonzero(np.repeat((size > 1) & (size <= _SMALL), size))
            found = np.zeros(len(small), dtype=bool)
            of_small(group[small], ahead[small], found)
            met[small] = found
            for g in np.flatnonzero(size > _SMALL).tolist():
                s = slice(first[g], first[g + 1])
                of_large(ahead[s], met[s])
            if met.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[met]), pa.array(node[met])], names=["key", "node"])

    return run


def near_rings(prints: DataFrame, plan: RingPlan, key_rows: int = KEY_ROWS) -> DataFrame:
    """Forest links (a, b) among the rows of ``prints`` (node, f0, f1, ...) that share a chain and are near."""
    names = [f"f{j}" for j in range(plan.words)]
    dealt_to = lambda rows: rows.select("node", F.inline(F.array(*ring_keys(names, plan))))
    keys = dealt_to(prints)
    # keys of many rows are not gone through in one task: all their rows are met below, in blocks
    sample = dealt_to(prints.filter(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0))
    heavy = saved(sample.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") * SAMPLE > key_rows).select("key"), "heavykeys")
    crowded = not heavy.isEmpty()
    light = keys.join(heavy, "key", "left_anti") if crowded else keys
    met = light.select("key", "node", "ahead").repartition("key").sortWithinPartitions("key").mapInArrow(_partnered(plan), "key long, node long")
    if crowded:
        met = met.unionByName(keys.join(heavy, "key", "left_semi").select("key", "node"))
    keys = saved(met, "metkeys")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("parts", F.ceil(F.col("n") / key_rows).cast("int"))
    met = keys.join(shared, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = met.select("key", "node", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    met = met.select("key", F.least("own", "other").alias("bx"), F.greatest("own", "other").alias("by"), "own", "node")
    place = ["key", "bx", "by"]
    dealt = met.join(prints.select("node", *names), "node").select(*place, "own", "node", *names).repartition(*place).sortWithinPartitions(*place)
    return dealt.mapInArrow(_under_keys(plan), "a long, b long")


def _within_roots(plan: RingPlan, similarity: float):
    """Forests of the pairs that are alike; rows are (root, bi, bj, role, node, label, sketch, set) sorted by the first three."""

    def group(role, node, label, f, sets, a, b):
        label = label.copy()
        for i in range(len(node)):
            if role[i] == 0:
                continue
            # role 2: every later row; role 1: the rows of role 0
            other = np.flatnonzero(label != label[i])
            other = other[other > i] if role[i] == 2 else other[role[other] == 0]
            for j in other[np.bitwise_count(f[other] ^ f[i]).sum(1) <= plan.limit].tolist():
                if label[j] != label[i] and alike(sets[i].as_py(), sets[j].as_py(), similarity):
                    a.append(node[i : i + 1])
                    b.append(node[j : j + 1])
                    label[label == label[j]] = label[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, 3):
            cols = _numbers(batch, 6 + plan.words)
            f = np.stack(cols[6:], axis=1).view(np.uint64)
            sets = batch.column(6 + plan.words)
            first = [*np.flatnonzero(group_edges(cols[:3])).tolist(), batch.num_rows]
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            for lo, hi in zip(first, first[1:]):
                if hi - lo > 1:
                    group(*(c[lo:hi] for c in cols[3:6]), f[lo:hi], sets[lo:hi], a, b)
            if (found := _forest(a, b)) is not None:
                yield found

    return run


def _loose(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            far = pa.array([not alike(x.as_py(), y.as_py(), similarity) for x, y in zip(batch.column(n - 2), batch.column(n - 1))], type=pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 1], far], names=[*batch.schema.names[: n - 1], "loose"])

    return run


def alike_links(sets: DataFrame, plan: RingPlan, similarity: float, root_rows: int = ROOT_ROWS, root_bytes: int = ROOT_BYTES, salts: int = 32) -> DataFrame:
    """Links (a, b) that join the rows of ``sets`` (root, node, sketch, set) which are alike, within each root."""
    spark = sets.sparkSession
    names = [f"f{j}" for j in range(plan.words)]
    parts = F.greatest(F.ceil(F.count("*") / root_rows), F.ceil(F.sum(F.length("set")) / root_bytes)).cast("int").alias("parts")
    large = saved(sets.groupBy("root").agg(parts).filter("parts > 1"), "largeroots")
    columns = ["root", "bi", "bj", "role", "node", "label", *names, "set"]
    zero = F.lit(0)
    links = spark.createDataFrame([], "a long, b long")
    if large.isEmpty():
        rows = sets.select("root", zero.alias("bi"), zero.alias("bj"), F.lit(2).alias("role"), "node", F.col("node").alias("label"), *names, "set")
    else:
        rows = sets.join(large, "root", "left_anti").select("root", zero.alias("bi"), zero.alias("bj"), F.lit(2).alias("role"), "node", F.col("node").alias("label"), *names, "set")
        big = sets.join(large, "root")
        leader = big.filter("node = root").select("root", F.col("set").alias("lead"), F.explode(F.sequence(zero, F.lit(salts - 1))).alias("salt"))
        met = big.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")).join(leader, ["root", "salt"]).select("root", "parts", "node", *names, "set", "lead")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in met.schema.fields[:-1])
        told = saved(met.mapInArrow(frugal(_loose(similarity)), f"{schema}, loose boolean"), "told")
        links = told.filter("not loose and node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        open_roots = told.filter("loose").groupBy("root").agg(parts.alias("lparts"))
        label = F.when(F.col("loose"), F.col("node")).otherwise(F.col("root")).alias("label")
        left = told.join(open_roots, "root").withColumn("label", label)
        block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(zero, F.col(n) - 1))
        asks = left.filter("loose").select("root", block("lparts").alias("bi"), each("parts").alias("bj"), F.lit(1).alias("role"), "node", "label", *names, "set")
        told_to = left.select("root", each("lparts").alias("bi"), block("parts").alias("bj"), zero.alias("role"), "node", "label", *names, "set")
        rows = rows.unionByName(asks).unionByName(told_to)
    place = ["root", "bi", "bj"]
    dealt = rows.select(*columns).repartition(*place).sortWithinPartitions(*place)
    return links.unionByName(dealt.mapInArrow(_within_roots(plan, similarity), "a long, b long"))


def similar_components(prints: DataFrame, texts: DataFrame, plan: RingPlan, similarity: float, *, key_rows: int = KEY_ROWS, root_rows: int = ROOT_ROWS) -> DataFrame:
    """(digest, node, root, component_id) for every distinct sequence of words of ``prints`` (doc_id, h, sketch, digest).

    ``texts`` (doc_id, h, text) has the texts; component_id is the smallest
    ``doc_id`` of the component that root names.
    """
    names = [f"f{j}" for j in range(plan.words)]
    same = prints.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "h", *names)).alias("m"))
    distinct = saved(same.select("digest", "rep", "m.*").withColumn("node", F.monotonically_increasing_id()), "distinct")
    maybe = saved(components(near_rings(distinct, plan, key_rows)), "maybe")
    maybe = maybe.unionByName(maybe.select(F.col("root").alias("node"), "root").distinct())
    member = maybe.join(distinct, "node").select("node", "root", *names, F.col("doc_id").alias("_doc"), F.col("h").alias("_h"))
    read = texts.join(member, (texts["h"] == member["_h"]) & texts["doc_id"].eqNullSafe(member["_doc"])).select("root", "node", *names, "text")
    sets = saved(with_set(read), "sets")
    roots = components(alike_links(sets, plan, similarity, root_rows))
    held = distinct.join(roots, "node", "left").select("digest", "rep", "node", F.coalesce("root", "node").alias("root"))
    return smallest_of_group(held, "rep", "component_id").select("digest", "node", "root", "component_id")


def keep_one(docs: DataFrame, *, similarity: float = SIMILARITY, plan: RingPlan = PLAN, **options) -> DataFrame:
    """``docs`` with one document of each component of similar texts: the smallest ``doc_id``, one row of it where rows repeat."""
    named_h = "_h"
    while named_h in docs.columns:
        named_h += "_"
    # a row's own key: repeated rows have the same, others do not
    hashed = [f"`{f.name}`" for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)]
    own = docs.withColumn(named_h, F.xxhash64(*hashed))
    texts = own.select("doc_id", F.col(named_h).alias("h"), "text")
    with scope(docs.sparkSession) as drop:
        prints = saved(with_sketch(texts, plan.words), "prints")
        named = similar_components(prints, texts, plan, similarity, **options)
        first = prints.join(named, "digest").filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("component_id").alias("_doc"), F.min("h").alias("_own"))
        first = saved(first.select("_doc", "_own"), "kept")
        repeats = not prints.groupBy("doc_id", "h").count().filter("count > 1").isEmpty()
        drop(first)
    kept = own.join(first, (own[named_h] == first["_own"]) & own["doc_id"].eqNullSafe(first["_doc"]), "left_semi")
    if repeats:
        kept = kept.dropDuplicates(["doc_id", named_h])
    return kept.select(*docs.columns)
