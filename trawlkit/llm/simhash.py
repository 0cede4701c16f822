"""SimHash near-duplicates, found by pigeonring filtering.

A fingerprint of 64 bits is cut into ``m`` consecutive segments that form a
ring. If two fingerprints differ in at most ``bits`` places, some segment
starts a chain whose first ``l`` segments together differ in at most
``l * bits / m`` places for every ``l``. With ``m = bits + 1`` the first
segment of such a chain is equal, so rows are dealt out by (start, first
segment); inside a group the chain is grown segment by segment, each step
pruning pairs, and the survivors' full distance is checked.

Equal fingerprints meet once, as one row with the smallest ``doc_id``. A group
of more than ``group_rows`` fingerprints is split into blocks, and pairs of
blocks go to different tasks; no pair is dropped. Linked pairs never leave a
task: it returns a spanning forest.

Defined cases: null text is empty; a text without words has fingerprint zero
and links like any other; repeated rows and ties share a component; an empty
table gives an empty result; a null ``doc_id`` is never a component's smallest
unless all are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlkit.llm.common import blocked, frugal, group_edges, saved, whole_groups
from trawlkit.llm.components import components, smallest_of_group, spanning_forest
from trawlkit.llm.prints import joined_hashes, majority, text_words

SHINGLE, BITS = 3, 3


def fingerprints(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    """The unsigned 64-bit SimHashes over word shingles, repeats counted; 0 for a text without words."""
    return majority(*joined_hashes([text_words(t) for t in texts], shingle))


def with_fingerprint(docs: DataFrame, *, text: str = "text", name: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with column ``text`` replaced by the fingerprint as a signed long."""
    at = docs.columns.index(text)
    keep = [i for i in range(len(docs.columns)) if i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fingerprints([t.as_py() for t in batch.column(at)], shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(found)], names=[*(batch.schema.names[i] for i in keep), name])

    schema = ", ".join(f"`{docs.schema[i].name}` {docs.schema[i].dataType.simpleString()}" for i in keep)
    return docs.mapInArrow(frugal(run), f"{schema + ', ' if schema else ''}`{name}` long")


def bounds(m: int) -> list[int]:
    return [64 * i // m for i in range(m + 1)]


def chain_masks(m: int) -> np.ndarray:
    """[start, l]: the bits of the first ``l + 1`` segments from ``start``, around the ring."""
    cut = bounds(m)
    seg = [((1 << (cut[i + 1] - cut[i])) - 1) << cut[i] for i in range(m)]
    return np.array([[sum(seg[(i + j) % m] for j in range(n + 1)) for n in range(m)] for i in range(m)], dtype=np.uint64)


def ring_pairs(x: np.ndarray, y: np.ndarray, start: np.ndarray, bits: int, m: int, masks: np.ndarray) -> np.ndarray:
    """Indexes of the pairs that keep within every budget of the chain from ``start``, then within ``bits`` altogether."""
    diff = x ^ y
    left = np.arange(len(diff))
    for n in range(1, m - 1):
        if not len(left):
            return left
        left = left[np.bitwise_count(diff[left] & masks[start[left], n]) <= (n + 1) * bits // m]
    return left[np.bitwise_count(diff[left]) <= bits]


def _joiner(bits: int, m: int):
    """Links of rows (start, seg, bx, by, own, node, fp) that are sorted by their group, the first four."""
    masks = chain_masks(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, 4):
            start, seg, bx, by, own, node, fp = (np.ascontiguousarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(7))
            fp, start = fp.view(np.uint64), start.astype(np.int64)
            group = np.cumsum(group_edges([start, seg, bx, by]))
            cross = bx != by
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            held = 0
            for gap in range(1, len(fp)):  # pairs are met by their distance in the order
                at = np.flatnonzero(group[:-gap] == group[gap:])
                if not len(at):
                    break
                at = at[~cross[at] | (own[at] != own[at + gap])]
                near = at[ring_pairs(fp[at], fp[at + gap], start[at], bits, m, masks)]
                if len(near):
                    a.append(node[near])
                    b.append(node[near + gap])
                    held += len(near)
                if held > 1_000_000:
                    x, y = spanning_forest(np.concatenate(a), np.concatenate(b))
                    a, b, held = [x], [y], 0
            if a:
                x, y = spanning_forest(np.concatenate(a), np.concatenate(b))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return run


def near_links(prints: DataFrame, *, bits: int = BITS, segments: int | None = None, group_rows: int = 20_000) -> DataFrame:
    """Forest links (a, b) among the rows of ``prints`` (node, fp) whose fingerprints differ in at most ``bits`` bits."""
    m = segments or bits + 1
    if bits >= m:
        raise ValueError("segments must be more than bits, so that a chain starts with an equal segment")
    cut = bounds(m)
    segs = [F.struct(F.lit(i).alias("start"), F.shiftrightunsigned("fp", cut[i]).bitwiseAND(F.lit((1 << (cut[i + 1] - cut[i])) - 1)).alias("seg")) for i in range(m)]
    keys = prints.select("node", "fp", F.explode(F.array(*segs)).alias("k")).select("k.start", "k.seg", "node", "fp")
    place = ["start", "seg", "bx", "by"]
    dealt = blocked(keys, ["start", "seg"], "node", group_rows).select(*place, "own", "node", "fp").repartition(*place).sortWithinPartitions(*place)
    return dealt.mapInArrow(_joiner(bits, m), "a long, b long")


def fingerprint_components(prints: DataFrame, **options) -> DataFrame:
    """(fp, component_id) for every distinct print of ``prints`` (doc_id, fp)."""
    # the fingerprint itself names the row
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).withColumn("node", F.col("fp")), "prints")
    roots = components(near_links(distinct, **options))
    member = distinct.join(roots, "node", "left").select("fp", "rep", F.coalesce("root", "node").alias("root"))
    return smallest_of_group(member, "rep", "component_id").select("fp", "component_id")


def simhash_groups(docs: DataFrame, *, shingle: int = SHINGLE, **options) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = saved(with_fingerprint(docs.select("doc_id", "text"), shingle=shingle), "docprints")
    named = fingerprint_components(prints, **options)
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
