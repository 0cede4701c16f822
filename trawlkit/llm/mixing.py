"""Mixing sources to target weights, over fixed-length blocks of words.

Each source's documents are packed, in an order that depends on ids alone,
into one stream of words cut into blocks of ``block_words``. A source's quota
of block slots is dealt to the output shards by multinomial counts, drawn as a
tree of seeded binomials: any shard finds its own counts, and where its slots
begin, in as many steps as the tree is deep, and the counts add up to the quota.
Slot ``k`` of a source is block ``permutation(k mod blocks)`` of pass
``k // blocks``, by a seeded Feistel permutation per source and pass, so no
block is drawn twice before all are drawn once. Slots and blocks meet in an
equi-join on (source, block). The last slot of a source takes only the words
that its target still lacks.

A source's target never exceeds ``most`` times its size, hence no document is
taken more than ``most`` times.

Sources are a short list by nature; their totals (one row each) are gathered on
the driver, at most ``max_sources`` of them.

Defined cases: null and blank texts have size 0 and nothing taken; a null
source is a source of its own, the last; repeated rows are separate documents;
an empty table gives an empty result; documents with equal ids lie side by side.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawlkit.llm.common import saved

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS, SHARD_SLOTS, WEIGHTS, MOST = 256, 16_384, (5, 2, 1), 3
_ROUNDS = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of all words by weight, none above ``most`` times its own size; the excess goes to the others."""
    out = [0.0] * len(sizes)
    left, free = float(sum(sizes)), set(range(len(sizes)))
    while free:
        total = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
            free.discard(i)
        left -= sum(out[i] for i in over)
    return out


def _keys(seed: int, source: int, lap: np.ndarray) -> list[np.ndarray]:
    base = np.uint64(int.from_bytes(hashlib.sha256(f"{seed}:{source}".encode()).digest()[:8], "little"))
    return [_mixed(base + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15) + lap.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)) for r in range(_ROUNDS)]


def _mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def permute(index: np.ndarray, n: int, seed: int, source: int, lap: np.ndarray, inverse: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 (Feistel rounds, walked until the value is in range)."""
    if n <= 1:
        return np.zeros(len(index), dtype=np.int64)
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    with np.errstate(over="ignore"):
        keys = _keys(seed, source, np.asarray(lap))

        def once(x, keys):
            left, right = x >> half, x & mask
            for k in reversed(keys) if inverse else keys:
                if inverse:
                    left, right = right ^ (_mixed(left ^ k) & mask), left
                else:
                    left, right = right, left ^ (_mixed(right ^ k) & mask)
            return (left << half) | right

        out = once(np.asarray(index).astype(np.uint64), keys)
        while (far := out >= np.uint64(n)).any():
            out[far] = once(out[far], [k[far] for k in keys])
    return out.astype(np.int64)


@dataclass
class Source:
    name: str | None
    index: int
    docs: int
    size: int
    target: float
    blocks: int = 0
    slots: int = 0  #: slots over all passes
    last: int = 0  #: words that the last slot takes

    def plan(self, block: int, seed: int, most: float = MOST) -> Source:
        self.blocks = -(-self.size // block)
        quota = min(round(self.target), math.floor(most * self.size))
        if not quota:
            return self
        laps, rest = divmod(quota, self.size)
        short = self.size - (self.blocks - 1) * block
        self.slots, self.last = laps * self.blocks, block
        if rest:
            at = int(permute(np.array([self.blocks - 1]), self.blocks, seed, self.index, np.array([laps]), inverse=True)[0])
            held = lambda q: q * block - (block - short if at < q else 0)
            q = next(q for q in (-(-rest // block), -(-rest // block) + 1) if held(q) >= rest)
            self.slots += q
            self.last = rest - held(q - 1)
        return self


def sources(sized: DataFrame, *, weights=WEIGHTS, most: float = MOST, block: int = BLOCK_WORDS, seed: int = 0, max_sources: int = 100_000) -> list[Source]:
    rows = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    goal = targets([r["size"] for r in rows], [float(weights[i % len(weights)]) for i in range(len(rows))], most)
    return [Source(r.source, i, r.n, r["size"], goal[i]).plan(block, seed, most) for i, r in enumerate(rows)]


def placed(sized: DataFrame, found: list[Source], bucket_docs: int = 256, range_buckets: int = 4096) -> DataFrame:
    """Each document's place in its source's stream: src, bucket, rn (a row's key) and its first word ``at``."""
    spark = sized.sparkSession
    info = spark.createDataFrame([(s.name, s.index, s.size, s.target, max(1, -(-s.docs // bucket_docs))) for s in found], "source string, src int, source_size long, target double, buckets long")
    known = sized.join(F.broadcast(info), sized["source"].eqNullSafe(info["source"])).select(*(sized[c] for c in sized.columns), "src", "source_size", "target", F.pmod(F.xxhash64("doc_id", "size"), F.col("buckets")).alias("bucket"))
    order = Window.partitionBy("src", "bucket").orderBy("doc_id", "size")
    inside = known.withColumns({"before": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"), "rn": F.row_number().over(order)})
    # words ahead of a bucket: in its range of buckets, and in the ranges before; no window holds all buckets of a source
    held = known.groupBy("src", "bucket").agg(F.sum("size").alias("words")).withColumn("range", F.expr(f"bucket div {range_buckets}"))
    upto = lambda *keys: F.sum("words").over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    ranges = held.groupBy("src", "range").agg(F.sum("words").alias("words")).select("src", "range", upto("src", "range").alias("ahead_of_range"))
    ahead = held.withColumn("inside", upto("src", "range", "bucket")).join(ranges, ["src", "range"]).select("src", "bucket", (F.col("inside") + F.col("ahead_of_range")).alias("ahead"))
    return inside.join(ahead.hint("merge"), ["src", "bucket"]).withColumn("at", F.col("before") + F.col("ahead")).drop("before", "ahead")


def pieces(stream: DataFrame, block: int) -> DataFrame:
    """A row for each block that a document reaches into: block, and the words ``lo`` to ``hi`` of the block that are its own."""
    b = F.lit(block).cast("long")
    last = F.col("at") + F.col("size") - 1
    cut = stream.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.expr(f"at div {block}"), F.floor(last / b).cast("long")))))
    first = F.col("block") * b
    return cut.withColumns({"lo": F.greatest(F.col("at") - first, F.lit(0)), "hi": F.least(F.col("at") + F.col("size") - first, b)})


def _shares(source: Source, shard: int, shards: int, seed: int) -> tuple[int, int]:
    """(first slot, slots) of one shard, by halving the range of shards down to it."""
    lo, hi, first, count = 0, shards, 0, source.slots
    while hi - lo > 1 and count:
        mid = (lo + hi) // 2
        key = int.from_bytes(hashlib.sha256(f"{seed}:{source.index}:{lo}:{hi}".encode()).digest()[:16], "little")
        left = int(np.random.Generator(np.random.Philox(key=key)).binomial(count, (mid - lo) / (hi - lo)))
        if shard < mid:
            hi, count = mid, left
        else:
            lo, first, count = mid, first + left, count - left
    return first, count


def slots(spark, found: list[Source], *, block: int = BLOCK_WORDS, seed: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix as slots: shard, slot (its place in the shard), src, block, words it takes from the block's start."""
    total = sum(s.slots for s in found)
    shards = max(1, -(-total // shard_slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                src, blocks, take = [], [], []
                for s in found:
                    first, count = _shares(s, shard, shards, seed)
                    if count:
                        k = np.arange(first, first + count, dtype=np.int64)
                        blocks.append(permute(k % s.blocks, s.blocks, seed, s.index, k // s.blocks))
                        src.append(np.full(count, s.index, dtype=np.int32))
                        take.append(np.where(k == s.slots - 1, s.last, block))
                if src:
                    n = sum(map(len, src))
                    place = permute(np.arange(n), n, seed, -1 - shard, np.zeros(n))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(place), pa.array(np.concatenate(src)), pa.array(np.concatenate(blocks)), pa.array(np.concatenate(take).astype(np.int64))], names=["shard", "slot", "src", "block", "take"])

    return spark.range(0, shards, 1, min(shards, 10_000)).mapInArrow(run, "shard long, slot long, src int, block long, take long")


def mix_report(docs: DataFrame, *, weights=WEIGHTS, most: float = MOST, block: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    sized = saved(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sized")
    found = sources(sized, weights=weights, most=most, block=block, seed=seed)
    cut = pieces(placed(sized, found), block)
    drawn = slots(sized.sparkSession, found, block=block, seed=seed).select("src", "block", "take")
    share = F.when(F.col("take").isNull(), 0).otherwise(F.greatest(F.least("hi", "take") - F.col("lo"), F.lit(0)))  # least() skips nulls
    met = cut.join(drawn.hint("merge"), ["src", "block"], "left")  # both sides grow with the words; their size estimates don't
    return met.groupBy("src", "bucket", "rn", "doc_id", "size", "source_size", "target").agg(F.sum(share).cast("long").alias("taken")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_text(docs: DataFrame, *, weights=WEIGHTS, most: float = MOST, block: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """The mix itself: shard, slot, source, text (the block's words, joined by spaces)."""
    sized = saved(docs.select("doc_id", "source", "text", word_count(F.col("text")).alias("size")), "sized")
    found = sources(sized, weights=weights, most=most, block=block, seed=seed)
    cut = pieces(placed(sized, found), block).filter("block is not null")
    start = (F.col("lo") + F.col("block") * block - F.col("at") + 1).cast("int")
    part = F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), start, (F.col("hi") - F.col("lo")).cast("int"))
    whole = cut.select("src", "source", "block", "lo", part.alias("words")).groupBy("src", "source", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("lo", "words"))), lambda x: x["words"])).alias("words"))
    drawn = slots(sized.sparkSession, found, block=block, seed=seed)
    return drawn.join(whole.hint("merge"), ["src", "block"]).select("shard", "slot", "source", F.array_join(F.slice("words", F.lit(1), F.col("take").cast("int")), " ").alias("text"))
