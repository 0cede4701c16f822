"""What the training-data operators share: tables, row keys, splitting of large groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlkit.operators.batches import frugal
from trawlkit.sources.scratch import drop_saved, saved, scope, scratch_path, shared_dir, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def crc_mod(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def hash_order(*cols):
    """A 63-bit pseudorandom order key that does not depend on how rows are partitioned."""
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 63) - 1))


__all__ = ["ASCII_LOWER", "blocked", "crc_mod", "drop_saved", "frugal", "group_edges", "hash_order", "saved", "scope", "scratch_path", "shared_dir", "spread", "table", "whole_groups"]

#: A-Z to a-z, everything else as it is.
ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def blocked(df: DataFrame, keys: list[str], item: str, rows: int) -> DataFrame:
    """``df`` with columns bx, by, own that split its large groups for comparing all pairs within a group.

    A group of more than ``rows`` rows is cut into blocks by a hash of ``item``,
    and each pair of blocks (bx <= by) becomes a group of its own. A pair of rows
    is to be compared where ``bx = by`` or their ``own`` blocks differ; each pair
    then meets in exactly one place. Smaller groups have 0, 0, 0.
    """
    sizes = saved(df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > rows).select(*keys, F.ceil(F.col("n") / rows).cast("int").alias("parts")), "large")
    if sizes.isEmpty():
        return df.withColumns({c: F.lit(0) for c in ("bx", "by", "own")})
    met = df.join(sizes, keys, "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64(item), F.col("parts")).cast("int"), F.lit(0)))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0)))))
    return met.select(*df.columns, F.least("own", "other").alias("bx"), F.greatest("own", "other").alias("by"), "own")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows, cut so that no group (equal first ``keys`` columns) is in two of them."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        heads = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        if rest and any(rest[0].column(i)[0].as_py() != batch.column(i)[0].as_py() for i in range(keys)):
            yield _one(rest)
            rest = []
        last = int(np.flatnonzero(group_edges(heads))[-1])
        if last:
            yield _one([*rest, batch.slice(0, last)])
            rest = []
        rest.append(batch.slice(last))
    if rest:
        yield _one(rest)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


def group_edges(columns) -> np.ndarray:
    """Where each run of equal rows begins in sorted columns."""
    change = np.zeros(len(columns[0]), dtype=bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return change
