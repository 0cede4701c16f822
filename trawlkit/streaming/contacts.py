"""Contacts kept up to date from a landing folder of fetches.

The stream itself is stateless: it lands new pages in the page table, and each
micro-batch recomputes the sites it touched. Ranking needs all pages of a site,
so it runs on the batch side, for those sites alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlkit.plans.contacts import contacts

PAGES = "site string, page_seq int, url string, html string"


def refresh(spark: SparkSession, batch: DataFrame, pages_path: str, contacts_path: str, epoch: int) -> None:
    """Adds a batch to the page table and writes its sites' records under ``epoch``; a replayed batch overwrites itself."""
    batch.select("site", "page_seq", "url", "html").write.mode("overwrite").parquet(f"{pages_path}/epoch={epoch}")
    touched = batch.select("site").distinct()
    known = spark.read.parquet(pages_path).drop("epoch").dropDuplicates(["site", "page_seq", "url"])
    contacts(known.join(touched, "site", "left_semi")).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{contacts_path}/batch={epoch}")


def follow(spark: SparkSession, landing: str, pages_path: str, contacts_path: str, checkpoint: str):
    """A running query over ``landing`` (Parquet files of fetched pages)."""
    stream = spark.readStream.schema(PAGES).parquet(landing)
    return stream.writeStream.foreachBatch(lambda df, epoch: refresh(spark, df, pages_path, contacts_path, epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, contacts_path: str) -> DataFrame:
    """Each domain's record from the last batch that touched it."""
    df = spark.read.parquet(contacts_path).drop("batch")
    newest = df.groupBy("domain").agg(F.max("epoch").alias("epoch"))
    return df.join(newest, ["domain", "epoch"]).drop("epoch")
