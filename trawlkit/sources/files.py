"""Reading landed fetches and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlkit.functions.urls import url_host
from trawlkit.operators.frontier import guarded_html
from trawlkit.plans.results import export_ready
from trawlkit.sources.scratch import spread

FETCHES = "site string, page_seq int, url string, final_url string, status int, html string, content_type string, headers map<string,array<string>>, mode_used string, error string"


def read_fetches(spark: SparkSession, path: str) -> DataFrame:
    """Landed fetch results (Parquet or JSON lines); payloads that are no html are blanked, with the reason in ``error``."""
    df = spark.read.schema(FETCHES).json(path) if path.endswith((".json", ".jsonl", ".json.gz")) else spark.read.parquet(path)
    html, why = guarded_html(F.col("html"), F.col("content_type"))
    return df.withColumns({"html": html, "error": F.coalesce("error", why)})


def pages_of(pages: DataFrame) -> DataFrame:
    """A table (page_id, url, html) as pages: the host is the site, ids give the order."""
    return spread(pages).select(url_host(F.col("url")).alias("site"), F.col("page_id").alias("page_seq"), "url", "html")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_csv(df: DataFrame, path: str, english: bool = True) -> None:
    export_ready(df, english).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
