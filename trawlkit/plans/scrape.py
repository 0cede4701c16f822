"""Seeds to contact records over a corpus of fetched pages: crawl, extract, rank, one row per seed.

A seed whose crawl keeps no page gives a full row with the reason in ``error``;
repeated seeds give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlkit.functions import rules
from trawlkit.operators.frontier import crawl
from trawlkit.operators.parse import parse_pages
from trawlkit.plans.contacts import contacts
from trawlkit.sources.scratch import saved


def scrape_contacts(seeds: DataFrame, corpus: DataFrame, *, limits: dict = rules.CRAWL) -> DataFrame:
    """``seeds``: seed_id, query. ``corpus``: seed_id, url_norm, final_url, status, error, html and optional headers."""
    parsed = parse_pages(corpus.select("seed_id", "url_norm", "final_url", "status", "error", "html"), url="final_url")
    # a row per kept page, without its html
    kept = saved(crawl(seeds, parsed, limits=limits), "crawled")
    place = kept.filter("url_norm is not null").select("seed_id", "url_norm", "page_seq", "url", "domain", "weight_class")
    fetched = corpus.select("seed_id", "url_norm", "html", *(["headers"] if "headers" in corpus.columns else []))
    pages = fetched.join(place, ["seed_id", "url_norm"]).withColumn("site", F.col("seed_id").cast("string")).drop("seed_id", "url_norm")
    tried = kept.groupBy(F.col("seed_id").cast("string").alias("site")).agg(F.first("domain").alias("domain"), F.max("error").alias("error"))
    return contacts(pages, tried)
