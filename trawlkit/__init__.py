"""Trawlkit: contact intelligence over crawled pages, as Spark DataFrames."""
