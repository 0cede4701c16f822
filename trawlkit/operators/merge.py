"""Hits of all pages of a site become entries, scored, ranked and listed.

``hits`` is long: site, page_seq, page_url, hit_seq, field, key, value, handle,
from_href, in_footer, region_match. First-seen order is (page_seq, hit_seq).
Everything up to the ranked items is expressions and grouped minima, so pages
of a giant site are pre-aggregated where they are read. Only phone numbers need
a sequential rule, over one site's distinct numbers.

Defined cases: repeated hits and pages count once; ties keep first-seen order;
sites without hits get empty lists where records are assembled.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlkit.functions import numbering, rules
from trawlkit.functions.emails import email_bonus
from trawlkit.functions.socials import social_bonus_exact

PHONE_FIELDS = ("phones", "phones_uncertain")
_ENTRY = ["site", "field", "key"]


def page_entries(hits: DataFrame) -> DataFrame:
    """A row for each entry and page it is on; flags are true if any occurrence has them."""
    order = F.struct("page_seq", "hit_seq")
    return hits.groupBy(*_ENTRY, "page_url").agg(
        F.min(order).alias("first"), F.min_by("value", order).alias("value"), F.min_by("handle", order).alias("handle"),
        F.min_by("weight", order).alias("weight"), F.max(F.coalesce("is_homepage", F.lit(False))).alias("is_homepage"),
        *(F.max(F.coalesce(c, F.lit(False))).alias(c) for c in ("from_href", "in_footer", "region_match")),
    )


@F.pandas_udf(T.DoubleType())
def likeness(one: pd.Series, other: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio, which no expression computes."""
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(one, other)])


def fold_phones(pages: DataFrame) -> DataFrame:
    """(site, field, key, into): phone entries that are another form of a valid number of their site."""
    sets = pages.filter(F.col("field").isin(*PHONE_FIELDS)).groupBy(*_ENTRY).agg(F.min("first").alias("first"), F.min_by("value", "first").alias("value"), F.collect_set("page_url").alias("urls"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.sort_values(["p", "h"])
        rows = [{"field": f, "key": k, "value": v, "urls": {*u}} for f, k, v, u in zip(order["field"], order["key"], order["value"], order["urls"])]
        valid = [r for r in rows if r["field"] == "phones"]
        full = [r for r in valid if r["value"].startswith("+")]
        out = []

        def joined(row, among):
            for v in among:
                if numbering.same_number(v["value"], row["value"], row["urls"] <= v["urls"]):
                    v["urls"] |= row["urls"]
                    out.append((pdf["site"].iloc[0], row["field"], row["key"], v["key"]))
                    return True
            return False

        kept = [r for r in valid if r["value"].startswith("+") or not joined(r, full)]
        for r in rows:
            if r["field"] == "phones_uncertain":
                joined(r, kept)
        return pd.DataFrame(out, columns=["site", "field", "key", "into"])

    flat = sets.select(*_ENTRY, F.col("first.page_seq").alias("p"), F.col("first.hit_seq").alias("h"), "value", "urls")
    return flat.groupBy("site").applyInPandas(fold, "site string, field string, key string, into string")


def entries(hits: DataFrame, sites: DataFrame) -> DataFrame:
    """Scored entries: site, field, key, value, first_page, first_hit, n_pages, score, rank, sources (at most ten).

    ``sites`` has site and domain; bonuses compare with the domain.
    """
    pages = page_entries(hits)
    moved = pages.join(fold_phones(pages), _ENTRY, "left").withColumn("moved", F.col("into").isNotNull())
    moved = moved.withColumns({"key": F.coalesce("into", "key"), "field": F.when(F.col("moved"), "phones").otherwise(F.col("field"))}).drop("into")
    # an entry keeps its own first page, value and handle; pages that moved in come after
    order = F.struct("moved", "first")
    once = moved.groupBy(*_ENTRY, "page_url").agg(F.min(order).alias("ord"), *(F.min_by(c, order).alias(c) for c in ("value", "handle", "weight", "is_homepage")), *(F.max(c).alias(c) for c in ("from_href", "in_footer", "region_match")))
    shown = Window.partitionBy(*_ENTRY).orderBy(F.desc("weight"), "ord")
    top = once.withColumn("place", F.row_number().over(shown)).filter(F.col("place") <= rules.SOURCES_SHOWN)
    sources = top.groupBy(*_ENTRY).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "page_url"))), lambda x: x["page_url"]).alias("sources"))
    summed = once.groupBy(*_ENTRY).agg(
        F.min("ord").alias("ord"), F.min_by("value", "ord").alias("value"), F.min_by("handle", "ord").alias("handle"), F.count("*").alias("n_pages"),
        F.sum("weight").alias("weights"), *(F.max(c).alias(c) for c in ("is_homepage", "from_href", "in_footer", "region_match")),
    )
    return ranked(summed.join(sources, _ENTRY).join(sites.select("site", "domain"), "site"))


def prominence(weights: Column) -> Column:
    yes = lambda c, n: F.when(F.col(c), n).otherwise(0)
    return weights + yes("is_homepage", rules.HOMEPAGE_BONUS) + yes("in_footer", rules.FOOTER_BONUS) + yes("from_href", rules.HREF_BONUS)


def ranked(summed: DataFrame) -> DataFrame:
    from trawlkit.functions.urls import registrable_host, site_label

    label = site_label(F.col("domain"))
    plain = F.regexp_replace(F.lower(F.coalesce("handle", F.lit(""))), "[^a-z0-9]", "")
    exact = F.when(~F.col("field").isin("emails", *PHONE_FIELDS), social_bonus_exact(F.col("handle"), label)).otherwise(0)
    scored = summed.withColumns({"exact": exact, "plain": plain, "label": label})
    # likeness is computed where names neither match nor hold each other
    scored = scored.withColumn("alike", likeness(F.when(F.col("exact").isNull(), F.col("plain")), F.when(F.col("exact").isNull(), F.col("label"))))
    phone = F.when(F.col("region_match"), rules.REGION_BONUS).otherwise(0) + F.when(F.col("from_href"), rules.HREF_BONUS).otherwise(0)
    bonus = F.when(F.col("field") == "emails", email_bonus(F.col("value"), registrable_host(F.col("domain")))).when(F.col("field").isin(*PHONE_FIELDS), phone).otherwise(F.coalesce("exact", F.when(F.col("alike") >= 0.75, 2).otherwise(0)))
    scored = scored.withColumn("score", (prominence(F.col("weights")) + bonus).cast("long"))
    place = F.row_number().over(Window.partitionBy("site", "field").orderBy(F.desc("score"), "ord"))
    return scored.withColumn("rank", place).select(*_ENTRY, "value", F.col("ord.first.page_seq").alias("first_page"), F.col("ord.first.hit_seq").alias("first_hit"), "n_pages", "score", "rank", "sources")


def listed(ranked_entries: DataFrame) -> DataFrame:
    """One row per site with a list per field, best first; the first of each list is likely the official one."""
    lists = []
    for field in ("emails", *PHONE_FIELDS, *rules.PLATFORMS):
        item = [F.col("value"), F.col("sources")]
        flagged = field != "phones_uncertain"
        if flagged:
            item.append((F.col("rank") == 1).alias("is_likely_official"))
        held = F.array_sort(F.collect_list(F.when(F.col("field") == field, F.struct("rank", F.struct(*item).alias("item")))))
        lists.append(F.transform(held, lambda x: x["item"]).alias(field))
    return ranked_entries.groupBy("site").agg(*lists)
