"""From fetched pages to one ranked contact record per site.

The html is read once: the parse, the pattern scans and the number reading are
one narrow chain per page that ends in an array of hits, so nothing is parsed
twice and no page text is shuffled. What is shuffled are hits, grouped by
(site, field, key), and the homepages, one per site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlkit.functions import rules
from trawlkit.functions.emails import DISGUISE, decoded_cfemail, deobfuscated, false_email, found_emails, is_email, mailto_address
from trawlkit.functions.rules import java
from trawlkit.functions.session import per_session
from trawlkit.functions.socials import detected, dialled_number, only_profiles, vendor_credit, with_profile
from trawlkit.functions.tech import detect_technologies, plain_headers
from trawlkit.functions.text import scan_safe
from trawlkit.functions.urls import keyword_score, region_of, site_label, url_host, url_path, weight_class
from trawlkit.operators.merge import entries, listed
from trawlkit.operators.parse import parse_pages
from trawlkit.operators.phones import with_phones
from trawlkit.sources.scratch import saved

_ITEMS = "array<struct<value:string,sources:array<string>,is_likely_official:boolean>>"
_PLAIN = "array<struct<value:string,sources:array<string>>>"



def _found(field, value: Column, from_href: Column, in_footer: Column) -> Column:
    return F.struct((F.lit(field) if isinstance(field, str) else field).alias("field"), value.alias("value"), from_href.alias("from_href"), in_footer.alias("in_footer"))


@per_session
def email_hits() -> Column:
    """Addresses of a parsed page in order of evidence: links, coded ones, text, text with disguises undone."""
    linked = F.transform(F.filter("anchors", lambda a: a["href"].rlike(java(rules.MAILTO))), lambda a: _found("emails", mailto_address(a["href"]), F.lit(True), a["in_footer"]))
    coded = F.transform("cfemails", lambda c: _found("emails", decoded_cfemail(c["hex"]), c["from_href"], c["in_footer"]))
    shown = lambda text: F.transform(found_emails(text), lambda v: _found("emails", v, F.lit(False), F.lit(False)))
    return F.concat(linked, coded, shown(F.col("safe_text")), shown(F.coalesce("plain_text", F.lit(""))))


@per_session
def social_urls(platform: str) -> Column:
    """Urls of a page that a platform's pattern finds: in the raw html, then in whole links."""
    none = F.array().cast("array<struct<field:string,value:string,from_href:boolean,in_footer:boolean>>")
    raw = F.transform(detected(F.col("scanned"), platform), lambda u: _found(platform, u, F.lit(False), F.lit(False))) if platform not in rules.ANCHOR_ONLY else none
    fits = F.filter("anchors", lambda a: F.coalesce(a["resolved"].rlike(java(rules.PLATFORM_PATTERN[platform])), F.lit(False)))
    linked = F.transform(fits, lambda a: _found(platform, a["resolved"], F.lit(True), a["in_footer"]))
    gated = lambda text, hits: F.when(F.col(text).rlike(rules.GATES[platform]), hits).otherwise(none)
    return F.concat(gated("low", raw), gated("low_links", linked))


def page_hits(pages: DataFrame) -> DataFrame:
    """``pages`` (site, page_seq, url, html, domain) to hits; each page also gives one hit of field ``_page`` with title and description."""
    kept = pages.select("site", "page_seq", "url", "html", "domain")
    read = parse_pages(kept).withColumns({"scanned": F.substring(F.coalesce("html", F.lit("")), 1, rules.SCAN_CHARS), "safe_text": scan_safe(F.col("text")), "region": region_of(F.col("domain"))})
    # raw html is scanned to a limit, links are not: each has its own gate
    read = read.withColumns({"plain_text": deobfuscated(F.when(F.col("safe_text").rlike(DISGUISE), F.col("safe_text"))), "low": F.lower("scanned"), "low_links": F.lower(F.array_join(F.transform("anchors", lambda a: a["resolved"]), " "))})
    read = read.withColumn("socials", F.concat(*map(social_urls, rules.PLATFORMS)))
    numbers = F.transform(F.filter("socials", lambda h: h["field"] == "whatsapps"), lambda h: dialled_number(h["value"]))
    read = read.withColumn("wa_numbers", F.array_distinct(F.filter(numbers, lambda n: n.isNotNull())))
    read = with_phones(read.select("site", "page_seq", "url", "domain", "title", "description", "text", "anchors", "region", "wa_numbers", email_hits().alias("emails"), "socials"))
    numbered = lambda field: F.transform(field, lambda p: F.struct(F.lit(field).alias("field"), p["key"].alias("key"), p["value"].alias("value"), F.lit(None).cast("string").alias("handle"), p["from_href"].alias("from_href"), p["in_footer"].alias("in_footer"), p["region_match"].alias("region_match")))
    loose = lambda h: F.struct(h["field"].alias("field"), F.lower(h["value"]).alias("key"), h["value"].alias("value"), F.lit(None).cast("string").alias("handle"), h["from_href"].alias("from_href"), h["in_footer"].alias("in_footer"), F.lit(False).alias("region_match"))
    page = F.struct(F.lit("_page").alias("field"), F.lit("").alias("key"), F.col("title").alias("value"), F.col("description").alias("handle"), F.lit(False).alias("from_href"), F.lit(False).alias("in_footer"), F.lit(False).alias("region_match"))
    at = ["site", "page_seq", F.col("url").alias("page_url"), "domain"]
    rest = F.concat(F.array(page), numbered("phones"), numbered("phones_uncertain"))
    # one array of all hits, so that the chain above runs once
    each = read.select(*at, F.posexplode(F.concat(rest, F.transform("emails", loose), F.transform("socials", loose))).alias("hit_seq", "h"))
    return _checked(each.select("site", "page_seq", "page_url", "domain", "hit_seq", "h.*"))


def _checked(each: DataFrame) -> DataFrame:
    """Canonical profiles and real addresses only; other hits stay as they are."""
    social, mail = F.col("field").isin(*rules.PLATFORMS), F.col("field") == "emails"
    each = with_profile(each, F.col("field"))
    credit = F.coalesce(vendor_credit(F.col("profile.handle"), site_label(F.col("domain"))), F.lit(False))
    as_is = F.struct("value", "key", "handle")
    each = each.withColumn("profile", F.when(social, F.when(~credit, F.col("profile"))).when(mail, F.when(F.coalesce(is_email(F.col("value")) & ~false_email(F.col("key")), F.lit(False)), F.struct(F.col("key").alias("value"), "key", "handle"))).otherwise(as_is))
    kept = only_profiles(each.select("site", "page_seq", "page_url", "hit_seq", "field", "from_href", "in_footer", "region_match", "profile"))
    return kept.select("site", "page_seq", "page_url", "hit_seq", "field", "profile.key", "profile.value", "profile.handle", "from_href", "in_footer", "region_match")


def homepages(pages: DataFrame) -> DataFrame:
    """Each site's first page, with the technologies it shows."""
    page = F.struct("page_seq", "url", "html", "domain", *(["headers"] if "headers" in pages.columns else []))
    first = pages.groupBy("site").agg(F.min_by(page, "page_seq").alias("home")).select("site", "home.*")
    headers = plain_headers(F.col("headers")) if "headers" in pages.columns else None
    return first.select("site", "domain", F.col("page_seq").alias("home_seq"), detect_technologies(F.col("html"), headers).alias("technologies"))


def contacts(pages: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """One row per site in the fixed 25-column layout.

    ``pages``: site, page_seq, url, html, optional domain, weight_class,
    headers. ``seeds`` (site, domain, error) adds rows for sites without pages.
    Without ``weight_class`` a page's class follows from its path; the page of
    the smallest ``page_seq`` is the homepage.
    """
    if "domain" not in pages.columns:
        pages = pages.withColumn("domain", url_host(F.col("url")))
    homes = homepages(pages)
    # read by the ranking, the number folding and the titles: pages are parsed once
    hits = saved(page_hits(pages), "hits")
    if "weight_class" in pages.columns:
        classed = hits.join(pages.select("site", "page_seq", F.col("weight_class").alias("kind")), ["site", "page_seq"])
    else:
        classed = hits.withColumn("kind", weight_class(keyword_score(url_path(F.col("page_url")), F.lit("")), F.lit(False)))
    placed = classed.join(homes.select("site", "home_seq"), "site").withColumn("is_homepage", F.col("page_seq") == F.col("home_seq"))
    weight = F.create_map(*(F.lit(x) for kv in rules.PAGE_WEIGHT.items() for x in kv))
    placed = placed.withColumn("weight", F.when(F.col("is_homepage"), rules.PAGE_WEIGHT["homepage"]).otherwise(F.coalesce(F.try_element_at(weight, F.col("kind")), F.lit(1))))
    meta = placed.filter((F.col("field") == "_page") & F.col("is_homepage")).select("site", F.col("value").alias("title"), F.col("handle").alias("description"))
    lists = listed(entries(placed.filter(F.col("field") != "_page"), homes))
    rows = homes.drop("home_seq").join(meta, "site", "left").join(lists, "site", "left").withColumn("error", F.lit(None).cast("string"))
    if seeds is not None:
        given = seeds.select("site", F.col("domain").alias("seed_domain"), F.col("error").alias("seed_error"))
        rows = given.join(rows, "site", "left").withColumns({"domain": F.coalesce("domain", "seed_domain"), "error": F.when(F.col("domain").isNull(), F.coalesce("seed_error", F.lit("unreachable: no pages fetched")))})
    return laid_out(rows)


def laid_out(rows: DataFrame) -> DataFrame:
    """The fixed columns in their order; missing lists are empty."""
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    return rows.select(
        "domain", "title", "description", empty("emails", _ITEMS), empty("phones", _ITEMS), empty("phones_uncertain", _PLAIN),
        *(empty(p, _ITEMS) for p in rules.PLATFORMS), empty("technologies", "array<struct<name:string,versions:array<string>,categories:array<string>>>"), "error",
    )


def error_rows(seeds: DataFrame) -> DataFrame:
    """The layout for seeds (domain, error) that gave nothing."""
    blank = seeds.select("domain", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("description"), *(F.lit(None).cast(_PLAIN if c == "phones_uncertain" else _ITEMS).alias(c) for c in ("emails", "phones", "phones_uncertain", *rules.PLATFORMS)), F.lit(None).cast("array<struct<name:string,versions:array<string>,categories:array<string>>>").alias("technologies"), F.substring("error", 1, 200).alias("error"))
    return laid_out(blank)
