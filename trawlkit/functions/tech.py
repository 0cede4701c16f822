"""Technologies of a site, from marks in its homepage and response headers.

A small hand-made table: name, categories, patterns over the html, patterns
over headers, and a pattern whose group is the version.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawlkit.functions import rules
from trawlkit.functions.rules import java

#: name: categories, html pattern, (header, pattern), version pattern
TECHNOLOGIES = {
    "Angular": (["JavaScript frameworks"], r"ng-version=|\bng-app\b", None, r'ng-version="([\d.]+)"'),
    "Apache HTTP Server": (["Web servers"], None, ("server", r"^apache(?:/|$|\s)"), r"apache/([\d.]+)"),
    "Bootstrap": (["UI frameworks"], r"bootstrap(?:\.min)?\.(?:css|js)", None, r"bootstrap[@/-]v?([\d.]+\d)"),
    "Cloudflare": (["CDN"], r"/cdn-cgi/", ("server", "cloudflare"), None),
    "Drupal": (["CMS"], r"drupal-settings-json|/sites/default/files/", ("x-generator", "drupal"), r"drupal (\d+)"),
    "Ghost": (["CMS"], r'content="ghost', None, r'content="ghost ([\d.]+)"'),
    "Google Analytics": (["Analytics"], r"google-analytics\.com/|googletagmanager\.com/gtag/js", None, None),
    "Google Tag Manager": (["Tag managers"], r"googletagmanager\.com/gtm\.js", None, None),
    "HubSpot": (["Marketing automation"], r"js\.hs-scripts\.com|hs-analytics", None, None),
    "Joomla": (["CMS"], r'content="joomla', None, None),
    "Next.js": (["JavaScript frameworks"], r'id="__next"|/_next/static/', ("x-powered-by", r"next\.js"), r"next\.js ?([\d.]+)"),
    "Nginx": (["Web servers", "Reverse proxies"], None, ("server", "nginx"), r"nginx/([\d.]+)"),
    "Nuxt.js": (["JavaScript frameworks"], r'id="__nuxt"|/_nuxt/', None, None),
    "PHP": (["Programming languages"], None, ("x-powered-by", r"^php"), r"php/([\d.]+)"),
    "React": (["JavaScript frameworks"], r"data-reactroot|react(?:-dom)?(?:\.production)?(?:\.min)?\.js", None, None),
    "Shopify": (["Ecommerce"], r"cdn\.shopify\.com|shopify\.theme", ("x-shopify-stage", "."), None),
    "Squarespace": (["CMS"], r"static1?\.squarespace\.com", None, None),
    "Tailwind CSS": (["UI frameworks"], r"tailwind(?:css)?(?:\.min)?\.(?:css|js)", None, None),
    "Vue.js": (["JavaScript frameworks"], r"data-v-[0-9a-f]{8}|vue(?:\.runtime)?(?:\.global)?(?:\.min)?\.js", None, r"vue@([\d.]+)"),
    "Webflow": (["Page builders"], r"data-wf-site|assets\.website-files\.com", None, None),
    "Wix": (["CMS"], r"static\.wixstatic\.com|x-wix-", None, None),
    "WooCommerce": (["Ecommerce"], r"/plugins/woocommerce/", None, r'content="woocommerce ([\d.]+)"'),
    "WordPress": (["CMS", "Blogs"], r'/wp-content/|/wp-includes/|content="wordpress', ("link", r"/wp-json/"), r'content="wordpress ([\d.]+)"'),
    "jQuery": (["JavaScript libraries"], r"jquery(?:[.-][\d.]+)?(?:\.min)?\.js", None, r"jquery[.-/@]([\d.]+\d)".replace(".-/@", r".\-/@")),
}


def plain_headers(headers: Column) -> Column:
    """Lower-case names; the values of a repeated header joined by commas."""
    named = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), F.array_join(e["value"], ", ").alias("value")))
    keys = F.array_distinct(F.transform(named, lambda e: e["key"]))
    pick = lambda k: F.array_join(F.transform(F.filter(named, lambda e: e["key"] == k), lambda e: e["value"]), ", ")
    return F.map_from_arrays(keys, F.transform(keys, pick))


def detect_technologies(html: Column, headers: Column | None = None) -> Column:
    """array<struct<name, versions, categories>> by name; empty where nothing is known."""
    page = F.substring(F.coalesce(html, F.lit("")), 1, rules.SCAN_CHARS)
    head = F.coalesce(headers, F.create_map().cast("map<string,string>")) if headers is not None else None
    found = []
    for name in sorted(TECHNOLOGIES, key=str.lower):
        categories, in_html, in_header, version = TECHNOLOGIES[name]
        hit, where = F.lit(False), page
        if in_html:
            hit = page.rlike(java(in_html))
        if in_header and head is not None:
            value = F.coalesce(F.try_element_at(head, F.lit(in_header[0])), F.lit(""))
            hit = hit | value.rlike(java(in_header[1]))
            where = F.concat(page, F.lit("\n"), value)
        versions = F.array_distinct(F.regexp_extract_all(where, F.lit(java(version)), F.lit(1))) if version else F.array().cast("array<string>")
        found.append(F.when(hit, F.struct(F.lit(name).alias("name"), versions.alias("versions"), F.array(*map(F.lit, categories)).alias("categories"))))
    return F.filter(F.array(*found), lambda t: t.isNotNull())
