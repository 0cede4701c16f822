"""Hosts, registrable domains and normalised urls, as column expressions."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlkit.functions import rules
from trawlkit.functions.rules import java, some
from trawlkit.functions.session import once

#: Second-level public suffixes: these labels under a country code are a suffix together with it.
_SECOND = "ac co com edu gob gov gouv govt id ind mil ne net nic nom or org sch".split()
_SECOND_OF = {
    "uk": "ac co gov ltd me net nhs org plc police sch", "au": "asn com edu gov id net org", "nz": "ac co geek gen govt health iwi kiwi maori mil net org school",
    "jp": "ac ad co ed go gr lg ne or", "kr": "ac co go mil ne or pe re", "br": "art blog com edu eng gov ind jus leg mil net org tv", "za": "ac co edu gov law mil net nom org school web",
    "in": "ac co edu firm gen gov ind mil net nic org res", "cn": "ac com edu gov mil net org", "tw": "com edu gov idv net org", "hk": "com edu gov idv net org", "sg": "com edu gov net org per",
    "mx": "com edu gob net org", "ar": "com edu gob gov int mil net org tur", "tr": "av bel biz com edu gen gov info k12 mil name net org tel tv web", "il": "ac co gov idf k12 muni net org",
    "th": "ac co go in mi net or", "id": "ac biz co desa go mil my net or sch web", "my": "com edu gov mil name net org", "ph": "com edu gov mil net ngo org", "vn": "ac biz com edu gov health info int name net org pro",
    "ua": "com edu gov in net org", "pl": "com edu gov info net org", "at": "ac co gv or", "ae": "ac co gov mil net org sch", "sa": "com edu gov med net org pub sch", "eg": "com edu gov mil net org sci",
    "ke": "ac co go info me mobi ne or sc", "ng": "com edu gov mil mobi name net org sch", "pk": "com edu gov net org", "bd": "ac com edu gov mil net org", "lk": "ac com edu gov ltd net org", "es": "com edu gob nom org",
    "pt": "com edu gov int net nome org publ", "it": "edu gov", "fr": "asso com gouv nom prd tm", "gr": "com edu gov net org", "cy": "ac com gov ltd net org", "hu": "co info org", "ro": "com info org", "co": "com edu gov mil net nom org",
    "pe": "com edu gob mil net nom org", "ve": "co com edu gob net org web", "uy": "com edu gub mil net org", "ec": "com edu fin gob gov info med mil net org pro",
}
DOUBLE_SUFFIXES = tuple(sorted(f"{second}.{top}" for top, words in _SECOND_OF.items() for second in words.split()))
#: Last labels that are no public suffix.
PRIVATE_TOPS = tuple("corp example home internal invalid lan local localhost onion test".split())
SCHEME = java("^" + some("a-z", "1") + some(r"a-z0-9+.\-", "0,") + "://")

CCTLD_REGION = {t: t.upper() for t in "ae at au be br ca ch cn cz de dk es fi fr hk ie in it jp kr mx nl no nz pl pt se sg us za".split()} | {"uk": "GB"}


def url_host(url: Column) -> Column:
    """Lower-case host of a url or bare host, without user and port."""
    rest = F.regexp_replace(F.trim(url), SCHEME, "")
    authority = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^[^@]*@", ""), r":\d*$", ""))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(F.trim(url), SCHEME, ""), r"^[^/?#]*([^?#]*)", 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def without_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def _suffix_labels(host: Column) -> Column:
    """Number of labels of the host's public suffix; 0 where it has none."""
    last = F.substring_index(host, ".", -1)
    named = F.size(F.split(host, r"\.")) > 1
    known = named & last.rlike("^[a-z][a-z0-9-]+$") & ~last.isin(*PRIVATE_TOPS)
    return F.when(~known, 0).when(F.substring_index(host, ".", -2).isin(*DOUBLE_SUFFIXES), 2).otherwise(1)


def registrable_host(host: Column) -> Column:
    """The registrable domain; a host without a public suffix stays, less one ``www.``."""
    n, labels = _suffix_labels(host), F.size(F.split(host, r"\."))
    whole = F.concat_ws(".", F.slice(F.split(host, r"\."), -(n + 1), n + 1))
    return F.when((n > 0) & (labels > n), whole).otherwise(without_www(host))


def registrable_domain(url: Column) -> Column:
    return registrable_host(url_host(url))


def site_label(host: Column) -> Column:
    """The label before the public suffix (``acme`` of ``www.acme.co.uk``)."""
    return F.substring_index(registrable_host(host), ".", 1)


def public_suffix_top(host: Column) -> Column:
    """Last label of the public suffix, null where there is none."""
    return F.when(_suffix_labels(host) > 0, F.substring_index(host, ".", -1))


def region_of(host: Column) -> Column:
    """Phone region of the host's country code, null for generic endings."""
    table = F.create_map(*(F.lit(x) for kv in sorted(CCTLD_REGION.items()) for x in kv))
    return F.try_element_at(table, public_suffix_top(host))


def seed_host(query: Column) -> Column:
    """Host as typed, lower-cased, dots at the ends dropped."""
    q = F.trim(query)
    part = F.when(q.contains("://"), F.regexp_extract(q, r"://([^/?#]*)", 1)).otherwise(F.substring_index(q, "/", 1))
    return F.regexp_replace(F.lower(part), r"^\.+|\.+$", "")


def flip_www(bare: Column) -> Column:
    return F.when(F.lower(bare).startswith("www."), F.substring(bare, 5, 1 << 30)).otherwise(F.concat(F.lit("www."), bare))


def seed_urls(query: Column) -> Column:
    """Up to four urls to try for a seed, in order."""
    q = F.trim(query)
    scheme = F.when(F.lower(q).startswith("http://"), "http").otherwise("https")
    bare = F.regexp_replace(F.regexp_replace(q, r"^.*?://", ""), "^/+|/+$", "")
    at = lambda s, b: F.concat(F.lit(s) if isinstance(s, str) else s, F.lit("://"), b)
    first = F.array(at(scheme, bare), at(scheme, flip_www(bare)))
    return F.when(scheme == "https", F.concat(first, F.array(at("http", bare), at("http", flip_www(bare))))).otherwise(first)


def normalized(url: str | None) -> str | None:
    """Key for visited pages: https, no www, no trailing slash or fragment, parameters sorted, trackers dropped."""
    if url is None:
        return None
    try:
        parts = urlsplit(url if "://" in url else "https://" + url)
    except ValueError:
        return url
    host = parts.netloc.lower().removeprefix("www.")
    params = parse_qsl(parts.query, keep_blank_values=True)
    kept = sorted(p for p in params if not re.match(rules.TRACKING_PARAM, p[0], re.I))
    return urlunsplit(("https", host, parts.path.rstrip("/"), urlencode(kept), ""))


@F.pandas_udf(T.StringType())
def normalize_url(urls: pd.Series) -> pd.Series:
    """:func:`normalized` as a column: the one key of a url, on both sides of the crawl."""
    return urls.map(normalized, na_action="ignore")


# links of the crawl frontier


def keyword_score(path: Column, text: Column) -> Column:
    """What kind of page a link leads to: 100 contact, 90 imprint, 80 about, 60 support, 40 legal, else 10."""
    segments = F.transform(F.split(F.lower(path), "/"), lambda s: F.regexp_replace(s, rules.SEGMENT_TAIL, ""))
    label = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    words = F.filter(F.concat(segments, F.array(once(label, lambda w: F.when(F.length(w) <= 30, w).otherwise("")))), lambda w: w != "")

    def points(found: Column) -> Column:
        score = F
        for n, pattern in rules.KEYWORDS:
            score = score.when(F.exists(found, lambda w: w.rlike(pattern)), n)
        return score.otherwise(rules.NO_KEYWORD)

    return once(words, points)


def link_score(keyword: Column, in_footer: Column, in_nav: Column, depth: Column) -> Column:
    """A link's place in the crawl, by its :func:`keyword_score`; make that a column of its own."""
    return keyword + F.when(in_footer, 20).otherwise(0) + F.when(in_nav, 10).otherwise(0) - 10 * depth


def weight_class(keyword: Column, is_homepage: Column) -> Column:
    return F.when(is_homepage, "homepage").when(keyword >= 90, "contact").when(keyword >= 80, "about").otherwise("other")


def followable(url: Column) -> Column:
    """Links to pages: http(s), no files to skip, no noise paths."""
    return F.coalesce(url.rlike(java("^https?://")) & ~url.rlike(java(rules.SKIP_FILE)) & ~url_path(url).rlike(java(rules.NOISE_PATH)), F.lit(False))


def registrable_name(host: str) -> str:
    """:func:`registrable_host` for one host, for code that runs outside expressions."""
    labels = host.lower().split(".")
    last = labels[-1]
    if len(labels) > 1 and re.fullmatch("[a-z][a-z0-9-]+", last) and last not in PRIVATE_TOPS:
        n = 2 if ".".join(labels[-2:]) in DOUBLE_SUFFIXES else 1
        if len(labels) > n:
            return ".".join(labels[-n - 1 :])
    return host.lower().removeprefix("www.")
