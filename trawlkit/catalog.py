"""The queries of the contact engine, by name, with their SQL where SQL can express them.

Every query reads its whole tables. Inputs that the tables lack (profile links,
coded addresses, redirects) are derived from the columns of ``customer`` and
``supplier``, alike in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trawlkit.functions import rules
from trawlkit.functions.emails import decoded_cfemail, email_bonus, false_email, found_emails
from trawlkit.functions.rules import java
from trawlkit.functions.socials import vendor_credit, with_profile
from trawlkit.functions.text import digits, fold_accents, html_text, scan_safe
from trawlkit.functions.urls import flip_www, followable, keyword_score, link_score, normalize_url, region_of, registrable_domain, seed_host, seed_urls, site_label, url_host, url_path, weight_class
from trawlkit.operators import frontier as fr
from trawlkit.operators.merge import entries
from trawlkit.operators.parse import parse_pages
from trawlkit.operators.phones import is_junk, shown_numbers
from trawlkit.plans import results
from trawlkit.plans.contacts import contacts, error_rows
from trawlkit.plans.scrape import scrape_contacts
from trawlkit.sources.files import pages_of
from trawlkit.sources.scratch import spread
from trawlkit.sources.tasks import duration, split_tasks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(_read(spark, sf_dir, name))


def _long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["contacts"](spark, sf_dir)


# whole pipeline


@query("SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS domain, 25::BIGINT AS n_columns FROM pages", "contacts_sites")
def _contacts_sites(spark, sf_dir):
    found = contacts(pages_of(_read(spark, sf_dir, "pages")))
    return found.select("domain", F.lit(len(found.columns)).cast("long").alias("n_columns"))


@query(name="contacts")
def _contacts(spark, sf_dir):
    """Pages to one record of 25 columns per site."""
    return contacts(pages_of(_read(spark, sf_dir, "pages")))


@query(name="contacts_overview")
def _overview(spark, sf_dir):
    return results.overview(contacts(pages_of(_read(spark, sf_dir, "pages"))))


@query(name="contacts_email_list")
def _email_list(spark, sf_dir):
    return results.email_list(contacts(pages_of(_read(spark, sf_dir, "pages"))))


def _made_pages(spark, sf_dir) -> DataFrame:
    """Three pages for a site of each supplier, with what a site of a small firm shows."""
    k = F.col("s_suppkey").cast("string")
    place = lambda text: F.expr("concat('" + text.replace("'", "\\'").replace("{k}", "', s_suppkey, '") + "')")
    home = "<title> Site {k} </title><meta name=description content='About {k}'><nav><a href='/about'>About us</a><a href='/contact/'>Contact</a><a href='/a.pdf'>File</a><a href='/cart'>Cart</a><a href='//other.org/contact'>Other</a></nav><p>Write to INFO@s{k}.com</p><footer><a href='mailto:info@s{k}.com?subject=x'>mail</a><a href='https://m.facebook.com/Acme{k}xx/?ref=1'>f</a></footer>"
    contact = "<p>sales@s{k}.com, info@s{k}.com, logo@2x.png</p><a href='tel:+1-415-555-2671'>call</a><a href='https://twitter.com/share?url=x'>t</a><a href='https://x.com/acme{k}'>x</a>"
    about = "<p>joe{k}@gmail.com</p><a href='https://x.com/other{k}'>x</a><a href='/deep?a=b%20c&utm_source=q'>deep</a>"
    deep = "<p>nobody at all</p>"
    pages = [("/", home), ("/about", about), ("/contact/", contact), ("/deep?a=b%20c&utm_source=q", deep)]
    rows = F.array(*(F.struct(F.lit(i).cast("long").alias("page_seq"), F.concat(F.lit("https://s"), k, F.lit(".com" + path)).alias("url"), place(text).alias("html")) for i, (path, text) in enumerate(pages)))
    return _t(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("s"), k, F.lit(".com")).alias("site"), F.explode(rows).alias("p")).select("s_suppkey", "site", "p.*")


_MADE = "(SELECT s_suppkey AS k, 'https://s' || s_suppkey || '.com' AS u FROM supplier)"


@query(f"""SELECT 's' || k || '.com' AS domain, 'Site ' || k AS title, 'info@s' || k || '.com, sales@s' || k || '.com, joe' || k || '@gmail.com' AS emails, '+14155552671' AS phones, '' AS linkedins, 'https://x.com/acme' || k || ', https://x.com/other' || k AS twitters,
 '' AS instagrams, 'https://www.facebook.com/Acme' || k || 'xx' AS facebooks, '' AS youtubes, '' AS githubs, '' AS technologies, CAST(NULL AS VARCHAR) AS error FROM {_MADE}""")
def contacts_made_overview(spark, sf_dir):
    """The whole engine over pages whose record is known."""
    return results.overview(contacts(_made_pages(spark, sf_dir).drop("s_suppkey")))


@query(f"""SELECT 's' || k || '.com' AS domain, unnest(['info@s' || k || '.com', 'sales@s' || k || '.com', 'joe' || k || '@gmail.com']) AS email, unnest([true, false, false]) AS is_likely_official, unnest([u || '/, ' || u || '/contact/', u || '/contact/', u || '/about']) AS sources FROM {_MADE}""")
def contacts_made_email_list(spark, sf_dir):
    return results.email_list(contacts(_made_pages(spark, sf_dir).drop("s_suppkey")))


@query(f"""SELECT k AS seed_id, 's' || k || '.com' AS domain, CAST(i - 1 AS BIGINT) AS page_seq, u || ['', '/contact', '/about', '/deep?a=b+c'][i] AS url_norm, u || ['', '/contact/', '/about', '/deep?a=b%20c&utm_source=q'][i] AS url, CAST([0, 1, 1, 2][i] AS BIGINT) AS depth,
 ['homepage', 'contact', 'about', 'other'][i] AS weight_class FROM {_MADE}, generate_series(1, 4) AS t(i)
UNION ALL SELECT s_suppkey + 1000000, 'none' || s_suppkey || '.org', NULL, NULL, NULL, NULL, 'no page: https://none' || s_suppkey || '.org' FROM supplier""")
def crawl_made(spark, sf_dir):
    """The crawl of these sites, from hosts as typed; a host without pages is an error."""
    pages = _made_pages(spark, sf_dir)
    corpus = pages.select(F.col("s_suppkey").alias("seed_id"), "site", "page_seq", normalize_url(F.col("url")).alias("url_norm"), "url", F.regexp_replace("url", "[.]com/$", ".com").alias("final_url"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("error"), "html")
    seeds = _t(spark, sf_dir, "supplier").select(F.explode(F.array(F.struct(F.col("s_suppkey").alias("seed_id"), F.concat(F.lit(" S"), F.col("s_suppkey"), F.lit(".com/")).alias("query")), F.struct((F.col("s_suppkey") + 1000000).alias("seed_id"), F.concat(F.lit("none"), F.col("s_suppkey"), F.lit(".org")).alias("query")))).alias("s")).select("s.*")
    found = fr.crawl(seeds, parse_pages(corpus))
    return found.select("seed_id", "domain", _long("page_seq").alias("page_seq"), "url_norm", "url", _long("depth").alias("depth"), F.coalesce("weight_class", "error").alias("weight_class"))


# html

_SQL_TEXT = "coalesce(html, '')"
for _pattern, _by in (
    [(r"(?s)<!--.*?-->", "")] + [(rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", "") for t in sorted(rules.SILENT_TAGS)] + [(r"(?i)<br\b[^>]*>", "\n"), (rf"(?i)</?(?:{'|'.join(sorted(rules.BLOCK_TAGS))})\b[^>]*>", "\n"), (r"<[^>]*>", "")]
    + [("&middot;?", "·"), ("&copy;?", "©"), ("&quot;?", '"'), ("&amp;?", "&"), ("[ \t]+", " "), (" ?\n ?", "\n"), ("\n{2,}", "\n"), (r"^\s+|\s+$", "")]
):
    _SQL_TEXT = f"regexp_replace({_SQL_TEXT}, '{_sql(_pattern)}', '{_sql(_by)}', 'g')"


@query(f"SELECT page_id, {_SQL_TEXT} AS text FROM pages")
def html_flattened_text(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", html_text(F.coalesce("html", F.lit(""))).alias("text"))


@query(f"SELECT page_id, {_SQL_TEXT} AS text FROM pages")
def html_parsed_text(spark, sf_dir):
    """The same through the parser: both agree on well-formed pages."""
    return parse_pages(_t(spark, sf_dir, "pages")).select("page_id", "text")


@query("""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')) AS title FROM pages""")
def html_title(spark, sf_dir):
    return parse_pages(_t(spark, sf_dir, "pages")).select("page_id", F.coalesce("title", F.lit("")).alias("title"))


_SQL_ANCHORS = r"""a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*">(.*?)</a>', 1)) AS text,
 generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS seq FROM pages),
r AS (SELECT page_id, url, CAST(seq AS BIGINT) AS seq, replace(href, '&amp;', '&') AS href, replace(text, '&amp;', '&') AS text,
 regexp_extract(url, '^[a-z]+://[^/]+') || replace(href, '&amp;', '&') AS resolved FROM a)"""


def _anchors(spark, sf_dir) -> DataFrame:
    each = parse_pages(_t(spark, sf_dir, "pages")).select("page_id", "url", F.explode("anchors").alias("a"))
    return each.select("page_id", "url", _long("a.seq").alias("seq"), "a.href", "a.text", "a.resolved", "a.in_footer", "a.in_nav")


@query(f"WITH {_SQL_ANCHORS} SELECT page_id, seq, href, text, resolved, false AS in_footer, true AS in_nav FROM r")
def html_anchors(spark, sf_dir):
    return _anchors(spark, sf_dir).drop("url")


@query("SELECT page_id, CAST(NULL AS VARCHAR) AS reason FROM pages")
def needs_browser(spark, sf_dir):
    """No page of the table is a shell or a challenge."""
    parsed = parse_pages(_t(spark, sf_dir, "pages"))
    return parsed.select("page_id", fr.needs_browser(F.lit(200), F.col("html"), F.col("text"), F.col("noscript")).alias("reason"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 IN (1, 2) THEN 'blocked' WHEN c_custkey % 7 = 3 THEN 'csr' WHEN c_custkey % 7 = 4 THEN 'csr' WHEN c_custkey % 7 = 5 THEN 'csr' END AS reason FROM customer""")
def needs_browser_kinds(spark, sf_dir):
    k = F.col("c_custkey") % 7
    page = F.when(k == 2, F.concat(F.lit("<title>Just a moment...</title>"), F.col("c_name"))).when(k == 3, '<div id="root"></div>').when(k == 5, F.repeat(F.lit("<i></i>"), 3000)).otherwise(F.concat(F.lit("<p>"), F.col("c_name")))
    banner = F.when(k == 4, F.array(F.lit("Please enable JavaScript"))).otherwise(F.array().cast("array<string>"))
    return _t(spark, sf_dir, "customer").select("c_custkey", fr.needs_browser(F.when(k == 1, 403).otherwise(200), page, F.lit(""), banner).alias("reason"))


@query("""SELECT c_custkey, c_custkey % 5 IN (0, 2) AS failed FROM customer""")
def seed_failed(spark, sf_dir):
    k = F.col("c_custkey") % 5
    status = F.when(k == 1, 503).when(k == 2, 525).when(k == 3, 404).when(k == 4, 200)
    return _t(spark, sf_dir, "customer").select("c_custkey", fr.seed_failed(status, F.when(k == 0, "").otherwise("<p>x"), F.when(k == 0, "dns: no such host")).alias("failed"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS html, CASE WHEN s_suppkey % 3 = 0 THEN 'non-html content-type: application/pdf' END AS error FROM supplier""")
def content_guard(spark, sf_dir):
    kind = F.when(F.col("s_suppkey") % 3 == 0, "Application/PDF; q=1").otherwise("text/html")
    html, error = fr.guarded_html(F.col("s_name"), kind)
    return _t(spark, sf_dir, "supplier").select("s_suppkey", html.alias("html"), error.alias("error"))


# urls and links

_SQL_NORM = r"""'https://' || regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)), '^www\.', '') || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', '')"""


@query(f"SELECT page_id, {_SQL_NORM} || CASE WHEN url LIKE '%?%' AND url NOT LIKE '%?utm_source=%' THEN '?' || regexp_replace(regexp_extract(url, '\\?([^#]*)', 1), '&ref=x', '') ELSE '' END AS url_norm FROM pages")
def url_normalized(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", normalize_url(F.col("url")).alias("url_norm"))


@query(r"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host FROM pages)
SELECT page_id, host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS registrable, list_extract(string_split(host, '.'), -2) AS label, CAST(NULL AS VARCHAR) AS region FROM u""")
def url_domains(spark, sf_dir):
    host = url_host(F.col("url"))
    return _t(spark, sf_dir, "pages").select("page_id", host.alias("host"), registrable_domain(F.col("url")).alias("registrable"), site_label(host).alias("label"), region_of(host).alias("region"))


_SEEDS = "CASE WHEN c_custkey % 3 = 0 THEN 'http://www.shop' || c_custkey || '.co.uk/be' WHEN c_custkey % 3 = 1 THEN ' Acme' || c_custkey || '.de ' ELSE 'https://x' || c_custkey || '.com/' END"


@query(f"""WITH s AS (SELECT c_custkey, {_SEEDS} AS q FROM customer)
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'www.shop' || c_custkey || '.co.uk' WHEN 1 THEN 'acme' || c_custkey || '.de' ELSE 'x' || c_custkey || '.com' END AS host,
 CASE c_custkey % 3 WHEN 0 THEN 'http://www.shop' || c_custkey || '.co.uk/be, http://shop' || c_custkey || '.co.uk/be'
 WHEN 1 THEN 'https://Acme' || c_custkey || '.de, https://www.Acme' || c_custkey || '.de, http://Acme' || c_custkey || '.de, http://www.Acme' || c_custkey || '.de'
 ELSE 'https://x' || c_custkey || '.com, https://www.x' || c_custkey || '.com, http://x' || c_custkey || '.com, http://www.x' || c_custkey || '.com' END AS tries,
 CASE c_custkey % 3 WHEN 0 THEN 'GB' WHEN 1 THEN 'DE' END AS region FROM s""")
def seed_variants(spark, sf_dir):
    q = F.expr(_SEEDS)
    return _t(spark, sf_dir, "customer").select("c_custkey", seed_host(q).alias("host"), F.array_join(seed_urls(q), ", ").alias("tries"), region_of(seed_host(q)).alias("region"))


_SQL_KEYWORD = "CASE " + " ".join(f"WHEN len([x for x in w if regexp_matches(x, '{_sql(p)}')]) > 0 THEN {n}" for n, p in rules.KEYWORDS) + f" ELSE {rules.NO_KEYWORD} END"
_PATHS = "CASE c_custkey % 8 WHEN 0 THEN '/contact-us.html' WHEN 1 THEN '/de/Impressum' WHEN 2 THEN '/about/team/' || c_custkey WHEN 3 THEN '/google-maps-with-contact-details' WHEN 4 THEN '/help' WHEN 5 THEN '/privacy-policy.php' WHEN 6 THEN '/x' || c_custkey ELSE '/' END"
_LABELS = "CASE c_custkey % 5 WHEN 0 THEN 'Contact Us' WHEN 1 THEN 'Über uns' WHEN 2 THEN 'Read more about our very long story of contact' WHEN 3 THEN 'Legal' ELSE c_name END"


@query(f"""WITH l AS (SELECT c_custkey, {_PATHS} AS path, trim(regexp_replace(lower({_LABELS}), '[^0-9a-z]+', '-', 'g'), '-') AS label FROM customer),
w AS (SELECT c_custkey, [x for x in list_concat([regexp_replace(s, '{_sql(rules.SEGMENT_TAIL)}', '') for s in string_split(lower(path), '/')], [CASE WHEN length(label) <= 30 THEN label ELSE '' END]) if x <> ''] AS w FROM l),
k AS (SELECT c_custkey, {_SQL_KEYWORD} AS kw FROM w)
SELECT c_custkey, CAST(kw AS BIGINT) AS keyword, CAST(kw + CASE WHEN c_custkey % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN c_custkey % 3 = 0 THEN 10 ELSE 0 END - 10 * (c_custkey % 3) AS BIGINT) AS score,
 CASE WHEN c_custkey = 1 THEN 'homepage' WHEN kw >= 90 THEN 'contact' WHEN kw >= 80 THEN 'about' ELSE 'other' END AS weight_class FROM k""")
def link_scores(spark, sf_dir):
    k = F.col("c_custkey")
    links = _t(spark, sf_dir, "customer").select("c_custkey", F.expr(_PATHS).alias("path"), F.expr(_LABELS).alias("text"))
    scored = links.select("c_custkey", keyword_score(F.col("path"), F.col("text")).alias("keyword"))
    return scored.select("c_custkey", _long("keyword").alias("keyword"), _long(link_score(F.col("keyword"), k % 2 == 0, k % 3 == 0, k % 3)).alias("score"), weight_class(F.col("keyword"), k == 1).alias("weight_class"))


_LINKS = "CASE c_custkey % 9 WHEN 0 THEN 'https://a.com/x.PNG?v=1' WHEN 1 THEN 'https://a.com/login' WHEN 2 THEN 'https://a.com/blog/2024/05/x' WHEN 3 THEN 'ftp://a.com/x' WHEN 4 THEN 'https://a.com/page/12' WHEN 5 THEN 'https://a.com/pagers' WHEN 6 THEN 'https://a.com/x.pngs' WHEN 7 THEN 'http://a.com/tagged/' || c_custkey ELSE 'https://a.com/' || c_custkey END"


@query("SELECT c_custkey, c_custkey % 9 IN (5, 6, 7, 8) AS followed FROM customer")
def noise_link_filter(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", followable(F.expr(_LINKS)).alias("followed"))


@query(f"""WITH {_SQL_ANCHORS},
k AS (SELECT page_id, url, seq, resolved, 'https://' || regexp_replace(regexp_replace(regexp_replace(resolved, '^[a-z]+://', ''), '^www\\.', ''), '/+$', '') AS url_norm,
 [x for x in list_concat(string_split(lower(regexp_extract(resolved, '^[a-z]+://[^/]+(.*)$', 1)), '/'), [CASE WHEN length(trim(regexp_replace(lower(text), '[^0-9a-z]+', '-', 'g'), '-')) <= 30 THEN trim(regexp_replace(lower(text), '[^0-9a-z]+', '-', 'g'), '-') ELSE '' END]) if x <> ''] AS w,
 lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS site FROM r),
s AS (SELECT site, page_id, seq, url_norm, {_SQL_KEYWORD} AS kw FROM k),
f AS (SELECT *, row_number() OVER (PARTITION BY site, url_norm ORDER BY page_id, seq) AS rn FROM s)
SELECT site, url_norm, CAST(kw AS BIGINT) AS keyword, CAST(kw + 10 - 10 AS BIGINT) AS score, row_number() OVER (PARTITION BY site ORDER BY kw DESC, page_id, seq) AS place FROM f WHERE rn = 1""")
def link_frontier(spark, sf_dir):
    """Each host's distinct links, best first."""
    parsed = parse_pages(pages_of(_read(spark, sf_dir, "pages")))
    return fr.frontier(fr.links(parsed)).select("site", "url_norm", _long("keyword").alias("keyword"), _long("score").alias("score"), _long("place").alias("place"))


def _own_crawl(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every host as a seed, its own pages as the corpus. A seed is its host's first page, without scheme, query and fragment."""
    pages = pages_of(_read(spark, sf_dir, "pages"))
    corpus = pages.withColumns({"seed_id": F.xxhash64("site"), "url_norm": normalize_url(F.col("url")), "final_url": F.col("url"), "status": F.lit(200), "error": F.lit(None).cast("string")})
    seeds = pages.groupBy(F.xxhash64("site").alias("seed_id")).agg(F.min_by(F.concat("site", url_path(F.col("url"))), "page_seq").alias("query"))
    return seeds, corpus


@query(name="crawl_replay")
def _crawl(spark, sf_dir):
    """Replays a crawl of every host against its own pages."""
    seeds, corpus = _own_crawl(spark, sf_dir)
    return fr.crawl(seeds, parse_pages(corpus))


@query(name="scrape_contacts")
def _scrape(spark, sf_dir):
    """Seeds to records: the crawl, then the contacts of the pages it keeps."""
    return scrape_contacts(*_own_crawl(spark, sf_dir))


# e-mail

_SQL_EMAIL = f"regexp_extract_all(coalesce(text, ''), '(?i){_sql(rules.EMAIL_PLAIN)}', 0)"
_SQL_FALSE = f"""(regexp_matches(v, '(?i){_sql(rules.ASSET_TAIL)}') OR length(regexp_extract(v, '^(.*)@', 1)) > 64 OR regexp_matches(regexp_extract(v, '^(.*)@', 1), '[0-9a-f]{{24}}')
 OR {' OR '.join(f"regexp_extract(v, '@(.*)$', 1) = '{d}' OR regexp_extract(v, '@(.*)$', 1) LIKE '%.{d}'" for d in rules.PLACEHOLDER_DOMAINS)}
 OR NOT regexp_matches(list_extract(string_split(v, '.'), -1), '^[a-z]{{2,24}}$'))"""


@query(f"SELECT doc_id, v AS email, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, lower(unnest({_SQL_EMAIL})) AS v FROM documents) GROUP BY doc_id, v")
def email_extract(spark, sf_dir):
    found = found_emails(scan_safe(F.coalesce("text", F.lit(""))))
    return _t(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("v")).groupBy("doc_id", F.lower("v").alias("email")).agg(_long(F.count("*")).alias("n"))


_ADDRESSES = "CASE c_custkey % 10 WHEN 0 THEN 'logo@2x.png' WHEN 1 THEN 'user@example.com' WHEN 2 THEN 'foo@mail.example.com' WHEN 3 THEN '0123456789abcdef01234567@acme.com' WHEN 4 THEN repeat('a', 65) || '@acme.com' WHEN 5 THEN 'x@acme.c0m' WHEN 6 THEN 'a@sentry.io' WHEN 7 THEN 'a@notsentry.io' WHEN 8 THEN 'info@acme' || c_custkey || '.co.uk' ELSE 'sales' || c_custkey || '@acme.com' END"


@query(f"SELECT c_custkey, v AS email, {_SQL_FALSE} AS dropped FROM (SELECT c_custkey, {_ADDRESSES} AS v FROM customer)")
def email_false_positives(spark, sf_dir):
    v = F.expr(_ADDRESSES)
    return _t(spark, sf_dir, "customer").select("c_custkey", v.alias("email"), false_email(v).alias("dropped"))


@query("SELECT c_custkey, lower(replace(c_name, '#', '.')) || '@acme.com' AS email FROM customer")
def email_cf_decode(spark, sf_dir):
    """Addresses coded with a key of their own, decoded again."""
    rows = _t(spark, sf_dir, "customer").withColumns({"email": F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@acme.com")), "key": (F.col("c_custkey") % 255 + 1).cast("int")})
    byte = lambda n: F.lower(F.lpad(F.hex(n), 2, "0"))
    coded = F.concat(byte(F.col("key").cast("long")), F.array_join(F.transform(F.filter(F.split("email", ""), lambda c: c != ""), lambda c: byte(F.ascii(c).bitwiseXOR(F.col("key")).cast("long"))), ""))
    return rows.select("c_custkey", coded.alias("code")).select("c_custkey", decoded_cfemail(F.col("code")).alias("email"))


@query("SELECT c_custkey, CAST(CASE c_custkey % 5 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN -1 WHEN 3 THEN -2 ELSE 0 END AS BIGINT) AS bonus FROM customer")
def email_bonuses(spark, sf_dir):
    k = F.col("c_custkey") % 5
    mail = F.when(k == 0, "info@mail.acme.co.uk").when(k == 1, F.concat(F.lit("joe"), F.col("c_custkey"), F.lit("@acme.co.uk"))).when(k == 2, "sales@gmail.com").when(k == 3, "joe@web.de").otherwise("joe@other.com")
    return _t(spark, sf_dir, "customer").select("c_custkey", _long(email_bonus(mail, F.lit("acme.co.uk"))).alias("bonus"))


# the tables' addresses are of placeholder hosts, which the engine drops; both engines read them as of another host
_REAL_HOST = "replace(coalesce(text, ''), 'example.', 'acme-mail.')"


@query(f"""WITH h AS (SELECT DISTINCT source AS site, lower(v) AS v, doc_id FROM (SELECT source, doc_id, unnest({_SQL_EMAIL.replace("coalesce(text, '')", _REAL_HOST)}) AS v FROM documents)),
k AS (SELECT * FROM h WHERE NOT {_SQL_FALSE}),
e AS (SELECT site, v, count(*) + CASE WHEN regexp_extract(v, '^(.*)@', 1) IN ({", ".join(f"'{w}'" for w in rules.GENERIC_LOCALS)}) THEN 1 ELSE 0 END AS score, min(doc_id) AS first_doc FROM k GROUP BY site, v),
s AS (SELECT site, v, doc_id, row_number() OVER (PARTITION BY site, v ORDER BY doc_id) AS rn FROM k)
SELECT e.site, e.v AS email, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY e.site ORDER BY score DESC, first_doc, e.v) AS rank,
 (SELECT string_agg(CAST(doc_id AS VARCHAR), ', ' ORDER BY doc_id) FROM s WHERE s.site = e.site AND s.v = e.v AND rn <= 10) AS sources FROM e""")
def email_ranking(spark, sf_dir):
    """Addresses of each source, merged and ranked as the pages of a site are; a document is a page."""
    docs = _t(spark, sf_dir, "documents").withColumn("site", F.col("source"))
    shown = F.array_sort(F.array_distinct(F.transform(found_emails(scan_safe(F.expr(_REAL_HOST))), F.lower)))
    each = docs.select("site", F.col("doc_id").alias("page_seq"), F.col("doc_id").cast("string").alias("page_url"), F.posexplode(shown).alias("hit_seq", "value"))
    no = F.lit(False)
    hits = each.filter(~false_email(F.col("value"))).withColumns({"field": F.lit("emails"), "key": F.col("value"), "handle": F.lit(None).cast("string"), "from_href": no, "in_footer": no, "region_match": no, "weight": F.lit(1), "is_homepage": no})
    ranked = entries(hits, docs.select("site", F.col("site").alias("domain")).distinct())
    return ranked.select("site", F.col("value").alias("email"), _long("score").alias("score"), _long("rank").alias("rank"), F.array_join("sources", ", ").alias("sources"))


# phone

_SQL_PHONE = f"unnest(regexp_extract_all(coalesce(text, ''), '{_sql(rules.PHONE)}', 0))"
_SQL_JUNK = " OR ".join(f"regexp_matches(v, '{_sql(p)}')" for p in rules.PHONE_JUNK)


def _phones(spark, sf_dir) -> DataFrame:
    # most places hold nothing a number could begin with; the lookahead settles them at once, and (?d) lets a dot be all but a line feed
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?d)(?=[0-9(+])" + rules.PHONE), F.lit(0))
    return _t(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("v")).filter(F.length(digits(F.col("v"))) >= rules.PHONE_DIGITS[0])


@query(f"""SELECT DISTINCT doc_id, trim(v) AS phone FROM (SELECT doc_id, {_SQL_PHONE} AS v FROM documents)
WHERE length(regexp_replace(v, '[^0-9]', '', 'g')) >= 7 AND NOT regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')""")
def phone_extract(spark, sf_dir):
    """Number-like texts of each document, as the engine's own scan finds them; the words before a number, which its reader weighs, do not count here."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.explode(shown_numbers(F.coalesce("text", F.lit("")))).alias("phone")).select("doc_id", F.trim("phone").alias("phone")).distinct()


@query(f"""WITH h AS (SELECT doc_id, {_SQL_PHONE} AS v FROM documents), d AS (SELECT doc_id, v, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM h)
SELECT doc_id, v AS phone, length(d) > 15 OR len(list_distinct(string_split(d, ''))) = 1 OR {_SQL_JUNK} AS junk FROM d WHERE length(d) >= 7""")
def phone_junk_filter(spark, sf_dir):
    return _phones(spark, sf_dir).select("doc_id", F.col("v").alias("phone"), is_junk(F.col("v")).alias("junk"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'GB' WHEN 1 THEN 'DE' WHEN 2 THEN 'AU' END AS region FROM customer")
def phone_region(spark, sf_dir):
    k = F.col("c_custkey") % 4
    host = F.when(k == 0, "sub.example.co.uk").when(k == 1, "acme.de").when(k == 2, "shop.example.com.au").otherwise("example.io")
    return _t(spark, sf_dir, "customer").select("c_custkey", region_of(host).alias("region"))


# socials

_OUT = "https://l.facebook.com" + "/l.php?u="
#: platform: two urls with a profile, their value and key, and one that names none; {n} is a name of the row
_EXAMPLES = {
    "linkedins": ("https://fr.linkedin.com/company/Ac{n}/about?utm_source=x", "https://www.linkedin.com/company/Ac{n}", "company/ac{n}", "https://www.linkedin.com/feed/Ac{n}"),
    "twitters": ("twitter.com/@Ac{n}?s=20&amp;t=1", "https://x.com/Ac{n}", "ac{n}", "https://x.com/share?url=Ac{n}"),
    "instagrams": ("https://www.instagram.com/stories/Ac{n}./1", "https://www.instagram.com/Ac{n}", "ac{n}", "https://instagram.com/p/Ac{n}"),
    "facebooks": (_OUT + "https%3A%2F%2Fm.facebook.com%2FAcme{n}%2F&h=1", "https://www.facebook.com/Acme{n}", "acme{n}", "https://facebook.com/sharer.php?u=Acme{n}"),
    "youtubes": ("https://m.youtube.com/user/Ac{n}/videos", "https://www.youtube.com/user/Ac{n}", "user/ac{n}", "https://youtu.be/Ac{n}"),
    "tiktoks": ("https://www.tiktok.com/@Ac{n}/video/7", "https://www.tiktok.com/@Ac{n}", "ac{n}", "https://www.tiktok.com/tag/Ac{n}"),
    "pinterests": ("https://www.pinterest.co.uk/Ac{n}/board", "https://www.pinterest.com/Ac{n}", "ac{n}", "https://pinterest.com/pin/{n}"),
    "discords": ("https://discordapp.com/invite/Ac{n}", "https://discord.gg/Ac{n}", "invite/Ac{n}", "https://discord.com/channels/{n}"),
    "snapchats": ("https://snapchat.com/@Ac{n}?share=1", "https://www.snapchat.com/add/Ac{n}", "ac{n}", "https://snapchat.com/discover/Ac{n}"),
    "threads": ("https://www.threads.com/@Ac{n}/post/C1", "https://www.threads.net/@Ac{n}", "ac{n}", "https://threads.net/t/Ac{n}"),
    "telegrams": ("https://telegram.me/s/Acme{n}/12", "https://t.me/Acme{n}", "acme{n}", "https://t.me/share/url?url=Acme{n}"),
    "reddits": ("https://old.reddit.com/u/Ac{n}/comments", "https://www.reddit.com/user/Ac{n}", "user/ac{n}", "https://reddit.com/submit/Ac{n}"),
    "whatsapps": ("https://api.whatsapp.com/send?text=hi&phone=%2B4917000{n}", "https://wa.me/4917000{n}", "wa.me/4917000{n}", "https://wa.me/message/Ac{n}"),
    "githubs": ("https://github.com/orgs/Ac{n}/people", "https://github.com/Ac{n}", "ac{n}", "https://github.com/features/Ac{n}"),
    "blueskys": ("https://bsky.app/profile/Ac{n}.bsky.social/post/1", "https://bsky.app/profile/ac{n}.bsky.social", "ac{n}.bsky.social", "https://bsky.app/search/Ac{n}"),
    "mediums": ("https://Ac{n}.medium.com/story-1", "https://ac{n}.medium.com", "ac{n}", "https://medium.com/Ac{n}"),
    "calendlys": ("https://calendly.com/Ac{n}/30min", "https://calendly.com/Ac{n}", "ac{n}", "https://calendly.com/pricing/Ac{n}"),
}


def _filled(text: str) -> str:
    return "'" + text.replace("{n}", "' || lpad(CAST(c_custkey AS VARCHAR), 7, '1') || '") + "'"


def _social_query(platform: str) -> None:
    found, value, key, none = map(_filled, _EXAMPLES[platform])

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        as_spark = lambda s: F.expr(s.replace("VARCHAR", "STRING"))
        rows = _t(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, as_spark(none)).otherwise(as_spark(found)).alias("value"))
        return with_profile(rows, platform).select("c_custkey", F.col("profile.value").alias("profile"), F.col("profile.key").alias("key"))

    run.__doc__ = f"Canonical {platform} profiles of derived links."
    query(f"SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN {value} END AS profile, CASE WHEN c_custkey % 4 <> 0 THEN {key} END AS key FROM customer", f"social_{platform}")(run)


for _platform in rules.PLATFORMS:
    _social_query(_platform)


@query("SELECT s_suppkey, s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 AS dropped FROM supplier")
def social_vendor_credit(spark, sf_dir):
    k = F.col("s_suppkey")
    return _t(spark, sf_dir, "supplier").select("s_suppkey", F.coalesce(vendor_credit(F.when(k % 2 == 0, "Wix").otherwise("acme"), F.when(k % 3 == 0, "wix").otherwise("acme")), F.lit(False)).alias("dropped"))


# merging and the result surface

_SQL_HITS = "h AS (SELECT c_nationkey AS site, c_mktsegment AS key, c_custkey AS page, 1 + c_custkey % 5 AS weight, c_custkey % 7 = 0 AS home, c_custkey % 11 = 0 AS footer, c_custkey % 13 = 0 AS href FROM customer)"


def _hits(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    return _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("site"), F.col("c_mktsegment").alias("key"), k.alias("page"), (k % 5 + 1).alias("weight"), (k % 7 == 0).alias("home"), (k % 11 == 0).alias("footer"), (k % 13 == 0).alias("href"))


@query(f"""WITH {_SQL_HITS} SELECT CAST(site AS BIGINT) AS site, key, CAST(sum(weight) + CASE WHEN bool_or(home) THEN 3 ELSE 0 END + CASE WHEN bool_or(footer) THEN 2 ELSE 0 END + CASE WHEN bool_or(href) THEN 2 ELSE 0 END AS BIGINT) AS score FROM h GROUP BY site, key""")
def prominence_score(spark, sf_dir):
    from trawlkit.operators.merge import prominence

    summed = _hits(spark, sf_dir).groupBy("site", "key").agg(F.sum("weight").alias("weights"), F.max("home").alias("is_homepage"), F.max("footer").alias("in_footer"), F.max("href").alias("from_href"))
    return summed.select(_long("site").alias("site"), "key", _long(prominence(F.col("weights"))).alias("score"))


@query(f"""WITH {_SQL_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY site, key ORDER BY weight DESC, page) AS rn FROM h)
SELECT CAST(site AS BIGINT) AS site, key, string_agg(CAST(page AS VARCHAR), ', ' ORDER BY rn) AS sources FROM r WHERE rn <= 10 GROUP BY site, key""")
def top_sources(spark, sf_dir):
    no = F.lit(False)
    hits = _hits(spark, sf_dir).select(_long("site").alias("site"), F.col("page").alias("page_seq"), F.col("page").cast("string").alias("page_url"), F.lit(0).alias("hit_seq"), F.lit("githubs").alias("field"), "key", F.col("key").alias("value"), F.lit("").alias("handle"), no.alias("from_href"), no.alias("in_footer"), no.alias("region_match"), "weight", no.alias("is_homepage"))
    found = entries(hits, hits.select("site", F.lit("none.org").alias("domain")).distinct())
    return found.select("site", "key", F.array_join("sources", ", ").alias("sources"))


@query("SELECT 's' || s_suppkey || '.com' AS domain, left('ConnectionError: ' || s_name, 200) AS error, CAST(0 AS BIGINT) AS n_emails FROM supplier")
def failed_sites(spark, sf_dir):
    seeds = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey"), F.lit(".com")).alias("domain"), F.concat(F.lit("ConnectionError: "), F.col("s_name")).alias("error"))
    return error_rows(seeds).select("domain", "error", _long(F.size("emails")).alias("n_emails"))


def _records(spark, sf_dir) -> DataFrame:
    """Small records in the shape of the surface, from suppliers."""
    k = F.col("s_suppkey")
    item = lambda v: F.struct(v.alias("value"), F.array(F.concat(F.lit("https://s"), k, F.lit(".com/"))).alias("sources"), F.lit(True).alias("is_likely_official"))
    mails = F.when(k % 3 == 0, F.array().cast("array<struct<value:string,sources:array<string>,is_likely_official:boolean>>")).otherwise(F.array(item(F.concat(F.lit("info@s"), k, F.lit(".com"))), item(F.concat(F.lit("a@s"), k, F.lit(".com")))))
    return _t(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k, F.lit(".com")).alias("domain"), mails.alias("emails"), F.when(k % 5 == 0, "timeout").alias("error"), F.col("s_acctbal").alias("balance"), (k % 2 == 0).alias("active"), _long("s_nationkey").alias("nation"))


_SQL_RECORDS = "r AS (SELECT 's' || s_suppkey || '.com' AS domain, s_suppkey % 3 <> 0 AS has_emails, CASE WHEN s_suppkey % 5 = 0 THEN 'timeout' END AS error, s_acctbal AS balance, s_suppkey % 2 = 0 AS active, CAST(s_nationkey AS BIGINT) AS nation FROM supplier)"


def _filter_query(name: str, where: str, *filters: tuple) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return results.apply_filters(_records(spark, sf_dir), list(filters)).select("domain", "error", "balance", "nation")

    query(f"WITH {_SQL_RECORDS} SELECT domain, error, balance, nation FROM r WHERE {where}", f"filter_{name}")(run)


_filter_query("search_text", "lower(domain) LIKE '%1.c%'", ("search", "domain", " 1.C "))
_filter_query("min_max", "balance >= 1000 AND balance <= 5000", ("min", "balance", 1000), ("max", "balance", 5000))
_filter_query("is_true", "active", ("is_true", "active"))
_filter_query("is_false", "NOT active", ("is_false", "active"))
_filter_query("is_null", "error IS NULL", ("is_null", "error"))
_filter_query("has_error", "error IS NOT NULL", ("is_not_null", "error"))
_filter_query("has_emails", "has_emails", ("truthy", "emails"))
_filter_query("no_emails", "NOT has_emails", ("falsy", "emails"))
_filter_query("single_select", "nation = 3", ("equals", "nation", 3))
_filter_query("multi_select", "nation IN (1, 5, 7)", ("any_of", "nation", [1, 5, 7]))
_filter_query("blank_filters", "true", ("search", "domain", " "), ("min", "balance", None), ("any_of", "nation", []), ("truthy", "emails", False))
_filter_query("conjunction", "has_emails AND error IS NULL AND active", ("truthy", "emails"), ("is_null", "error"), ("is_true", "active"))


@query(f"WITH {_SQL_RECORDS}, n AS (SELECT domain, balance, row_number() OVER (ORDER BY domain) AS place FROM r) SELECT domain, balance FROM n WHERE place BETWEEN 26 AND 50 OR (place <= 25 AND (SELECT count(*) FROM r) <= 25)")
def sort_and_page(spark, sf_dir):
    """Second page of 25, by domain; out of range is the first page."""
    return results.request(_records(spark, sf_dir), sort="domain", page=2).select("domain", "balance")


@query("SELECT 's' || s_suppkey || '.com' AS domain, m || s_suppkey || '.com' AS email, true AS is_likely_official, 'https://s' || s_suppkey || '.com/' AS sources FROM supplier, (VALUES ('info@s'), ('a@s')) AS v(m) WHERE s_suppkey % 3 <> 0")
def view_email_list(spark, sf_dir):
    return results.email_list(_records(spark, sf_dir))


@query("SELECT 's' || s_suppkey || '.com' AS domain, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'info@s' || s_suppkey || '.com, a@s' || s_suppkey || '.com' END AS emails FROM supplier")
def view_joined_values(spark, sf_dir):
    return _records(spark, sf_dir).select("domain", results.joined("emails"))


@query("SELECT doc_id, translate(coalesce(text, ''), 'éèêçàâîïôöûùüäñóíáúßÉÈÊÇÀÂÎÏÔÖÛÙÜÄÑÓÍÁÚ', 'eeecaaiioouuuanoiauß' || 'EEECAAIIOOUUUANOIAU') AS text FROM documents")
def export_accent_folding(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", fold_accents(F.coalesce("text", F.lit(""))).alias("text"))


@query("""WITH s AS (SELECT c_custkey AS submission_id, [' ' || c_name || ' ', '', 'b.com', '  ', 'b.com'] AS w FROM customer),
e AS (SELECT submission_id, unnest(w) AS q, generate_subscripts(w, 1) - 1 AS place FROM s)
SELECT submission_id, CAST(place AS BIGINT) AS place, trim(q) AS task_name, false AS is_all_task, 'pending' AS status FROM e WHERE trim(q) <> ''
UNION ALL SELECT submission_id, -1, 'All Task', true, 'pending' FROM s""")
def task_split(spark, sf_dir):
    given = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("submission_id"), F.array(F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")), F.lit(""), F.lit("b.com"), F.lit("  "), F.lit("b.com")).alias("websites"))
    return split_tasks(given).withColumn("place", _long("place"))


@query("""SELECT c_custkey, CASE WHEN s = 0 THEN '0s' ELSE trim(concat_ws(' ', CASE WHEN s // 86400 > 0 THEN s // 86400 || 'd' END, CASE WHEN s // 3600 % 24 > 0 THEN s // 3600 % 24 || 'h' END, CASE WHEN s // 60 % 60 > 0 THEN s // 60 % 60 || 'm' END, CASE WHEN s % 60 > 0 THEN s % 60 || 's' END)) END AS took FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 61 ELSE 90061 END AS s FROM customer)""")
def task_duration(spark, sf_dir):
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + s)
    k = F.col("c_custkey")
    return _t(spark, sf_dir, "customer").select("c_custkey", duration(at(F.lit(0)), F.when(k % 3 == 0, at(k * 61)), at(F.lit(90_061))).alias("took"))
