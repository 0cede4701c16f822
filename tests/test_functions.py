"""Column functions against expected values, and against Python's own regular expressions."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trawlkit.functions import numbering, rules, urls
from trawlkit.functions.emails import decoded_cfemail, false_email, found_emails, is_email, plain_address_text
from trawlkit.functions.rules import java
from trawlkit.functions.socials import detected, with_profile
from trawlkit.functions.tech import detect_technologies, plain_headers
from trawlkit.functions.text import fold_accents, scan_safe
from trawlkit.operators.parse import parse_page
from trawlkit.operators.phones import junk, page_phones


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


FB, OUT = "https://www.facebook.com/", "https://l.facebook.com/l.php"
PROFILES = [
    ("linkedins", "https://www.linkedin.com/school/MIT", "https://www.linkedin.com/school/MIT", "school/mit"),
    ("linkedins", "https://linkedin.com/feed", None, None),
    ("twitters", "http://www.twitter.com/Oak?lang=en", "https://x.com/Oak", "oak"),
    ("twitters", "https://x.com/intent/tweet", None, None),
    ("twitters", "https://evilx.com/Oak", None, None),
    ("instagrams", "instagr.am/oak.", "https://www.instagram.com/oak", "oak"),
    ("instagrams", "https://instagram.com/reel/abc", None, None),
    ("facebooks", "https://facebook.com/profile.php?id=12345&sk=about", FB + "profile.php?id=12345", "id/12345"),
    ("facebooks", "https://facebook.com/people/Oak-Mill/100", "https://www.facebook.com/people/Oak-Mill/100", "people/100"),
    ("facebooks", "https://facebook.com/login.php", None, None),
    ("facebooks", OUT + "?u=https%3A%2F%2Fl.facebook.com%2Fl.php%3Fu%3Dhttps%253A%252F%252Ffb.com%252Foakmill", "https://www.facebook.com/oakmill", "oakmill"),
    ("facebooks", OUT, None, None),
    ("youtubes", "https://youtube.com/channel/UCaB", "https://www.youtube.com/channel/UCaB", "channel/UCaB"),
    ("youtubes", "https://youtube.com/@Oak", "https://www.youtube.com/@Oak", "@oak"),
    ("youtubes", "https://youtube.com/watch?v=1", None, None),
    ("tiktoks", "https://m.tiktok.com/@Oak.", "https://www.tiktok.com/@Oak", "oak"),
    ("pinterests", "https://uk.pinterest.com/Oak/b", "https://www.pinterest.com/Oak", "oak"),
    ("discords", "https://canary.discord.com/users/77", "https://discord.com/users/77", "users/77"),
    ("discords", "discord.gg/AbC", "https://discord.gg/AbC", "invite/AbC"),
    ("snapchats", "https://snapchat.com/add/Oak", "https://www.snapchat.com/add/Oak", "oak"),
    ("threads", "https://threads.net/@oak.mill", "https://www.threads.net/@oak.mill", "oak.mill"),
    ("telegrams", "https://t.me/+AbCdEf", "https://t.me/+AbCdEf", "+AbCdEf"),
    ("telegrams", "https://t.me/joinchat/XyZ", "https://t.me/joinchat/XyZ", "joinchat/XyZ"),
    ("telegrams", "https://t.me/share/url", None, None),
    ("reddits", "https://old.reddit.com/r/Oak", "https://www.reddit.com/r/Oak", "r/oak"),
    ("whatsapps", "https://chat.whatsapp.com/invite/AbCdEfGhIjKlMnOp", "https://chat.whatsapp.com/AbCdEfGhIjKlMnOp", "chat/AbCdEfGhIjKlMnOp"),
    ("whatsapps", "https://api.whatsapp.com/send?text=x", None, None),
    ("githubs", "https://github.com/Oak/repo", "https://github.com/Oak", "oak"),
    ("githubs", "https://github.com/pricing", None, None),
    ("blueskys", "https://bsky.app/profile/Oak.bsky.social.", "https://bsky.app/profile/oak.bsky.social", "oak.bsky.social"),
    ("mediums", "https://oak-mill.medium.com/x", "https://oak-mill.medium.com", "oak-mill"),
    ("mediums", "https://medium.com/oak", None, None),
    ("calendlys", "https://calendly.com/d/aBc-123", "https://calendly.com/d/aBc-123", "d/abc-123"),
]


def test_canonical_profiles(spark):
    rows = spark.createDataFrame([(i, p, u) for i, (p, u, _, _) in enumerate(PROFILES)], "i int, platform string, value string")
    got = {r.i: r.profile for r in with_profile(rows, F.col("platform")).collect()}
    for i, (p, url, value, key) in enumerate(PROFILES):
        found = got[i]
        assert (found and found.value, found and found.key) == (value, key), (p, url, found)


def test_patterns_read_alike_in_java_and_python(spark):
    texts = [
        " ".join(u for _, u, _, _ in PROFILES), "KKey twitter.com/Koak 日本twitter.com/oak", 'href="https://github.com/Oak/x" (facebook.com/oak.mill)',
        "a.b+c@d-e.co.uk, \"quoted x\"@y.org x@[127.0.0.1] 1@2.3 a@b", "+1 (415) 555-2671 00 49 30 1234567 413-577-1234 2018-11-10 10.0.0.1",
    ]
    for name, pattern in {**rules.PLATFORM_PATTERN, "email": rules.EMAIL, "phone": rules.PHONE}.items():
        got = column(spark, texts, lambda v: F.regexp_extract_all(v, F.lit(java(pattern)), F.lit(0)))
        assert got == [[m[0] for m in re.finditer(pattern, t, re.I | re.A)] for t in texts], name


def test_escaped_slashes_are_scanned_again(spark):
    assert column(spark, ['"https:\\/\\/instagram.com\\/oak"'], lambda v: detected(v, "instagrams")) == [["https://instagram.com/oak"]]


def test_false_emails(spark):
    bad = ["logo@2x.png", "user@example.com", "a@mail.example.com", "0123456789abcdef01234567@a.com", "a" * 65 + "@a.com", "a@b.c0m"]
    good = ["a@notexample.com", "info@oak.co.uk", "a@b.museum"]
    assert column(spark, bad + good, false_email) == [True] * len(bad) + [False] * len(good)
    assert column(spark, ["a@b.com", "a@b.com,c@d.com", "x a@b.com", "a@b.com\n"], is_email) == [True, False, False, False]


def test_coded_addresses(spark):
    assert column(spark, ["73171205163312101e165e071600075d101c1e", "zz", "7", None], decoded_cfemail) == ["dave@acme-test.com", None, None, None]


@pytest.mark.parametrize(
    "text,plain",
    [("a [at] b (dot) com", "a@b.com"), ("john at oak dot com", "john@oak.com"), ("we met at the office", "we met at the office"), ("x＠y．com", "x@y.com"), ("john@oak dot com", "john@oak.com"), ("a &commat; b", "a @ b"), ("a {arobase} b [punkt] de", "a@b.de")],
)
def test_disguised_addresses(text, plain):
    assert plain_address_text(text) == plain


def test_regions_and_domains(spark):
    hosts = ["sub.example.co.uk", "example.com", "example.de", "shop.example.com.au", "example.us", "example.fr", "example.io", "example.co", ""]
    assert column(spark, hosts, urls.region_of) == ["GB", None, "DE", "AU", "US", "FR", None, None, None]
    names = ["www.acme.co.uk", "a.b.acme.com", "127.0.0.1", "localhost", "www.shop.localhost", "acme.github.io", "co.uk"]
    expected = ["acme.co.uk", "acme.com", "127.0.0.1", "localhost", "shop.localhost", "github.io", "co.uk"]
    assert column(spark, names, urls.registrable_host) == expected
    assert [urls.registrable_name(n) for n in names] == expected


@given(st.text(alphabet="abAB./?&=#%+-_:@ w", max_size=40))
@settings(max_examples=300, deadline=None)
def test_normalized_is_idempotent(text):
    once = urls.normalized("https://host.com/" + text)
    assert urls.normalized(once) == once


def test_normalized_forms(spark):
    urls_in = ["http://WWW.Acme.com/a/?utm_source=x&b=2&a=1#f", "acme.com", "https://acme.com/a?x"]
    assert [urls.normalized(u) for u in urls_in] == ["https://acme.com/a?a=1&b=2", "https://acme.com", "https://acme.com/a?x="]
    assert column(spark, urls_in, urls.normalize_url) == ["https://acme.com/a?a=1&b=2", "https://acme.com", "https://acme.com/a?x="]


def test_junk_numbers():
    assert all(map(junk, ["1200 2015", "950 2017", "000123456", "336359125457", "49.36.137.230", "2019-2020", "52.519060", "1111111", "12345"]))
    assert not junk("84591203")


def test_page_numbers():
    page = parse_page("https://a.dk/", "<p>CVR 40596860. Ring +45 41 11 10 75. Stand: 31.07.2026. VAT DE123456789. HRB 12345678</p>")
    valid, unsure = page_phones(page["text"], page["anchors"], "DK")
    # the piece that a space-separated shape cuts off is folded in when the site's entries merge
    assert [p["value"] for p in valid] == ["+4541111075"] and [p["value"] for p in unsure] == ["+45 41 11 10"]
    assert numbering.same_number("+4541111075", "+45 41 11 10", False)
    page = parse_page("https://a.com/", "<a href='tel:12-345-678-901234'>x</a>")
    valid, _ = page_phones(page["text"], page["anchors"], None)
    assert [(p["value"], p["key"], p["from_href"]) for p in valid] == [("12345678901234", "12345678901234", True)]
    valid, unsure = page_phones("Berlin 030 1234567, order 84591203, US (415) 555-2671", [{"href": "tel:+14155552671", "in_footer": True}], "DE", ["+4930999999999"])
    assert [p["key"] for p in valid] == ["+14155552671", "+4930999999999", "+49301234567"] and [p["key"] for p in unsure] == ["84591203"]
    assert valid[0]["in_footer"] and valid[2]["region_match"] and not valid[0]["region_match"]


def test_same_number():
    same = numbering.same_number
    assert same("+14155552671", "415.555.2671", False) and not same("+14152331234", "52 33 12 34", False)
    assert same("+4552331234", "52 33 12 34", False) and same("+442031234567", "02031234567", False)
    assert same("+14155552671", "+1 415 55", False) and not same("+14155552671", "5552671", False) and same("+14155552671", "5552671", True)


@given(st.text(alphabet="0123456789 ()+-.x", max_size=40))
@settings(max_examples=300, deadline=None)
def test_scanned_is_finditer(text):
    pattern = re.compile(rules.PHONE)
    assert [m.span() for m in numbering.scanned(pattern, text)] == [m.span() for m in pattern.finditer(text)]


@given(st.integers(1, 400))
@settings(max_examples=12, deadline=None)
def test_guard_keeps_tokens_up_to_its_length(spark, n):
    kept = column(spark, ["a " + "x" * n], scan_safe)[0]
    assert ("x" * n in kept) == (n <= rules.LONG_TOKEN)


def test_long_texts_are_scanned_whole(spark):
    text = "word " * 310_000 + "end@oak-mill.com +1 415 555 2671"
    assert column(spark, [text], lambda v: found_emails(scan_safe(v)), "string") == [["end@oak-mill.com"]]
    assert [p["value"] for p in page_phones(text, [], None)[0]] == ["+14155552671"]


def test_accents(spark):
    assert column(spark, ["Éàü ñ ß z", None], fold_accents) == ["Eau n ß z", None]


def test_technologies(spark):
    html = '<link href="/wp-content/x.css"><meta name="generator" content="WordPress 6.4.2"><script src="jquery-3.7.1.min.js">'
    df = spark.createDataFrame([(html, {"Server": ["nginx/1.2"], "X-Powered-By": ["PHP/8.1", "x"]}), (None, {}), ("<p>nothing", {})], "html string, headers map<string,array<string>>")
    rows = [r[0] for r in df.select(detect_technologies(F.col("html"), plain_headers(F.col("headers")))).collect()]
    assert [(t.name, t.versions) for t in rows[0]] == [("jQuery", ["3.7.1"]), ("Nginx", ["1.2"]), ("PHP", ["8.1"]), ("WordPress", ["6.4.2"])]
    assert rows[1] == [] and rows[2] == []


def test_parse_flags():
    p = parse_page("https://a.com/x/", '<div class="Main-Menu"><a href="../b">B <i>c</i></a></div><footer><p><a href=" mailto:x@y.z ">m</a><noscript>Enable JavaScript</noscript></footer><a href="">e</a><a href="http://[bad">z</a>')
    assert [(a["href"], a["resolved"], a["text"], a["in_footer"], a["in_nav"]) for a in p["anchors"]] == [("../b", "https://a.com/b", "B c", False, True), ("mailto:x@y.z", None, "m", True, False), ("http://[bad", None, "z", False, False)]
    assert p["noscript"] == ["Enable JavaScript"] and p["text"] == "B c\nm\nez" and p["title"] is None
