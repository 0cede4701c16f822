"""Whole pages to contact records: extraction order, merging, ranking, layout."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trawlkit.functions import rules
from trawlkit.operators.batches import PIECE_BYTES
from trawlkit.operators.parse import parse_pages
from trawlkit.operators.phones import with_phones
from trawlkit.plans.contacts import contacts, error_rows, laid_out, page_hits
from trawlkit.plans import results

PAGES = "site string, page_seq int, url string, html string"

CONTACT = """<html><head><title> Our   office </title><meta name="Description" content="What  we do"></head><body>
<header class="top"><a href="/about-us">About</a></header>
<div>write to jo<b>hn</b>@oak-mill.com or press (at) oak-mill (dot) com, sales at oak-mill dot com. We met at the office.</div>
<p>logo@2x.png user@example.com abcdefabcdefabcdefabcdef@oak-mill.com</p>
<p data-cfemail="42232c2c0223217b6c2d30">[email protected]</p>
<div id="site-FOOTER"><a href="mailto:Info%40oak-mill.com?subject=x">mail</a> <a href="tel:+1 (415) 555-2671">call</a>
<b><a class="s" href='https://www.facebook.com/OakMillShop/?utm_source=x'>fb</a></b> <a class="w" href='https://www.wix.com'>w</a>
<a rel="me" href='https://x.com/wix'>built with</a></div>
<script>var s = {"sameAs": "https:\\/\\/instagram.com\\/oak.mill"}; /* github.com/necolas */</script></body></html>"""


@pytest.fixture(scope="module")
def found(spark):
    rows = [
        ("oak-mill.com", 1, "https://www.oak-mill.com/", CONTACT),
        ("oak-mill.com", 2, "https://www.oak-mill.com/contact", '<p>info@oak-mill.com</p><a href="https://instagram.com/other_one">i</a><p>(415) 555-2671</p>'),
        ("oak-mill.com", 3, "https://www.oak-mill.com/blog", "<p>zoe@gmail.com</p>"),
        ("empty.org", 1, "https://empty.org/", None),
    ]
    seeds = spark.createDataFrame([("oak-mill.com", None, None), ("empty.org", None, None), ("dead.net", "dead.net", "dns: no such host: dead.net")], "site string, domain string, error string")
    df = contacts(spark.createDataFrame(rows, PAGES), seeds)
    return df, {r.domain: r.asDict(True) for r in df.collect()}


def values(record, field):
    return [x["value"] for x in record[field]]


def test_long_pages_are_read_whole(spark):
    late = '<footer><a href="https://www.facebook.com/LateOak">f</a><a href="mailto:late@oak-mill.com">m</a></footer>'
    rows = [("oak-mill.com", k, "https://oak-mill.com/", "<p>" + "word " * n + "</p>" + late) for k, n in ((1, 320_000), (2, 620_000))]
    hits = {(h.page_seq, h.field, h.value) for h in page_hits(spark.createDataFrame(rows, PAGES).withColumn("domain", F.col("site"))).collect()}
    assert {(k, f, v) for k in (1, 2) for f, v in (("facebooks", "https://www.facebook.com/LateOak"), ("emails", "late@oak-mill.com"))} <= hits


def test_layout(found):
    df, rows = found
    assert df.columns == ["domain", "title", "description", "emails", "phones", "phones_uncertain", *rules.PLATFORMS, "technologies", "error"]
    assert len(df.columns) == 25 and set(rows) == {"www.oak-mill.com", "empty.org", "dead.net"}
    assert df.schema["phones_uncertain"].dataType.elementType.names == ["value", "sources"]


def test_error_rows_are_total(found, spark):
    dead = found[1]["dead.net"]
    assert dead["error"].startswith("dns") and all(dead[p] == [] for p in rules.PLATFORMS) and dead["title"] is None
    assert found[1]["empty.org"]["error"] is None and found[1]["empty.org"]["emails"] == []
    long = error_rows(spark.createDataFrame([("a", "x" * 500)], "domain string, error string")).first()
    assert len(long.error) == 200


def test_emails(found):
    r = found[1]["www.oak-mill.com"]
    assert values(r, "emails")[0] == "info@oak-mill.com"
    assert set(values(r, "emails")) == {"info@oak-mill.com", "john@oak-mill.com", "press@oak-mill.com", "sales@oak-mill.com", "ann@ac9.or", "zoe@gmail.com"}
    assert r["emails"][0]["sources"] == ["https://www.oak-mill.com/", "https://www.oak-mill.com/contact"]
    assert values(r, "emails")[-1] == "zoe@gmail.com"


def test_phones_fold_into_the_international_form(found):
    r = found[1]["www.oak-mill.com"]
    assert values(r, "phones") == ["+14155552671"] and r["phones_uncertain"] == []
    assert len(r["phones"][0]["sources"]) == 2


def test_socials(found):
    r = found[1]["www.oak-mill.com"]
    assert values(r, "facebooks") == ["https://www.facebook.com/OakMillShop"]
    assert values(r, "instagrams") == ["https://www.instagram.com/oak.mill", "https://www.instagram.com/other_one"]
    assert r["twitters"] == [] and r["githubs"] == []  # the builder's own profile, and a credit in a script


def test_one_official_per_list(found):
    for r in found[1].values():
        for field in ("emails", "phones", *rules.PLATFORMS):
            assert [x["is_likely_official"] for x in r[field]] == [i == 0 for i in range(len(r[field]))]


def test_meta(found):
    r = found[1]["www.oak-mill.com"]
    assert r["title"] == "Our office" and r["description"] == "What we do"


def test_result_does_not_depend_on_partitions(found, spark):
    rows = [("a.com", i, f"https://a.com/{i}", f"<p>x{i % 3}@a.com y@a.com</p>") for i in range(12)]
    one = contacts(spark.createDataFrame(rows, PAGES).repartition(1)).collect()
    many = contacts(spark.createDataFrame(rows[::-1], PAGES).repartition(5)).collect()
    assert one == many
    mails = one[0].emails
    assert mails[0].value == "y@a.com" and len(mails[0].sources) == rules.SOURCES_SHOWN  # scored before the cap


def test_views(found):
    df, rows = found
    over = results.overview(df)
    assert len(over.columns) == 12
    assert over.filter("domain = 'dead.net'").first().emails == ""
    listed = results.email_list(df)
    assert listed.columns == ["domain", "email", "is_likely_official", "sources"] and listed.count() == 6
    flat = results.export_ready(df)
    assert all(t in ("string",) for _, t in flat.dtypes)


def test_empty_table(spark):
    assert contacts(spark.createDataFrame([], PAGES)).count() == 0
    assert page_hits(spark.createDataFrame([], PAGES + ", domain string")).count() == 0


def test_deep_and_hostile_pages(spark):
    html = "<div>" * 3000 + "a@deep.com" + "x" * 50_000 + ' "' + "q" * 20_000 + "</div>" * 3000 + " b@deep.com"
    r = contacts(spark.createDataFrame([("deep.com", 1, "https://deep.com/", html)], PAGES)).first()
    assert [x.value for x in r.emails] == ["b@deep.com"]


class Caught:
    """Stands for a frame: gives the function that a step would run on its Arrow batches."""

    def __init__(self, spark, ddl):
        self.schema = spark.createDataFrame([], ddl).schema

    def mapInArrow(self, run, schema):
        return run


def test_steps_on_pages_work_in_pieces(spark):
    """A batch of long pages reaches the parser and the number reader in pieces, so that a worker's memory follows bytes, not rows."""
    html = "<p>call +1 415 555 2671</p>" + "<p>some words</p>" * 60_000
    batch = pa.record_batch({"url": ["https://a.com/"] * 24, "html": [html] * 23 + [None]})
    parsed = list(parse_pages(Caught(spark, "url string, html string"))(iter([batch])))
    assert sum(b.num_rows for b in parsed) == 24 and len(parsed) >= 3 and max(b.nbytes for b in parsed) <= 3 * PIECE_BYTES
    assert parsed[0]["text"][0].as_py().startswith("call +1 415 555 2671\nsome words") and parsed[-1]["text"][-1].as_py() == ""
    read = pa.record_batch({"text": ["call +1 415 555 2671 " + "word " * 200_000] * 24, "anchors": [[]] * 23 + [None], "region": ["US", None] * 12, "wa_numbers": [[]] * 23 + [None]})
    found = list(with_phones(Caught(spark, "text string, anchors array<struct<href:string,in_footer:boolean>>, region string, wa_numbers array<string>"))(iter([read])))
    assert len(found) >= 3 and [p["key"] for b in found for x in b["phones"].to_pylist() for p in x] == ["+14155552671"] * 24
