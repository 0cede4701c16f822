"""The crawl replay, tasks, filters, streaming and the driver's entry."""

import subprocess
import sys
import tracemalloc
from unittest.mock import MagicMock

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trawlkit.functions.urls import normalized
from trawlkit.operators.frontier import crawl, frontier, keyword_points, links, replay
from trawlkit.operators.parse import parse_page, parse_pages
from trawlkit.plans import results
from trawlkit.plans.scrape import scrape_contacts
from trawlkit.sources import scratch
from trawlkit.sources.files import read_fetches, write_csv, write_json
from trawlkit.sources.tasks import Client, changed_since, with_status
from trawlkit.streaming import contacts as streaming


def graph(pages):
    """A fetch function over {url: html or (final_url, html) or int status}."""
    known = {normalized(u): (u, p) for u, p in pages.items()}

    def fetch(url, mode):
        blank = {"key": None, "final_url": url, "status": None, "error": "refused", "has_html": False, "anchors": [], "reason": None, "has_email": False, "has_phone": False}
        if normalized(url) not in known:
            return blank
        u, p = known[normalized(url)]
        final, html = p if isinstance(p, tuple) else (u, p)
        return blank | {"key": normalized(u), "final_url": final, "status": 200, "error": None, "has_html": bool(html), "anchors": parse_page(final, html)["anchors"], "has_email": "@" in html, "has_phone": "tel:" in html}

    return fetch


def a(*hrefs):
    return "".join(f'<a href="{h}">{h.strip("/").split("?")[0]}</a>' for h in hrefs)


def test_small_site():
    pages = {"https://acme.com": a("/blog", "/contact", "/about?utm_source=x", "/about", "https://other.org/", "/login", "/x.pdf"), "https://acme.com/contact": "c", "https://acme.com/about": "d", "https://acme.com/blog": "e"}
    out = replay("acme.com", graph(pages))
    assert [(u.rsplit(".com", 1)[1], d, k) for _, u, d, k in out["pages"]] == [("", 0, "homepage"), ("/contact", 1, "contact"), ("/about", 1, "about"), ("/blog", 1, "other")]


@pytest.mark.parametrize("extra,count", [("", 20), ('<a href="mailto:a@acme.com">m</a><a href="tel:+1">t</a>', 8)])
def test_caps_and_early_exit(extra, count):
    pages = {"https://acme.com": extra + a(*(f"/p{i}" for i in range(30)))} | {f"https://acme.com/p{i}": "x" for i in range(30)}
    assert len(replay("acme.com", graph(pages))["pages"]) == count


def test_redirect_and_dead_sites():
    pages = {"https://old.com": ("https://www.newbrand.com/", a("/contact", "https://old.com/x")), "https://newbrand.com/contact": "c"}
    out = replay("old.com", graph(pages))
    assert out["domain"] == "www.newbrand.com" and len(out["pages"]) == 2
    dead = replay("http://Gone.com/", graph({}))
    assert dead["pages"] == [] and dead["error"] == "refused" and dead["domain"] == "gone.com"


def test_five_failures_end_the_crawl():
    pages = {"https://acme.com": a(*(f"/p{i}" for i in range(9)), "/z"), "https://acme.com/z": "z"}
    assert len(replay("acme.com", graph(pages))["pages"]) == 1


def test_keywords():
    assert keyword_points("/de/kontakt.html", "") == 100 and keyword_points("/google-maps-with-contact-details", "") == 10
    assert keyword_points("/", "About us") == 80 and keyword_points("/x", "a very long label that ends in contact") == 10


def test_crawl_over_frames(spark):
    html = {"https://acme.com": a("/contact", "/b") + "<p>x@acme.com", "https://acme.com/contact": "<p>c", "https://acme.com/b": "<p>b"}
    rows = [(1, normalized(u), u, 200, None, u, h) for u, h in html.items()]
    corpus = parse_pages(spark.createDataFrame(rows, "seed_id long, url_norm string, final_url string, status int, error string, url string, html string"))
    seeds = spark.createDataFrame([(1, "acme.com"), (2, "dead.org")], "seed_id long, query string")
    got = crawl(seeds, corpus).orderBy("seed_id", "page_seq").collect()
    assert [(r.seed_id, r.url, r.weight_class) for r in got] == [(1, "https://acme.com", "homepage"), (1, "https://acme.com/contact", "contact"), (1, "https://acme.com/b", "other"), (2, None, None)]
    assert got[-1].error.startswith("no page")
    ranked = frontier(links(corpus.withColumns({"site": F.lit("acme"), "page_seq": F.lit(1)}))).orderBy("place").collect()
    assert [r.url_norm for r in ranked] == ["https://acme.com/contact", "https://acme.com/b"]


def test_scrape(spark):
    html = {"https://acme.com": a("/contact", "/b"), "https://acme.com/contact": "<title>c</title><p>x@acme.com", "https://acme.com/b": "<p>x@acme.com y@gmail.com"}
    rows = [(1, normalized(u), u, 200, None, h) for u, h in html.items()]
    corpus = spark.createDataFrame(rows, "seed_id long, url_norm string, final_url string, status int, error string, html string")
    seeds = spark.createDataFrame([(1, "acme.com"), (2, "http://Dead.org/x")], "seed_id long, query string")
    got = {r.domain: r for r in scrape_contacts(seeds, corpus).collect()}
    assert set(got) == {"acme.com", "dead.org"} and got["dead.org"].emails == [] and got["dead.org"].error.startswith("no page")
    assert [e.value for e in got["acme.com"].emails] == ["x@acme.com", "y@gmail.com"] and got["acme.com"].error is None
    assert got["acme.com"].emails[0].sources == ["https://acme.com/contact", "https://acme.com/b"]


def test_filters_and_pages(spark):
    df = spark.createDataFrame([(f"d{i:02d}", [] if i % 2 else ["x"], None if i % 3 else "err") for i in range(60)], "domain string, emails array<string>, error string")
    assert results.apply_filters(df, [("truthy", "emails"), ("is_not_null", "error")]).count() == 10
    page = lambda n: [r.domain for r in results.request(df, page=n, sort="domain").collect()]
    assert page(3) == [f"d{i:02d}" for i in range(50, 60)] and page(9) == page(1) and page(0) == page(1)
    assert results.page_count(60) == 3 and results.label("is_likely_official") == "Is Likely Official"
    assert results.apply_view(df, None, ("error",)).columns == ["domain", "emails"]


def test_pages_are_cut_from_the_sorted_rows(spark):
    rows = [(f"d{i:02d}", (i * 37) % 60 // 2) for i in range(60)]
    df = spark.createDataFrame(rows, "domain string, score int")
    order = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    for n in (1, 2, 3):
        assert [r.domain for r in results.request(df, page=n, sort="score").collect()] == order[25 * n - 25 : 25 * n]
    nulls = spark.createDataFrame([("a", None), ("b", 2), ("c", 1)], "domain string, score int")
    assert [r.domain for r in results.request(nulls, page=1, per_page=2, sort="score").collect()] == ["c", "b"]


def test_links_and_fetches_have_one_key(spark):
    hrefs = ["https://www.a.com/x?q=a%20b", "https://a.com/x?u=a/b&utm_source=z", "https://a.com/x?q=a+b"]
    html = "".join(f"<a href='{u}'>x</a>" for u in hrefs)
    parsed = parse_pages(spark.createDataFrame([("a.com", 0, "https://a.com/", html)], "site string, page_seq int, url string, html string"))
    assert [r.url_norm for r in links(parsed).orderBy("seq").collect()] == [normalized(u) for u in hrefs]


def test_scratch_is_shared_off_local_mode():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: Session.conf)

    with pytest.raises(ValueError):
        scratch.shared_dir(Session)


def test_a_scope_deletes_what_nothing_reads(spark):
    with scratch.scope(spark) as drop:
        one = scratch.saved(spark.range(3), "one")
        with scratch.scope(spark):
            two = scratch.saved(spark.range(5), "two")
        drop(two)
    assert two.count() == 5
    with pytest.raises(Exception):
        one.count()


def test_tasks(spark, tmp_path):
    client = Client(spark, f"file://{tmp_path}")
    made = client.create(7, [" a.com ", "", "a.com", "b.com"])
    assert [(r.task_name, r.is_all_task, r.status) for r in made.orderBy("task_id").collect()] == [("All Task", True, "pending"), ("a.com", False, "pending"), ("a.com", False, "pending"), ("b.com", False, "pending")]
    first = made.filter("task_name = 'b.com'").first().task_id
    client.abort(7, [first])
    assert client.tasks().filter("status = 'aborted'").count() == 1
    client.delete(7, [first])
    assert client.tasks().count() == 3
    seen = client.tasks().select("task_id", "updated_at", "status")
    assert changed_since(client.tasks(), seen).count() == 0
    assert changed_since(with_status(client.tasks(), [7_000_000], "completed"), seen).count() == 1
    client.save_results(7, spark.createDataFrame([("a.com",), ("b.com",)], "domain string"))
    assert client.results(7).count() == 2 and client.results(7, "a.com").count() == 1


def test_sinks_and_fetches(spark, tmp_path):
    df = spark.createDataFrame([("é.com", [("a@b.c", ["u"], True)], None)], "domain string, emails array<struct<value:string,sources:array<string>,is_likely_official:boolean>>, error string")
    write_csv(df, f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").first().asDict() == {"domain": "e.com", "emails": "a@b.c", "error": None}
    write_json(df, f"file://{tmp_path}/json")
    assert spark.read.json(f"file://{tmp_path}/json").columns == ["domain", "emails", "error"]
    (tmp_path / "f.json").write_text('{"site":"a","page_seq":1,"url":"https://a","html":"x","content_type":"image/png; q"}\n')
    row = read_fetches(spark, f"file://{tmp_path}/f.json").first()
    assert row.html == "" and row.error == "non-html content-type: image/png"


def test_streaming(spark, tmp_path):
    at = lambda name: f"file://{tmp_path}/{name}"
    rows = spark.createDataFrame([("a.com", 1, "https://a.com/", "<p>x@a.com")], streaming.PAGES)
    rows.write.parquet(at("in"))
    streaming.follow(spark, at("in"), at("pages"), at("contacts"), at("cp")).awaitTermination()
    spark.createDataFrame([("a.com", 2, "https://a.com/c", "<p>y@a.com x@a.com"), ("b.com", 1, "https://b.com/", None)], streaming.PAGES).write.mode("append").parquet(at("in"))
    streaming.follow(spark, at("in"), at("pages"), at("contacts"), at("cp")).awaitTermination()
    got = {r.domain: [e.value for e in r.emails] for r in streaming.latest(spark, at("contacts")).collect()}
    assert got == {"a.com": ["x@a.com", "y@a.com"], "b.com": []}


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert len(df.columns) == 25 and df.count() > 0
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) >= 60


def test_the_rest_works_without_the_training_data_operators():
    code = "import sys; sys.modules['trawlkit.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; n = e.queries(); assert 'contacts' in n and 'pipeline' not in n and not any(x.startswith('op') for x in n); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_crawl_reads_only_what_it_fetches(spark):
    """A site of many pages stays in Arrow; a crawl turns the few pages it fetches into Python objects."""
    seeds = MagicMock()
    crawl(seeds, MagicMock())
    run = seeds.select.return_value.groupBy.return_value.cogroup.return_value.applyInArrow.call_args[0][0]
    url = "https://a.com/p"
    anchors = [{"resolved": f"{url}{k}", "text": "contact", "in_footer": False, "in_nav": False} for k in range(20)]
    n = 5000
    pages = pa.table({"seed_id": [1] * n, "url_norm": ["https://a.com", *(f"{url}{k}" for k in range(1, n))], "final_url": [None] * n, "status": [200, *[None] * (n - 1)], "error": pa.array([None] * n, pa.string()), "has_html": [True] * n, "anchors": [anchors] * n, "reason": pa.array([None] * n, pa.string()), "has_email": [False] * n, "has_phone": [False] * n})
    tracemalloc.start()
    out = run(pa.table({"seed_id": [1], "query": ["a.com"]}), pages).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["url"] for r in out[:3]] == ["https://a.com", f"{url}1", f"{url}2"] and len(out) == 20 and out[0]["is_homepage"]
    assert peak < 5_000_000
    assert run(pa.table({"seed_id": [1], "query": ["b.com"]}), pages.slice(0, 0)).to_pylist()[0]["error"].startswith("no page")
