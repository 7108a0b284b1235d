import datetime as dt
import hashlib
import time
from urllib.robotparser import RobotFileParser

import pytest
from catalog.common import SUFFIXES
from pyspark.sql import functions as F

from webloom.functions import permissions as pm
from webloom.functions import urls
from webloom.functions.html import parse_page
from webloom.functions.keys import page_key_blake2b
from webloom.operators import frontier as fr
from webloom.operators import links as ln
from webloom.operators import pages as pg
from webloom.operators import robots as rb
from webloom.sources import layout, tables

PAGE = "https://s.example.com/dir/p.html?q=1"

LINKS = {
    "/a/b": "https://s.example.com/a/b",
    "//cdn.example.org/x/": "https://cdn.example.org/x",
    "HTTP://h.example.com/a": None,
    "http://H.Ex.com/a;p=1?q#f": "http://H.Ex.com/a",
    "https://h.example.com//": "https://h.example.com",
    "b.html": None,
    "#top": None,
    "?x=1": None,
    "mailto:a@b.c": None,
    "": None,
    "/a.HTML": "https://s.example.com/a.HTML",
    "/p.php/": "https://s.example.com/p.php",
    "/v1.0/page": None,
    "/et.": None,
    "/.hidden": None,
    "/x.tar.gz": None,
    "/b.pdf": None,
    "http://h.example.com/a b|c/": "http://h.example.com/a b|c",
    "/": "https://s.example.com",
    "/a.html/.": "https://s.example.com/a.html/.",
    "/a;v=1.5/b": None,
    "/a;v=1/b;w=2.pdf": "https://s.example.com/a;v=1/b",
}


def test_links(spark):
    rows = [(1, PAGE, i, href) for i, href in enumerate(LINKS)]
    hrefs = spark.createDataFrame(rows, "page_id LONG, url STRING, pos INT, href STRING")
    got = {r["href"]: r["target_url"] for r in ln.page_links(ln.resolved_links(hrefs)).collect()}
    assert got == {href: target for href, target in LINKS.items() if target is not None}


def test_url_parts(run):
    cases = {
        "HTTP://u@H.com:80/a;b/c;d?e?f#g#h": ("http", "u@H.com:80", "/a;b/c", "d", "e?f", "g#h"),
        " \thttps://x.com": ("https", "x.com", "", "", "", ""),
        "//h/p": ("", "h", "/p", "", "", ""),
        "a b|c": ("", "", "a b|c", "", "", ""),
        "mailto:a;b": ("mailto", "", "a;b", "", "", ""),
    }
    assert [tuple(v) for v in run(urls.url_parts(F.col("x")), list(cases))] == list(cases.values())


def test_registered_domain(run):
    rules = ["com", "uk", "co.uk", "*.ck", "!www.ck", "ck"]
    cases = {
        "https://a.b.Example.com:8080/x": "Example.com",
        "http://user@www.shop.co.uk./": "shop.co.uk",
        "http://a.b.c.ck/": "b.c.ck",
        "http://x.www.ck/": "www.ck",
        "http://localhost/": "localhost.",
        "http://10.0.0.1/": "10.0.0.1.",
        "http://co.uk/": ".co.uk",
        "http://a.unknown/": "unknown.",
    }
    assert run(urls.registered_domain(F.col("x"), rules), list(cases)) == list(cases.values())


def test_url_title(run):
    cases = {"https://x.com/a/report.v2.html": "report.v2", "https://x.com/a/plain": "plain", "https://example.com": "example"}
    assert run(urls.url_title(F.col("x")), list(cases)) == list(cases.values())


TITLES = [
    ("<title> T </title><h1>H</h1>", "T"),
    ('<title></title><meta property="og:title" content="O"><meta name="twitter:title" content="W">', "O"),
    ('<meta name="twitter:title" content=" W "><h1>H</h1>', "W"),
    ('<meta property="og:title" content=""><h1>H</h1>', "b"),
    ('<meta property="og:title"><meta name="twitter:title" content="W">', "b"),
    ("<h2>Two</h2>", "Two"),
    ("<h3>Three</h3><h2>Two <b>bold</b></h2>", "Two bold"),
    ("<h1> </h1><h2>Two</h2>", "b"),
    ("<p>nothing</p>", "b"),
    ("<title>A &amp; B\n &lt;c&gt;</title>", "A & B\n <c>"),
    ("<!-- <title>no</title> --><title>yes</title><title>later</title>", "yes"),
    (None, "b"),
]


def test_titles(spark):
    rows = [(i, "https://x.example.com/a/b.html", html) for i, (html, _) in enumerate(TITLES)]
    got = pg.titled_pages(spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING")).orderBy("page_id")
    assert [r["title"] for r in got.collect()] == [title for _, title in TITLES]


def test_page_text(spark):
    pages = [
        ("<title>T</title><body>a<b>b</b>c<script>no</script></body>after", "T", "T a b c"),
        ("<title></title><body>x</body>", "", "x"),
        ("<body><p>one<p>two<div>three</body> out", "one two three", "one two three"),
        ("<p>no body</p>", "", ""),
        ("<body>1 < 2 &amp; x<!-- c -->y<style>s</style><template><i>t</i></template>", "1 < 2 & x y", "1 < 2 & x y"),
        ("<body><pre>a<b>b</b></pre>", "ab", "ab"),
    ]
    rows = [(i, "u", html) for i, (html, _, _) in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING")
    for scope, column in (("title_else_body", 1), ("title_and_body", 2)):
        got = pg.page_texts(frame, scope).orderBy("page_id").collect()
        assert [" ".join(r["text"].split()) for r in got] == [case[column] for case in pages]
    with pytest.raises(ValueError):
        pg.page_texts(frame, "other")


def test_html_fields_of_links_and_meta():
    fields = parse_page(
        '<A HREF="/x&amp;y">1</A><a href>2</a><a name=n>3</a><script>"<a href=\'/no\'>"</script><a href=1 href=2>4</a>'
        '<meta name="robots" content="a"><META NAME="robots"><meta name="robots" content="b, c">'
    )
    assert fields["hrefs"] == ["/x&y", "", "2"]
    assert fields["meta_robots"] == ["a", "b, c"]


ROBOTS = [
    "",
    "User-agent: *\nDisallow: /a\nAllow: /a/b\nCrawl-delay: 3",
    "User-agent: *\nAllow: /a/b\nDisallow: /a",
    "User-agent: *\n\nDisallow: /q",
    "Disallow: /",
    "User-agent: *\nDisallow:",
    "User-agent: *\nDisallow: /*.pdf$",
    "User-agent: BO\nDisallow: /p\nCrawl-delay: 1.5\n\nUser-agent: *\nDisallow: /",
    "User-agent: x\nUser-agent: mybot\nDisallow: /a # no\n # c\nCrawl-delay: 7\nUser-agent: *\nDisallow: /",
    "User-agent: *\nDisallow: /a\n\nUser-agent: *\nDisallow: /q\n\nUser-agent: other\nDisallow: /",
    "user-AGENT : MYBOT \r\n disallow : /%7Eb/%zz \r\nAllow: /\r\n",
    "User-agent: *\nRequest-rate: 1/5\nUser-agent: mybot\nCrawl-delay: 2\nCrawl-delay: x\nDisallow: /p?x\n",
    "User-agent: \nDisallow: /a\n\nUser-agent: mybot\nDisallow: /q",
    "User-agent: *\nDisallow: *\nDisallow: /caf%C3%A9\nDisallow: /a+b\nDisallow: /x?",
    "User-agent: mybot\n\n\nUser-agent: *\nCrawl-delay: 0\nDisallow: /p",
    "Sitemap: /s\nUser-agent: *\nSitemap: /t\nbad line\nDisallow: /q\n \nDisallow: /p",
]
PATHS = ["", "/", "/a", "/a/b", "/a/c", "/q", "/x", "/x.pdf", "/p/1", "/p?x=1", "/~b/%zz", "/%7Eb/%zz", "/café", "/a+b", "/other", "/x?y#z", "/a;b"]


def test_robots_agree_with_the_standard_library(spark):
    files = spark.createDataFrame([(f"h{i}", text, False) for i, text in enumerate(ROBOTS)], tables.ROBOTS)
    links = [(f"http://h{i}{path}",) for i in range(len(ROBOTS)) for path in PATHS]
    got = rb.robots_allow(spark.createDataFrame(links, "url STRING"), files, "MyBot/1").collect()
    assert len(got) == len(links)
    for i, text in enumerate(ROBOTS):
        parser = RobotFileParser()
        parser.parse(text.splitlines())
        for row in got:
            if row["url"].startswith(f"http://h{i}/") or row["url"] == f"http://h{i}":
                assert row["visit"] == parser.can_fetch("MyBot/1", row["url"]), (text, row)
                assert row["crawl_delay"] == float(parser.crawl_delay("MyBot/1") or 1), (text, row)


def test_robots_missing_and_failed(spark):
    files = spark.createDataFrame([("bad", None, True), ("empty", None, False)], tables.ROBOTS)
    links = spark.createDataFrame([("http://bad/x",), ("http://new/x",), ("http://empty/x",)], "url STRING")
    got = {r["url"]: (r["visit"], r["crawl_delay"]) for r in rb.robots_allow(links, files, "bot").collect()}
    assert got == {"http://bad/x": (False, 0.0), "http://new/x": (True, 1.0), "http://empty/x": (True, 1.0)}


AS_OF = lambda: F.lit(dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc))

DIRECTIVES = {
    "": (True, True),
    "noindex": (False, True),
    "nofollow": (True, False),
    "none": (False, False),
    "NOINDEX": (True, True),
    "noodp": (True, True),
    "unavailable_after: 2020-01-01T00:00:00Z": (False, False),
    "unavailable_after: 2030-01-01T00:00:00Z": (True, True),
    "noindex,unavailable_after: Wed, 01 Jan 2020 00:00:00 GMT": (False, False),
    "noarchive, unavailable_after: 2020-01-01T00:00:00Z": (True, True),
    "unavailable_after: Wednesday, 01-Jan-20 00:00:00 GMT": (False, False),
    "unavailable_after: 25 Jun 2010 15:00:00 PST": (False, False),
    "unavailable_after: December 31, 2023": (False, False),
    "unavailable_after: 2023-12-31T23:30:00-01:00": (True, True),
    "unavailable_after: 2024-01-01T00:30:00+01:00": (False, False),
    "unavailable_after:": (True, True),
    "unavailable_after:,unavailable_after: 2020-01-01": (True, True),
    "unavailable_after: 2020-01-01,unavailable_after:": (False, False),
    "unavailable_after: sometime,unavailable_after: 2020-13-45": (True, True),
    "unavailable_after": (True, True),
}


def test_directives(run):
    got = run(pm.directive_permissions(F.col("x"), AS_OF()), [*DIRECTIVES, None])
    assert [(r["index"], r["follow"]) for r in got] == [*DIRECTIVES.values(), (True, True)]


def test_permissions_of_both_sources(run):
    cases = [({"X-Robots-Tag": "nofollow"}, ["noindex"]), ({"x-robots-tag": "none"}, []), (None, ["a", "nofollow"])]
    got = run(pm.page_permissions(F.col("h"), F.col("m"), AS_OF()), cases, "h MAP<STRING,STRING>, m ARRAY<STRING>")
    assert [(r["index"], r["follow"]) for r in got] == [(False, False), (True, True), (True, False)]


def test_crawl_outcome(spark):
    rows = [
        ("ok", True, "text/html", None, [], True),
        ("noindex", True, "text/html", None, ["noindex"], True),
        ("refused", False, "text/html", None, [], True),
        ("failed", True, None, None, [], False),
        ("pdf", True, "application/pdf", None, [], True),
    ]
    ddl = "url STRING, can_visit BOOLEAN, content_type STRING, headers MAP<STRING,STRING>, meta_robots ARRAY<STRING>, fetched BOOLEAN"
    got = pg.crawl_outcome(spark.createDataFrame(rows, ddl), AS_OF()).collect()
    found = {r["url"]: (r["indexation"], r["follow"], r["page_key"] is not None) for r in got}
    assert found == {
        "ok": (True, True, True),
        "noindex": (False, True, True),
        "refused": (False, False, False),
        "failed": (False, False, False),
        "pdf": (False, False, False),
    }


def test_parse_pages_first_wins(spark):
    rows = [(2, "u", "<title>second</title>", True), (1, "u", "<title>first</title>", True), (3, "v", "", False), (4, "w", "", True)]
    crawled = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING, indexation BOOLEAN")
    known = spark.createDataFrame([("w",)], "url STRING")
    assert [tuple(r) for r in pg.parse_pages(crawled, known).collect()] == [(1, "u", "first")]


def at(second):
    return dt.datetime(2024, 1, 1, 12, 0, second)


def test_frontier_batch(spark):
    queue = spark.createDataFrame([(1, "u1", "d1"), (2, "u2", "d2"), (3, "u3", "d2"), (4, "u4", "d3"), (5, "u5", "d4")], tables.QUEUE)
    domains = spark.createDataFrame([("d1", 5.0, at(8)), ("d3", 5.0, at(0))], tables.VISITED_DOMAINS)
    claimed, remaining, state = fr.frontier_batch(queue, domains, F.lit(at(10)), n=3)
    assert sorted(map(tuple, claimed.collect())) == [(2, "u2", "d2"), (4, "u4", "d3")]
    assert sorted(r["id"] for r in remaining.collect()) == [1, 3, 5]
    assert sorted(map(tuple, state.collect())) == [("d1", 5.0, at(8)), ("d2", 1.0, at(10)), ("d3", 5.0, at(10))]


def test_domain_state_upsert(spark):
    known = spark.createDataFrame([("a", 5.0, at(0))], tables.VISITED_DOMAINS)
    visits = spark.createDataFrame(
        [("a", 1.0, at(1), 0), ("a", 2.0, at(2), 1), ("b", 3.0, at(3), 2), ("b", 4.0, at(4), 3)],
        tables.VISITED_DOMAINS + ", seq BIGINT",
    )
    kept = sorted(map(tuple, fr.domain_state_upsert(known, visits, keep_delay=True).collect()))
    assert kept == [("a", 5.0, at(2)), ("b", 3.0, at(4))]
    replaced = sorted(map(tuple, fr.domain_state_upsert(known, visits).collect()))
    assert replaced == [("a", 2.0, at(2)), ("b", 4.0, at(4))]


def test_frontier_add(spark):
    rows = [("https://a.example.com/1",)] * 50 + [("https://a.example.com/2",), ("https://b.example.org/3",), ("q",)]
    urls_of = lambda items: spark.createDataFrame(items, "url STRING")
    fresh = fr.frontier_add(urls_of(rows), urls_of([("https://a.example.com/2",)] * 3), urls_of([("q",)]), SUFFIXES)
    assert sorted(map(tuple, fresh.collect())) == [
        ("https://a.example.com/1", "example.com"),
        ("https://b.example.org/3", "example.org"),
    ]


def test_pending_and_batch(spark):
    pages = spark.createDataFrame([(i, f"u{i}") for i in range(20)], "page_id LONG, url STRING")
    pending = pg.pending(pages, spark.createDataFrame([(0,), (2,), (2,)], "page_id LONG"), "indexed")
    assert pending.count() == 20
    assert [r["page_id"] for r in pg.batch(pending, "indexed", 3).collect()] == [1, 3, 4]


def test_page_layout(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", "<p>") for i in range(40)], tables.STORED_PAGES)
    manifest = layout.write_pages(pages, str(tmp_path / "pages")).collect()
    assert sorted(r["page_id"] for r in manifest) == list(range(40))
    assert all(r["prefix"] == r["page_key"][:2] for r in manifest)


def test_blake2b_key(run):
    keys = run(page_key_blake2b(F.col("x")), ["https://example.com", None])
    assert keys == [hashlib.blake2b(b"https://example.com", digest_size=16).hexdigest(), None]


@pytest.mark.parametrize("bad", ["<![foo[x]]>", "<![ [x]]>", "<![CDATA[x", "<!-- ", "<!--", "<a ", "<a b='", "</", "<?", "<![", "<script>"])
def test_broken_markup_costs_a_tag_and_not_the_page(bad):
    page = parse_page(f"<title>T</title><h1>one</h1>{bad}<a href='/x'>y</a>")
    assert page["title"] == "T" and page["heading"] == "one"
    if bad.startswith("<![f") or bad.startswith("<![ "):
        assert page["hrefs"] == ["/x"]


@pytest.mark.parametrize("bad", ["<a ", "<!--", "<!-- x>", "<![foo[x]]>", "<![cdata[", "<a b='", "</", "<![if x>"])
def test_time_doubles_with_the_page(bad):
    def seconds(n):
        begin = time.process_time()
        parse_page("<title>T</title>" + bad * n)
        return time.process_time() - begin

    seconds(1000)
    assert min(seconds(80_000) for _ in range(2)) < 6 * min(seconds(20_000) for _ in range(2)) + 0.2


def test_null_flags_of_a_fetch_are_false(spark):
    rows = [("u", None, "text/html", None, None, True), ("v", True, "text/html", None, None, None), ("w", True, "text/html", None, None, True)]
    ddl = "url STRING, can_visit BOOLEAN, content_type STRING, headers MAP<STRING,STRING>, meta_robots ARRAY<STRING>, fetched BOOLEAN"
    got = {r.url: (r.indexation, r.follow) for r in pg.crawl_outcome(spark.createDataFrame(rows, ddl), F.current_timestamp()).collect()}
    assert got == {"u": (False, False), "v": (False, False), "w": (True, True)}


def test_more_date_forms(run):
    cases = {
        "20200102": (2020, 1, 2, 0, 0),
        "2020/01/02 3:04": (2020, 1, 2, 3, 4),
        "01/02/2020": (2020, 1, 2, 0, 0),
        "Jan. 2, 2020 3:04 PM": (2020, 1, 2, 15, 4),
        "2 Sept. 2020 12:30 a.m.": (2020, 9, 2, 0, 30),
        "Thu, Jan 2, 2020, 12 pm": (2020, 1, 2, 12, 0),
        "2020-01-02T03:04:05Z": (2020, 1, 2, 3, 4),
        "13/45/2020": None,
    }
    as_of = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    got = run(F.date_format(pm.parse_date(F.col("x"), as_of), "yyyy-MM-dd HH:mm"), list(cases))
    want = [v and "{:04}-{:02}-{:02} {:02}:{:02}".format(*v) for v in cases.values()]
    assert got == want
