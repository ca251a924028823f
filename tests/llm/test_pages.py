import time

import pytest

from cinderlog.llm import pages, urls
from cinderlog.llm.queries import URL_RULES
from tests.llm.conftest import SF


def article(body, before="", after=""):
    return f"<html><head><title>T</title><script>var t='</p>';</script></head><body>{before}{body}{after}</body></html>"


NAV = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
FOOT = "<footer>&copy; site &middot; all rights</footer>"
LONG = "A sentence that says something at length. " * 8


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("<html></html>", ""), ("plain text", "plain text"),
    (article(f"<article><h1>Head</h1><p>{LONG}<p>b &amp;amp; c<br>d</article>", NAV, FOOT), f"Head\n\n{LONG.strip()}\n\nb &amp; c d"),
    (article(f"<div id=content><h1>H</h1><p>{LONG}</p><p>Ti.</p><p>{LONG}</p></div>", NAV, FOOT), f"H\n\n{LONG.strip()}\n\nTi.\n\n{LONG.strip()}"),
    (article(f"<main><p>{LONG}</p><aside>more</aside><div class='cookie-notice'>ok?</div><form><input>x</form></main>"), LONG.strip()),
    (article(f"<article><p>{LONG}</p><section class=comments><article class=comment><p>me too</p></article></section></article>"), LONG.strip()),
    (article("<article><p>That it.</p></article>", NAV, FOOT + "<div class=ad>" + LONG + "</div>"), "That it."),
    (article(f"<article><b>{LONG}<i>x</b></i> y &#8364;&nbsp;5</article>", "<div hidden>no</div>"), f"{LONG}x y € 5"),
    (article(f"<nav><ul><li>open<article><p>{LONG}</p></article>"), LONG.strip()),
    ("<p>a<p>b<!-- never closed", "a\n\nb"),
])
def test_main_text(html, text):
    assert pages.main_text(html) == text


THIRD = "Another sentence of the same article, further down. " * 3


@pytest.mark.parametrize("body, parts", [
    (f"<div id=content><div><p>{LONG}</p><p>{LONG}</p></div><div><p>{THIRD}</p><p>End.</p></div></div>", [LONG, LONG, THIRD, "End."]),
    (f"<div id=content><div><div><p>{LONG}</p><p>{LONG}</p></div></div><section><ul><li>{THIRD}</li></ul></section></div>", [LONG, LONG, THIRD]),
    (f"<article><p>{LONG}</p></article><article><p>Short one.</p></article>", [LONG, "Short one."]),
    (f"<div><article><p>{LONG}</p></article></div><p>Between.</p><article>b</article>", [LONG, "b"]),
])
def test_no_part_of_a_split_article_is_lost(body, parts):
    assert pages.main_text(article(body, NAV, FOOT)) == "\n\n".join(x.strip() for x in parts)


@pytest.mark.parametrize("before, after", [
    ("<script>var s = '<!--';</script>", ""),
    ("<style>/* <!-- */</style>", ""),
    ("<p hidden title='<!--'>no</p>", ""),
    ("<!-- closed --><nav title='<!--'>no</nav>", "<!-- never closed <p>no</p>"),
    ("<nav>no<script>s = '<!--'</script></nav>", "<!-- never closed <a href='<!--'> &amp"),
    ("", "<script>var s = '<!--"),
])
def test_comment_marks_that_open_no_comment(before, after):
    assert pages.main_text(article(f"<article><p>{LONG}</p></article>", before, after)) == LONG.strip()


def test_extract(spark):
    table = spark.read.parquet(f"{SF}/pages.parquet").withColumnRenamed("url", "url")
    out = pages.extract(table.selectExpr("*", "1 as text")).collect()
    assert len(out) == table.count() and all(r.n_chars == len(r.text) for r in out)
    assert all(r.text and "<" not in r.text.replace("<", "", 0)[:1] for r in out)
    assert pages.extract(table.limit(0)).count() == 0


# --- urls ---------------------------------------------------------------------------


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string")


def test_hosts_paths_and_rules(spark):
    rows = [
        (1, "HTTPS://WWW.Example.com/en/a?b#c"), (2, "http://x.example.com/en/"), (3, "http://example.com/EN/"),
        (4, "http://n.net/es/x"), (5, "http://n.net/en/x"), (6, None), (7, "no scheme/en/"), (8, "ftp://host"), (9, "a://b://c/d"),
        (10, "http://notexample.com/en/x"), (11, "http://com/"), (12, "http://x.com?q=/en/"), (12, "http://x.com?q=/en/"),
        (13, "http://ÀB.NET/fr/"), (14, ""),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(frame(spark, rows), URL_RULES).collect()}
    assert got == {
        1: ("www.example.com", "/en/a", "www.example.com/en/", "allow"), 2: ("x.example.com", "/en/", "example.com/en/", "block"),
        3: ("example.com", "/EN/", "com/", "allow"), 4: ("n.net", "/es/x", "net/es/", "block"), 5: ("n.net", "/en/x", None, "allow"),
        6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("host", "", None, "allow"), 9: ("b:", "//c/d", None, "allow"),
        10: ("notexample.com", "/en/x", "com/", "allow"), 11: ("com", "/", "com/", "allow"), 12: ("x.com", "", None, "allow"),
        13: ("Àb.net", "/fr/", "net/fr/", "block"), 14: ("", "", None, "allow"),
    }
    assert urls.judge(frame(spark, []), URL_RULES).count() == 0


def test_templates_are_rejected_by_purity(spark):
    rows = [(k, f"http://h.org/spam/{k}") for k in range(40)] + [(100 + k, f"http://h.org/good/{k}.html") for k in range(40)]
    rows += [(200 + k, f"http://other.org/spam/{k}") for k in range(5)]
    labels = spark.createDataFrame(
        [(k, True) for k in range(0, 40, 2)] + [(100 + k, False) for k in range(0, 40, 2)], "page_id long, blocked boolean"
    )
    out = urls.judge(frame(spark, rows), [], labels).collect()
    assert all(r.verdict == ("block" if r.page_id < 100 else "allow") for r in out)
    assert {r.template for r in out} == {"/spam/*", "/good/*.html"}


def test_alike_branches_and_crowds_merge(spark):
    rows, blocked = [], []
    for k in range(30):  # many rare names below one node
        rows.append((k, f"http://h.org/user/name{chr(97 + k % 26)}{chr(97 + k // 26)}/x"))
    for k in range(60):  # three siblings with one block share
        rows.append((100 + k, f"http://s.org/{'abc'[k % 3]}/page"))
        blocked.append((100 + k, True))
    labels = spark.createDataFrame(blocked, "page_id long, blocked boolean")
    rows += [(300 + k, f"http://c.org/{'x' * (k + 1)}/y") for k in range(70)]
    out = {r.page_id: (r.template, r.verdict) for r in urls.judge(frame(spark, rows), [], labels).collect()}
    assert {out[100 + k] for k in range(60)} == {("/*/page", "block")}
    assert {out[300 + k][0] for k in range(70)} == {"/*/y"}


def test_deep_paths(spark):
    deep = "/".join("abcdefg")
    rows = [(1, f"http://h.org/{deep}"), (2, "http://h.org/2024-01-02/0123456789abcdef/x1y2z3w4v5u6t7")]
    rows += [(100 + k, f"http://s.org/{deep}/spam/{k}") for k in range(40)]
    rows += [(200 + k, f"http://s.org/{deep}/news/{k}") for k in range(60)]
    labels = spark.createDataFrame(
        [(100 + k, True) for k in range(0, 40, 2)] + [(200 + k, False) for k in range(0, 60, 2)], "page_id long, blocked boolean"
    )
    out = {r.page_id: (r.template, r.verdict) for r in urls.judge(frame(spark, rows), [], labels).collect()}
    assert out[1][0] == f"/{deep}" and out[2][0] == "/*/*/*"
    assert {out[100 + k] for k in range(40)} == {(f"/{deep}/spam/*", "block")}
    assert {out[200 + k] for k in range(60)} == {(f"/{deep}/news/*", "allow")}


def test_a_bad_host_is_rejected_where_nothing_is_known(spark):
    rows = [(k, f"http://bad.net/es/{k}") for k in range(50)] + [(100 + k, f"http://bad.net/about/{k}") for k in range(5)]
    rows += [(200 + k, f"http://fair.net/es/{k}") for k in range(5)] + [(300 + k, f"http://fair.net/about/{k}") for k in range(50)]
    rows += [(400 + k, f"http://new.org/about/{k}") for k in range(5)]
    out = {r.page_id: (r.rule, r.verdict) for r in urls.judge(frame(spark, rows), URL_RULES).collect()}
    assert {out[100 + k] for k in range(5)} == {(None, "block")}
    assert {out[300 + k] for k in range(50)} == {(None, "allow")}
    assert {out[400 + k] for k in range(5)} == {(None, "allow")}


def test_the_query_judges_pages_without_a_rule(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    found = urls.judge(table, URL_RULES)
    open_pages = found.where("rule IS NULL")
    assert open_pages.where("verdict <> CASE WHEN purity >= 0.8 THEN 'block' ELSE 'allow' END").isEmpty()
    # what the rules say of a host's pages weighs on its others
    assert open_pages.select("purity").distinct().count() > 10
    assert open_pages.where("host LIKE '%.org' AND purity <> 0.5").isEmpty()


def test_many_open_tags_take_time_in_proportion():
    began = time.monotonic()
    for page in ("<div>x" * 50_000, "<b>x" * 50_000 + "</i>" * 50_000, "<p>x<span>" * 50_000 + "</i></p>" * 50_000):
        assert pages.main_text(page).count("x") == 50_000
    assert time.monotonic() - began < 20


@pytest.mark.parametrize("name, stays", [
    ("related-work", True), ("share-price", True), ("search-algorithm", True), ("comments", False),
    ("related-posts", False), ("shareButtons", False), ("comment-list-2", False), ("newsletter_box", False),
])
def test_classes_inside_an_article(name, stays):
    html = f'<body><article><p>Before it.</p><section class="{name}"><p>The part.</p></section><p>After.</p></article></body>'
    assert ("The part." in pages.main_text(html)) == stays
    assert "The part." not in pages.main_text(html.replace("article>", "div>").replace(name, "related-work share"))


def test_ratios_choose_the_region_of_a_page_without_article(monkeypatch):
    links = "".join(f"<li><a href=/{k}><b>{w}</b></a></li>" for k, w in enumerate("home about shop work team jobs maps help".split()))
    body = "".join(f"<p>{'A sentence of the text, long enough to be one. ' * 4}</p>" for _ in range(6))
    html = f"<body><div><ul>{links}</ul></div><div id=x><h2>Head</h2>{body}<p>Short end.</p></div><div><ul>{links}</ul></div></body>"
    text = pages.main_text(html)
    assert text.startswith("Head\n\nA sentence") and text.endswith("Short end.") and "jobs" not in text
    monkeypatch.setattr(pages, "smoothed", lambda values, sigma=1.5: 1.0 * (values < values.mean()))
    assert "jobs" in pages.main_text(html)
