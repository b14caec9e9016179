import time

from llm import line_dedup as D


def test_ratio_is_the_hosts_own(spark):
    rows = [(i, "a", f"menu\nbody {i}\n\n  menu ") for i in range(6)] + [(6, "a", "rare"), (7, "a", None), (7, "a", ""), (8, "a", "rare\nbody 1")]
    rows += [(20, "b", "menu\nrare"), (21, "b", "menu"), (22, None, "menu"), (None, None, "x" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, host string, text string").selectExpr("*", "1 AS lines", "2 AS common", "3 AS pages")
    got = {(r.page_id, r.host, r.n_lines, r.n_dropped, r.text) for r in D.dedup_lines(pages).collect()}
    want = {(i, "a", 3, 2, f"body {i}") for i in range(6)} | {(6, "a", 1, 0, "rare"), (7, "a", 0, 0, ""), (8, "a", 2, 0, "rare\nbody 1")}
    want |= {(20, "b", 2, 0, "menu\nrare"), (21, "b", 1, 0, "menu"), (22, "", 1, 0, "menu"), (None, "", 1, 0, "x" * 200_000)}
    assert got == want
    assert D.dedup_lines(pages).count() == len(rows)
    assert D.dedup_lines(pages.limit(0)).count() == 0


def test_html_and_hosts(spark):
    html = '<p>a<b>b</b></p><SCRIPT>x="<p>"</script><style>p{}</style><!-- <i>c</i> -->d<br/>e'
    row = spark.createDataFrame([("http://u@WWW.x.org:80/p?q", html), (None, None), ("/p", "")], "url string, html string").select(
        D.host_of(D.F.col("url")).alias("host"), D.lines_of(D.text_of_html(D.F.col("html"))).alias("lines")
    )
    assert [tuple(r) for r in row.collect()] == [("www.x.org", ["a", "b", "d", "e"]), ("", []), ("", [])]


def test_long_pages_of_open_tags_take_linear_time(spark):
    parts = ["a<script>", "a<!--", "a<style>", "a<", "a<script"]
    pages = spark.createDataFrame([(p * (1 << 18),) for p in parts], "html string")
    start = time.monotonic()
    assert [r.lines for r in pages.select(D.lines_of(D.text_of_html(D.F.col("html"))).alias("lines")).collect()] == [["a"]] * len(parts)
    assert time.monotonic() - start < 20
