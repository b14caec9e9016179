import time

from pyspark.sql import functions as F

from pagestrata.operators.dom import node_table, sql_inner_html, sql_text, with_nodes
from pagestrata.plans.crawl import crawl
from pagestrata.plans.parse import page_blocks
from pagestrata.streaming.ingest import ingest, page_stream

def at():
    return F.expr("timestamp_seconds(page_id)")


def pages_of(spark, *htmls):
    return spark.createDataFrame([(i, f"http://x.org/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def test_nodes_cut_text_and_markup_by_bytes(spark):
    nodes = with_nodes(pages_of(spark, "<DIV id=a>ü<p>日本<p>b😀</DIV>&copy;<!-- x --><img src=/i.png>", "", None))
    cut = nodes.select("page_id", F.expr(f"transform(nodes, n -> struct(n.tag, {sql_inner_html('n')} AS html, {sql_text('n')} AS text))").alias("n"))
    found = {r.page_id: [(n.tag, n.html, n.text) for n in r.n or []] for r in cut.collect()}
    tags = {t: (h, x) for t, h, x in found[0]}
    assert tags["div"] == ("ü<p>日本</p><p>b😀</p>", "ü日本b😀")
    assert [(h, x) for t, h, x in found[0] if t == "p"] == [("日本", "日本"), ("b😀", "b😀")]
    assert node_table(nodes, "page_id").filter("tag = 'img'").count() == 1


def test_blocks_of_one_page_with_many_sections_take_linear_time(spark):
    def page(n):
        return "<!DOCTYPE html><html><body>" + "".join(f"<section><p>é words of section number {i}, long enough to keep</p></section>" for i in range(n)) + "</body></html>"

    took = {}
    for n in (500, 2000, 4000):
        began = time.perf_counter()
        assert page_blocks(pages_of(spark, page(n)), at()).count() == n
        took[n] = time.perf_counter() - began
    assert took[4000] < 4 * took[2000] + 5


def test_depth_is_the_least_number_of_steps(spark):
    def page(*links):
        return "<html>" + "".join(f'<a href="http://x.org/{k}">l</a>' for k in links) + "</html>"

    rows = pages_of(spark, page(1, 2), page(3), page(3, 4), page(0, 5), page(), page(6)).withColumn("status", F.when(F.col("page_id") == 4, 404).otherwise(200))
    seeds = spark.createDataFrame([("http://x.org/0", 3)], "seed_url string, max_depth int")
    got = {r.url.rpartition("/")[2]: (r.depth, r.status) for r in crawl(rows, seeds, ["x.org"]).collect()}
    assert got == {"0": (0, 200), "1": (1, 200), "2": (1, 200), "3": (2, 200), "4": (2, 404), "5": (3, 200)}
    assert crawl(rows, seeds, ["y.org"]).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    html = "<!DOCTYPE html><html><header><b>head</b></header><section><p>a section with more than enough words in it to be kept</p></section><footer>f</footer></html>"
    pages = pages_of(spark, *[html.replace(">head<", f">head {i}<") for i in range(20)])
    pages.repartition(4).write.parquet(f"{tmp_path}/in")
    query = ingest(page_stream(spark, f"{tmp_path}/in", max_files=1), f"{tmp_path}/out", f"{tmp_path}/log", at())
    query.awaitTermination()
    stored, batch = spark.read.parquet(f"{tmp_path}/out"), page_blocks(pages, at())
    assert stored.count() == 60
    assert stored.select(*sorted(stored.columns)).exceptAll(batch.select(*sorted(stored.columns))).count() == 0


def test_the_reader_holds_the_nodes_of_a_small_piece_of_a_batch():
    """A batch of any number of pages is read piece by piece; one page is never cut."""
    import pyarrow as pa
    from pyspark.sql import types as T

    class Pages:
        schema = T.StructType([T.StructField("html", T.StringType())])

        def mapInArrow(self, read, schema):
            return read

    sources = ["<p>" + "x" * 4000] * 500 + [None, "", "<b>" + "y" * 700_000] + ["<p>z"]
    made = list(with_nodes(Pages())(iter([pa.RecordBatch.from_arrays([pa.array(sources)], names=["html"])])))
    assert [s for b in made for s in b.column("html").to_pylist()] == sources
    assert [len(n) for b in made for n in b.column("nodes").to_pylist()] == [1] * 500 + [0, 0, 1, 1]
    sizes = [[len(s or "") for s in b.column("html").to_pylist()] for b in made]
    assert len(made) > 4 and all(sum(s) - s[-1] < 500_000 for s in sizes)
