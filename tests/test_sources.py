from pyspark.sql import functions as F

from tidegraph.operators import metering
from tidegraph.sources import documents, html

MD = '---\ndoc_id: "a"\ntitle: "x"\ntitle: "T \\"q\\""\nbad: nope\n---\n\n# T\n\nbody --- more\n'


def test_markdown(spark, tmp_path):
    (tmp_path / "b.md").write_text(MD, encoding="utf-8")
    (tmp_path / "a.md").write_text("---\nk: \"v\"\n---\nz", encoding="utf-8")
    rows = documents.read_markdown(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r["id"], r["content"]) for r in rows] == [("a", "z"), ("a", "# T\n\nbody --- more")]
    assert rows[1]["metadata"] == {"doc_id": "a", "title": 'T "q"'}


def test_manifest(spark, tmp_path):
    rows = spark.createDataFrame([("b", "t1", 1), ("a", None, 2), ("b", "t2", 3), ("", "x", 4)], "doc_id string, title string, o int")
    documents.write_manifest(documents.latest(rows, "o"), str(tmp_path / "m"))
    got = documents.read_manifest(spark, str(tmp_path / "m")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["title"]) for r in got] == [("a", None), ("b", "t2")] and len(got[0]) == 7


def test_html(spark):
    page = "<title>T &amp; x</title><nav>no<nav>no</nav></nav><p>One <b>two</b><br>three<script>var t='</p>'</script><li>é &lt;"
    row = spark.createDataFrame([(page,)], "h string").select(html.title("h"), html.page_text("h"), html.parse("h").alias("x"), html.links(F.lit('<a href="/a"><a href="/b"><a href="/a">'))).head()
    assert row[0] == "T &amp; x" and "var t" not in row[1] and row[1].endswith("é <")
    assert row["x"]["title"] == "T & x" and row["x"]["text"] == "T & x\nOne two\nthree\né <" and row[3] == ["/a", "/b"]


def test_prices(spark):
    log = spark.createDataFrame([("openai/gpt-4o-mini", 1000, 100), ("nobody", 5, 5)], "model string, input_tokens long, output_tokens long")
    assert [round(r["usd"], 9) for r in metering.priced(log, metering.prices(spark)).orderBy("input_tokens").collect()] == [0.0, 0.00021]


def test_writer_makes_a_file_a_document(spark, tmp_path):
    rows = [("a/1", "One", "first body"), ("b", "Two", "second\n\nbody --- with a rule")]
    docs = spark.createDataFrame(rows, "doc_id string, title string, body string")
    folder = tmp_path / "out"
    assert documents.write_markdown(docs, str(folder)) == 2
    assert sorted(p.name for p in folder.glob("*.md")) == ["a-1.md", "b.md"]
    (folder / "plain.md").write_text("no front matter here")
    got = {r["id"]: r["content"] for r in documents.read_markdown(spark, str(folder)).collect()}
    assert got == {"a/1": "# One\n\nfirst body", "b": "# Two\n\nsecond\n\nbody --- with a rule", "plain": "no front matter here"}


def test_manifest_upsert_and_gate(spark):
    old = spark.createDataFrame([("a", "old"), ("b", "stays")], "doc_id string, title string")
    new = spark.createDataFrame([("a", "new"), ("c", "more")], "doc_id string, title string")
    got = [(r["doc_id"], r["title"]) for r in documents.upsert_manifest(old, new).collect()]
    assert got == [("a", "new"), ("b", "stays"), ("c", "more")]
    pages = spark.createDataFrame([("x" * 80, "text/html; charset=utf-8"), ("x" * 79, "text/html"), (None, "text/plain"), ("y" * 90, "image/png")], "content string, kind string")
    assert documents.content_gate(pages).count() == 2 and documents.content_gate(pages, kind="kind").count() == 1


def test_law_and_news_pages(spark):
    law = '<p>x</p><div class="mw-parser-output"><p>intro</p><h3>Điều 1. Tội A</h3><p>một</p><p>↑ note</p><h3>Điều 22.  B </h3><p>hai</p><p>Chú thích</p><p>gone</p></div><div class="printfooter">Điều 3. no'
    rows = html.law_pages(spark.createDataFrame([("u", "BLHS", "v", law)], "url string, law string, version string, html string")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["title"], r["body"]) for r in rows] == [("blhs-dieu-1", "Điều 1 BLHS. Tội A", "Điều 1. Tội A\nmột"), ("blhs-dieu-22", "Điều 22 BLHS. B", "Điều 22.  B\nhai")]
    page = '<h1 data-role="title">Vụ &amp; Ma túy</h1><h2 data-role="sapo">lead</h2><i itemprop="datePublished" datetime="2026"></i><div data-role="content"><p>' + "y" * 300 + "</p><p>short</p><p>" + "z" * 41 + '</p></div detail-author-bot><p>' + "w" * 99
    pages = spark.createDataFrame([("/a-b-123.htm", "u", page + "</p>"), ("/c-1.htm", "u", page.replace("y" * 300, "y")), ("/d-2.htm", "u", None)], "path string, url string, html string")
    got = html.news_pages(pages, "ma túy").collect()
    assert [tuple(r) for r in got] == [("news-123", "Vụ & Ma túy", "u", "2026", "lead\n\n" + "y" * 300 + "\n\n" + "z" * 41)]
    link = lambda *n: "".join(f'<a href="/x-{k:015d}.htm">' for k in n)
    lists = spark.createDataFrame([(0, link(1, 2, 1)), (1, link(2, 3, 4)), (2, link(5))], "ord int, html string")
    assert [r["path"][-5] for r in html.news_links(lists, 2).orderBy("place").collect()] == ["1", "2", "3", "4"]
    assert html.news_links(lists, 1).count() == 2 and html.news_links(lists, 9).count() == 5


def test_metadata_keeps_extra_columns(spark):
    rows = spark.createDataFrame([("http://h/a/my%20page.html", "", "x", "", "no"), ("http://h/", "T", None, "2", "no")], "url string, title string, publisher string, document_version string, Bad string")
    got = documents.page_metadata(rows, ("publisher", "Bad", "title")).collect()
    assert [(r["doc_id"], r["title"], r["document_version"], r["extra"]) for r in got] == [("my-20page", "My 20page", "not-stated", {"publisher": "x"}), ("t", "T", "2", {})]


def test_news_bodies_are_made_once(spark):
    from tidegraph.sources import html

    page = '<h1 data-role="title">Topic</h1><div data-role="content"><p>' + "y" * 400 + "</p></div>"
    out = html.news_pages(spark.createDataFrame([("/a-1.htm", "u", page), ("/a-2.htm", "u", page[:90])], "path string, url string, html string"), "topic")
    assert [(r["doc_id"], r["body"]) for r in out.collect()] == [("news-1", "y" * 400)]
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not any("lambdafunction" in line for line in plan if "Filter (" in line)
