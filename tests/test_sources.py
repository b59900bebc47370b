from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from inkweave.plans.engine import Corpus
from inkweave.sources import files, parse, store


def package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


RELS = '<Relationships xmlns="r"><Relationship Id="r1" Target="https://x.example/a"/><Relationship Id="s1" Target="worksheets/sheet1.xml"/></Relationships>'


def test_markdown():
    raw = b"# Deploy **Guide** #\n\nSee [the runbook](runbook.md 'T') and [on call][OC] or ![pic](p.png).\n> quoted\n- item one\nSetext\n---\n[oc]: <oncall.md>\n```\ncode\n"
    p = parse.parse_markdown(raw, "deploy-guide.md")
    assert p.title == "Deploy Guide" and p.headings == ["Deploy Guide", "Setext"]
    assert p.targets == ["oncall.md", "runbook.md", "p.png", "oncall.md"]
    assert p.links == [("the runbook", "runbook.md"), ("on call", "oncall.md")]
    assert p.text.split("\n") == ["Deploy Guide", "See the runbook and on call or pic.", "quoted", "item one", "Setext", "code"]


def test_html():
    raw = b"<html><head><title>A &amp; B</title><script>no</script></head><body><h1>Top <b>one</b></h1><p>Hi<br>you&nbsp;&#x21;</p><a href=\"x.md\">go</a><a href='#top'>t</a><a href=y.md>z</a><script>var a</script></body>"
    p = parse.parse_html(raw, "f.html")
    assert (p.title, p.headings, p.targets, p.links) == ("A & B", ["Top one"], ["x.md", "y.md"], [("go", "x.md"), ("z", "y.md")])
    assert "no" not in p.text and "Hi\nyou" in p.text
    assert parse.parse_html(b"<p>unclosed", "my-page.html").title == "My Page"


def test_office():
    word = '<w:document xmlns:w="w" xmlns:r="r"><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:hyperlink r:id="r1"><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p></w:document>'
    p = parse.parse_office(package({"word/document.xml": word, "word/_rels/document.xml.rels": RELS, "docProps/core.xml": "<c xmlns:d='d'><d:title> T </d:title></c>"}), "a.docx", "docx")
    assert (p.title, p.headings, p.text, p.links) == ("T", ["Head"], "Head\nlink", [("link", "https://x.example/a")])
    slide = '<p:s xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>{}</a:t></a:r></a:p></p:s>'
    p = parse.parse_office(package({f"ppt/slides/slide{i}.xml": slide.format(f"S{i}") for i in (10, 2)}), "a.pptx", "pptx")
    assert p.text == "Slide 1: S2\nSlide 2: S10"
    sheet = '<s xmlns="m"><row><c t="s"><v>0</v></c><c t="b"><v>1</v></c><c><v>3.5</v></c><c t="inlineStr"><is><t>in</t></is></c></row></s>'
    book = '<w xmlns="m" xmlns:r="r"><sheet name="One" r:id="s1"/></w>'
    p = parse.parse_office(package({"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": RELS, "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": '<t xmlns="m"><si><t>shared</t></si></t>'}), "a.xlsx", "xlsx")
    assert p.text == "Sheet: One\nshared | TRUE | 3.5 | in"
    for bad in (b"no zip", package({"x": "y"}), b""):
        assert all(parse.parse_office(bad, "b", k).status == "unreadable" for k in ("docx", "pptx", "xlsx"))


def test_csv_and_entities():
    assert parse.parse_csv('a,"b ""q"", x"\r\nc\n"two\nlines",d,e\n\n') == [["a", 'b "q", x'], ["c"], ["two\nlines", "d", "e"]]
    assert parse.parse_csv("") == []
    assert parse.decode_entities("&lt;&#65;&#x42;&unknown;") == "<AB&unknown;"


def test_folder_to_graph(spark, tmp_path):
    (tmp_path / "docs/.hidden").mkdir(parents=True)
    (tmp_path / "docs/node_modules").mkdir()
    (tmp_path / "docs/deploy.md").write_text("# Deploy\nThe AuthService and TokenStore. See [run](run.txt).")
    (tmp_path / "docs/run.txt").write_text("AuthService and TokenStore restart. deploy.md has more")
    (tmp_path / "docs/.hidden/x.md").write_text("x")
    (tmp_path / "docs/node_modules/y.md").write_text("y")
    (tmp_path / "docs/z.exe").write_text("z")
    c = Corpus.from_folder(spark, str(tmp_path / "docs"))
    assert sorted(r.path for r in c.documents.collect()) == ["docs/deploy.md", "docs/run.txt"]
    nodes, edges = c.graph()
    kinds = {r.kind for r in edges.collect()}
    assert {"reference", "entity"} <= kinds and nodes.where("kind = 'document'").select("community").distinct().count() == 1
    assert c.search("restart").first().title == "Run"


def test_admission(spark):
    f = spark.createDataFrame([("a", 5), ("b", 50), ("c", 6), ("d", 1)], "path string, size bigint")
    assert {r.path: r.admission for r in files.admit_files(f, 10, 11).collect()} == {"a": "taken", "b": "ignored", "c": "taken", "d": "deferred"}


def test_vectors_as_text(spark):
    df = spark.createDataFrame([([1.0, -2.5],), ([],), (None,)], "v array<float>")
    back = df.select(store.base64_to_vector(store.vector_to_base64("v")).alias("v")).collect()
    assert [r.v for r in back] == [[1.0, -2.5], [], None]
    odd = spark.createDataFrame([("AACAPwA=",), ("no base64!",)], "s string").select(store.base64_to_vector("s").alias("v")).collect()
    assert [r.v for r in odd] == [[1.0], None]


def test_share_links(spark):
    text = store.encode_share({"version": 1, "nodes": [{"id": "n0", "path": "secret"}]})
    assert store.decode_share(text) == {"version": 1, "nodes": [{"id": "n0"}]}
    for bad in ("", "!!", text[:-6], store.encode_share({"version": 2})):
        with pytest.raises(ValueError):
            store.decode_share(bad)
    nodes = spark.createDataFrame([(c, "t", "p", "f", 1) for c in "ab"], "id string, title string, path string, folder_key string, last_modified bigint")
    edges = spark.createDataFrame([("a", "b", "entity", 0.5)], "source string, target string, kind string, weight double")
    n, e = store.share_graph(nodes, edges)
    assert sorted(n.columns) == ["id", "title"] and tuple(e.first()) == ("e0", "n0", "n1", "entity", 0.5)


def test_import(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"version": 1, "nodes": [{"id": "a", "title": "A", "topics": ["t"]}, {"id": "b"}], "edges": [{"id": "e", "source": "a", "target": "b", "kind": "entity", "weight": 9}]}')
    nodes, edges = store.import_graph(spark, str(tmp_path / "g.json"))
    assert sorted(r.id for r in nodes.collect()) == ["a", "b"] and [r.weight for r in edges.collect()] == [1.0]
    (tmp_path / "h.json").write_text('{"version": 2, "nodes": [{"id": "a"}], "edges": []}')
    assert store.import_graph(spark, str(tmp_path / "h.json"))[0].count() == 0


def test_cache_and_snapshots(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "y")], "id string, text string")
    vec = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "id string, vector array<float>")
    store.write_cache(docs, vec, str(tmp_path / "c"), "m1")
    assert {r.id: r.stale for r in store.read_cache(spark, str(tmp_path / "c"), "m1", 2).collect()} == {"a": False, "b": True}
    assert all(r.stale for r in store.read_cache(spark, str(tmp_path / "c"), "m2", 2).collect())
    nodes = spark.createDataFrame([("a", "document"), ("t", "topic")], "id string, kind string")
    store.save_snapshot(spark, str(tmp_path / "s"), 7, "n", nodes, spark.createDataFrame([], "source string, target string"))
    assert store.load_snapshot(spark, str(tmp_path / "s"), 7)[0].count() == 2
    a, b = spark.createDataFrame([("x",), ("y",)], "id string"), spark.createDataFrame([("y",), ("x",), ("x",)], "id string")
    assert store.corpus_hash(a).first() == store.corpus_hash(b).first()


def test_page_furniture_and_labels(spark):
    rows = [("d", p, i, line) for p in range(3) for i, line in enumerate([f"Report {p}", f"body {'abc'[p]}"])] + [("e", p, 0, "same") for p in range(2)]
    left = parse.strip_page_furniture(spark.createDataFrame(rows, "doc_id string, page int, line_no int, line string"))
    assert sorted((r.doc_id, r.line) for r in left.collect()) == [("d", "body a"), ("d", "body b"), ("d", "body c"), ("e", "same"), ("e", "same")]
    spans = spark.createDataFrame([("d", 1, 1, "click", 40.0, 100.0, 20.0), ("d", 1, 2, "here", 62.0, 100.0, 20.0), ("d", 1, 3, "far", 200.0, 100.0, 20.0)], "doc_id string, page int, span_no int, str string, tx double, ty double, width double")
    rects = spark.createDataFrame([("d", 1, 0, 38.0, 96.0, 92.0, 110.0)], "doc_id string, page int, rect_no int, x1 double, y1 double, x2 double, y2 double")
    assert parse.link_labels(spans, rects).first().label == "click here"


def test_parse_files(spark):
    df = spark.createDataFrame([("a.md", bytearray(b"# T"), 1), ("b.pdf", bytearray(b"x"), 2), ("c.txt", None, 3)], "name string, content binary, title int")
    got = {r.name: (r.title, r.status) for r in parse.parse_files(df).orderBy(F.col("name")).collect()}
    assert got == {"a.md": ("A", "ok"), "b.pdf": ("B", "unreadable"), "c.txt": ("C", "unreadable")}
