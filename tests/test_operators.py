"""Operators on DataFrames, sources, plans and streams."""

import io
import random
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.functions import counting
from docloom.operators import catalog, keywords, layout, placement, recognition, summaries
from docloom.plans import analysis
from docloom.sources import files
from docloom.streaming import ingest


def frame(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")


def test_keywords_golden(spark):
    docs = frame(spark, "Python developer with experience in Django, Flask and PostgreSQL.", None, "", "a data of science flask")
    got = {r.doc_id: r.keywords for r in keywords.keywords(docs).collect()}
    assert got[0] == ["postgresql", "python", "django", "flask", "experience", "developer", "experience django", "python developer", "django flask"]
    assert got[1] == got[2] == [] and "science flask" in got[3]
    scores = {r.word: (r.score, r.n) for r in keywords.ranked_terms(docs.where("doc_id = 0")).collect()}
    assert scores == {"postgresql": (8, 1), "python": (7, 1), "django": (7, 1), "flask": (7, 1), "experience": (3, 1), "developer": (3, 1)}


def test_no_more_than_the_limit(spark):
    docs = frame(spark, " ".join(f"word{chr(97 + k)}{chr(97 + k)}" for k in range(26)))
    assert len(keywords.keywords(docs, limit=4).first().keywords) == 4


def test_greedy_cover(spark):
    rows = [(0, ["a"]), (1, ["a"]), (2, []), (3, ["a", "b"])]
    df = spark.createDataFrame([([(k, f"s{k}", t) for k, t in rows],)], "l array<struct<pos:int,sentence:string,topics:array<string>>>")
    assert df.select(summaries.cover(F.col("l"), 3).alias("v")).first().v == ["s0", "s2", "s3"]


def test_summaries_by_kind(spark):
    plain = "This guide explains how docker containers support the deployment of a larger application in production. "
    docs = frame(spark, None, plain, plain + "Words without any further meaning are repeated here and there is nothing else. " * 20, "a | b\n" * 9, "Education\nLinkedIn GitHub\nSkills\nPython")
    got = {r.doc_id: r for r in summaries.summaries(docs).collect()}
    assert [got[k].kind for k in range(5)] == ["empty", "short", "normal", "structured", "resume"]
    assert "KEY FLOW / STEPS\n• This guide explains" in got[1].summary and "\nKEY POINTS\n• This guide" in got[2].summary
    assert got[0].summary.startswith("No meaningful text") and got[4].summary.startswith("PURPOSE\n")


def test_catalog(spark):
    docs = spark.createDataFrame([(1, "u", "a_b 50%"), (2, "u", "axb"), (3, "v", "AXB"), (4, "u", None)], "doc_id long, source string, text string")
    ids = lambda d: sorted(r.doc_id for r in d.collect())
    assert ids(catalog.search(docs, " A_B ", ["text"], "u")) == [1, 2] and ids(catalog.search(docs, "", ["text"], "u")) == [1, 2, 4]
    assert ids(catalog.lookup(docs, "v", 3)) == [3] and ids(catalog.lookup(docs, "u", 3)) == []
    new = spark.createDataFrame([(2, "u", "new"), (9, "w", "x")], docs.schema)
    assert {(r.doc_id, r.text) for r in catalog.upsert(docs, new).collect()} == {(1, "a_b 50%"), (2, "new"), (3, "AXB"), (4, None), (9, "x")}
    assert ids(catalog.remove(docs, new)) == [1, 3, 4]
    good, bad = catalog.split_empty(docs)
    assert ids(good) == [1, 2, 3] and ids(bad) == [4]
    assert [(r.marked, r.pages) for r in catalog.occurrences(docs, "a_b").collect()] == [("[a_b] 50%", [0])]
    assert ids(catalog.recent(docs.withColumn("uploaded_at", F.lit(5) - F.col("doc_id")), 2)) == [1, 2]
    users = spark.createDataFrame([("ann", "ann@x.io")], "username string, email string")
    asked = [("ann", "z@x.io", "p", "p"), ("bob", "ANN@x.io", "p", "p"), ("cat", "cat@x.io", "p", "q"), ("dan", "dan@x.io", "p", "p"), ("eve", "bad", "p", "p")]
    fresh = catalog.new_users(spark.createDataFrame(asked, "username string, email string, password string, confirm string"), users)
    assert [r.username for r in fresh.collect()] == ["dan"]


@pytest.mark.parametrize(("centres", "low", "want"), [([100, 150, 200, 250, 700, 750, 800, 850], -1, 475), ([100, 150, 200, 250, 700, 750, 800, 850], 0, None), ([100, 130, 160, 190, 220, 250, 280, 310], -1, None)])
def test_column_split(spark, centres, low, want):
    rows = [(1, "w", 10.0 if k == low else 90.0, x - 10, 20) for k, x in enumerate(centres)]
    boxes = spark.createDataFrame(rows, "image_id long, text string, conf double, left int, width int")
    assert layout.column_splits(boxes, spark.createDataFrame([(1, 1000)], "image_id long, image_width int")).first().split == want


def test_complex_pages(spark):
    good = "A perfectly ordinary paragraph without trouble"
    pages = spark.createDataFrame([(1, good, 100), (2, good, 100), (3, "", 100)], "page_id long, text string, page_width int")
    blocks = spark.createDataFrame([(1, 0.0, 20.0, "a"), (1, 0.0, 20.0, "b"), (1, 80.0, 99.0, "c"), (1, 80.0, 99.0, "d"), (2, 0.0, 99.0, "a")], "page_id long, x0 double, x1 double, text string")
    assert {r.page_id: r.complex for r in layout.complex_pages(pages, blocks).collect()} == {1: True, 2: False, 3: True}


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(body, pages=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        if pages:
            z.writestr("docProps/app.xml", f"<Properties><Pages>{pages}</Pages></Properties>")
    return out.getvalue()


P = "<w:p><w:r><w:t>{}</w:t></w:r></w:p>"


def test_files_become_documents(spark, tmp_path):
    table = "<w:tbl><w:tr><w:tc>" + P.format("a") + "</w:tc><w:tc>" + P.format("b") + "</w:tc></w:tr></w:tbl>"
    (tmp_path / "a.TXT").write_bytes("first line\nsecond \xff line".encode("latin-1"))
    (tmp_path / "b.docx").write_bytes(docx(P.format("Hello") + table + P.format("Bye"), 3))
    (tmp_path / "c.docx").write_bytes(docx(P.format("x") + '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'))
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / "e.pdf").write_bytes(b"two")
    (tmp_path / "f.png").write_bytes(b"img")
    (tmp_path / "g.exe").write_bytes(b"no")
    got = {r.name: r for r in files.documents(files.scan(spark, str(tmp_path)), pdf=lambda b: ["page one", ""]).collect()}
    assert got["a.TXT"].text == "first line\nsecond line" and got["a.TXT"].page_info.label == "Estimated text pages"
    assert got["b.docx"].text == "Hello\n[TABLE 1]\na | b\nBye" and tuple(got["b.docx"].page_info) == (3, True, "Saved Word pages")
    assert (got["c.docx"].page_info["count"], got["c.docx"].page_info.exact) == (2, False)
    assert got["d.docx"].error and got["d.docx"].page_info.label == "Page count unavailable"
    assert got["e.pdf"].text == "--- Page 1 ---\npage one\n--- Page 2 ---\n[No text detected on this page]" and got["e.pdf"].page_info["count"] == 2
    assert tuple(got["f.png"].page_info) == (1, True, "Image page")
    assert "no engine" in got["f.png"].error and "unsupported" in got["g.exe"].error


def test_pdf_pages_are_recognised_where_their_text_is_poor(spark, tmp_path):
    for name in ("a.pdf", "b.pdf"):
        (tmp_path / name).write_bytes(name.encode())
    fine = "A plain sentence of selectable text stands here."
    left, right = (10, 90, "l"), (110, 190, "r")
    pages = [(fine, 200, [left] * 4, b"never"), ("", 200, [], b"scan"), (fine, 200, [left, left, right, right], b"columns"), (fine, 200, [left, left, right, right], b"fail"), ("", 200, [], b"fail"), ("", 200, [], b"blank"), fine]

    def pdf(content):
        return pages if content == b"a.pdf" else 1 / 0

    def ocr(image):
        return {b"scan": ["seen text"], b"columns": ["left", "right"], b"blank": [" "]}[image]

    got = {r.name: r for r in files.documents(files.scan(spark, str(tmp_path)), pdf=pdf, ocr=ocr).collect()}
    want = [fine, "seen text", "left\nright", fine, "[OCR failed - no text could be extracted]", "[No text detected on this page]", fine]
    assert got["a.pdf"].text == "\n".join(f"--- Page {k} ---\n{t}" for k, t in enumerate(want, 1))
    assert tuple(got["a.pdf"].page_info) == (7, True, "Actual PDF pages") and "ZeroDivisionError" in got["b.pdf"].error


def test_model_step(spark):
    docs = frame(spark, "Alpha is here. Beta follows. Gamma ends.", None)
    ok = {r.doc_id: r.ai for r in analysis.model_analysis(docs).collect()}
    assert ok[0].success and ok[0].insights and not ok[1].success
    assert not analysis.model_analysis(docs, None).where("doc_id = 0").first().ai.success
    failed = analysis.model_analysis(docs, lambda p: 1 / 0).where("doc_id = 0").first().ai
    assert not failed.success and "ZeroDivisionError" in failed.message


def test_analysis_and_report(spark):
    docs = frame(spark, "Docker and Flask are used. Write to a@b.co", None)
    rows = analysis.analyse(docs)
    got = {r.doc_id: r for r in rows.collect()}
    assert set(got) == {0, 1} and got[0].information.emails == ["a@b.co"] and got[1].keywords == []
    text = {r.doc_id: r.report for r in analysis.report(rows, F.lit("n.txt")).collect()}
    assert "Emails: ['a@b.co']" in text[0] and "AI analysis is not configured." in text[0] and "KEY INSIGHTS" in text[0] and "No keywords found." in text[1] and "No text could be extracted." in text[1]


def test_analysis_shuffles_nothing(spark, tmp_path):
    frame(spark, "Docker and Flask are used.").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for df in (analysis.analyse(docs), keywords.keywords(docs), keywords.ranked_terms(docs), summaries.summaries(docs), summaries.scored_sentences(summaries.prepared(docs))):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_null_and_repeated_ids_are_rows_of_their_own(spark):
    docs = spark.createDataFrame([(None, "flask and django here"), (1, "docker twice docker"), (1, "pandas alone"), (1, "pandas alone")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.keywords[0]) for r in keywords.keywords(docs).collect())
    assert got == [(0, "django"), (1, "docker"), (1, "pandas"), (1, "pandas")]
    assert analysis.analyse(docs).count() == summaries.summaries(docs).count() == 4


def test_counting_in_arrays(spark):
    rng = random.Random(3)
    lists = [[rng.choice("abcde") for _ in range(rng.randint(0, 30))] for _ in range(40)] + [[]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, a array<string>")
    got = df.select("k", counting.counted(F.col("a")).alias("c"), counting.first_of_each(F.col("a"), F.upper).alias("f")).collect()
    for r in got:
        want = Counter(lists[r.k])
        assert {x.item: (x.n, x.first) for x in r.c} == {x: (n, lists[r.k].index(x)) for x, n in want.items()}
        assert r.f == list(dict.fromkeys(lists[r.k]))


def test_small_tables_are_spread_and_large_ones_left(spark):
    docs = spark.range(10)
    assert placement.spread(docs).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert "Exchange" not in placement.spread(docs, task_bytes=1)._jdf.queryExecution().executedPlan().toString()


def test_python_lists(spark):
    lists = [["a"], ["it's", 'say "x"', "both ' and \""], ["a\\b", "tab\there\nline"], []]
    df = spark.createDataFrame([(x,) for x in lists], "a array<string>")
    assert [r.v for r in df.select(analysis.quoted_list(F.col("a")).alias("v")).collect()] == [repr(x) for x in lists]


def test_recognition_of_images(spark):
    """Two columns, a page that a second reading improves, an engine that fails."""

    def words(image):
        if image == b"two":
            return 1000, [("w", 90.0, x, 20) for x in (90, 140, 190, 240, 690, 740, 790, 840)]
        return 1 / 0 if image == b"broken" else (1000, [])

    def read(image, mode, span):
        if image == b"broken":
            raise ValueError
        if image == b"two":
            return "the left column of a page" if span and span[0] == 0 else "the right column" if span else "never"
        return {6: "short", 11: "a longer reading of the sparse page"}[mode]

    images = spark.createDataFrame([(1, b"two"), (2, b"sparse"), (3, b"broken")], "image_id long, image binary")
    got = {r.image_id: r.text for r in recognition.recognise(images, words, read).collect()}
    # columns are apart by an empty line, which cleaning takes out
    assert got == {1: "the left column of a page\nthe right column", 2: "a longer reading of the sparse page", 3: ""}
    e = spark.range(1).select(recognition.edges(F.lit(1000), F.lit(10)).alias("e"), recognition.edges(F.lit(1000), F.lit(995)).alias("f")).first()
    assert tuple(e.e) == (1, 25) and tuple(e.f) == (980, 999)


def test_stream(spark, tmp_path):
    docs = frame(spark, "one two", "three")
    docs.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        ingest.run(ingest.analysed(ingest.incoming(spark, str(tmp_path / "in"), docs.schema)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.word_count for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
