"""Readers of files into documents, and sinks.

Files are scanned as binary; parsing of containers is Arrow-batched Python,
everything else stays in expressions. PDF and image engines are passed in,
as none is part of Spark; without one such files get null text and an error.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.extract import estimated_pages, quality
from ..functions.text import clean_extracted


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, extension, length, modified, content) of the files below a path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), "length", F.col("modificationTime").alias("modified"), "content")


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def cell_text(cell) -> list[str]:
    """Texts of a cell: its paragraphs, then rows of nested tables."""
    out = []
    for child in cell:
        if local(child.tag) == "p" and (t := paragraph_text(child).strip()):
            out.append(t)
        elif local(child.tag) == "tbl":
            out += table_rows(child)
    return out


def paragraph_text(p) -> str:
    kinds = {"t": lambda e: e.text or "", "tab": lambda e: "\t", "br": lambda e: "\n", "cr": lambda e: "\n"}
    return "".join(kinds[local(e.tag)](e) for e in p.iter() if local(e.tag) in kinds)


def table_rows(table) -> list[str]:
    rows = []
    for row in (e for e in table if local(e.tag) == "tr"):
        cells = [" ".join(" ".join(cell_text(c)).split()) for c in row if local(c.tag) == "tc"]
        if any(cells):
            rows.append(" | ".join(c for c in cells if c))
    return rows


def docx_blocks(content: bytes) -> str:
    """Paragraphs and tables of a DOCX body in order; tables are numbered."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = next(e for e in ElementTree.fromstring(z.read("word/document.xml")) if local(e.tag) == "body")
    out, n = [], 0
    for block in body:
        if local(block.tag) == "p" and (t := paragraph_text(block).strip()):
            out.append(t)
        elif local(block.tag) == "tbl":
            n += 1
            out += [f"[TABLE {n}]", *table_rows(block)]
    return "\n".join(out)


def docx_pages(content: bytes) -> tuple[int | None, bool, str]:
    """(count, exact, label) of a DOCX: saved pages, else page breaks."""
    none = (None, False, "Page count unavailable")
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = set(z.namelist())
            if "docProps/app.xml" in names:
                found = [e.text for e in ElementTree.fromstring(z.read("docProps/app.xml")).iter() if local(e.tag) == "Pages"]
                if found and (found[0] or "").strip().isdigit() and int(found[0]) > 0:
                    return int(found[0]), True, "Saved Word pages"
            if "word/document.xml" not in names:
                return none
            tags = [(local(e.tag), e.attrib) for e in ElementTree.fromstring(z.read("word/document.xml")).iter()]
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
        return none
    drawn = sum(t == "lastRenderedPageBreak" for t, _ in tags)
    asked = sum(t == "br" and any(local(k) == "type" and v == "page" for k, v in a.items()) for t, a in tags)
    n = max(drawn, asked)
    return (n + 1, False, "Estimated Word pages") if n else none


PARSED = "text string, pages int, exact boolean, label string, error string"
#: An engine gives texts; a PDF engine may give pages as (text, page width, [(x0, x1, text) of blocks], rendered image) instead.
Engine = Callable[[bytes], list]


def parse(kind: str, content: bytes, pdf: Engine | None, ocr: Engine | None) -> tuple:
    """(text, pages, exact, label, error) of one file that is no plain text."""
    try:
        if kind == "docx":
            return docx_blocks(content), *docx_pages(content), None
        engine = {"pdf": pdf}.get(kind, ocr if kind in ("jpg", "jpeg", "png") else None)
        if engine is None:
            pages = (None, False, "Page count unavailable") if kind == "pdf" else (1, True, "Image page")  # an image is a page, read or not (P7)
            return None, *pages, f"no engine for .{kind}"
        parts = [x if isinstance(x, str) else x[0] or "" for x in engine(content)]
        if kind == "pdf":
            marked = [f"--- Page {n} ---\n{t.strip() or '[No text detected on this page]'}" for n, t in enumerate(parts, 1)]
            return "\n".join(marked), len(parts), True, "Actual PDF pages", None
        return "\n".join(parts), 1, True, "Image page", None
    except Exception as e:  # noqa: BLE001  one broken file is a row with an error, not a failed job
        return None, None, False, "Page count unavailable", f"{type(e).__name__}: {e}"


def two_columns(width: float, blocks: list[tuple[float, float, str]]) -> bool:
    """If text blocks stand on both sides of a page."""
    middle = [(a + b) / 2 for a, b, t in blocks if (t or "").strip()]
    return len(middle) >= 4 and sum(x < width * 0.46 for x in middle) >= 2 and sum(x > width * 0.54 for x in middle) >= 2


def recognised_pdfs(rows: DataFrame, pdf: Engine, ocr: Engine) -> DataFrame:
    """(path, p) of PDF files, p as PARSED: empty, poor and two-column pages are recognised, else their own text stands."""

    @F.pandas_udf("pages array<struct<text:string,two:boolean,image:binary>>, error string")
    def read(contents: pd.Series) -> pd.DataFrame:
        out = []
        for c in contents:
            try:
                pages = [(x, 0.0, [], None) if isinstance(x, str) else x for x in pdf(c)]
                out.append(([{"text": t or "", "two": two_columns(w, b), "image": i} for t, w, b, i in pages], None))
            except Exception as e:  # noqa: BLE001  as in parse
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["pages", "error"])

    @F.pandas_udf("text string, failed boolean")
    def seen(images: pd.Series) -> pd.DataFrame:
        out = []
        for i in images:
            try:
                out.append((None if i is None else "\n".join(ocr(i)), False))
            except Exception:  # noqa: BLE001  the page falls back to its own text
                out.append((None, True))
        return pd.DataFrame(out, columns=["text", "failed"])

    own, found = F.col("own"), F.col("found")
    each = rows.select("path", read("content").alias("r")).select("path", F.col("r.error").alias("error"), F.posexplode_outer("r.pages").alias("k", "page"))
    each = each.withColumn("own", clean_extracted(F.coalesce("page.text", F.lit(""))))
    each = each.withColumn("o", seen(F.when((own == "") | (quality(own) < 0.72) | F.col("page.two"), F.col("page.image"))))
    each = each.withColumn("found", clean_extracted(F.coalesce("o.text", F.lit(""))))
    body = F.when(found != "", found).when(own != "", own).when(F.col("o.failed"), "[OCR failed - no text could be extracted]").otherwise("[No text detected on this page]")
    marked = F.concat(F.lit("--- Page "), F.col("k") + 1, F.lit(" ---\n"), body)
    whole = each.groupBy("path").agg(F.sort_array(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", marked.alias("t"))))).alias("pages"), F.first("error").alias("error"))
    good = F.col("error").isNull()
    p = F.struct(
        F.when(good, F.array_join(F.col("pages.t"), "\n")).alias("text"), F.when(good, F.size("pages")).alias("pages"), good.alias("exact"),
        F.when(good, "Actual PDF pages").otherwise("Page count unavailable").alias("label"), F.col("error").alias("error"),
    )
    return whole.select("path", p.alias("p"))


def documents(files: DataFrame, pdf: Engine | None = None, ocr: Engine | None = None) -> DataFrame:
    """Files of scan() as documents: path, name, extension, text, page_info, error.

    Plain texts never leave the JVM; only containers go through Python.
    """

    @F.pandas_udf(PARSED)
    def parsed(kinds: pd.Series, contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(k, c, pdf, ocr) for k, c in zip(kinds, contents, strict=True)], columns=[f.split()[0] for f in PARSED.split(", ")])

    info = lambda n, exact, label: F.struct(n.cast("int").alias("count"), exact.alias("exact"), label.alias("label"))
    raw = utf8(F.col("content"))
    plain = files.where("extension = 'txt'").select("path", "name", "extension", clean_extracted(raw).alias("text"), info(estimated_pages(raw), F.lit(False), F.lit("Estimated text pages")).alias("page_info"), F.lit(None).cast("string").alias("error"))
    boxed = files.where(F.col("extension").isin("docx", "pdf", "jpg", "jpeg", "png"))
    if pdf and ocr:
        pdfs = boxed.where("extension = 'pdf'")
        rest = boxed.where("extension <> 'pdf'").withColumn("p", parsed("extension", "content")).select("path", "name", "extension", "p")
        boxed = rest.unionByName(pdfs.select("path", "name", "extension").join(recognised_pdfs(pdfs, pdf, ocr), "path"))
    else:
        boxed = boxed.withColumn("p", parsed("extension", "content"))
    boxed = boxed.select("path", "name", "extension", clean_extracted(F.col("p.text")).alias("text"), info(F.col("p.pages"), F.col("p.exact"), F.col("p.label")).alias("page_info"), "p.error")
    other = files.where(~F.col("extension").isin(V.EXTENSIONS)).select("path", "name", "extension", F.lit(None).cast("string").alias("text"), info(F.lit(None), F.lit(False), F.lit("Page count unavailable")).alias("page_info"), F.concat(F.lit("unsupported file type ."), "extension").alias("error"))
    return plain.unionByName(boxed).unionByName(other)


def utf8(content: Column) -> Column:
    """Bytes as UTF-8 text; bytes that are none become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


#: What stands between reports in a file; no text has it.
REPORT_END = "\n\f\n"


def write_reports(rows: DataFrame, path: str, report: str = "report") -> None:
    """One text row per report."""
    rows.select(report).write.mode("overwrite").text(path, lineSep=REPORT_END)


def write_json(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)
