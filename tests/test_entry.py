"""The driver's entry points."""

import ast
import os

import __spark_entry__ as entry
from docloom import queries as own

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = "/root/testdata/sf0.001"


def test_queries_and_oracles_match(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(own.QUERIES) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_queries_run_on_the_smallest_tables(spark):
    for name in ("keyword_lists", "document_types", "resume_entries", "page_columns", "document_upsert", "lines_by_page", "pdf_documents", "text_files"):
        assert own.QUERIES[name](spark, SMALL).count() > 0, name


def compared(spark, name, texts, folder):
    """What a query and its SQL give for a table of documents with these texts."""
    import duckdb

    rows = spark.createDataFrame([(k, t, "es", "src0", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(f"{folder}/documents.parquet")
    got = {tuple(r) for r in own.QUERIES[name](spark, str(folder)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    return got, set(db.execute(own.ORACLES[name]).fetchall())


def test_cleaning_has_the_boundaries_of_its_sql(spark, tmp_path):
    texts = ["cimenteco. Alñlldorr", "ñAl Al Alx xAl _Al", "ñ20262028ñ a20262028 120262028", "66+ yearsñ ñ66+ years 66+\u2028years 77+ yearsx", "\u2028• a\n\u1680b \x0b"]
    got, want = compared(spark, "clean_extracted_text", texts, tmp_path)
    assert got == want and any("AIñlldorr" in out for _, out in got)


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "docloom")):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                tree = ast.parse(open(os.path.join(folder, n)).read())
                found = [x.module or "" for x in ast.walk(tree) if isinstance(x, ast.ImportFrom)] + [a.name for x in ast.walk(tree) if isinstance(x, ast.Import) for a in x.names]
                assert not any("llm" in f.split(".") for f in found), n
