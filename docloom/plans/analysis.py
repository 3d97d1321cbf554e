"""The whole analysis of documents, reports of it, and the optional language-model step."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions.text import for_model, let, strip, text_of, words_in
from ..operators.keywords import keyword_list
from ..operators.summaries import summary_of

ANALYSIS = "success boolean, summary string, insights array<string>, raw_response string, message string"
PROMPTS = {
    "CV / Resume": "Below is a CV. Sum up the person's background, strongest skills, education and projects, using only what it says.",
    "Study Material": "Below is study material. Sum up what it teaches, its main concepts and what a learner should keep in mind.",
    "Report": "Below is a report. Sum up its aim, method, findings, conclusions and advice, using only what it says.",
    "General Document": "Below is a document. Sum up its subject, main points and any facts a reader would act on.",
}
FORM = "\nAnswer in this form:\nSUMMARY: a paragraph\nKEY INSIGHTS:\n- up to five points\n\nDOCUMENT:\n"


def prompt(text: Column) -> Column:
    """The prompt for a document by its type."""

    def asked_for(kind: Column) -> Column:
        out = F.lit(PROMPTS["General Document"])
        for k, p in PROMPTS.items():
            out = F.when(kind == k, F.lit(p)).otherwise(out)
        return out

    return F.concat(let(X.document_type(text), asked_for), F.lit(FORM), for_model(text))


def offline(prompts: list[str]) -> list[str]:
    """A stand-in for a model: repeats the first sentences of the document."""
    out = []
    for p in prompts:
        parts = [s.strip() for s in p.partition("DOCUMENT:\n")[2].replace("\n", " ").split(". ") if s.strip()]
        out.append("SUMMARY: " + ". ".join(parts[:2]) + "\nKEY INSIGHTS:\n" + "\n".join(f"- {s}" for s in parts[:3]))
    return out


def asked(docs: DataFrame, model: Callable[[list[str]], list[str]], text: str, into: str) -> DataFrame:
    """docs with `into`: the answer of a model called on batches of prompts, and its error; documents without text have no prompt."""

    @F.pandas_udf("answer string, error string")
    def ask(prompts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"answer": None, "error": None}, index=prompts.index, dtype=object)
        there = prompts.notna()
        try:
            if there.any():
                out.loc[there, "answer"] = pd.Series(model(prompts[there].tolist()), index=prompts.index[there], dtype=object)
        except Exception as e:  # noqa: BLE001  a failing service is a message, not a failed job
            out.loc[there, "error"] = f"{type(e).__name__}: {e}"
        return out

    return docs.withColumn(into, ask(F.when(strip(text_of(F.col(text))) != "", prompt(F.col(text)))))


def model_answer(text: Column, a: Column | None) -> Column:
    """The struct ANALYSIS from an answer of asked(); None: no model."""
    none = lambda message: F.struct(F.lit(False).alias("success"), F.lit("").alias("summary"), F.array().cast("array<string>").alias("insights"), F.lit(None).cast("string").alias("raw_response"), message.alias("message"))
    blank, missing = strip(text_of(text)) == "", F.lit("No text available for AI analysis.")
    if a is None:
        return none(F.when(blank, missing).otherwise(F.lit("AI analysis is not configured.")))
    done = F.struct(F.lit(True).alias("success"), X.answer_summary(a["answer"]).alias("summary"), X.answer_insights(a["answer"]).alias("insights"), a["answer"].alias("raw_response"), F.lit(None).cast("string").alias("message"))
    failed = F.concat(F.lit("AI analysis failed: "), a["error"])
    return F.when(blank, none(missing)).when(a["error"].isNull(), done).otherwise(none(failed))


def model_analysis(docs: DataFrame, model: Callable[[list[str]], list[str]] | None = offline, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ai) for every row of docs."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if model is None:
        return rows.select("doc_id", model_answer(F.col("text"), None).alias("ai"))
    return asked(rows, model, "text", "a").select("doc_id", model_answer(F.col("text"), F.col("a")).alias("ai"))


def analyse(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """(doc_id, text, document_type, word_count, keywords, information, summary, ai) for every row of docs; nothing is shuffled."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = asked(rows, model, "text", "a") if model else rows
    t = F.col("text")
    return rows.select(
        "doc_id",
        "text",
        X.document_type(t).alias("document_type"),
        words_in(t).alias("word_count"),
        keyword_list(t).alias("keywords"),
        X.information(t).alias("information"),
        summary_of(t)["summary"].alias("summary"),
        model_answer(t, F.col("a") if model else None).alias("ai"),
    )


def quoted_list(a: Column) -> Column:
    """A list of texts as Python writes it."""
    mark = lambda x: F.when(F.contains(x, F.lit("'")) & ~F.contains(x, F.lit('"')), F.lit('"')).otherwise(F.lit("'"))

    def one(x: Column) -> Column:
        y = F.replace(x, F.lit("\\"), F.lit("\\\\"))
        y = F.when(mark(x) == "'", F.replace(y, F.lit("'"), F.lit("\\'"))).otherwise(y)
        for c, name in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            y = F.replace(y, F.lit(c), F.lit(name))
        return F.concat(mark(x), y, mark(x))

    return F.concat(F.lit("["), F.array_join(F.transform(a, one), ", "), F.lit("]"))


def report(rows: DataFrame, name: Column, title: str = "DOCUMENT ANALYSIS", uploaded: Column | None = None) -> DataFrame:
    """(doc_id, report): the plain-text report of analyse() rows (E46, E48). uploaded: when."""
    ai = F.col("ai")
    rule = lambda c: F.lit(c * 60)
    listed = lambda a, none: F.when(F.size(F.coalesce(a, F.array().cast("array<string>"))) > 0, F.array_join(F.transform(a, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(F.lit(none))
    info = rows.schema["information"].dataType
    shown = []
    for f in info.fieldNames():
        v = F.col(f"information.{f}")
        said = quoted_list(v) if info[f].dataType.typeName() == "array" else v.cast("string")
        shown.append(F.when(v.isNotNull(), F.concat(F.lit(f.replace("_", " ").title() + ": "), said)))
    head = [F.lit(title), rule("="), F.lit(""), F.concat(F.lit("Document: "), name)]
    if uploaded is not None:
        head.append(F.concat(F.lit("Uploaded At: "), uploaded.cast("string")))
    good = F.coalesce(ai["success"], F.lit(False))
    head += [
        F.lit(""), F.lit("AI-POWERED ANALYSIS"), rule("="), F.lit(""),
        F.lit("AI SUMMARY"), rule("-"), F.when(good, ai["summary"]).otherwise(F.coalesce(ai["message"], F.lit("AI analysis unavailable."))), F.lit(""),
        F.lit("KEY INSIGHTS"), rule("-"), F.when(good, listed(ai["insights"], "No AI insights available.")).otherwise(F.lit("No AI insights available.")),
    ]
    parts = [
        *head, F.lit(""),
        F.lit("KEYWORDS"), rule("-"), listed(F.col("keywords"), "No keywords found."), F.lit(""),
        F.lit("EXTRACTED INFORMATION"), rule("-"), F.coalesce(F.nullif(F.concat_ws("\n", *shown), F.lit("")), F.lit("No structured information found.")), F.lit(""),
        F.lit("SUMMARY"), rule("-"), F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.lit("No summary available.")), F.lit(""),
        F.lit("EXTRACTED TEXT"), rule("-"), F.coalesce(F.nullif(F.col("text"), F.lit("")), F.lit("No text could be extracted.")),
    ]
    return rows.select("doc_id", F.concat_ws("\n", *parts).alias("report"))
