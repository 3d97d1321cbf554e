"""Golden vectors of normalisation and extraction."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import extract as X
from docloom.functions import summary as S
from docloom.functions import text as T


def one(spark, f, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.v for r in df.select("k", f(F.col("t")).alias("v")).orderBy("k").collect()]
    return got if len(got) > 1 else got[0]


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (T.clean_extracted, "20262028", "2026-2028"),
        (T.clean_extracted, "120262028", "120262028"),
        (T.clean_extracted, "66+ years 67+ years 77+year", "6+ years 67+ years 7+ years"),
        (T.clean_extracted, "$500 fee", "500 fee"),
        (T.clean_extracted, "Al and AL", "AI and AL"),
        (T.clean_extracted, "ﬁle", "file"),
        (T.clean_extracted, "a\r\n\r\n  ★ b\tc \n•••\n", "a\nb c"),
        (T.clean_lines, "Full  time, 2022 – 2024", "full-time, 2022-2024"),
        (T.plain_scan, "95 % |||| -----", "95% || ---"),
        (T.clean_scan, "***\nok\n\n", "ok"),
        (T.clean_scan, "Skills: Tensor Flow, education, experience 2018 Present", "Skills: TensorFlow, education, experience 2018 - Present"),
        (T.for_model, "Tensor Flow 2018 present 95 % 6 + years\n\n x", "TensorFlow 2018-Present 95% 6+ years\nx"),
        (T.visible, "a​b \t c\r\n", "ab c"),
        (T.heading_key, " Skills & Tools: 2 ", "skills & tools"),
        (T.for_summary, "--- Page 3 ---\n[TABLE 2]\nTopic | Status | Role\nbody", "body"),
        (T.words_in, " a  b\nc ", 3),
        (X.document_type, "education skills projects linkedin", "CV / Resume"),
        (X.document_type, "experience skills projects education", "General Document"),
        (X.document_type, "methodology findings results discussion", "Report"),
        (X.document_type, "chapter unit lesson exam", "Study Material"),
        (X.quality, "ab cd\nhello world\nx\n€ 5", 0.49130434782608695),
        (X.quality, "", 0.0),
        (X.estimated_pages, "", 0),
        (X.estimated_pages, "x\n" * 50, 1),
        (X.estimated_pages, "x\n" * 51, 2),
        (X.pages_marked, "--- Page 1 ---\nx\n---page 01---\n--- Page 1 ---", 2),
        (X.emails, "a@b.co, A@b.co a@b.co you@example.com bad@x .q@r.io.", ["a@b.co", "A@b.co", "q@r.io"]),
        (X.phones, "+919876543210", []),
        (X.phones, "call 9876543210", ["9876543210"]),
        (X.phones, "x+919876543210", ["+919876543210"]),
        (X.urls, "see https://a.b/c?d=1). or http://x.y,", ["https://a.b/c?d=1).", "http://x.y,"]),
        (X.dates, "on 01/02/2024, 3-4-24, 70.23.22.9 and 2024-01-02 99/99/9999", ["01/02/2024", "3-4-24", "70.23.22", "99/99/9999"]),
        (X.amounts, "Fees ₹ 1,200 then Rs. 500 and rs 20, INR 7.50, rs, and ₹5", ["₹ 1,200", "₹5", "Rs. 500", "rs 20,", "rs,", "INR 7.50"]),
        (X.commands, "python -m pip install x", ["python -m pip install x", "pip install x"]),
        (X.wrapped, "y" * 200, ["y" * 95, "y" * 95, "y" * 10]),
        (X.answer_summary, "SUMMARY: One. KEY INSIGHTS: - a", "One."),
        (X.answer_summary, "whole text", "whole text"),
        (X.answer_insights, "KEY INSIGHTS:\n- 1. Alpha\n2026 graduates\n99.53% accuracy\n* (beta)\nDOCUMENT: x", ["Alpha", "graduates", "% accuracy", "(beta)"]),
        (S.topic_sentence, "nothing", ""),
        (S.topic_sentence, "docker", "The main technical area covered is Docker."),
        (S.topic_sentence, "docker nlp logging", "The main technical areas covered are Docker, Logging and NLP."),
        (S.sentences, "Short one. This sentence is certainly longer than forty characters! And yet another sentence that passes the limit? ok", ["This sentence is certainly longer than forty characters!", "And yet another sentence that passes the limit?"]),
        (S.candidate_name, "x\nJ.R. SMITH\nSKILLS", "J.R. Smith"),
        (S.experience, "over 6+ years of animation", "6+ years of animation"),
        (S.accuracy, "97.5%  test accuracy", "97.5% test accuracy"),
    ],
)
def test_golden(spark, f, text, want):
    got = one(spark, f, text)
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


def test_the_type_is_counted_once_in_a_prompt_and_words_are_looked_for_first(spark):
    from docloom.functions import vocabulary as V
    from docloom.plans.analysis import prompt

    of = lambda c: spark.range(1).select(F.lit("x").alias("t")).select(c.alias("v"))._jdf.queryExecution().analyzed().toString().lower()
    listed = sum(map(len, V.TYPE_WORDS.values())) + len(V.TYPE_STRONG)
    assert of(X.document_type(F.col("t"))).count("contains(") == listed
    assert of(prompt(F.col("t"))).count("contains(") - of(T.for_model(F.col("t"))).count("contains(") == listed
    assert of(T.for_model(F.col("t"))).count("contains(") >= len(V.MODEL_SPELLINGS)
    assert one(spark, T.for_model, "T\u0130DB fulltıme Lınkedin \u017fqlite") == one(spark, lambda c: T.respell(c, V.MODEL_SPELLINGS), "T\u0130DB fulltıme Lınkedin \u017fqlite")


def test_null_is_empty(spark):
    for f in (T.clean_extracted, T.clean_lines, T.plain_scan, T.clean_scan, T.for_model, T.visible, T.for_summary, T.words_in, X.document_type, X.quality, X.emails, X.information, X.wrapped, X.answer_insights, S.topic_sentence, S.resume_lines, S.purpose):
        a, b = one(spark, f, None, "")
        assert a == b, f


def test_cleaning_twice_changes_nothing(spark):
    texts = ["• a  b\n\n20222024", "Full time 2020 - 2021\n x ", "plain"]
    for f in (T.clean_extracted, T.for_summary):
        assert one(spark, f, *texts) == one(spark, lambda c, f=f: f(f(c)), *texts)


def test_information_record(spark):
    empty, nothing, some = one(spark, X.information, "", "nothing here", "Docker at a@b.co --- Page 2 ---")
    assert all(v is None for v in empty) and nothing.message and nothing.emails is None
    assert some.emails == ["a@b.co"] and some.pages_processed == 1 and some.technical_topics == ["Docker"] and some.message is None


def test_resume_sections(spark):
    text = "Jane\nEDUCATION\n2022 - 2024 | Diploma\nA | B | MCA\nSkills:\nSQL\nProjects\nSales Dashboard App\npython, pandas\n"
    rows = one(spark, S.resume_lines, text)
    assert [(r.section, r.line) for r in rows][:3] == [("header", "Jane"), ("education", "2022 - 2024 | Diploma"), ("education", "A | B | MCA")]
    assert one(spark, lambda c: S.education(S.resume_lines(c)), text) == ["2022 - 2024 | Diploma"]
    assert one(spark, lambda c: S.projects(S.resume_lines(c)), text) == ["Sales Dashboard App"]
    out = one(spark, S.resume_summary, text + "6 years of experience")
    assert out.startswith("PURPOSE\nThe candidate has 6 years of experience with skills including") and "• Sales Dashboard App" in out and out.endswith("1 notable project(s).")
