"""Predicates and parts of the rule-based summaries as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .extract import every, has_any, named, topics
from .text import contained, heading_key, let, lines, strip, sub, text_of

WORD = r"\b[a-zA-Z][a-zA-Z0-9_.+-]*\b"


def is_resume(c: Column) -> Column:
    """Two strong indicators or six of all."""
    return let(F.lower(text_of(c)), lambda low: (contained(low, V.CV_STRONG) >= 2) | (contained(low, V.CV_TERMS) >= 6))


def is_structural(c: Column) -> Column:
    return F.lower(c).rlike("(?iuU)" + "|".join(f"(?:{p})" for p in V.STRUCTURAL))


def is_command(c: Column) -> Column:
    return F.lower(strip(c)).rlike("(?U)" + V.COMMAND_LINE)


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"\P{L}", ""))


def times(c: Column, mark: str) -> Column:
    return F.length(c) - F.length(F.translate(c, mark, ""))


def is_noise(c: Column) -> Column:
    """Lines that no summary wants."""
    x = strip(c)
    low = F.lower(x)
    starts = low.rlike(r"\A(?:" + "|".join(s.replace("/", "\\/") for s in V.NOISE_STARTS) + ")")
    # cheap tests first: the rest is then not looked at
    return (F.length(x) < 35) | F.contains(x, F.lit("|")) | starts | (times(x, ":") >= 4) | x.rlike(r"[{}]|=>|->") | (letters(x) < 25) | is_command(x) | is_structural(x)


def is_good(c: Column) -> Column:
    """Sentences fit for a summary."""
    low, n = F.lower(c), F.size(every(c, r"\S+"))
    verb = low.rlike(r"(?U)\b(?:" + "|".join(V.VERBS) + r")\b")
    shouted = F.size(F.filter(every(c, r"\b[A-Za-z]+\b"), lambda w: w.rlike(r"\A[A-Z]{3,}\z"))) >= 4
    return ~is_structural(c) & ~has_any(low, V.TITLE_PHRASES) & (times(c, "|") == 0) & (times(c, ":") < 3) & ((n > 18) | verb) & ~shouted


def sentences(cleaned: Column) -> Column:
    """Sentences of at least 40 characters of a cleaned text."""
    parts = F.split(F.translate(cleaned, "\n", " "), r"(?U)(?<=[.!?])\s+")
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) >= 40)


def words(c: Column) -> Column:
    """Lower-case words that are no stop words (for frequencies)."""
    return F.filter(every(F.lower(c), WORD), lambda w: ~w.isin(V.SUMMARY_STOP_WORDS))


def bonus(c: Column) -> Column:
    """The part of a sentence's score that does not depend on other sentences."""
    low, n = F.lower(c), F.length(c)
    out = 8 * F.size(topics(c)) + 4 * contained(low, V.IMPORTANT) + F.when(n.between(60, 300), 5).otherwise(0)
    out = out - F.when(n > 450, 15).otherwise(0) - F.when(times(c, ":") >= 2, 8).otherwise(0)
    return out - F.when(times(c, "|") > 0, 20).otherwise(0) - F.when(times(c, "[]") > 0, 15).otherwise(0)


def purpose(c: Column) -> Column:
    """What a document is for."""
    return let(F.lower(text_of(c)), purpose_of)


def purpose_of(low: Column) -> Column:
    has = lambda *w: [F.contains(low, F.lit(x)) for x in w]
    python, environment, deployment, learning, science = has("python", "environment", "deployment", "machine learning", "data science")
    return F.when(python & environment & deployment & learning, V.PURPOSES["full"]).when(learning & science, V.PURPOSES["learning"]).when(python, V.PURPOSES["python"]).otherwise(V.PURPOSES["other"])


def topic_sentence(c: Column, most: int = 12) -> Column:
    """One sentence on the topics covered."""
    return let(F.slice(topics(c), 1, most), listed_topics)


def listed_topics(found: Column) -> Column:
    n = F.size(found)
    several = F.concat(F.lit("The main technical areas covered are "), F.array_join(F.slice(found, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.get(found, n - 1), F.lit("."))
    return F.when(n == 0, "").when(n == 1, F.concat(F.lit("The main technical area covered is "), F.get(found, F.lit(0)), F.lit("."))).otherwise(several)


def heading_of_key(key: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, texts in V.CV_HEADINGS.items():
        out = F.when(key.isin(texts), F.lit(name)).otherwise(out)
    return out


def heading(c: Column) -> Column:
    """The CV section that a line is the heading of, else null."""
    return heading_of_key(heading_key(c))


def resume_lines(c: Column) -> Column:
    """Array of (section, line) in order, headings left out.

    Lines are marked with their place and heading; each section is the stretch
    of lines from its heading to the next, so nothing is carried line by line.
    """
    keyed = F.transform(lines(text_of(c)), lambda x, i: F.struct(i.alias("at"), heading_key(x).alias("key"), x.alias("line")))
    headed = F.transform(keyed, lambda r: F.struct(r["at"].alias("at"), heading_of_key(r["key"]).alias("section"), r["line"].alias("line")))
    start = F.array(F.struct(F.lit(-1).alias("at"), F.lit("header").alias("section"), F.lit("").alias("line")))

    def stretches(rows):
        heads = F.concat(start, F.filter(rows, lambda r: r["section"].isNotNull()))
        each = lambda h, k: F.transform(
            F.slice(rows, h["at"] + 2, F.greatest(F.coalesce(F.get(heads, k + 1)["at"], F.size(rows)) - h["at"] - 1, F.lit(0))),
            lambda r: F.struct(h["section"].alias("section"), r["line"].alias("line")),
        )
        return F.flatten(F.transform(heads, each))

    return let(headed, stretches)


def section(rows: Column, name: str) -> Column:
    return F.transform(F.filter(rows, lambda r: r["section"] == name), lambda r: strip(sub(r["line"], r"\s+", " ")))


def first_of(c: Column, patterns: list[str]) -> Column:
    """The first match of the first pattern that has one; empty if none has."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text_of(c), f"(?iuU){p}", 0), F.lit("")) for p in patterns], F.lit(""))


def experience(c: Column) -> Column:
    return strip(first_of(c, V.CV_EXPERIENCE))


def accuracy(c: Column) -> Column:
    return strip(sub(first_of(c, V.CV_ACCURACY), r"\s+", " "))


def education(rows: Column, most: int = 6) -> Column:
    """Entries of the education section."""

    def fits(x):
        degree, years = x.rlike("(?iuU)" + V.DEGREE), x.rlike("(?iuU)" + V.YEAR_RANGE)
        listed = (times(x, "|") >= 2) & ~years
        return degree & (years | (~listed & (F.size(every(x, r"\S+")) >= 2) & ~F.contains(F.lower(x), F.lit("classification"))))

    return F.slice(F.array_distinct(F.filter(section(rows, "education"), fits)), 1, most)


def is_project(x: Column) -> Column:
    """Lines that name a project."""
    low = F.lower(x)
    starts = low.rlike(r"\A(?:" + "|".join(V.PROJECT_DETAILS) + ")")
    several = F.size(every(x, r"[A-Za-z0-9][A-Za-z0-9&'().-]*")) >= 2
    only = F.regexp_replace(low, r"\.+\z", "").isin(V.TECHNOLOGY_ONLY)
    return (x != "") & (F.length(x) <= 140) & ~starts & (times(x, "|") == 0) & several & ~only & has_any(low, V.PROJECT_WORDS)


def projects(rows: Column, most: int = 8) -> Column:
    return F.slice(F.array_distinct(F.filter(section(rows, "projects"), is_project)), 1, most)


def skills(c: Column) -> Column:
    return let(F.lower(text_of(c)), lambda low: named({n: F.contains(low, F.lit(w)) for n, w in V.SKILLS.items()}))


def candidate_name(c: Column) -> Column:
    """A name in capitals among the first ten lines."""
    fits = lambda x: F.size(every(x, r"\S+")).between(2, 5) & x.rlike(r"(?U)\A[A-Z][A-Z\s.]+\z") & ~F.lower(x).isin(V.NOT_NAMES)
    found = F.get(F.filter(F.slice(lines(text_of(c)), 1, 10), fits), F.lit(0))
    # a capital after every character that is no letter
    titled = F.aggregate(F.split(F.lower(found), ""), F.lit(""), lambda a, x: F.concat(a, F.when((a == "") | a.rlike(r"\P{L}\z"), F.upper(x)).otherwise(x)))
    return F.coalesce(titled, F.lit(""))


def line_with(c: Column, keywords: list[str]) -> Column:
    """The first line that contains any of the words, else empty."""
    return F.coalesce(F.get(F.filter(lines(text_of(c)), lambda x: has_any(F.lower(x), keywords)), F.lit(0)), F.lit(""))


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def bullets(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.concat(F.lit("• "), x)), "\n")


def resume_summary(cleaned: Column) -> Column:
    """Summary of a CV by its sections."""
    parts = let(resume_lines(cleaned), lambda r: F.struct(experience(cleaned).alias("exp"), accuracy(cleaned).alias("acc"), education(r).alias("edu"), projects(r).alias("pro"), skills(cleaned).alias("ski")))
    return let(parts, resume_blocks)


def resume_blocks(p: Column) -> Column:
    exp, acc, edu, pro, ski = p["exp"], p["acc"], F.filter(p["edu"], lambda x: F.length(x) <= 150), p["pro"], p["ski"]
    who = F.when(exp != "", F.concat(F.lit("The candidate has "), exp)).otherwise("The candidate has a background in Data Science, AI and related technical fields")
    with_skills = F.when(F.size(ski) > 0, F.concat(F.lit("with skills including "), F.array_join(F.slice(ski, 1, 8), ", ")))
    aim = F.concat_ws(" ", who, with_skills)
    aim = F.when(F.endswith(aim, F.lit(".")), aim).otherwise(F.concat(aim, F.lit(".")))
    block = lambda title, body, there: F.when(there, F.concat(F.lit(title + "\n"), body))
    dotted = lambda x: F.when(x != "", F.concat(F.lit("• "), capitalised(x), F.lit(".")))
    overview = F.concat_ws(", ", F.nullif(exp, F.lit("")), F.when(F.size(pro) > 0, F.concat(F.size(pro).cast("string"), F.lit(" notable project(s)"))), F.nullif(acc, F.lit("")))
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("PURPOSE\n"), aim),
        block("EDUCATION", bullets(edu), F.size(edu) > 0),
        block("PROJECTS", bullets(pro), F.size(pro) > 0),
        block("SKILLS", F.concat(F.array_join(ski, ", "), F.lit(".")), F.size(ski) > 0),
        block("KEY ACHIEVEMENTS", F.concat_ws("\n", dotted(acc), dotted(exp)), (acc != "") | (exp != "")),
        block("OVERVIEW", F.concat(F.lit("Overall, the CV highlights "), overview, F.lit(".")), overview != ""),
    )


def structure(cleaned: Column) -> Column:
    """How table-like or command-like the lines are."""
    each = lambda x: F.contains(x, F.lit("|")).cast("int") + 2 * F.contains(F.upper(x), F.lit("[TABLE")).cast("int") + is_command(x).cast("int")
    return F.aggregate(F.transform(lines(cleaned), each), F.lit(0), lambda a, x: a + x)
