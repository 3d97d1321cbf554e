"""Entities, topics, sections, types, quality and layout as Column expressions.

Lists keep the order in which their rule finds them; null and empty texts give
empty lists (null fields in the information record).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import contained, let, strip, sub, text_of, visible


def every(c: Column, pattern: str, flags: str = "U", group: int = 0) -> Column:
    return F.regexp_extract_all(text_of(c), F.lit(f"(?{flags})" + pattern), F.lit(group))


def folded(c: Column) -> Column:
    """Lower case, with the long s as s, as patterns that ignore case have it; for cheap tests before a pattern."""
    return F.translate(F.lower(text_of(c)), "\u017f", "s")


def if_any(low: Column, needles: list[str], found: Column) -> Column:
    """found, but no pattern is run on texts without any of the strings that its matches must have."""
    return F.when(has_any(low, needles), found).otherwise(F.array().cast("array<string>"))


def if_like(c: Column, part: str, found: Column) -> Column:
    """found, but only where the text has a part that every match has; that pattern starts at rare characters and has no boundaries."""
    return F.when(c.rlike(part), found).otherwise(F.array().cast("array<string>"))


def first_seen(a: Column) -> Column:
    return F.array_distinct(a)


def emails(c: Column) -> Column:
    """Addresses in order of appearance, without placeholders."""
    return F.filter(first_seen(every(c, V.EMAIL)), lambda x: ~F.lower(x).isin(V.PLACEHOLDER_EMAILS))


def phones(c: Column, strict: bool = False) -> Column:
    """Phone numbers (E2). strict: with their country code, and none that follows a letter, digit or plus."""
    return first_seen(every(c, V.PHONE_STRICT if strict else V.PHONE))


def urls(c: Column) -> Column:
    return first_seen(every(c, V.URL))


def dates(c: Column) -> Column:
    return first_seen(every(c, V.DATE))


def amounts(c: Column, strict: bool = False) -> Column:
    """Amounts of money, pattern by pattern, white space collapsed (E5). strict: with a digit first."""
    found = F.concat(*[every(c, p, "iuU") for p in (V.CURRENCY_STRICT if strict else V.CURRENCY)])
    return first_seen(F.transform(found, lambda x: sub(strip(x), r"\s+", " ")))


def commands(c: Column, most: int = V.MOST_COMMANDS) -> Column:
    """Shell commands, pattern by pattern."""
    found = F.transform(F.concat(*[every(c, p, "iuU") for p in V.COMMANDS]), strip)
    return F.slice(first_seen(F.filter(found, lambda x: x != "")), 1, most)


def named(conditions: dict[str, Column]) -> Column:
    """The names whose condition holds, in their order."""
    return F.array_compact(F.array(*[F.when(k, F.lit(n)) for n, k in conditions.items()]))


def has_any(low: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])


def concepts(low: Column, whole: bool = False) -> Column:
    """Technical concepts of a lower-case text (E7). whole: only where their words are no parts of others."""
    if not whole:
        return named({n: has_any(low, ws) for n, ws in V.CONCEPTS.items()})
    alone = lambda ws: r"(?U)(?<!\w)(?:" + "|".join(map(re.escape, ws)) + r")(?!\w)"
    return named({n: has_any(low, ws) & low.rlike(alone(ws)) for n, ws in V.CONCEPTS.items()})


def literal_of(pattern: str) -> str:
    """The longest string that every match of a section's pattern has."""
    return max(re.split(r"\\b|\w\?|[.+]+", pattern), key=len)


def sections(low: Column) -> Column:
    """Sections of a lower-case text."""
    tests = {n: [has_any(low, [literal_of(p)]) & low.rlike("(?iuU)" + p) for p in ps] for n, ps in V.SECTIONS.items()}
    return named({n: reduce(lambda a, b: a | b, ts) for n, ts in tests.items()})


def topics(c: Column) -> Column:
    """Topics in the order of their list."""
    return let(F.lower(text_of(c)), lambda low: named({t: F.contains(low, F.lit(t.lower())) for t in V.TOPICS}))


def marks(c: Column, pattern: str) -> Column:
    """Number of distinct ordinals of page or table marks, null if none."""
    return F.nullif(F.size(first_seen(every(c, pattern, "iuU", 1))), F.lit(0))


def pages_marked(c: Column) -> Column:
    return marks(c, V.PAGE_MARK)


def tables_marked(c: Column) -> Column:
    return marks(c, V.TABLE_MARK)


def information(c: Column) -> Column:
    """The information record (E11): absent fields are null; the message stands only alone."""
    some = lambda a: F.nullif(a, F.array().cast("array<string>"))

    def fields(t: Column, low: Column) -> Column:
        found = {
            "technical_topics": some(concepts(low)),
            "major_sections": some(sections(low)),
            "important_commands": some(if_any(low, ["python", "pip", "git", "jupyter", "conda"], commands(t))),
            "pages_processed": F.when(F.contains(low, F.lit("page")), pages_marked(t)),
            "tables_detected": F.when(F.contains(low, F.lit("[table")), tables_marked(t)),
            "emails": some(if_any(low, ["@"], emails(t))),
            "phone_numbers": some(if_like(t, r"[6-9]\p{Nd}{9}", phones(t))),
            "urls": some(if_any(low, ["http"], urls(t))),
            "dates": some(if_like(t, r"[./-]\p{Nd}{1,2}[./-]\p{Nd}", dates(t))),
            "currency": some(if_any(low, ["₹", "rs", "inr"], amounts(t))),
        }
        return F.struct(*[v.alias(k) for k, v in found.items()])

    names = ["technical_topics", "major_sections", "important_commands", "pages_processed", "tables_detected", "emails", "phone_numbers", "urls", "dates", "currency"]

    def record(r: Column) -> Column:
        nothing = reduce(lambda a, b: a & b, [r[n].isNull() for n in names])
        message = F.when((text_of(c) != "") & nothing, F.lit(V.NOTHING_FOUND))
        return F.struct(*[r[n].alias(n) for n in names], message.alias("message"))

    return let(let(visible(c), lambda t: let(folded(t), lambda low: fields(t, low))), record)


def document_type(c: Column) -> Column:
    """CV, study material, report or general document (E41); ties go to the first of these."""
    counts = lambda low: F.struct(*[contained(low, ws).alias(k) for k, ws in {**V.TYPE_WORDS, "strong": V.TYPE_STRONG}.items()])

    def kind_of(n: Column) -> Column:
        most = F.greatest(*[n.getField(k) for k in V.TYPE_WORDS])
        weak = (n["strong"] == 0) & (n.getField("CV / Resume") < 6)
        out = F.when(most < 4, F.lit("General Document"))
        for k in V.TYPE_WORDS:
            out = out.when(n.getField(k) == most, F.when(weak, F.lit("General Document")).otherwise(F.lit(k)) if k == "CV / Resume" else F.lit(k))
        return out

    # counted once even where the type is asked for within a branch
    return let(let(F.lower(text_of(c)), counts), kind_of)


def count_of(c: Column, pattern: str, flags: str = "U") -> Column:
    return F.regexp_count(c, F.lit(f"(?{flags})" + pattern))


def quality(c: Column) -> Column:
    """Quality of selectable text, 0 to 1."""
    t = text_of(c)
    kept = F.filter(F.transform(F.split(t, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"), strip), lambda x: x != "")
    n = F.size(kept)
    suspicious = F.length(t) - F.length(F.translate(t, V.SUSPICIOUS, ""))
    short = F.size(F.filter(kept, lambda x: F.length(x) <= 2))
    # the marks that a match must have are looked for first
    with_mark = lambda marks, p: F.when(has_any(t, marks), count_of(t, p)).otherwise(0)
    broken = count_of(t, V.BROKEN[0]) + with_mark(["»", ">"], V.BROKEN[1]) + with_mark(["@"], V.BROKEN[2])
    score = F.lit(1.0) - suspicious / F.length(t) * 2.5 - short / n * 0.8 - F.least(broken / n, F.lit(1.0)) * 0.8
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).otherwise(F.lit(0.0))


def estimated_pages(c: Column, per_page: int = 50) -> Column:
    """Pages of a plain text by its lines."""
    ends = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
    n = F.size(F.split(F.regexp_replace(text_of(c), f"(?:{ends})\\z", ""), ends))
    return F.when(strip(text_of(c)) == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(n / per_page))).cast("int")


def page_info(count: Column, exact: Column, label: Column) -> Column:
    """Stored page information with its fallbacks."""
    by_count = F.when(count.isNull(), F.lit("Page count unavailable")).otherwise(F.lit("Stored page count"))
    return F.struct(count.cast("int").alias("count"), F.coalesce(exact, F.lit(False)).alias("exact"), F.coalesce(F.nullif(label, F.lit("")), by_count).alias("label"))


def wrapped(c: Column, width: int = 95) -> Column:
    """Trimmed lines cut hard at a width."""
    kept = F.filter(F.transform(F.split(text_of(c), r"\r\n|[\n\r]"), strip), lambda x: x != "")
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / width).cast("int")), lambda k: F.substring(x, k * width + 1, F.lit(width)))
    return F.flatten(F.transform(kept, cut))


def answer_summary(c: Column) -> Column:
    """The summary part of a model's answer."""

    def head(t: Column) -> Column:
        return F.when(t.rlike(r"(?iuU)KEY\s+INSIGHTS\s*:"), F.regexp_extract(t, r"(?isuU)\A(.*?)KEY\s+INSIGHTS\s*:", 1)).otherwise(
            F.when(t.rlike(r"(?iuU)\bDOCUMENT\s*:"), F.regexp_extract(t, r"(?isuU)\A(.*?)\bDOCUMENT\s*:", 1)).otherwise(t)
        )

    out = let(strip(text_of(c)), head)
    for heading in (r"^\s*SUMMARY\s*:\s*", r"\bKEY\s+INSIGHTS\s*:\s*$", r"\bDOCUMENT\s*:\s*$"):
        out = sub(strip(out), heading, "", "iuU")
    return strip(out)


def answer_insights(c: Column, most: int = 5, strict: bool = False) -> Column:
    """The bullet points of a model's answer (E44). strict: a bullet or number goes, but not what a point begins with."""
    bare = lambda x: strip(sub(strip(x), V.BULLET_STRICT if strict else r"^[\-*\u2022\d.)\s]+", ""))

    def part(t: Column) -> Column:
        return F.when(t.rlike(r"(?iuU)\bDOCUMENT\s*:"), strip(F.regexp_extract(t, r"(?isuU)\A(.*?)\bDOCUMENT\s*:", 1))).otherwise(t)

    def points(t: Column) -> Column:
        by_line = F.filter(F.transform(F.split(t, r"\r\n|[\n\r]"), bare), lambda x: (x != "") & ~F.upper(x).isin("SUMMARY", "KEY INSIGHTS", "DOCUMENT", "DOCUMENT TYPE"))
        by_sentence = F.filter(F.transform(F.split(t, r"(?U)(?<=[.!?])\s+"), bare), lambda x: x != "")
        return let(by_line, lambda found: F.when(F.size(found) > 0, found).otherwise(by_sentence))

    tail = strip(F.regexp_extract(strip(text_of(c)), r"(?isuU)KEY\s+INSIGHTS\s*:(.*)\z", 1))
    return F.slice(first_seen(let(let(tail, part), points)), 1, most)


def matches_of(c: Column, needle: str) -> Column:
    """How often a text contains a string, ignoring case; non-overlapping (in-document search)."""
    low, n = F.lower(text_of(c)), needle.lower()
    return ((F.length(low) - F.length(F.replace(low, F.lit(n), F.lit("")))) / max(1, len(n))).cast("long")


def highlighted(c: Column, needle: str, before: str = "[", after: str = "]") -> Column:
    quoted = "".join("\\" + x if not x.isalnum() and x != " " else x for x in needle)
    return F.regexp_replace(text_of(c), f"(?iu)({quoted})", f"\\{before}$1\\{after}")
