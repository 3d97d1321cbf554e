"""Text normalisation as Column expressions; null counts as empty text everywhere."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

LINE_ENDS = r"[\n\x0B\f\x1C-\x1E\x85\u2028\u2029]"


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def sub(c: Column, pattern: str, by: str, flags: str = "U") -> Column:
    """Replace all matches; classes and boundaries are Unicode's."""
    return F.regexp_replace(c, f"(?{flags})" + pattern, by)


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, wherever f uses it; Spark does not share parts of branches and lambdas."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space (as Unicode has it) at both ends; trimming stops at the first other character, a pattern would not."""
    return F.btrim(c, F.lit(V.WHITE_SPACE))


def if_holds(c: Column, needle: str, f) -> Column:
    """f(text), run on texts alone that contain a string which it needs to change anything."""
    return let(c, lambda x: F.when(F.contains(x, F.lit(needle)), f(x)).otherwise(x))


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(text_of(c), "\r\n?", "\n")


def lines(c: Column, drop_blank: bool = True) -> Column:
    """Trimmed lines, without blank ones."""
    found = F.transform(F.split(c, LINE_ENDS), strip)
    return F.filter(found, lambda x: x != "") if drop_blank else found


def join_lines(a: Column) -> Column:
    return F.array_join(a, "\n")


def respell(c: Column, table: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, r: sub(x, r[0], r[1], "iuU"), table, c)


def lower_lines(c: Column) -> Column:
    """Line ends to LF, lower case."""
    return F.lower(unix_lines(c))


def visible(c: Column) -> Column:
    """Without invisible characters, spaces and tabs to one space, trimmed (T4)."""
    c = F.regexp_replace(unix_lines(c), r"[\u200b-\u200f\u202a-\u202e\ufeff]", "")
    return strip(F.regexp_replace(c, r"[ \t]+", " "))


@lru_cache(maxsize=1)
def composer():
    """NFKC, which Spark has no function for; made on first use, as it needs a session."""

    def nfkc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    return F.pandas_udf(nfkc, "string")


def ascii_pattern(pattern: str) -> str:
    """The pattern with boundaries and white space of ASCII alone, as RE2 has them, in any version of Java; to be run without (?U)."""
    word = r"[0-9A-Za-z_]"
    pattern = pattern.replace(r"\b", f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))")
    return pattern.replace(r"[\s", r"[\t\n\f\r ").replace(r"\s", r"[\t\n\f\r ]")


def clean_extracted(c: Column, compose: bool = True, ascii: bool = False) -> Column:
    """Cleaning of extracted text (T5). compose: NFKC first, the one step Spark has no function for. ascii: letters beyond ASCII are no parts of words, so Al is respelled before them too."""
    replace = lambda x, p, by, flags="": sub(x, ascii_pattern(p), by, flags + "u") if ascii else sub(x, p, by, flags + "U")
    trim = (lambda x: F.btrim(x, F.lit("\t\n\f\r "))) if ascii else strip
    c = unix_lines(c)
    c = composer()(c) if compose else c
    c = F.translate(c, "\u200b\u200c\u200d\u2060\ufeff\u00a0", "      ")
    c = F.regexp_replace(c, V.PICTURES, " ")
    c = if_holds(c, "20", lambda x: replace(x, V.JOINED_YEARS, "$1-$2"))
    c = if_holds(c, "+", lambda x: replace(x, r"\b([0-9])\1\+\s*years?\b", "$1+ years", "i"))
    c = if_holds(c, "Al", lambda x: replace(x, r"\bAl\b", "AI"))
    kept = F.transform(F.filter(F.transform(F.split(c, "\n"), trim), lambda x: x != ""), lambda x: trim(replace(x, V.DECORATION, "")))
    return trim(F.regexp_replace(join_lines(F.filter(kept, lambda x: x != "")), r"[ \t]+", " "))


def clean_lines(c: Column) -> Column:
    """Cleaning before a summary."""
    c = F.translate(unix_lines(F.translate(text_of(c), "\u00a0", " ")), "\x00", " ")
    c = if_holds(c, "20", lambda x: sub(x, r"\b(20\d{2})\s*[-\u2013\u2014]\s*(20\d{2})\b", "$1-$2"))
    c = let(c, lambda x: F.when(F.contains(like(x), F.lit("full")), sub(x, r"\bfull\s*time\b", "full-time", "iU")).otherwise(x))
    return join_lines(F.transform(lines(c), lambda x: F.regexp_replace(x, r"[ \t]+", " ")))


def plain_scan(c: Column) -> Column:
    """Basic cleaning of recognised text."""
    c = F.translate(F.translate(text_of(c), "\u00a0\u2013\u2014\u2212", " ---"), "\u200b\u200c\u200d\ufeff", "")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = sub(sub(c, r"\b2026\s*2028\b", "2026 - 2028"), r"\b2026\s*-\s*2028\b", "2026 - 2028")
    c = sub(c, r"\b(20\d{2})\s+(20\d{2})\b", "$1 - $2")
    c = sub(c, r"(\d+(?:\.\d+)?)\s+%", "$1%")
    return strip(F.regexp_replace(F.regexp_replace(c, r"\|{3,}", "||"), r"-{4,}", "---"))


def contained(low: Column, words: list[str]) -> Column:
    """How many of the words a lower-case text contains."""
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in words])


def resume_like(c: Column) -> Column:
    """Recognised text that looks like a CV."""
    return contained(F.lower(text_of(c)), V.SCAN_CV_TERMS) >= 3


def resume_scan(c: Column, names: dict[str, str] | None = None) -> Column:
    """Respelling of recognised CVs (T9). names: corrections of proper names, by pattern."""
    c = respell(c, V.SCAN_SPELLINGS)
    for garbage in (r"^\s*[Qq][_\-:]+\s*", r"^\s*[Qq]\s*$", r"^\s*[S$]\s*%\s*$", r"^\s*[e€©®]\s*@?\s*$"):
        c = sub(c, garbage, "", "imU")
    c = respell(c, list((names or {}).items()))
    c = sub(sub(c, r"\b6\s*\+\s*years\b", "6+ years", "iU"), r"\b6\+\s+years\b", "6+ years", "iU")
    c = sub(sub(c, r"\b(20\d{2})\s*-\s*(20\d{2})\b", "$1 - $2"), r"\b(20\d{2})\s+(?:Present|present)\b", "$1 - Present")
    return respell(sub(c, r"(\d+(?:\.\d+)?)\s*%\s*", "$1% "), V.SCAN_WORDS)


def clean_scan(c: Column, names: dict[str, str] | None = None) -> Column:
    """Cleaning of recognised text."""
    c = let(plain_scan(c), lambda x: F.when(let(F.lower(x), lambda low: contained(low, V.SCAN_CV_TERMS)) >= 3, resume_scan(x, names)).otherwise(x))
    keep = lambda x: ~x.rlike(r"(?U)^[\W_]+$") & ((F.length(x) > 2) | x.rlike("[A-Za-z0-9]"))
    return strip(join_lines(F.filter(lines(c), keep)))


def like(c: Column) -> Column:
    """Lower case, with all that patterns which ignore case take for s and i; for cheap tests before them."""
    return F.lower(F.translate(c, "\u017f\u0131\u0130", "sii"))


def respell_words(c: Column, table: list[tuple[str, str]]) -> Column:
    """respell(), whose patterns are words between boundaries here, run on texts alone that contain one of them."""
    words = [p.removeprefix(r"\b").removesuffix(r"\b").lower() for p, _ in table]
    there = lambda x: let(like(x), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]))
    return let(c, lambda x: F.when(there(x), respell(x, table)).otherwise(x))


def for_model(c: Column) -> Column:
    """Cleaning of text that a language model is to read."""
    c = F.translate(F.translate(text_of(c), "\u00a0\u2013\u2014\u2212", " ---"), "\u200b\u200c\u200d\ufeff", "")

    def years(x: Column) -> Column:
        x = sub(x, r"\b(20\d{2})(20\d{2})\b", "$1-$2")
        x = sub(sub(x, r"\b(20\d{2})\s+(20\d{2})\b", "$1-$2"), r"\b(20\d{2})\s*-\s*(20\d{2})\b", "$1-$2")
        return sub(x, r"\b(20\d{2})\s+Present\b", "$1-Present", "iU")

    c = respell_words(if_holds(c, "20", years), V.MODEL_SPELLINGS)
    c = if_holds(c, "%", lambda x: sub(x, r"(\d+(?:\.\d+)?)\s+%", "$1%"))
    c = if_holds(c, "+", lambda x: sub(x, r"\b(\d+)\s*\+\s*years\b", "$1+ years", "iU"))
    return join_lines(lines(F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), r"[ \t]+", " ")))


def without_page_marks(c: Column) -> Column:
    return if_holds(text_of(c), "---", lambda x: sub(x, r"---\s*Page\s+\d+\s*---", " ", "iU"))


def without_tables(c: Column) -> Column:
    c = if_holds(text_of(c), "[", lambda x: sub(x, r"\[TABLE\s*\d+\]", " ", "iU"))
    return if_holds(c, "|", lambda x: reduce(lambda y, p: sub(y, p, " ", "iU"), V.TABLE_HEADERS, x))


def without_titles(c: Column, titles: list[str] = ()) -> Column:
    """titles: patterns of document titles to leave out."""
    return reduce(lambda x, p: sub(x, p, " ", "iU"), titles, text_of(c))


def for_summary(c: Column, titles: list[str] = ()) -> Column:
    """Page marks, tables and titles out, then cleaned."""
    return clean_lines(without_titles(without_tables(without_page_marks(c)), titles))


def plain_answer(c: Column) -> Column:
    """A model's answer without code fences and its first heading."""
    c = F.regexp_replace(text_of(c), r"(?i)```(?:text|markdown)?", "")
    return strip(sub(c, r"^\s*SUMMARY\s*:\s*", "", "iU"))


def heading_key(c: Column) -> Column:
    """A line as it is compared with headings."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-zA-Z& ]", ""), r"\s+", " "))


def words_in(c: Column) -> Column:
    """Number of words between white space."""
    return F.regexp_count(text_of(c), F.lit(r"(?U)\S+")).cast("long")
