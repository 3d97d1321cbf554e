"""Keywords and phrases of each document.

All that a document's keywords rest on is in its own row, so they are Column
expressions: words are counted by sorting an array, and nothing is shuffled.
Rows are independent of each other, whatever their ids are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.counting import counted
from ..functions.extract import every
from ..functions.text import let, lower_lines


def words_of(c: Column) -> Column:
    """Candidate keywords of a text in order (T2 and the filters of E12)."""
    bare = F.transform(every(lower_lines(c), V.KEYWORD_TOKEN), lambda w: F.regexp_replace(w, V.KEYWORD_EDGES, ""))
    return F.filter(bare, lambda w: (F.length(w) >= 4) & ~w.isin(V.KEYWORD_STOP_WORDS))


def terms_of(c: Column) -> Column:
    """Array of (word, n, first_pos, total): frequencies in a text."""
    each = lambda total: lambda x: F.struct(x["item"].alias("word"), x["n"].alias("n"), x["first"].alias("first_pos"), total.alias("total"))
    return let(words_of(c), lambda words: F.transform(counted(words), each(F.greatest(F.size(words).cast("long"), F.lit(1).cast("long")))))


def keyword_score(word: Column, n: Column, total: Column) -> Column:
    return (
        n
        + F.when(word.isin(V.TECHNICAL_TERMS), 5).otherwise(0)
        + F.when(n >= 3, 2).otherwise(0)
        + F.when(F.length(word) >= 8, 1).otherwise(0)
        - F.when(word.isin(V.GENERIC_WORDS), 2).otherwise(0)
        + F.when(n / total > 0.01, 1).otherwise(0)
    )


def top(ordered: Column, limit: int, **fields) -> Column:
    """The first elements of an array, with their rank."""
    return F.transform(F.slice(ordered, 1, limit), lambda x, k: F.struct((k + 1).alias("rank"), *[x[c].alias(name) for name, c in fields.items()]))


def top_terms(c: Column, limit: int = 10) -> Column:
    """Array of (rank, word, score, n): the top terms, technical ones first (O2, O3)."""
    scored = F.transform(terms_of(c), lambda x: F.struct(x.alias("x"), keyword_score(x["word"], x["n"], x["total"]).alias("score")))
    order = lambda s: F.struct(
        (~s["x"]["word"].isin(V.TECHNICAL_TERMS)).alias("plain"), (-s["score"]).alias("low"), (-s["x"]["n"]).alias("rare"), (-F.length(s["x"]["word"])).alias("short"),
        s["x"]["first_pos"].alias("at"), s["x"]["word"].alias("word"), s["score"].alias("score"), s["x"]["n"].alias("n"),
    )
    return top(F.array_sort(F.transform(scored, order)), limit, word="word", score="score", n="n")


def phrases_of(c: Column, technical: bool = False) -> Column:
    """Array of (phrase, n, first_pos): neighbours of which neither is a stop word (T3, G2); technical: one is a technical term."""

    def pairs(w: Column) -> Column:
        two = F.transform(w, lambda a, k: F.struct(a.alias("a"), F.get(w, k + 1).alias("b")))
        fits = lambda p: p["b"].isNotNull() & ~p["a"].isin(V.KEYWORD_STOP_WORDS) & ~p["b"].isin(V.KEYWORD_STOP_WORDS)
        wanted = lambda p: fits(p) & (p["a"].isin(V.TECHNICAL_TERMS) | p["b"].isin(V.TECHNICAL_TERMS)) if technical else fits(p)
        return F.transform(F.filter(two, wanted), lambda p: F.concat_ws(" ", p["a"], p["b"]))

    found = counted(let(every(lower_lines(c), V.PHRASE_TOKEN), pairs))
    return F.transform(found, lambda x: F.struct(x["item"].alias("phrase"), x["n"].alias("n"), x["first"].alias("first_pos")))


def top_phrases(c: Column, limit: int = 10) -> Column:
    """Array of (rank, phrase, n): the top phrases with a technical term."""
    order = lambda x: F.struct((-x["n"]).alias("rare"), (-F.length(x["phrase"])).alias("short"), x["first_pos"].alias("at"), x["phrase"].alias("phrase"), x["n"].alias("n"))
    return top(F.array_sort(F.transform(phrases_of(c, technical=True), order)), limit, phrase="phrase", n="n")


def keyword_list(c: Column, limit: int = 10) -> Column:
    """Terms, then phrases while there is room."""
    both = F.concat(F.transform(top_terms(c, limit), lambda x: x["word"]), F.transform(top_phrases(c, limit), lambda x: x["phrase"]))
    return F.slice(F.array_distinct(both), 1, limit)


def listed(docs: DataFrame, array: Column, doc_id: str) -> DataFrame:
    """One row for each element of an array; the outer form, since Spark would else compute the array a second time to drop rows before."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), array.alias("_a")).select("doc_id", F.explode_outer("_a").alias("_x"))
    return rows.where("_x IS NOT NULL").select("doc_id", "_x.*")


def term_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, word, n, first_pos, total)."""
    return listed(docs, terms_of(F.col(text)), doc_id)


def ranked_terms(docs: DataFrame, limit: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rank, word, score, n)."""
    return listed(docs, top_terms(F.col(text), limit), doc_id)


def phrases(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, phrase, n, first_pos)."""
    return listed(docs, phrases_of(F.col(text)), doc_id)


def ranked_phrases(docs: DataFrame, limit: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rank, phrase, n)."""
    return listed(docs, top_phrases(F.col(text), limit), doc_id)


def keywords(docs: DataFrame, limit: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, keywords) for every row of docs."""
    return docs.select(F.col(doc_id).alias("doc_id"), keyword_list(F.col(text), limit).alias("keywords"))
