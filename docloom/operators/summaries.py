"""Extractive summaries: a document's sentences are ranked within its row, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import summary as S
from ..functions import vocabulary as V
from ..functions.counting import first_of_each, runs
from ..functions.extract import every, topics
from ..functions.text import for_summary, let, strip
from .keywords import listed


def prepared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", titles: list[str] = ()) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), for_summary(F.col(text), titles).alias("cleaned"))


def valid_of(cleaned: Column) -> Column:
    """Sentences of a cleaned text that are fit for a summary, of equal ones the first, in order."""
    fits = lambda c: ~S.is_noise(c) & S.is_good(c) & (F.size(every(c, r"\S+")) >= 8)
    return first_of_each(F.filter(S.sentences(cleaned), fits), lambda c: F.lower(strip(c)))


def scored_of(cleaned: Column) -> Column:
    """Array of (pos, sentence, score): word frequencies among the valid sentences, and bonuses."""

    def scored(valid: Column) -> Column:
        used = F.flatten(F.transform(valid, lambda c, k: F.transform(S.words(c), lambda w: F.struct(w.alias("w"), k.alias("k")))))
        weighted = let(
            F.array_sort(used),
            lambda u: F.flatten(F.transform(runs(u, lambda x: x["w"]), lambda r: F.transform(F.slice(u, r["at"] + 1, r["n"]), lambda x: F.struct(x["k"].alias("k"), r["n"].cast("long").alias("f"))))),
        )
        # a zero for each sentence, so that every one of them has a run
        zeros = F.transform(valid, lambda c, k: F.struct(k.alias("k"), F.lit(0).cast("long").alias("f")))
        sums = let(
            F.array_sort(F.concat(zeros, weighted)),
            lambda u: F.transform(runs(u, lambda x: x["k"]), lambda r: F.aggregate(F.slice(u, r["at"] + 1, r["n"]), F.lit(0).cast("long"), lambda a, x: a + x["f"])),
        )
        bonus = lambda c, k: (S.bonus(c) + F.when(k < 10, 3).otherwise(0)).cast("long")
        return let(sums, lambda s: F.transform(valid, lambda c, k: F.struct(k.alias("pos"), c.alias("sentence"), (F.get(s, k) + bonus(c, k)).alias("score"))))

    return let(valid_of(cleaned), scored)


def cover(ranked: Column, k: int) -> Column:
    """Greedy choice: a sentence whose topics are all covered is passed over; k are taken."""
    state = F.struct(F.array().cast("array<struct<pos:int,sentence:string>>").alias("taken"), F.array().cast("array<string>").alias("seen"))

    def step(a, x):
        new = (F.size(x["topics"]) == 0) | (F.size(F.array_except(x["topics"], a["seen"])) > 0)
        take = new & (F.size(a["taken"]) < k)
        return F.struct(
            F.when(take, F.array_append(a["taken"], F.struct(x["pos"].alias("pos"), x["sentence"].alias("sentence")))).otherwise(a["taken"]).alias("taken"),
            F.when(take, F.array_union(a["seen"], x["topics"])).otherwise(a["seen"]).alias("seen"),
        )

    return F.aggregate(ranked, state, step, lambda a: F.transform(F.array_sort(a["taken"]), lambda t: t["sentence"]))


def chosen_of(cleaned: Column, sizes: dict[str, int]) -> Column:
    """A struct with an array of sentences for each name and size, in document order."""
    one = lambda x: F.struct((-x["score"]).alias("score"), x["pos"].alias("pos"), x["sentence"].alias("sentence"), topics(x["sentence"]).alias("topics"))
    return let(F.array_sort(F.transform(scored_of(cleaned), one)), lambda l: F.struct(*[cover(l, k).alias(n) for n, k in sizes.items()]))


def valid_sentences(docs: DataFrame, column: str = "cleaned") -> DataFrame:
    """docs as of prepared(). (doc_id, pos, sentence)."""
    return listed(docs, F.transform(valid_of(F.col(column)), lambda c, k: F.struct(k.alias("pos"), c.alias("sentence"))), "doc_id")


def scored_sentences(docs: DataFrame, column: str = "cleaned") -> DataFrame:
    """(doc_id, pos, sentence, score)."""
    return listed(docs, scored_of(F.col(column)), "doc_id")


def chosen_sentences(docs: DataFrame, sizes: dict[str, int], column: str = "cleaned") -> DataFrame:
    """(doc_id, one array of sentences for each name and size) for every row of docs."""
    return docs.select("doc_id", chosen_of(F.col(column), sizes).alias("_c")).select("doc_id", "_c.*")


def summary_of(text: Column, titles: list[str] = ()) -> Column:
    """(kind, summary): the router and the four kinds of summary."""
    block = lambda title, a: F.when(F.size(a) > 0, F.concat(F.lit(title), S.bullets(a)))

    def normal(c: Column, five: Column) -> Column:
        return let(S.topic_sentence(c), lambda topic: F.concat_ws("\n\n", F.concat(F.lit("PURPOSE\n"), S.purpose(c)), F.when(topic != "", F.concat(F.lit("\nCOVERAGE\n"), topic)), block("\nKEY POINTS\n", five)))

    def routed(c: Column) -> Column:
        kind = F.when(F.coalesce(text, F.lit("")) == "", "empty").when(S.is_resume(c), "resume").when(S.structure(c) >= 8, "structured").when(F.length(c) < 1200, "short").otherwise("normal")

        def whole(k: Column) -> Column:
            # a prepared text is cleaned once more when sentences are chosen
            chosen = F.when(~k.isin("empty", "resume"), chosen_of(for_summary(c, titles), {"four": 4, "five": 5}))
            short = lambda x: F.concat_ws("\n\n", S.purpose(c), block("KEY FLOW / STEPS\n", x["four"]))
            return let(chosen, lambda x: F.when((k == "empty") | (c == ""), V.NO_TEXT).when(k == "resume", S.resume_summary(c)).when(k == "short", short(x)).otherwise(normal(c, x["five"])))

        return let(kind, lambda k: F.struct(k.alias("kind"), whole(k).alias("summary")))

    return let(for_summary(text, titles), routed)


def summaries(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", titles: list[str] = ()) -> DataFrame:
    """(doc_id, kind, summary) for every row of docs."""
    return docs.select(F.col(doc_id).alias("doc_id"), summary_of(F.col(text), titles).alias("_s")).select("doc_id", "_s.*")
