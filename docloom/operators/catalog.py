"""The document catalogue: lookups, search, lists, upserts and deletes as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.extract import highlighted, matches_of
from ..functions.text import let, strip


def allowed_file(name: Column) -> Column:
    """A name with one of the known extensions (V1)."""
    return F.contains(name, F.lit(".")) & F.lower(F.substring_index(name, ".", -1)).isin(V.EXTENSIONS)


def safe_name(name: Column) -> Column:
    """A file name without path parts and unusual characters (V2)."""
    ascii_only = F.regexp_replace(F.regexp_replace(name, r"[/\\]", " "), r"[^\x00-\x7F]", "")
    joined = F.array_join(F.filter(F.split(ascii_only, r"\s+"), lambda x: x != ""), "_")
    return F.regexp_replace(F.regexp_replace(joined, r"[^A-Za-z0-9_.-]", ""), r"^[._]+|[._]+$", "")


def unique_name(name: Column, content: Column) -> Column:
    """A name that equal names of different contents do not share (V3): eight hex digits of the content's hash."""
    stem, ext = F.regexp_extract(name, r"(?s)\A(.*?)(\.[^.]*)?\z", 1), F.regexp_extract(name, r"(?s)\A(.*?)(\.[^.]*)?\z", 2)
    return F.concat(stem, F.lit("_"), F.substring(F.sha2(content, 256), 1, 8), ext)


def has_text(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) != ""


def split_empty(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rows with and without text (V4)."""
    return docs.where(has_text(F.col(text))), docs.where(~has_text(F.col(text)))


def valid_email(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(r"(?U)\A[^@\s]+@[^@\s]+\.[^@\s]+\z")


def new_users(candidates: DataFrame, users: DataFrame) -> DataFrame:
    """Candidates whose fields are valid and whose name and address no user has."""
    fine = candidates.where((strip(F.col("username")) != "") & valid_email(F.col("email")) & (F.col("password") == F.col("confirm")))
    fine = fine.withColumn("email", F.lower("email"))
    taken = users.select("username").distinct()
    fine = fine.join(taken, "username", "left_anti")
    return fine.join(users.select("email").distinct(), "email", "left_anti")


def owned(docs: DataFrame, owner, column: str = "source") -> DataFrame:
    return docs.where(F.col(column) == F.lit(owner))


def lookup(docs: DataFrame, owner, doc_id, column: str = "source") -> DataFrame:
    return owned(docs, owner, column).where(F.col("doc_id") == F.lit(doc_id)).limit(1)


def search(docs: DataFrame, query: str, columns: list[str], owner=None, owner_column: str = "source", literal: bool = False) -> DataFrame:
    """Rows of an owner with the query in any column, ignoring case; % and _ are wildcards unless literal."""
    q = query.strip()
    rows = docs if owner is None else owned(docs, owner, owner_column)
    if not q:
        return rows
    hit = F.lit(False)
    for c in columns:
        value = F.coalesce(F.col(c), F.lit(""))
        hit = hit | (F.contains(F.lower(value), F.lit(q.lower())) if literal else value.ilike(f"%{q}%"))
    return rows.where(hit)


def newest_first(docs: DataFrame, time: str = "uploaded_at", doc_id: str = "doc_id") -> DataFrame:
    """All documents, the newest first (O1)."""
    return docs.orderBy(F.desc(time), F.asc(doc_id))


def recent(docs: DataFrame, n: int = 5, time: str = "uploaded_at", doc_id: str = "doc_id") -> DataFrame:
    """The newest documents."""
    return newest_first(docs, time, doc_id).limit(n)


def page_of(docs: DataFrame, number: int, size: int, order: list[Column]) -> DataFrame:
    """One page of a list, counted from 1."""
    return docs.orderBy(*order).offset((number - 1) * size).limit(size)


def paged_lines(text: Column) -> Column:
    """Array of (page, line): the lines of a text with page marks, each with the number of the mark above it, 0 before the first."""
    number = lambda x: F.nullif(F.regexp_extract(x, "(?iU)" + V.PAGE_MARK, 1), F.lit("")).cast("int")
    rows = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x, k: F.struct(k.alias("at"), number(x).alias("page"), x.alias("line")))
    start = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("page"), F.lit("").alias("line")))

    def stretches(r: Column) -> Column:
        marks = F.concat(start, F.filter(r, lambda x: x["page"].isNotNull()))
        each = lambda m, k: F.transform(
            F.slice(r, m["at"] + 2, F.greatest(F.coalesce(F.get(marks, k + 1)["at"], F.size(r)) - m["at"] - 1, F.lit(0))),
            lambda x: F.struct(m["page"].alias("page"), x["line"].alias("line")),
        )
        return F.flatten(F.transform(marks, each))

    return let(rows, stretches)


def occurrences(docs: DataFrame, needle: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """In-document search: how often, the pages of the lines with hits, and the text with the hits marked."""
    n = matches_of(F.col(text), needle)
    hit = F.filter(paged_lines(F.col(text)), lambda r: F.contains(F.lower(r["line"]), F.lit(needle.lower())))
    pages = F.array_distinct(F.transform(hit, lambda r: r["page"]))
    return docs.select(doc_id, n.alias("n_matches"), pages.alias("pages"), highlighted(F.col(text), needle).alias("marked")).where("n_matches > 0")


def upsert(table: DataFrame, changes: DataFrame, key: str = "doc_id") -> DataFrame:
    """The table with rows of equal key replaced and new ones added (S11, S12); changes have the table's columns."""
    return table.join(changes.select(key), key, "left_anti").select(*table.columns).unionByName(changes.select(*table.columns))


def remove(table: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """The table without rows of these keys."""
    return table.join(keys.select(key).distinct(), key, "left_anti").select(*table.columns)


def with_owner(docs: DataFrame, users: DataFrame, owner: str = "user_id") -> DataFrame:
    return docs.join(users, docs[owner] == users["id"], "left")


def totals(docs: DataFrame, by: str) -> DataFrame:
    """Documents and characters by a column, with the grand total (dashboard)."""
    return docs.rollup(by).agg(F.count("*").alias("n_documents"), F.sum(F.length("text")).alias("n_chars"))
