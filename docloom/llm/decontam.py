"""Benchmark decontamination by winnowing, in DataFrame functions only.

Method: words of A-Z lower-cased texts are hashed, K consecutive hashes make a
k-gram hash, and of each window of SPAN words the least k-gram hash is kept:
its fingerprint. Equal windows have equal fingerprints, so every shared span of
SPAN words or more is found (k-gram length K, SPAN - K + 1 grams per window).
Training fingerprints are matched with those of the benchmark; matching windows
are extended to whole windows of words, compared as text, and the document's
hit words are the union of the windows that agree. Benchmark items of fewer
words than SPAN are one window each, found by their own hash.

A benchmark of up to LITERALS fingerprints is matched inside the scan; a larger
one by a join on the fingerprint, which is shuffled.

Cases: null and empty texts have no words, are not contaminated and name no
items; very long texts are read whole; a passage that many documents or items
share is matched window by window, with the items of a window held once per
distinct list; items of equal text have the same windows and all count;
repeated rows give repeated results; an empty benchmark leaves everything clean;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, ascii_lower, cut, text_of

#: What stands between words: ASCII other than digits and a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN, K = 10, 5
#: Most benchmark fingerprints that go into the scan as a set of values.
LITERALS = 20_000


def words_of(text: str | Column = "text") -> Column:
    # splitting costs a tenth of extracting the words by a pattern
    return F.filter(F.split(ascii_lower(text_of(text)), BETWEEN), lambda w: w != "")


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def grams_of(h: Column, n: int) -> Column:
    """Hash of every n consecutive word hashes."""
    last = F.size(h) - n
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.lit(n), *[F.get(h, i + d) for d in range(n)]))


def least_of(g: Column, i: Column, n: int) -> Column:
    return F.least(*[F.get(g, i + d) for d in range(n)]) if n > 1 else F.get(g, i)


def with_fingerprints(df: DataFrame, lengths: list[int], span: int, k: int) -> DataFrame:
    """df(words) with h and, for each window length in words, its k-gram hashes g_<length>."""
    df = df.withColumn("h", hashes_of(F.col("words")))
    return df.withColumns({f"g_{n}": grams_of(F.col("h"), k if n == span else n) for n in lengths})


def starts_where(length: int, span: int, k: int, keep) -> Column:
    """Starts of the windows of this length whose fingerprint passes keep."""
    g, per = F.col(f"g_{length}"), span - k + 1 if length == span else 1
    last = F.size(g) - per
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: keep(least_of(g, i, per)))


def benchmark_windows(benchmark: DataFrame, text: str, item_id: str, span: int, k: int) -> DataFrame:
    """(len, win, fp, items): the distinct windows of the benchmark, their fingerprint and the items that have them."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(text).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("len", F.least(F.size("words"), F.lit(span)))
    w = items.select("item", "len", F.posexplode(F.sequence(F.lit(0), F.size("words") - F.col("len"))).alias("p", "s"), "words")
    w = w.select("item", "len", F.expr("slice(words, s + 1, len)").alias("words"))
    w = w.withColumn("win", F.concat_ws(" ", "words")).withColumn("h", hashes_of(F.col("words")))
    long = F.array_min(grams_of(F.col("h"), k))
    short = F.lit(None).cast("long")
    for n in range(1, span):
        short = F.when(F.col("len") == n, F.xxhash64(F.lit(n), *[F.get(F.col("h"), F.lit(d)) for d in range(n)])).otherwise(short)
    w = w.withColumn("fp", F.when(F.col("len") == span, long).otherwise(short))
    return w.groupBy("len", "win", "fp").agg(F.array_sort(F.collect_set("item")).alias("items"))


def covered(spans: Column) -> Column:
    """Number of positions in the union of spans (s, e), ends exclusive."""
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["to"], x["s"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to"))
    return F.aggregate(F.array_sort(spans), state, step, lambda a: a["n"])


def window_at(n: int):
    """The window of n words from a start on (its parameter alone, as F.transform counts parameters)."""
    return lambda i: F.struct(i.alias("s"), F.lit(n).alias("len"), F.array_join(F.slice("words", i + 1, n), " ").alias("win"))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
    span: int = SPAN,
    k: int = K,
    literals: int = LITERALS,
    carry: tuple[Column, ...] = (),
) -> DataFrame:
    """For every row of docs: doc_id, the columns to carry, n_words, n_hit, n_items, items (sorted as strings), items_sha256, contaminated, spans."""
    windows = cut(benchmark_windows(benchmark, item_text, item_id, span, k))
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # at most `span` values
    read = docs.select(F.col(doc_id).alias("doc_id"), *carry, words_of(text).alias("words"))
    own = [c for c in read.columns if c != "words"]
    small = windows.select("len", "fp").distinct().limit(literals + 1).collect()
    if len(small) <= literals:
        rows = with_fingerprints(read, lengths, span, k)
        sets = {n: [r[1] for r in small if r[0] == n] for n in lengths}
        tests = {n: (lambda own: lambda v: v.isin(own))(sets[n]) for n in lengths}
    else:
        every = lambda n: F.transform(starts_where(n, span, k, lambda v: F.lit(True)), lambda i: least_of(F.col(f"g_{n}"), i, span - k + 1 if n == span else 1))
        prints = with_fingerprints(read, lengths, span, k).select("doc_id", F.explode(F.array_distinct(F.concat(*[every(n) for n in lengths]))).alias("fp"))
        found = prints.join(windows.select("fp").distinct(), "fp").groupBy("doc_id").agg(F.collect_set("fp").alias("own"))
        joined = read.alias("r").join(found.alias("f"), F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")), "left").select(*[f"r.{c}" for c in own], "words", F.coalesce("f.own", F.array().cast("array<bigint>")).alias("own"))
        rows = with_fingerprints(joined, lengths, span, k)
        tests = dict.fromkeys(lengths, lambda v: F.array_contains("own", v))
    found = [F.transform(starts_where(n, span, k, tests[n]), window_at(n)) for n in lengths]
    none = F.array().cast("array<struct<s:int,len:int,win:string>>")
    scanned = cut(rows.select(F.monotonically_increasing_id().alias("row"), *own, F.size("words").cast("long").alias("n_words"), (F.concat(*found) if found else none).alias("found")))
    # a window that many documents have would be one hot key, so a small benchmark goes to the hits
    side = windows.select("len", "win", "items")
    size = windows.agg(F.sum(F.octet_length("win") + F.octet_length(F.array_join("items", ",")) + 64)).first()[0] or 0
    hits = scanned.select("row", F.inline("found")).join(F.broadcast(side) if size <= BROADCAST_BYTES else side, ["len", "win"])
    per_row = hits.groupBy("row").agg(F.collect_set(F.struct("s", (F.col("s") + F.col("len")).alias("e"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    out = scanned.select("row", *own, "n_words").join(per_row, "row", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        *own,
        "n_words",
        F.coalesce(covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        items.alias("items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.col("spans").isNotNull().alias("contaminated"),
        "spans",
    )
