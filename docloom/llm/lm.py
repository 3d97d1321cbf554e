"""Language-model scores: stupid backoff with counts of the whole corpus.

Method: words (A-Z lower-cased, between ASCII white space) and their n-grams up
to an order are counted over all documents in tables partitioned by a hash of
the n-gram. The n-grams of the documents are matched with these tables, and the
logarithms of their scores are summed per document. Counts leave out the
document's own rows: with c the other documents' counts, N their words and v the
words before w, as many as the order allows and the document has,

    S(w | v) = c(v w) / c(v)          if c(v w) > 0
               0.4 S(w | v')          else, v' being v without its first word

    S(w)     = c(w) / N               if c(w) > 0
               1 / (N + 1)            else

N-grams travel packed. Documents are dealt into blocks of about BLOCK words,
written once as a table in the shared folder; a block asks each hash bucket for
the totals of its distinct n-grams by one row of sorted, delta-coded 64-bit
hashes with counts, and is answered by one row of totals in that order. So a
frequent n-gram is one entry a block, however often it occurs, and what is
shuffled is about six bytes a distinct n-gram and block.

Cases: null and empty texts have 0 words, log-probability 0 and mean null; a
document longer than a block is a block of its own; repeated rows and copies
count as other documents; a lone document is scored by the last line above; an
empty table gives an empty result; other columns are ignored. No result depends
on an order of rows or n-grams, so there are no ties to break.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, join_hot, scratch, ship, text_of, without_old_shuffles
from .pieces import mixed

BACKOFF = 0.4
#: Words of a block, and distinct n-grams of a bucket, about.
BLOCK, BUCKET = 1_000_000, 1_500_000
SEED = 11


def pack(a: np.ndarray) -> bytes:
    """Bytes of an unsigned array, compressed; equal places of the numbers lie together."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(raw: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64), dtype=np.uint64)


def longer(keys: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Keys of n-grams, and of the word after each: keys of n-grams of one word more."""
    return mixed(mixed(keys) + hashes)


class Block:
    """Documents of a block: their words as numbers into a sorted vocabulary of hashes."""

    def __init__(self, sizes: np.ndarray, vocabulary: np.ndarray, numbers: np.ndarray) -> None:
        self.sizes, self.vocabulary, self.numbers = sizes, vocabulary, numbers

    @classmethod
    def of(cls, row) -> Block:
        return cls(np.asarray(row["sizes"], dtype=np.int64), unpack_sorted(row["vocabulary"]), unpack(row["numbers"], np.uint32).astype(np.int64))

    def grams(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For n-grams of 2, 3, ... words within documents: their keys, and where their last word stands."""
        hashes = self.vocabulary[self.numbers]
        place = np.arange(len(hashes)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        keys, at = hashes, np.arange(len(hashes))
        for k in range(2, order + 1):
            more = np.flatnonzero(place >= k - 1)
            keys = longer(keys[np.searchsorted(at, more - 1)], hashes[more])
            at = more
            yield keys, at

    def asked(self, order: int) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Sorted distinct keys (words and n-grams), their counts here, and how to get back to occurrences."""
        every, counts, ways = [self.vocabulary], [np.bincount(self.numbers, minlength=len(self.vocabulary))], []
        for keys, at in self.grams(order):
            distinct, back, n = np.unique(keys, return_inverse=True, return_counts=True)
            every.append(distinct)
            counts.append(n)
            ways.append((back, at))
        ends = np.cumsum([len(x) for x in every])[:-1]
        every, counts = np.concatenate(every), np.concatenate(counts).astype(np.uint32)
        order_of = np.argsort(every, kind="stable")
        place = np.empty(len(every), np.int64)
        place[order_of] = np.arange(len(every))
        one, *rest = np.split(place, ends)
        return every[order_of], counts[order_of], (one, [(p, *w) for p, w in zip(rest, ways, strict=True)])


def make_blocks(docs: DataFrame, text: str, doc_id: str, words: int) -> DataFrame:
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"block string, ids array<{kind}>, sizes array<int>, n_words long, vocabulary binary, numbers binary"

    def build(batches):
        from pyspark import TaskContext

        task, made, ids, sizes, hashes, n = TaskContext.get().partitionId(), 0, [], [], [], 0
        h = xxhash.xxh64_intdigest

        def flush():
            nonlocal made, ids, sizes, hashes, n
            every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            vocabulary, numbers = np.unique(every, return_inverse=True)
            row = (f"{task}-{made}", ids, sizes, len(every), pack_sorted(vocabulary), pack(numbers.astype(np.uint32)))
            made, ids, sizes, hashes, n = made + 1, [], [], [], 0
            return pd.DataFrame([row], columns=["block", "ids", "sizes", "n_words", "vocabulary", "numbers"])

        for pdf in batches:
            for i, t in zip(pdf["doc_id"], pdf["text"], strict=True):
                w = (t or "").encode("utf-8", "surrogatepass").lower().split()
                ids.append(None if i is None or i != i else i)
                sizes.append(len(w))
                hashes.append(np.fromiter((h(x, SEED) for x in w), np.uint64, len(w)))
                n += len(w)
                if n >= words or len(ids) >= words:
                    yield flush()
        if ids:
            yield flush()

    return docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).mapInPandas(build, schema)


def backoff_scores(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", backoff: float = BACKOFF, block_words: int = BLOCK, bucket_keys: int = BUCKET, order: int = 2) -> DataFrame:
    """(doc_id, n_words, n_bigrams_known, logprob, mean_logprob) for every row of docs.

    order is the longest n-gram in words; beyond two, n_trigrams_known, n_4grams_known, ... follow n_bigrams_known.
    """
    if order < 1:
        raise ValueError("the order is at least one word")
    spark = docs.sparkSession
    ship(spark)
    path = scratch(spark, "lm") + "/blocks"
    make_blocks(docs, text, doc_id, block_words).write.option("compression", "none").parquet(path)
    blocks = spark.read.parquet(path)
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, order * total / bucket_keys))))

    def ask(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                keys, counts, _ = Block.of(row).asked(order)
                if not len(keys):
                    continue
                bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                found, starts = np.unique(bucket, return_index=True)
                ends = [*starts[1:].tolist(), len(keys)]
                yield pd.DataFrame([(b, row["block"], pack_sorted(keys[s:e]), pack(counts[s:e])) for b, s, e in zip(found.tolist(), starts.tolist(), ends, strict=True)], columns=["bucket", "block", "keys", "counts"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [unpack_sorted(k) for k in pdf["keys"]]
        _, back = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(back, weights=np.concatenate([unpack(c, np.uint32) for c in pdf["counts"]]))[back].astype(np.uint64)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        return pd.DataFrame({"bucket": pdf["bucket"], "block": pdf["block"], "totals": [pack(x) for x in np.split(sums, cuts)]})

    def score(own: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in own.to_dict("records"):
            b = Block.of(row)
            _, _, (ones, ways) = b.asked(order)
            parts = [unpack(t, np.uint64) for t in answers.sort_values("bucket")["totals"]]
            totals = np.concatenate(parts).astype(np.float64) if parts else np.zeros(0)
            out.append(scored(b, row["ids"], totals[ones], [(totals[p], back, at) for p, back, at in ways], total, backoff))
        return pd.concat(out)

    asked = blocks.select("block", "sizes", "vocabulary", "numbers").mapInPandas(ask, "bucket long, block string, keys binary, counts binary")
    answers = asked.groupBy("bucket").applyInPandas(answer, "bucket long, block string, totals binary")
    kind = docs.schema[doc_id].dataType.simpleString()
    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(score, f"doc_id {kind}, n_words long, {''.join(f'{c} long, ' for c in known_columns(order))}logprob double")
    return out.withColumn("mean_logprob", F.when(F.col("n_words") > 0, F.col("logprob") / F.col("n_words")))


def known_columns(order: int) -> list[str]:
    return [{2: "n_bigrams_known", 3: "n_trigrams_known"}.get(k, f"n_{k}grams_known") for k in range(2, order + 1)]


def scored(b: Block, ids, words: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]], total: int, backoff: float) -> pd.DataFrame:
    """Scores of a block's documents. words: totals of its vocabulary; grams: of n-grams of each length, which of them occurs, and where it ends."""
    n_docs, n = len(b.sizes), len(b.numbers)
    doc = np.repeat(np.arange(n_docs), b.sizes)

    def others(which: np.ndarray, totals: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Totals of the occurrences' n-grams without the document's own."""
        own, inverse, count = np.unique(doc[where] * max(1, len(totals)) + which, return_inverse=True, return_counts=True)
        return totals[which] - count[inverse]

    c = others(b.numbers, words, np.arange(n))
    rest = (total - b.sizes)[doc].astype(np.float64)
    logs = np.where(c > 0, np.log(np.maximum(c, 1)) - np.log(np.maximum(rest, 1)), -np.log(rest + 1))
    sums = lambda v: np.bincount(doc, weights=v, minlength=n_docs)
    known = []
    for totals, back, at in grams:
        logs[at] += np.log(backoff)
        count = np.zeros(n)
        if len(at):
            count[at] = others(back, totals, at)
        seen = np.flatnonzero(count > 0)
        logs[seen] = np.log(count[seen]) - np.log(c[seen - 1])
        known.append(sums(count > 0).astype(np.int64))
        c = count
    return pd.DataFrame({"doc_id": list(ids), "n_words": b.sizes, **dict(zip(known_columns(len(known) + 1), known, strict=True)), "logprob": sums(logs)})


#: Of the n-grams of a length, those that are sent to the documents: at most as many.
HOT_GRAMS = 500_000
WHITE = r"[\x20\x09-\x0D]+"


def gram_hashes(h: Column, n: int) -> Column:
    """Hash of every n consecutive word hashes."""
    if n == 1:
        return h
    starts = F.when(F.size(h) >= n, F.sequence(F.lit(0), F.size(h) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.lit(n), *[F.get(h, i + d) for d in range(n)]))


def relational_scores(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", backoff: float = BACKOFF, order: int = 2) -> DataFrame:
    """The same as backoff_scores(), by tables and joins alone: nothing is packed, and every row that moves is an n-gram.

    N-grams of a length are counted in a table partitioned by hash, without those
    that occur once; the exploded n-grams of the documents are joined with it, and
    what is found is gathered and summed per document. The table's hot n-grams meet
    the documents where they are. The rows that move grow as the input does.
    """
    if order < 1:
        raise ValueError("the order is at least one word")
    spark = docs.sparkSession
    ship(spark)
    home = scratch(spark, "lm-tables")
    words = F.filter(F.split(ascii_lower(text_of(text)), WHITE), lambda w: w != "")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.transform(words, lambda w: F.xxhash64(w)).alias("h"))
    rows.write.option("compression", "zstd").parquet(f"{home}/words")
    rows = spark.read.parquet(f"{home}/words")
    total = rows.agg(F.sum(F.size("h"))).first()[0] or 0
    found = []
    with without_old_shuffles(spark):
        for n in range(1, order + 1):
            grams = rows.select("row", F.posexplode(gram_hashes(F.col("h"), n)).alias("at", "g"))
            grams.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").write.option("compression", "zstd").parquet(f"{home}/counts-{n}")
            counts = spark.read.parquet(f"{home}/counts-{n}")
            met = join_hot(grams, counts, "g", F.col("n"), total, HOT_GRAMS)
            met.select("row", F.lit(n).alias("length"), (F.col("at") + (n - 1)).alias("at"), "g", "n").write.option("compression", "zstd").parquet(f"{home}/found-{n}")
            found.append(f"{home}/found-{n}")
    listed = spark.read.parquet(*found).groupBy("row").agg(F.collect_list("length").alias("length"), F.collect_list("at").alias("at"), F.collect_list("g").alias("g"), F.collect_list("n").alias("n"))
    names = known_columns(order)

    @F.pandas_udf(f"{''.join(f'{c} long, ' for c in names)}logprob double")
    def score(size: pd.Series, lengths: pd.Series, places: pd.Series, grams: pd.Series, counts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([document_score(*x, total, order, backoff) for x in zip(size, lengths, places, grams, counts, strict=True)], columns=[*names, "logprob"])

    none = F.array().cast("array<long>")
    scored = rows.select("row", "doc_id", F.size("h").cast("long").alias("n_words")).join(listed, "row", "left")
    scored = scored.withColumn("s", score("n_words", *[F.coalesce(F.col(c).cast("array<long>"), none) for c in ("length", "at", "g", "n")]))
    return scored.select("doc_id", "n_words", "s.*").withColumn("mean_logprob", F.when(F.col("n_words") > 0, F.col("logprob") / F.col("n_words")))


def document_score(size: int, lengths, places, grams, counts, total: int, order: int, backoff: float) -> tuple:
    """Known n-grams of each length from two on, and the log-probability of a document of `size` words.

    lengths, places (of the last word), grams and counts: its n-grams that occur more than once in the corpus.
    """
    lengths, places, grams, counts = (np.asarray(x, dtype=np.int64) for x in (lengths, places, grams, counts))
    rest, known, c = float(total - size), [], np.zeros(size)
    logs = np.zeros(size)
    for n in range(1, order + 1):
        own = lengths == n
        _, back, times = np.unique(grams[own], return_inverse=True, return_counts=True)
        others = np.zeros(size)
        others[places[own]] = counts[own] - times[back]  # the document's own are left out
        if n == 1:
            logs = np.where(others > 0, np.log(np.maximum(others, 1)) - np.log(max(rest, 1.0)), -np.log(rest + 1))
        else:
            logs[n - 1 :] += np.log(backoff)
            seen = np.flatnonzero(others > 0)
            logs[seen] = np.log(others[seen]) - np.log(c[seen - 1])
            known.append(len(seen))
        c = others
    return (*known, float(logs.sum()))
