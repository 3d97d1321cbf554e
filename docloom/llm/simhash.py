"""SimHash near-duplicate groups.

Fingerprint: A-Z lower-cased, words between ASCII white space, shingles of
three words with repeats (fewer words: the whole sequence), each hashed by
XXH64; a bit is set if more than half the hashes have it.

Method: byte-position inverted index with count filtering. Two fingerprints
that differ in at most two bits differ in at most two of their eight bytes, so
they share at least six positional bytes. Postings are kept for pairs of
two-byte positions: of four such positions at most two are touched, so some
pair is shared whole. A pair found in a posting is tallied (how many of the
eight positional bytes agree), kept from the guaranteed minimum of six on, and
verified by counting differing bits.

Postings longer than HOT are not paired. There, each fingerprint is listed
under itself and its 64 one-bit neighbours: two are within two bits exactly if
their lists meet, and no list entry can have more than 65 members. That path is
exact too, so nothing is dropped, and rows stay linear in the distinct
fingerprints.

Groups are connected components, found by alternating large-star and
small-star steps on distinct fingerprints; every step is checkpointed.

Cases: null, empty and white-space texts have fingerprint zero and are linked
like any other; texts of any length are hashed whole; equal texts have equal
fingerprints, so they group at distance zero; repeated rows stay repeated rows;
an empty table gives an empty result; a null doc_id takes part but never names
a group unless it is alone; a group is named by its least id, whatever the order
of rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, join_hot, ship, text_of
from .similar import alike, band_keys, shingle_hashes, signature, signature_bytes

SEED = 42
BITS = 2
BLOCK = 1 << 16
#: Longest posting that is paired directly: as many pairs a row as the other path has list entries.
HOT = 64
#: Edges that a task of a component step writes, if there are that many.
EDGES = 10_000


def bits_of(hashes: np.ndarray) -> int:
    """SimHash of shingle hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[k : k + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, words: int = 3, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a text."""
    return bits_of(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3, seed: int = SEED, into: str = "fp") -> DataFrame:
    """docs with the fingerprint as a signed long."""
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words, seed) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn(into, simhash(text_of(text)))


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def shared_bytes(x: Column) -> Column:
    """How many of the eight positional bytes agree, given the exclusive or."""
    total = F.lit(0)
    for p in range(8):
        total = total + F.when(F.shiftrightunsigned(x, 8 * p).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0)
    return total


def links(distinct: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """Edges (u, v), u > v, that connect all fingerprints within `bits` (at most 2) of each other.

    distinct: one row per fingerprint in column fp. Within postings of up to
    `hot` entries every pair is an edge; beyond, edges lead to the least
    fingerprint of each shared neighbour.
    """
    if not 0 <= bits <= 2:
        raise ValueError("the index guarantees links of at most two bits")
    fp = F.col("fp")
    two = [F.shiftrightunsigned(fp, 16 * g).bitwiseAND(F.lit(0xFFFF)) for g in range(4)]
    pairs = [(a, b) for a in range(4) for b in range(a + 1, 4)]
    keys = F.array(*[F.lit(k << 32).cast("long") + two[a] * F.lit(1 << 16) + two[b] for k, (a, b) in enumerate(pairs)])
    postings = distinct.select("fp", F.explode(keys).alias("k"))
    sizes = postings.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(postings.join(sizes, "k"))
    short = shared.where(F.col("n") <= hot)
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    near = (
        short.alias("a")
        .join(short.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.fp") > F.col("b.fp")))
        .where(shared_bytes(x) >= 8 - bits)
        .where(F.bit_count(x) <= bits)
        .select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    )
    out = near
    crowd = shared.where(F.col("n") > hot).select("fp").distinct()
    if bits == 2:
        around = F.array(fp, *[fp.bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")) for b in range(64)])
        listed = crowd.select("fp", F.explode(around).alias("z"))
        least = listed.groupBy("z").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("z", "v")
        out = out.union(listed.join(least, "z").where(F.col("fp") > F.col("v")).select(F.col("fp").alias("u"), "v"))
    elif bits == 1:
        around = F.array(fp, *[fp.bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")) for b in range(64)])
        other = crowd.select("fp", F.explode(around).alias("z"))
        out = out.union(other.join(crowd.select(F.col("fp").alias("z")), "z").where(F.col("fp") > F.col("z")).select(F.col("fp").alias("u"), F.col("z").alias("v")))
    return out.distinct()


def components(edges: DataFrame, most: int = 40) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the least node that can be reached."""

    def two(e: DataFrame, *edges: tuple[str, str]) -> DataFrame:
        """The edges (names of u and v) of every row."""
        return e.select(F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in edges])).alias("e")).select("e.*")

    def star(e: DataFrame, least: DataFrame) -> DataFrame:
        return e.join(least, "u")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = cut(edges.select("u", "v").where("u <> v"))
    before = mark(e)
    for _ in range(most):
        if not before[0]:
            break
        tasks = 1 + 2 * before[0] // EDGES
        wide = two(e, ("u", "v"), ("v", "u"))
        least = wide.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = star(wide, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = two(star(down, least), ("v", "m"), ("u", "m"))
        # few edges are dealt to few tasks
        e = cut(small.where("u <> v").distinct().coalesce(tasks))
        after = mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("v", F.col("v").alias("root")))


def signed_texts(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """docs with _text replaced by fp, n (distinct shingles), bands and sig, all of one pass over the shingles."""
    ship(docs.sparkSession)

    @F.pandas_udf("fp long, n long, bands array<long>, sig binary")
    def signed(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            h = shingle_hashes(t, words, seed)
            least = signature(h)
            rows.append((np.array([bits_of(h)], np.uint64).view(np.int64)[0], len(np.unique(h)), band_keys(least) if len(h) else [], signature_bytes(least)))
        give_back()
        return pd.DataFrame(rows, columns=["fp", "n", "bands", "sig"])

    return docs.withColumn("s", signed("_text")).select(*[c for c in docs.columns if c != "_text"], "s.*")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 3, bits: int = BITS, seed: int = SEED, carry: tuple[Column, ...] = (), share: float | None = None) -> DataFrame:
    """(doc_id, fp, fingerprint, root, component_id) and the columns to carry, for every row of docs.

    root is the group's least fingerprint (signed); it tells groups apart even where ids repeat.
    With share, texts whose shingles have that Jaccard similarity are linked too.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), *carry, text_of(text).alias("_text"))
    if share is None:
        rows = cut(fingerprints(base, "_text", words, seed).drop("_text"))
    else:
        base = base.withColumn("_key", F.xxhash64("_text"))
        kept = cut(signed_texts(base, words, seed))
        rows = kept.drop("_key", "n", "bands", "sig")
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("size")))
    edges = links(distinct.select("fp"), bits)
    if share is not None:
        # texts of one fingerprint are one group, so edges between texts are edges between fingerprints
        texts = kept.select(F.col("_key").alias("key"), "fp", "n", "bands", "sig").dropDuplicates(["key"])
        pairs = alike(texts, base.select(F.col("_key").alias("key"), "_text"), share, words)
        both = pairs.join(texts.select(F.col("key").alias("u"), F.col("fp").alias("p")), "u").join(texts.select(F.col("key").alias("v"), F.col("fp").alias("q")), "v")
        edges = edges.union(both.where("p <> q").select(F.greatest("p", "q").alias("u"), F.least("p", "q").alias("v")))
    found = components(edges)
    member = distinct.join(found.withColumnRenamed("node", "fp"), "fp")
    least = member.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("many"))
    named = join_hot(member, least, "root", F.col("many"), distinct.count()).select("fp", "root", "least")
    alone = F.col("root").isNull()
    every = cut(distinct.join(named, "fp", "left").select("fp", "size", F.coalesce("root", "fp").alias("root"), F.when(alone, F.col("first")).otherwise(F.col("least")).alias("component_id")))
    total = every.agg(F.sum("size")).first()[0] or 0
    return join_hot(rows, every, "fp", F.col("size"), total).select(*rows.columns, as_hex(F.col("fp")).alias("fingerprint"), "root", "component_id")
