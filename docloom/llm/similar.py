"""Near copies by the Jaccard similarity of their word shingles.

A fingerprint of 64 bits changes by ten bits or so between texts of similarity
0.8, more than any index of its bytes can promise to find. So the same kind of
index is kept over a signature of BANDS * ROWS positions, each the least of the
text's shingle hashes in an order of its own: two texts agree at a position with
a probability of their similarity. Postings are kept for bands of ROWS
positions; texts of similarity 0.8 share none of them in one of ten million
pairs. What meets in a posting is tallied by the bytes that the signatures
share, kept if that tally is within five standard deviations of the similarity
asked for, and verified by the whole shingle sets.

Postings are not paired. In each, every text is first compared with one of
them, the one that meets most texts in all its postings: copies that differ from
one text at different places are each nearer to that text, or to one that is
little changed, than to each other, so it links nearly all that can be linked.
What is left apart after that is compared pair by pair, but only texts outside
of a posting's largest group with others, each pair in the first posting that
it shares, and only if sizes allow the similarity, and so do sketches of WIDE
bits that these texts get: least hashes in as many orders, a bit of each, which
of texts of the similarity differ in more than four standard deviations over
the mean in one of thirty thousand cases.

Cases: null and empty texts have no shingles and are like no other; fewer words
than a shingle has are one shingle; texts of any length are read whole; equal
texts are one key; an empty table gives no pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, give_back, ship

WORDS, SHARE, SEED = 5, 0.8, 42
#: Postings of a text, and signature positions of each.
BANDS, ROWS = 40, 5
#: Bits of the sketches of texts that are compared one by one.
WIDE = 2048
#: Shingles that are worked on together.
BLOCK, LIST = 1 << 11, 1 << 16
_ODD = (np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS + WIDE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
ORDERS, SKETCH = _ODD[: BANDS * ROWS], _ODD[BANDS * ROWS :]


def shingle_hashes(text: str | None, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Hashes of the shingles of a text, in order, repeats included; fewer words than a shingle has are one."""
    w, h = (text or "").encode("utf-8", "surrogatepass").lower().split(), xxhash.xxh64_intdigest
    joined = b" ".join(w)
    if len(w) < words:
        return np.array([h(joined, seed)] if w else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.r_[0, ends[: len(w) - words] + 1]
    ends, out = ends[words - 1 :], np.empty(len(starts), np.uint64)
    for k in range(0, len(starts), LIST):
        cut = zip(starts[k : k + LIST].tolist(), ends[k : k + LIST].tolist(), strict=True)
        out[k : k + LIST] = [h(joined[a:b], seed) for a, b in cut]
    return out


def signature(hashes: np.ndarray, orders: np.ndarray = ORDERS) -> np.ndarray:
    """The least hash in each of the orders; the largest number for no shingles."""
    least, block = np.full(len(orders), np.uint64(2**64 - 1)), max(1, BLOCK * len(ORDERS) // len(orders))
    for k in range(0, len(hashes), block):
        part = hashes[k : k + block]
        part = part ^ (part >> np.uint64(31))
        np.minimum(least, np.multiply.outer(orders, part).min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key a band; the bands' keys differ."""
    from .pieces import mixed

    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = mixed(key ^ column)
    return key.view(np.int64)


def signature_bytes(least: np.ndarray) -> bytes:
    """One byte of each position."""
    return ((least >> np.uint64(24)) & np.uint64(255)).astype(np.uint8).tobytes()


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One bit of the least hash in each of WIDE orders, in numbers of 64 bits."""
    return np.packbits(((signature(hashes, SKETCH) >> np.uint64(40)) & np.uint64(1)).astype(np.uint8)).view(np.int64)


def agreement(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Estimated similarity of signatures: their share of equal bytes, less what chance gives."""
    p, q = (np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1) for x in (a, b))
    return ((p == q).mean(axis=1) - 1 / 256) / (1 - 1 / 256)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def alike(texts: DataFrame, docs: DataFrame, share: float = SHARE, words: int = WORDS) -> DataFrame:
    """Pairs (u, v) of similar texts that connect all texts of similarity `share` or more.

    texts: one row per text with key (long), n (distinct shingles), bands and sig; docs: key and _text.
    """
    ship(docs.sparkSession)
    # standard deviations below what texts of that similarity agree in
    low = share - 5 * math.sqrt(share * (1 - share) / (BANDS * ROWS))
    most = (1 - share) / 2 * WIDE + 4 * math.sqrt((1 - share) / 2 * (1 + share) / 2 * WIDE)
    sigs = texts.where("n > 0").select("key", "n", "sig")
    entries = texts.where("n > 0").select("key", F.explode("bands").alias("b"))

    postings = entries.groupBy("b").agg(F.count("*").alias("size")).where("size > 1")
    owners = cut(entries.join(postings, "b").groupBy("key").agg(F.sum("size").alias("meets"), F.collect_list("b").alias("bs")))
    met = owners.select("key", "meets", F.explode("bs").alias("b"))
    hubs = met.groupBy("b").agg(F.max(F.struct("meets", F.xxhash64("key").alias("o"), "key"))["key"].alias("hub"))
    shared = cut(met.select("b", "key").join(hubs, "b"))

    @F.pandas_udf("boolean")
    def promising(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(agreement(x.tolist(), y.tolist()) >= low if len(x) else [], dtype=bool)

    @F.pandas_udf("binary")
    def packed(column: pd.Series) -> pd.Series:
        sets = [np.unique(shingle_hashes(t, words)).tobytes() for t in column]
        give_back()
        return pd.Series(sets)

    @F.pandas_udf("array<long>")
    def sketched(column: pd.Series) -> pd.Series:
        return pd.Series([sketch(np.unique(shingle_hashes(t, words))) for t in column])

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        each = (similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b, strict=True))
        found = [s >= share - 1e-9 for s in each]
        give_back()
        return pd.Series(found, dtype=bool)

    def texts_of(keys: DataFrame) -> DataFrame:
        """The texts of some keys; a list of keys of known size goes to the texts, else both sides are shuffled."""
        keys = cut(keys)
        small = keys.count() * 16 <= BROADCAST_BYTES
        return docs.join(F.broadcast(keys) if small else keys, "key", "left_semi").dropDuplicates(["key"])

    def screened(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (u, v) that may be similar by sizes and signatures, u < v, each once."""
        u, v = (sigs.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}")) for k in "uv")
        sized = F.least("nu", "nv") >= F.lit(share) * F.greatest("nu", "nv") - 1e-6
        return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().join(u, "u").join(v, "v").where(sized).where(promising("su", "sv")).select("u", "v")

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (u, v), each given once, that are similar."""
        told = cut(pairs)
        asked = told.select(F.col("u").alias("key")).union(told.select("v")).distinct()
        sets = cut(texts_of(asked).select("key", packed("_text").alias("s")))
        both = told.join(sets.select(F.col("key").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("key").alias("v"), F.col("s").alias("b")), "v")
        return cut(both.where(similar("a", "b")).select("u", "v"))

    from .simhash import components

    def open_postings(edges: DataFrame, rows: DataFrame) -> DataFrame:
        """(b, key, root, main) of the entries (b, key) of postings that hold several groups; main: the largest of them."""
        named = rows.join(components(edges).select(F.col("node").alias("key"), "root"), "key", "left").select("b", "key", F.coalesce("root", "key").alias("root"))
        sizes = named.groupBy("b", "root").agg(F.count("*").alias("n"))
        several = sizes.groupBy("b").agg(F.count("*").alias("groups"), F.max(F.struct("n", "root"))["root"].alias("main")).where("groups > 1")
        return cut(named.join(several.select("b", "main"), "b"))

    edges = verified(screened(shared.where("key <> hub").select(F.col("key").alias("u"), F.col("hub").alias("v"))))
    left = open_postings(edges, shared)
    if not left.head(1):
        return edges
    bits = texts_of(left.select("key").distinct()).select("key", sketched("_text").alias("bits"))
    known = cut(texts.select("key", "n", "bands").join(bits, "key"))
    x, y = (left.join(known, "key").select(*[F.col(c).alias(f"{c}{k}") for c in ("b", "key", "root", "main", "n", "bands", "bits")]) for k in "xy")
    differ = sum((F.bit_count(F.col("bitsx")[k].bitwiseXOR(F.col("bitsy")[k])) for k in range(WIDE // 64)), F.lit(0))
    on = (
        (F.col("bx") == F.col("by"))
        & (F.col("rootx") != F.col("rooty"))
        & ((F.col("rooty") == F.col("mainy")) | (F.col("keyx") < F.col("keyy")))
        & (F.least("nx", "ny") >= F.lit(share) * F.greatest("nx", "ny") - 1e-6)
        & (differ <= F.lit(most))
        & (F.get("bandsx", F.array_position(F.zip_with("bandsx", "bandsy", lambda p, q: p == q), True).cast("int") - 1) == F.col("bx"))
    )
    return edges.union(verified(x.where("rootx <> mainx").join(y, on).select(F.col("keyx").alias("u"), F.col("keyy").alias("v"))))
