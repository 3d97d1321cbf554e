"""Token counts of whole texts for a byte-level BPE vocabulary.

Method: whole-token shortcut. Before any text is read, every string of the
vocabulary is merged from its bytes; those that come out as exactly one token
are proven whole tokens. A text is cut into pre-tokens by the vocabulary's
pattern; pre-tokens that are proven count 1 without merging, and only the rest
is merged.

Cases: null and empty texts have 0 bytes and 0 tokens; texts of any length are
read whole (merging uses a heap, so a pre-token of n bytes costs n log n);
repeated rows give repeated results; an empty table gives an empty result;
other columns pass through, but for those of the result's names. Of merges of one
rank the leftmost is done first; a count equal to the limit is not over it.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_of

#: The pre-token pattern of byte-level BPE (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's memory of merged pre-tokens; when full it starts afresh.
MEMORY = 300_000
#: Longer pre-tokens are not remembered.
LONG = 64
FAR = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which the vocabulary file writes bytes."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Cost(dict):
    """Tokens of a pre-token: 1 for the proven, merged on first sight for the rest."""

    def __init__(self, owner: WholeTokenCounter) -> None:
        super().__init__(dict.fromkeys(owner.whole, 1))
        self.owner = owner

    def __missing__(self, pre: str) -> int:
        n = self.owner.merged(pre.encode("utf-8", "surrogatepass"))
        if len(pre) <= LONG:
            self[pre] = n
        return n


class WholeTokenCounter:
    """Counts tokens of texts; one is built per worker and vocabulary file."""

    def __init__(self, path: str, whole: frozenset[str] | None = None) -> None:
        """whole: what prove() has found elsewhere."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE vocabulary without normalizer is needed")
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (m.split(" ") if isinstance(m, str) else m))
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.bytes = [self.ids[bytes([b])] for b in range(256)]
        self.pre = regex.compile(PATTERN)
        special = [x["content"] for x in spec["added_tokens"] if x["special"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.whole = self.prove() if whole is None else whole
        self.cost = Cost(self)

    def prove(self) -> frozenset[str]:
        """The vocabulary strings that are one pre-token and encode alone as one token."""
        found = []
        for b in self.ids:
            try:
                s = b.decode()
            except UnicodeDecodeError:
                continue
            if self.pre.fullmatch(s) and self.pre.findall(s) == [s] and self.merged(b) == 1:
                found.append(s)
        return frozenset(found)

    def merged(self, b: bytes) -> int:
        """Number of tokens after all merges, best rank first and leftmost among equals."""
        n = len(b)
        if n < 2:
            return n
        ids, merges = [self.bytes[x] for x in b], self.merges
        if n <= 24:  # rescanning a short list is cheaper than a heap
            while len(ids) > 1:
                best, at, new = FAR, 0, 0
                for k in range(len(ids) - 1):
                    m = merges.get((ids[k], ids[k + 1]))
                    if m and m[0] < best:
                        best, at, new = m[0], k, m[1]
                if best == FAR:
                    break
                ids[at : at + 2] = [new]
            return len(ids)
        nxt, prv, alive = [*range(1, n), -1], [-1, *range(n - 1)], n
        heap = [(m[0], k, ids[k], ids[k + 1], m[1]) for k in range(n - 1) if (m := merges.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, c, new = heapq.heappop(heap)
            j = nxt[k]
            if ids[k] != a or j < 0 or ids[j] != c:
                continue  # one of the two has been merged meanwhile
            ids[k], ids[j], nxt[k], alive = new, -1, nxt[j], alive - 1
            if nxt[k] >= 0:
                prv[nxt[k]] = k
            for left in (prv[k], k):
                if left >= 0 and nxt[left] >= 0 and (m := merges.get((ids[left], ids[nxt[left]]))):
                    heapq.heappush(heap, (m[0], left, ids[left], ids[nxt[left]], m[1]))
        return alive

    def count(self, text: str) -> int:
        total = 0
        if self.special and self.special.search(text):
            total += sum(1 for _ in self.special.finditer(text))
            parts = self.special.split(text)
        else:
            parts = (text,)
        if len(self.cost) > MEMORY:
            self.cost = Cost(self)
        cost = self.cost.__getitem__
        return total + sum(sum(map(cost, self.pre.findall(part))) for part in parts)


@lru_cache(maxsize=2)
def counter(path: str, whole: frozenset[str] | None = None) -> WholeTokenCounter:
    return WholeTokenCounter(path, whole)


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", over: int = 1024, into: str = "n_tokens") -> DataFrame:
    """docs with n_bytes (UTF-8), `into` (tokens) and over_limit (more than `over`) in place of columns of those names."""
    ship(docs.sparkSession)
    # proven once; the vocabulary bounds what is sent
    whole = docs.sparkSession.sparkContext.broadcast(counter(vocabulary).whole)

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        c = counter(vocabulary, whole.value)
        return pd.Series([c.count(t) for t in texts], dtype="int64")

    keep = [c for c in docs.columns if c not in ("n_bytes", into, "over_limit")]
    out = docs.select(*keep, F.octet_length(text_of(text)).cast("long").alias("n_bytes"), tokens(text_of(text)).alias(into))
    return out.withColumn("over_limit", F.col(into) > over)
