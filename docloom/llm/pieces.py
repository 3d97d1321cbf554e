"""SentencePiece encoding with seeded merge-dropout, and decoding.

Method: a text becomes the symbols of its characters; an agenda of candidate
merges is worked off, best piece first and leftmost among equals, but a
candidate is skipped if a hash keyed by (seed, document, place of the chunk in
the text, left, middle, right) falls below alpha. A skipped candidate stays
skipped, so a segmentation is a function of the key alone: it can be repeated
anywhere, and no random state is kept. Every occurrence of a word has a key of
its own. With alpha 0 the library's own BPE segmentation results.

No piece spans a space after a letter or a line break, so texts are encoded
chunk by chunk. Each distinct chunk of a batch is first segmented without
dropout, and the candidates that came up are kept; an occurrence whose key skips
none of them is segmented just so, and only the others have an agenda of their
own. The agendas of all short chunks advance together, one merge a step, as
array operations; long chunks have a heap each, of n log n.

Decoding joins the pieces' bytes. It is lossless for every text: characters
without a piece, and U+2581 itself, which the library would read as a space,
are spelled in byte pieces.

Cases: null and empty texts have no pieces and decode to empty; texts of any
length are encoded whole; repeated rows get repeated results; an empty table
gives an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, ship, text_of, unused

SPACE = "▁"
CHUNK = re.compile(r" *[^ \n]+| +|\n")
ALPHA, SEED = 0.1, 1
#: Longer chunks have a heap of their own.
SHORT = 40
#: Characters whose distinct chunks are segmented once without dropout.
TOGETHER = 4_000_000
#: Chunks whose candidates are gathered, and occurrences with an agenda of their own, that are worked off in one go.
PLAIN, AGAIN = 20_000, 50_000
#: Symbols of agendas that advance together; bounds the arrays of a worker.
CELLS = 125_000
NEVER = np.int32(2**31 - 1)
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Odd factors of a candidate's left, middle and right places.
PLACES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
FULL = 2**64 - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (splitmix64)."""
    x = x + np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def mixed_one(x: int) -> int:
    x = (x + MIX[0]) & FULL
    x = ((x ^ (x >> 30)) * MIX[1]) & FULL
    x = ((x ^ (x >> 27)) * MIX[2]) & FULL
    return x ^ (x >> 31)


def candidate(k, m, r):
    """A number for a candidate that joins the symbols at k and m, r being the next; for arrays of uint64."""
    return k * np.uint64(PLACES[0]) + m * np.uint64(PLACES[1]) + r * np.uint64(PLACES[2])


def spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each stretch, one stretch after the other."""
    before = np.cumsum(size) - size
    return np.repeat(begin - before, size) + np.arange(int(size.sum()))


class Numbers(dict):
    """Numbers strings in the order in which they are asked for first."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class PieceCoder:
    """Encodes and decodes with one model; one is built per worker and model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if any(SPACE in text[i].lstrip(SPACE) or "\n" in text[i] for i in normal):
            raise ValueError("a model whose pieces start at spaces is needed")
        self.symbol = {text[i]: i for i in normal}
        self.byte = {int(text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("a model with byte pieces is needed")
        self.bytes = [b""] * n
        for i in normal:
            self.bytes[i] = text[i].replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])
        # single characters of pieces that are no pieces themselves are symbols too
        for c in sorted({c for i in normal for c in text[i]} - self.symbol.keys()):
            self.symbol[c] = n
            n += 1
        order = sorted({sp.get_score(i) for i in normal}, reverse=True)
        rank = {s: k for k, s in enumerate(order)}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for i in normal:
            p = text[i]
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    self.pairs[a, b] = (rank[sp.get_score(i)], i)
        keys = np.array([a << 20 | b for a, b in self.pairs], dtype=np.int64)
        # a table of twice to four times as many slots as pairs; a pair lies in the first free slot from its hash on
        self.shift = 64 - (2 * len(keys)).bit_length()
        self.slots = np.full(1 << (64 - self.shift), -1, np.int64)
        self.rows = np.full(len(self.slots), len(keys), np.int32)
        for row, (key, slot) in enumerate(zip(keys.tolist(), self.slot_of(keys).tolist(), strict=True)):
            while self.slots[slot] >= 0:
                slot = (slot + 1) % len(self.slots)
            self.slots[slot], self.rows[slot] = key, row
        self.ranks = np.append(np.array([r for r, _ in self.pairs.values()], dtype=np.int32), NEVER)
        self.made = np.append(np.array([i for _, i in self.pairs.values()], dtype=np.int32), np.int32(0))
        self.spelled = {" " if c == SPACE else c: i for c, i in self.symbol.items() if len(c) == 1}
        self.base = len(text)
        self.by_point = np.full(0x110000, -1, np.int32)
        for c, i in self.spelled.items():
            self.by_point[ord(c)] = i

    def limit(self, alpha: float) -> int:
        return min(int(alpha * 2.0**64), 2**64 - 1)

    def spans(self, chunk: str, key: int, limit: int, offered: list[int] | None = None) -> list[int]:
        """Pieces of one chunk by a heap; takes any characters and lengths. offered: gets the candidates that came up."""
        spelled, pairs, end = self.spelled, self.pairs, len(chunk)
        ids = [spelled.get(c, -1) for c in chunk]
        nxt, prv, heap = [*range(1, end + 1)], [*range(-1, end - 1)], []

        def offer(k: int) -> None:
            m = nxt[k]
            if m < end and (p := pairs.get((ids[k], ids[m]))):
                if limit or offered is not None:
                    where = (k * PLACES[0] + m * PLACES[1] + nxt[m] * PLACES[2]) & FULL
                    if offered is not None:
                        offered.append(where)
                    if mixed_one(where ^ key) < limit:
                        return
                heapq.heappush(heap, (p[0], k, m, nxt[m], p[1]))

        for k in range(end - 1):
            offer(k)
        while heap:
            _, k, m, r, made = heapq.heappop(heap)
            if ids[k] == -2 or nxt[k] != m or ids[m] == -2 or nxt[m] != r:
                continue
            ids[k], ids[m], nxt[k] = made, -2, r
            if r < end:
                prv[r] = k
            if prv[k] >= 0:
                offer(prv[k])
            offer(k)
        out, k = [], 0
        while k < end:
            if 0 <= ids[k] < self.base:
                out.append(ids[k])
            else:
                out.extend(self.byte[b] for b in chunk[k].encode("utf-8", "surrogatepass"))
            k = nxt[k]
        return out

    def slot_of(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(MIX[0])) >> np.uint64(self.shift)).astype(np.int64)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Row of the pair table; the last row if the two do not merge."""
        want = a.astype(np.int64) << 20 | b
        slot = self.slot_of(want)
        found = self.slots[slot]
        row = self.rows[slot]
        other = np.flatnonzero(found != want)
        while len(other):
            other = other[found[other] >= 0]  # an empty slot ends the search
            slot[other] = (slot[other] + 1) & (len(self.slots) - 1)
            found[other], row[other] = self.slots[slot[other]], self.rows[slot[other]]
            other = other[found[other] != want[other]]
        return row

    def agendas(self, ids: np.ndarray, length: np.ndarray, key: np.ndarray, limit: int, first: np.ndarray, begin: np.ndarray, offered: list | None = None) -> np.ndarray:
        """Work off the agendas of all rows together. ids (n, w): symbols from column 0 on, else -1; changed in place. first: rows of the pair table for a row's symbols and their next, from its begin on. offered: gets (rows, candidates)."""
        n, w = ids.shape
        cols = np.arange(w, dtype=np.int32)
        ids = ids.ravel()  # places are counted through all rows: base + column
        nxt, prv = np.tile(cols + 1, n), np.tile(cols - 1, n)
        rank, made = np.full(n * w, NEVER, np.int32), np.zeros(n * w, np.int32)
        length = length.astype(np.int32)

        def offer(rows: np.ndarray, k: np.ndarray, base: np.ndarray, row: np.ndarray | None = None) -> None:
            at = base + k
            m = nxt[at]
            if row is None:
                ok = np.flatnonzero(m < length[rows])
                rows, k, m, base, at = rows[ok], k[ok], m[ok], base[ok], at[ok]
                row = self.look_up(ids[at], ids[base + m])
            r = self.ranks[row]
            if limit or offered is not None:
                there = np.flatnonzero(r < NEVER)
                where = candidate(k[there].astype(np.uint64), m[there].astype(np.uint64), nxt[(base + m)[there]].astype(np.uint64))
                if offered is not None:
                    offered.append((rows[there], where))
                if limit:
                    r[there[mixed(where ^ key[rows[there]]) < np.uint64(limit)]] = NEVER
            rank[at], made[at] = r, self.made[row]

        rows, k = np.nonzero(cols[None, :] < length[:, None] - 1)
        offer(rows, k.astype(np.int32), rows * w, first[begin[rows] + k])
        table = rank.reshape(n, w)
        rows = np.arange(n)
        while len(rows):
            k = table[rows].argmin(1).astype(np.int32)
            base = rows * w
            at = base + k
            go = np.flatnonzero(rank[at] < NEVER)
            if not len(go):
                break
            rows, k, base, at = rows[go], k[go], base[go], at[go]
            m = nxt[at]
            to = base + m
            r = nxt[to]
            ids[at], ids[to], nxt[at] = made[at], -1, r
            prv[base + np.minimum(r, w - 1)] = k
            rank[to] = rank[at] = NEVER
            left = prv[at]
            has = np.flatnonzero(left >= 0)
            rank[base[has] + left[has]] = NEVER
            offer(rows[has], left[has], base[has])
            offer(rows, k, base)
        return ids.reshape(n, w)

    def laid_out(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of chunks: the symbols of all characters, the row of the pair table for each and its next, where each chunk begins, and its size, 0 if it goes by the heap."""
        size = np.array(list(map(len, chunks)), dtype=np.int64)
        begin = np.cumsum(size) - size
        spelled = self.by_point[np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)]
        bare = np.add.reduceat((spelled < 0) | (spelled >= self.base), begin) > 0 if len(chunks) else size > 0
        size[bare | (size > SHORT)] = 0
        first = np.zeros(len(spelled), np.int32)  # where a chunk ends, it is never read
        for k in range(0, len(spelled) - 1, CELLS):
            first[k : k + CELLS][: len(spelled) - 1 - k] = self.look_up(spelled[k : k + CELLS][: len(spelled) - 1 - k], spelled[k + 1 : k + 1 + CELLS])
        return spelled, first, begin, size

    def worked_off(self, chunks: list[str], laid: tuple, which: np.ndarray, keys: np.ndarray, limit: int, offered: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each (chunks[which], key): flat ids, and where each begins, with the end. laid: of laid_out(chunks). offered: gets (place in which, candidates)."""
        spelled, first, begin, size = laid
        count, done = np.zeros(len(which), np.int64), []
        for a, b in zip((1, 5, 9, 13, 19, 27), (5, 9, 13, 19, 27, SHORT + 1), strict=True):
            group = np.flatnonzero((size[which] >= a) & (size[which] < b))
            for part in np.array_split(group, len(group) * b // CELLS + 1):
                if not len(part):
                    continue
                n, cols = size[which[part]], np.arange(b, dtype=np.int64)
                inside = cols[None, :] < n[:, None]
                ids = np.where(inside, spelled[np.minimum(begin[which[part]][:, None] + cols[None, :], len(spelled) - 1)], -1).astype(np.int32)
                own = [] if offered is not None else None
                ids = self.agendas(ids, n, keys[part], limit, first, begin[which[part]], own)
                if own is not None:
                    offered += [(part[rows], where) for rows, where in own]
                keep = ids >= 0
                count[part] = keep.sum(1)
                done.append((part, ids[keep]))
        for k in np.flatnonzero(size[which] == 0):
            own = [] if offered is not None else None
            ids = np.array(self.spans(chunks[which[k]], int(keys[k]), limit, own), dtype=np.int32)
            if own is not None:
                offered.append((np.full(len(own), k), np.array(own, dtype=np.uint64)))
            count[k] = len(ids)
            done.append((np.array([k]), ids))
        starts = np.r_[0, np.cumsum(count)]
        flat = np.zeros(int(starts[-1]), np.int32)
        for part, ids in done:
            flat[spread(starts[part], count[part])] = ids
        return flat, starts

    def segment(self, chunks: list[str], which: np.ndarray, keys: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of each (chunks[which], key): flat ids, where each begins and its length."""
        limit, laid = self.limit(alpha), self.laid_out(chunks)
        flats, sizes, wheres, many = [], [], [], []
        for a in range(0, len(chunks), PLAIN):
            some = np.arange(a, min(a + PLAIN, len(chunks)))
            offered = [] if limit else None
            flat, starts = self.worked_off(chunks, laid, some, np.zeros(len(some), np.uint64), 0, offered)
            flats.append(flat)
            sizes.append(np.diff(starts))
            if offered:
                of = np.concatenate([o for o, _ in offered])
                wheres.append(np.concatenate([w for _, w in offered])[np.argsort(of, kind="stable")])
                many.append(np.bincount(of, minlength=len(some)))
            elif limit:
                many.append(np.zeros(len(some), np.int64))
        size = np.concatenate([np.zeros(0, np.int64), *sizes])
        begin, size = (np.cumsum(size) - size)[which], size[which]
        if limit and len(which):
            n, where = np.concatenate(many), np.concatenate([np.zeros(0, np.uint64), *wheres])
            first, total, again = np.cumsum(n) - n, sum(map(len, flats)), []
            del wheres
            for part in np.array_split(np.arange(len(which)), int(n[which].sum()) // CELLS + 1):
                each = n[which[part]]
                hit = mixed(where[spread(first[which[part]], each)] ^ np.repeat(keys[part], each)) < np.uint64(limit)
                ends = np.cumsum(each)
                hits = np.r_[0, np.cumsum(hit)]
                again.append(part[hits[ends] > hits[ends - each]])
            again = np.concatenate(again)
            for part in np.array_split(again, len(again) // AGAIN + 1):
                more, starts = self.worked_off(chunks, laid, which[part], keys[part], limit)
                begin[part], size[part] = total + starts[:-1], np.diff(starts)
                flats.append(more)
                total += len(more)
        return np.concatenate([np.zeros(0, np.int32), *flats]), begin, size

    def encode(self, texts: list[str | None], doc_keys: list[int], seed: int = SEED, alpha: float = ALPHA) -> list[np.ndarray]:
        """Piece ids of each text."""
        done, group, size = [], [], 0
        for t, d in zip(texts, doc_keys, strict=True):
            group.append((t or "", d))
            size += len(group[-1][0])
            if size >= TOGETHER:
                done += self.together(group, seed, alpha)
                group, size = [], 0
        return done + self.together(group, seed, alpha)

    def together(self, group: list[tuple[str, int]], seed: int, alpha: float) -> list[np.ndarray]:
        number = Numbers()
        which = [np.fromiter(map(number.__getitem__, CHUNK.findall(" " + t) if t else ()), np.int32) for t, _ in group]
        if not number:
            return [np.zeros(0, np.int32) for _ in group]
        many = [*map(len, which)]
        which = np.concatenate(which)
        keys = np.concatenate([self.keys_of(n, d, seed) for n, (_, d) in zip(many, group, strict=True)])
        flat, begin, size = self.segment(list(number), which, keys, alpha)
        out, at = [], 0
        for n in many:
            out.append(flat[spread(begin[at : at + n], size[at : at + n])])
            at += n
        return out

    def keys_of(self, n: int, doc_key: int, seed: int) -> np.ndarray:
        """The keys of the first n chunks of a text."""
        own = mixed_one((doc_key & FULL) ^ mixed_one(seed & FULL))
        return mixed(np.arange(n, dtype=np.uint64) ^ np.uint64(own))

    def decode(self, ids) -> str:
        """The text of piece ids; the space put before the first word is taken off."""
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        return raw.removeprefix(b" ").decode("utf-8", "surrogatepass")


@lru_cache(maxsize=2)
def coder(path: str) -> PieceCoder:
    return PieceCoder(path)


def doc_key(doc_id: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def encode(docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id", seed: int = SEED, alpha: float = ALPHA, into: str = "piece_ids") -> DataFrame:
    """docs with the piece ids of the text, an array of int."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def pieces(texts: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series(coder(model).encode(texts.tolist(), keys.tolist(), seed, alpha))

    return docs.withColumn(into, pieces(text_of(text), doc_key(doc_id)))


def decode(docs: DataFrame, model: str, ids: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """docs with the text of the piece ids; null ids decode to empty."""
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def texts(found: pd.Series) -> pd.Series:
        return pd.Series([coder(model).decode(x) if x is not None else "" for x in found])

    return docs.withColumn(into, texts(F.col(ids)))


def round_trip(docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id", seed: int = SEED, alpha: float = ALPHA, ids: bool = False) -> DataFrame:
    """docs with n_pieces, pieces_sha256 (ids as little-endian 32-bit integers), lossless (decoding gives the text) and, if asked for, piece_ids."""
    ship(docs.sparkSession)
    names = ["n_pieces", "pieces_sha256", "decoded_sha256", *["piece_ids"] * ids]

    @F.pandas_udf("n_pieces long, pieces_sha256 string, decoded_sha256 string" + ", piece_ids array<int>" * ids)
    def both(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        c = coder(model)
        found = c.encode(texts.tolist(), keys.tolist(), seed, alpha)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        rows = [(len(i), sha(i.astype("<i4").tobytes()), sha(c.decode(i).encode("utf-8", "surrogatepass")), *[i] * ids) for i in found]
        del found
        give_back()
        return pd.DataFrame(rows, columns=names)

    keep = [c for c in docs.columns if c not in ("n_pieces", "pieces_sha256", "lossless", "piece_ids")]
    coded = unused(docs, "coded")
    out = docs.withColumn(coded, both(text_of(text), doc_key(doc_id)))
    lossless = F.col(f"{coded}.decoded_sha256") == F.sha2(text_of(text), 256)
    return out.select(*keep, f"{coded}.n_pieces", f"{coded}.pieces_sha256", lossless.alias("lossless"), *[f"{coded}.piece_ids"] * ids)
