"""Secret scans: fixed patterns, and formats inferred as probabilistic automata.

Base spans come from three patterns (assign, access, hex). The method adds
spans: labelled credentials of a format form a prefix tree, whose states are
merged where their outgoing frequencies are statistically compatible
(Hoeffding bound, red-blue order), which leaves a probabilistic automaton.
Candidates are all runs of credential characters, and in each run what an
automaton accepts from its start, from behind a separator (+/_.=-) or from one
of the format's heads, up to the last accepting end at a separator, at the end
of the run or where the automaton cannot go on (formats of one length: at that
length). A candidate counts if the automaton gives it a likelihood that exceeds
that of the background by MARGIN nats a character; of overlapping ones the one
with the largest excess is reported, if base spans do not cover it. The
background is learned too: how often each character follows each other one in
all texts, but for runs that may be credentials themselves (long ones with
digits), and the same with upper and lower case exchanged. It starts from PRIOR,
prose of one case, as seen PRIOR_PAIRS times after every character.

Labelled credentials are either given (format, text) or drawn, with a fixed
seed, from the public formats in FORMATS.

Cases: null and empty texts have no spans; texts of any length are read whole;
offsets are code points, ends exclusive; of candidates with the same excess the
first one is reported, then the first format by name; repeated rows get repeated
results; an empty table gives an empty result; other columns pass through, but
for those of the result's names.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_of, unused

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
CANDIDATE = 16
#: Characters by which the literal heads of a format are found.
HEAD = 3
MARGIN = 0.25
LOWER, UPPER, DIGIT, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
BASE64 = UPPER + LOWER + DIGIT
#: Public credential formats (fixed values): name, and for each part literal heads, characters, shortest and longest rest.
FORMATS = [
    ("hexupper", [(("",), DIGIT + "ABCDEF", 32, 64)]),
    ("github", [(("ghp_", "gho_", "ghs_"), BASE64, 36, 36)]),
    ("stripe", [(("sk_live_", "rk_live_", "sk_test_"), BASE64, 24, 32)]),
    ("slack", [(("xoxb-", "xoxp-"), DIGIT + BASE64 + "-", 30, 50)]),
    ("google", [(("AIza",), BASE64 + "_-", 35, 35)]),
    ("jwt", [(("eyJ",), BASE64 + "_-", 40, 120)]),
    ("random", [(("",), BASE64, 24, 64)]),
    ("base64", [(("",), BASE64 + "+/", 24, 88)]),
    ("jwt", [(("eyJ",), BASE64 + "_-", 17, 60), ((".eyJ",), BASE64 + "_-", 17, 120), ((".",), BASE64 + "_-", 43, 86)]),
]
SEPARATORS = frozenset("+/_.=-")
_CANDIDATE = np.zeros(256, bool)
_CANDIDATE[list((BASE64 + "+/_.=-").encode())] = True
_HEX = np.zeros(256, bool)
_HEX[list(HEX.encode())] = True


def drawn_credentials(each: int = 150, seed: int = 7) -> list[tuple[str, str]]:
    """(format, text) examples of FORMATS."""
    rng = random.Random(seed)
    part = lambda heads, chars, a, b: rng.choice(heads) + "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    return [(name, "".join(part(*p) for p in parts)) for name, parts in FORMATS for _ in range(each)]


class Automaton:
    """A probabilistic automaton inferred from example strings."""

    def __init__(self, examples: list[str], alpha: float = 0.05) -> None:
        # prefix tree: counts of strings through and ending at a state, and of each move
        self.ends, self.seen, self.moves, self.count = [0], [0], [{}], [{}]
        for x in sorted(examples):
            s = 0
            self.seen[0] += 1
            for c in x:
                if c not in self.moves[s]:
                    self.moves[s][c] = len(self.ends)
                    self.ends.append(0)
                    self.seen.append(0)
                    self.moves.append({})
                    self.count.append({})
                self.count[s][c] = self.count[s].get(c, 0) + 1
                s = self.moves[s][c]
                self.seen[s] += 1
            self.ends[s] += 1
        self.shortest, self.longest = min(map(len, examples)), max(map(len, examples))
        heads = {x[:HEAD] for x in examples}  # few of them: the format has literal ones
        self.heads = re.compile("(?=" + "|".join(map(re.escape, sorted(heads))) + ")") if len(heads) * 20 <= len(examples) else None
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.merge_states()
        self.finish()

    def differ(self, a: int, n: int, b: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(a / n - b / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = self.seen[p], self.seen[q]
            if self.differ(self.ends[p], n, self.ends[q], m):
                return False
            for c in self.count[p].keys() | self.count[q].keys():
                if self.differ(self.count[p].get(c, 0), n, self.count[q].get(c, 0), m):
                    return False
                if c in self.moves[p] and c in self.moves[q]:
                    todo.append((self.moves[p][c], self.moves[q][c]))
        return True

    def fold(self, p: int, q: int) -> None:
        """Add the subtree of q to p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.ends[p] += self.ends[q]
            self.seen[p] += self.seen[q]
            for c, to in self.moves[q].items():
                self.count[p][c] = self.count[p].get(c, 0) + self.count[q][c]
                if c in self.moves[p]:
                    todo.append((self.moves[p][c], to))
                else:
                    self.moves[p][c] = to

    def merge_states(self) -> None:
        red = [0]
        while True:
            blue = sorted({(self.moves[p][c], p, c) for p in red for c in self.moves[p] if self.moves[p][c] not in red})
            if not blue:
                break
            q, p, c = max(blue, key=lambda b: (self.seen[b[0]], -b[0]))
            fits = [r for r in red if self.compatible(r, q)]
            if fits:  # rarely seen states are compatible with many: the one seen most is taken, of equals the latest
                r = max(fits, key=lambda r: (self.seen[r], red.index(r)))
                self.moves[p][c] = r
                self.fold(r, q)
            else:
                red.append(q)
        self.red = red

    def finish(self) -> None:
        """Log probabilities, with moves not seen left impossible."""
        name = {s: k for k, s in enumerate(self.red)}
        self.table = [{c: (name[to], math.log(self.count[s][c] / self.seen[s])) for c, to in self.moves[s].items()} for s in self.red]
        self.accepts = [self.ends[s] > 0 for s in self.red]
        self.stop = [math.log((self.ends[s] + 0.5) / (self.seen[s] + 1)) for s in self.red]

    def score(self, x: str) -> float:
        """Log likelihood of x; minus infinity if it leaves the format."""
        s, total, table = 0, 0.0, self.table
        for c in x:
            m = table[s].get(c)
            if m is None:
                return -math.inf
            s, total = m[0], total + m[1]
        return total + self.stop[s]

    def last_end(self, x: str, start: int, passed: dict, most: int | None) -> tuple[int, float, int] | None:
        """(end, log likelihood so far, state) at the last accepting end from start, or at `most` characters.

        passed: states at places of x that earlier starts came through, from where the way is known.
        """
        s, i, total, table, n, best, trail = 0, start, 0.0, self.table, len(x), None, []
        if most is not None:
            for i in range(start, start + most):
                if i >= n or (m := table[s].get(x[i])) is None:
                    return None
                s, total = m[0], total + m[1]
            return (start + most, total, s) if self.accepts[s] else None
        while True:
            m = table[s].get(x[i]) if i < n else None
            if self.accepts[s] and (m is None or x[i] in SEPARATORS):
                best = (i, total, s)
            if m is None:
                break
            if i > start and (i % 64 == 0 or x[i - 1] in SEPARATORS):
                if (s, i) in passed:
                    known, before = passed[s, i]
                    if known and known[0] > i:
                        best = (known[0], total + known[1] - before, known[2])
                    break
                trail.append((s, i, total))
            s, i, total = m[0], i + 1, total + m[1]
        for state, place, before in trail:
            passed[state, place] = (best, before)
        return best


#: Characters of candidates, by which the background is counted; all others are one.
ALPHABET = BASE64 + "+/_.=-"
OTHER = len(ALPHABET)
_CODE = np.full(256, OTHER, np.int64)
_CODE[list(ALPHABET.encode())] = np.arange(OTHER)
_SWAPPED = np.array([ALPHABET.index(c.swapcase()) for c in ALPHABET] + [OTHER])


PRIOR = np.array([0.92 / 26 if c in LOWER else 0.08 / 42 for c in ALPHABET] + [0.01])
PRIOR_PAIRS = 1000


class Background:
    """Log probability of a character after another, from counts of pairs."""

    def __init__(self, pairs: np.ndarray | None = None) -> None:
        n = np.tile(PRIOR_PAIRS * PRIOR, (OTHER + 1, 1))
        n += 0 if pairs is None else pairs.reshape(n.shape)
        self.logs = np.log(n / n.sum(axis=1, keepdims=True))

    def sums(self, x: str) -> list[np.ndarray]:
        """Running log probabilities of x, as it is and with cases exchanged, from before its first character on."""
        code = _CODE[np.frombuffer(x.encode(), np.uint8)]
        return [np.r_[0.0, np.cumsum(self.logs[np.r_[OTHER, v[:-1]], v])] for v in (code, _SWAPPED[code])]


def pair_counts(text: str | None) -> np.ndarray:
    """How often each character follows each other one in a text, without runs that may be credentials."""
    b = np.frombuffer(f" {text or ''}".encode("utf-8", "surrogatepass"), np.uint8)
    code = _CODE[b]
    for s, e in zip(*runs(b, _CANDIDATE, CANDIDATE), strict=True):
        if ((b[s:e] >= 48) & (b[s:e] <= 57)).any():
            code[s:e] = OTHER
    return np.bincount(code[:-1] * (OTHER + 1) + code[1:], minlength=(OTHER + 1) ** 2)


def learned_background(docs: DataFrame, text: str = "text") -> Background:
    """The background of all texts: counts are summed in each task, and a fixed number of sums meets in the driver."""
    ship(docs.sparkSession)

    def count(batches):
        total = np.zeros((OTHER + 1) ** 2, np.int64)
        for pdf in batches:
            for t in pdf["t"]:
                total += pair_counts(t)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"pair": at, "n": total[at]})

    found = docs.select(text_of(text).alias("t")).mapInPandas(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    pairs = np.zeros((OTHER + 1) ** 2, np.int64)
    for r in found:
        pairs[r["pair"]] = r["n"]
    return Background(pairs)


@lru_cache(maxsize=4)
def automata(labelled: tuple[tuple[str, str], ...] | None = None) -> dict[str, Automaton]:
    by: dict[str, list[str]] = {}
    for kind, x in labelled or drawn_credentials():
        by.setdefault(kind, []).append(x)
    return {k: Automaton(v) for k, v in sorted(by.items())}


def credentials(x: str, models: dict[str, Automaton], background: Background, margin: float) -> list[tuple[int, int, str]]:
    """(start, end, format) of what the automata explain better than the background in a run, without overlaps."""
    behind = [k for k in range(1, len(x)) if x[k - 1] in SEPARATORS]
    usual: list[np.ndarray] = []

    def excess(a: int, b: int, score: float) -> float:
        if not usual:
            usual.extend(background.sums(x))
        return score - max(float(p[b] - p[a]) for p in usual)

    found = []
    for kind, m in models.items():
        if (score := m.score(x)) > -math.inf:
            found.append((excess(0, len(x), score), 0, len(x), kind))
        starts, passed = [0, *behind] if m.heads is None else [h.start() for h in m.heads.finditer(x)], {}
        for a in starts:
            end = m.last_end(x, a, passed, m.longest if m.shortest == m.longest else None) if len(x) - a >= m.shortest else None
            if end and end[0] - a >= m.shortest:
                found.append((excess(a, end[0], end[1] + m.stop[end[2]]), a, end[0], kind))
    taken, out = bytearray(len(x)), []
    for gain, a, b, kind in sorted(found, key=lambda f: (-f[0], f[1], f[3])):
        if gain > margin * (b - a) and taken.find(1, a, b) < 0:
            taken[a:b] = b"\1" * (b - a)
            out.append((a, b, kind))
    return sorted(out)


def runs(b: np.ndarray, member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of member bytes of at least this length."""
    edge = np.flatnonzero(np.diff(member[b].view(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    keep = ends - starts >= least
    return starts[keep], ends[keep]


def spans_of(text: str | None, models: dict[str, Automaton], background: Background, margin: float = MARGIN) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base, added): spans (start, end, kind) in code points, sorted by start, then kind as listed."""
    t = text or ""
    if len(t) < min(LEAST.values()):
        return [], []
    raw = t.encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8)
    base: list[tuple[int, int, str]] = []
    if "=" in t or ":" in t:
        low = t.lower()
        if "passw" in low or "secret" in low or "token" in low or "key" in low:
            base += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in t:
        base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(t) if m.end() - m.start() >= LEAST["access"]]
    point = (lambda k: k) if len(raw) == len(t) else (np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])).__getitem__
    base += [(int(point(s)), int(point(e)), "hex") for s, e in zip(*runs(b, _HEX, LEAST["hex"]), strict=True)]
    base.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    added = []
    for s, e in zip(*runs(b, _CANDIDATE, CANDIDATE), strict=True):
        x = raw[s:e].decode()
        core = x.strip("./=-+")  # punctuation around it is not part of it
        if len(core) < CANDIDATE:
            continue
        first = int(point(s)) + x.index(core)
        for start, end, kind in credentials(core, models, background, margin):
            if not any(p <= first + start and first + end <= q for p, q, _ in base):
                added.append((first + start, first + end, kind))
    return base, added


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_secrets(docs: DataFrame, text: str = "text", labelled: list[tuple[str, str]] | None = None, margin: float = MARGIN, background: Background | None = None) -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256, spans (text) and found (array of kind, start, end). background: learned from docs unless given."""
    ship(docs.sparkSession)
    usual = background or learned_background(docs, text)
    models = automata(tuple(map(tuple, labelled)) if labelled else None)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base, added = spans_of(t, models, usual, margin)
            kinds = [k for _, _, k in base]
            every = sorted(base + added, key=lambda x: (x[0], KINDS.index(x[2]) if x[2] in KINDS else len(KINDS), x[2]))
            rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    keep = [c for c in docs.columns if c not in (*names, "found")]
    own = unused(docs, "scan")
    out = docs.withColumn(own, scan(text_of(text))).select(*keep, *[F.col(f"{own}.{n}").alias(n) for n in names])
    parts = F.filter(F.split("spans", ","), lambda p: p != "")
    each = lambda p: F.struct(F.split_part(p, F.lit(":"), F.lit(1)).alias("kind"), F.split_part(p, F.lit(":"), F.lit(2)).cast("int").alias("start"), F.split_part(p, F.lit(":"), F.lit(3)).cast("int").alias("end"))
    return out.withColumn("found", F.transform(parts, each))
