"""Toxicity by weighted finite-state patterns over clauses.

Method: words are mapped to classes, insults and threats also by learned stems.
Five transducers over the classes are composed into one deterministic automaton
that is run over each clause:

    insult    emits an insult, and if an intensifier or insult stands before it
    threat    emits a threat, and if somebody's intent leads to it ("I will ... kill");
              verbs that are harmless alone count only then, and if aimed
    target    emits whom a clause aims at, for REACH words
    negation  emits the scope of a negation, for REACH words
    report    emits reported speech, to the end of the clause

A match is an insult or threat with what the others emit there: plain, aimed,
strengthened, negated, reported. Each clause sums the weights of its matches by
context; a document's score is the logistic of a weighting of these sums.
Unmatched words have no say.

Word weights and the weighting of contexts are learned from at most SAMPLE
labelled rows outside the held-out fold; contexts that the labels hardly show
keep the weights of PRIOR. A row counts for word weights by one over the rows of
its label that share its least shingle, so that a text copied often lends no
weight to its rare words.

Cases: null and empty texts match nothing and get the score of no match; texts
of any length are read whole; a score equal to the threshold predicts 1;
repeated rows get repeated scores; rows with null labels are not learned from;
with no labelled rows the lists below stand alone; an empty table gives an empty
result; other columns pass through, but for those of the result's names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_of
from .quality import labelled_sample

#: Most labelled rows that the model is fitted on.
SAMPLE = 20_000
THRESHOLD = 0.5
WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+")
INSULT, THREAT, VERB, TARGET, NEGATION, REPORT, SUBJECT, INTENT, INTENSE, OTHER = CLASSES = range(10)
#: Starting word lists; insults are extended from the labels.
LISTS = {
    INSULT: "idiot moron loser scum trash stupid pathetic worthless disgusting clown imbecile fool filth vermin dumb jerk",
    THREAT: "kill hurt destroy beat murder stab shoot punish töten umbringen matar tuer",
    VERB: "find get burn break cut crush end ruin finden brechen trouver brûler encontrar quemar",
    TARGET: "you your yours yourself he him his she her they them their du dich dein sie ihr tu te ton ta tes vous tú ti usted ustedes",
    NEGATION: "not no never neither nor without isn aren wasn don doesn didn nobody nicht kein keine nie pas jamais ni nunca jamás",
    REPORT: "said says say saying wrote writes quoted quotes called claimed reported alleged sagte schrieb dit écrit dijo escribió",
    SUBJECT: "i we ich wir je nous yo nosotros",
    INTENT: "will ll shall gonna going want werde werden will vais allons voy vamos",
    INTENSE: "so such very really total complete absolute utter fucking damn sehr völlig très si muy",
}
REACH = 3
#: Support and log odds that a learned word or stem needs, and the lengths of stems.
SUPPORT, WEIGHT, STEMS = 5, 3.0, (4, 5, 6, 7, 8)
#: Distinct words that a worker remembers the classes of.
MEMORY = 500_000


class Transducer:
    """A deterministic transducer over word classes: step(state, class) -> (state, emitted bits of `width`)."""

    def __init__(self, start, step, width: int = 1):
        self.start, self.step, self.width = start, step, width


def within(kind: int) -> Transducer:
    """Emits 1 while a word of this kind lies at most REACH words back."""
    return Transducer(0, lambda left, c: (REACH, 1) if c == kind else (max(0, left - 1), int(left > 0)))


def since(kind: int) -> Transducer:
    """Emits 1 from a word of this kind to the end of the clause."""
    return Transducer(0, lambda on, c: (int(on or c == kind),) * 2)


def insult_step(near: int, c: int) -> tuple[int, int]:
    """State: an intensifier or insult stands just before. Emits 1 at an insult, 3 if it is strengthened so."""
    return int(c in (INSULT, INTENSE)), (1 + 2 * near if c == INSULT else 0)


def threat_step(s: int, c: int) -> tuple[int, int]:
    """State: 0, 1 to REACH words after a subject, or up to REACH after its intent. Emits 1 at a threat, 3 if intended, 2 at a verb that is intended."""
    intended = s > REACH
    out = (3 if intended else 1) if c == THREAT else (2 if intended and c == VERB else 0)
    if c == SUBJECT:
        return REACH, out
    if c == INTENT and 0 < s:
        return 2 * REACH, out
    return (0 if s in (0, REACH + 1) else s - 1), out


def compose(*parts: Transducer) -> list[list[tuple[int, int]]]:
    """One automaton that runs all parts at once: table[state][class] = (state, emitted bits side by side)."""
    states, table, k = {tuple(p.start for p in parts): 0}, [], 0
    todo = list(states)
    while k < len(todo):
        row = []
        for c in CLASSES:
            moved = [p.step(s, c) for p, s in zip(parts, todo[k], strict=True)]
            to, bits, at = tuple(m[0] for m in moved), 0, 0
            for p, m in zip(parts, moved, strict=True):
                bits |= m[1] << at
                at += p.width
            if to not in states:
                states[to] = len(todo)
                todo.append(to)
            row.append((states[to], bits))
        table.append(row)
        k += 1
    return table


PARTS = (Transducer(0, insult_step, 2), Transducer(0, threat_step, 2), within(TARGET), within(NEGATION), since(REPORT))
GRAMMAR = compose(*PARTS)
IS_INSULT, STRONG, IS_THREAT, INTENDED, AIMED, NEGATED, REPORTED = (1 << k for k in range(7))
#: What a clause's matches are summed by, and the whole document's asserted clauses: number, heaviest, share of all clauses.
FEATURES = ["plain", "aimed", "strengthened", "negated", "reported", "threat", "vague threat", "clauses", "heaviest", "share"]
PRIOR = np.array([1.0, 2.0, 0.5, 0.2, 0.1, 4.0, 0.7, 0.3, 1.0, 0.5])
BIAS, RIDGE = -4.5, 0.1


@dataclass
class Lexicon:
    kinds: dict[str, int] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    @classmethod
    def base(cls) -> Lexicon:
        kinds = {w: k for k, ws in LISTS.items() for w in ws.split()}
        return cls(kinds, {w: WEIGHT for w, k in kinds.items() if k in (INSULT, THREAT, VERB)})

    def __post_init__(self):
        self.known: dict[str, tuple[int, float]] = {}

    def __getstate__(self):
        return self.kinds, self.weights, self.stems

    def __setstate__(self, state):
        self.kinds, self.weights, self.stems = state
        self.known = {}

    def of(self, word: str) -> tuple[int, float]:
        """Class and weight of a word; of stems the longest decides."""
        found = self.known.get(word)
        if found is None:
            kind = self.kinds.get(word)
            if kind is not None:
                found = kind, self.weights.get(word, 0.0)
            else:
                w = next((self.stems[word[:n]] for n in reversed(STEMS) if word[:n] in self.stems and len(word) >= n), None)
                found = (OTHER, 0.0) if w is None else (INSULT, w)
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[word] = found
        return found


def clause_sums(seen: list[tuple[int, float]]) -> list[float]:
    """Weights of a clause's matches: plain, aimed, strengthened, negated, reported, threat, vague threat."""
    out, ahead, s = [0.0] * 7, [0] * len(seen), 0
    for k in range(len(seen) - 1, -1, -1):  # a target after the word counts as well
        s, bits = GRAMMAR[s][seen[k][0]]
        ahead[k] = bits & AIMED
    s = 0
    for k, (c, w) in enumerate(seen):
        s, bits = GRAMMAR[s][c]
        bits |= ahead[k]
        threat = bits & (IS_THREAT | INTENDED)
        if not bits & IS_INSULT and not (threat and bits & AIMED):
            continue
        if bits & REPORTED:
            out[4] += w
        elif bits & NEGATED:
            out[3] += w
        elif threat:
            out[5 if bits & INTENDED else 6] += w
        else:
            out[1 if bits & AIMED else 0] += w
            if bits & STRONG:
                out[2] += w
    return out


def matches(text: str | None, lex: Lexicon) -> list[float]:
    """Features of a text's matched clauses."""
    sums, clauses, heaviest, every, of = [0.0] * 7, 0, 0.0, 0, lex.of
    for clause in CLAUSE.split((text or "").lower()):
        seen = [of(w) for w in WORD.findall(clause)]
        every += bool(seen)
        if not any(w for _, w in seen):
            continue
        own = clause_sums(seen)
        sums = [a + b for a, b in zip(sums, own, strict=True)]
        asserted = own[0] + own[1] + own[5] + own[6]
        clauses += asserted > 0
        heaviest = max(heaviest, asserted)
    return [*np.log1p(sums).tolist(), float(np.log1p(clauses)), float(np.log1p(heaviest)), clauses / max(1, every)]


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    bias: float
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        z = self.bias + float(np.dot(self.weights, matches(text, self.lexicon)))
        return float(1.0 / (1.0 + np.exp(-z)))


def profile(text: str | None) -> tuple[list[str], int]:
    """A text's distinct words, and the least hash of its runs of three words by which near copies are known."""
    words = WORD.findall((text or "").lower())
    runs = [" ".join(r) for r in zip(words, words[1:], words[2:], strict=False)] or [" ".join(words)]
    return sorted(set(words)), min(xxhash.xxh64_intdigest(r) for r in runs) >> 1


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, ridge: float = RIDGE, steps: int = 50) -> tuple[float, np.ndarray]:
    """Logistic regression by Newton steps, drawn to the prior as much by any number of rows. Weights do not fall below zero."""
    a = np.hstack([np.ones((len(x), 1)), x])
    m = np.r_[BIAS, prior]
    w, pen = m.copy(), np.diag(np.r_[ridge, np.full(x.shape[1], ridge)]) * len(x) / 1000
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + pen, a.T @ (y - p) - pen @ (w - m))
        w += np.clip(step, -2, 2)
        w[1:] = np.maximum(w[1:], 0.0)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), w[1:]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> ToxicityModel:
    """Two passes over the bounded sample: words and stems, then contexts. Texts stay on the executors."""
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, most)
    lex = Lexicon.base()

    def words(batches):
        for pdf in batches:
            got = [profile(t) for t in pdf["text"]]
            yield pd.DataFrame({"y": pdf["y"], "mark": [g[1] for g in got], "words": [g[0] for g in got]})

    rows = sample.mapInPandas(words, "y int, mark long, words array<string>")
    same = rows.groupBy("y", "mark").agg(F.count("*").alias("same"))
    weighed = rows.join(same, ["y", "mark"]).select("y", (1 / F.col("same")).alias("one"), "words")
    n = dict(weighed.groupBy("y").agg(F.round(F.sum("one"), 6)).collect())
    starts = F.array(F.concat("w", F.lit("$")), *[F.when(F.length("w") >= k, F.substring("w", 1, k)) for k in STEMS])
    each = weighed.select("y", "one", F.explode("words").alias("w")).select("y", "one", "w", F.explode(F.array_compact(starts)).alias("s"))
    per_word = each.groupBy("s", "w").agg(F.sum(F.when(F.col("y") == 1, F.col("one"))).alias("c"), F.sum(F.when(F.col("y") == 0, F.col("one"))).alias("o"))
    per_stem = per_word.groupBy("s").agg(F.round(F.sum("c"), 6).alias("c"), F.round(F.sum("o"), 6).alias("other"), F.round(F.max("c"), 6).alias("best"))
    often = per_stem.where(F.col("c") >= max(SUPPORT, 0.01 * n.get(1, 0))).collect()  # at most the words of bounded rows
    lex = add_words(lex, [(r.s, r.c, r.other or 0.0, r.best) for r in often], n)

    def shapes(batches):
        for pdf in batches:
            yield pd.DataFrame({"y": pdf["y"], "x": [matches(t, lex) for t in pdf["text"]]})

    found = sample.mapInPandas(shapes, "y int, x array<double>").toPandas()
    if found["y"].nunique() < 2:
        return ToxicityModel(lex, BIAS, PRIOR)
    found = found.assign(x=found["x"].map(tuple)).sort_values(["y", "x"], kind="stable")
    x = np.array(found["x"].tolist(), dtype=float).reshape(len(found), len(FEATURES))
    return ToxicityModel(lex, *logistic(x, found["y"].to_numpy(dtype=float)))


def add_words(lex: Lexicon, often, n: dict[int, float]) -> Lexicon:
    """Extend the lists by words and stems far commoner under label 1, with their log odds as weight.

    often: (stem or word with $, weighed rows of label 1, of label 0, most of label 1 with one of its words).
    A stem must not live from one word alone.
    """
    out = Lexicon(dict(lex.kinds), dict(lex.weights), {})
    if not n.get(0) or not n.get(1):
        return out
    for s, c, other, best in sorted(often):
        odds = float(np.log((c + 0.5) / (n[1] + 1)) - np.log((other + 0.5) / (n[0] + 1)))
        if odds < WEIGHT:
            continue
        if not s.endswith("$"):
            if best <= 0.6 * c:
                out.stems[s] = odds
        elif out.kinds.get(s[:-1], OTHER) in (OTHER, INSULT, THREAT):
            out.kinds.setdefault(s[:-1], INSULT)
            out.weights[s[:-1]] = odds
    return out


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD, into: str = "score") -> DataFrame:
    """docs with `into` (double, 0 to 1) and predicted (1 from threshold on)."""
    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    keep = [c for c in docs.columns if c not in (into, "predicted")]
    return docs.select(*keep, score(text_of(text)).alias(into)).withColumn("predicted", (F.col(into) >= threshold).cast("int"))
