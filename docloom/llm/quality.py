"""Quality classifier: a generalised additive model with pairwise interactions.

Method: per-feature lookup tables are learned by cyclic boosting. Each round
visits every feature in turn and adds a shallow tree over that feature's bins
to its table; then the strongest pairs of features get tables of their own in
the same way. A score is the sigmoid of the sum of the table entries of a
document's bins, computed by vectorised additions.

Inputs are counts of the text's bytes and words alone. The model is fitted on
at most SAMPLE labelled rows outside the held-out fold, chosen by a hash of
doc_id; everything else (features, scores) covers whole texts of all rows.

Cases: null and empty texts get the score of an all-zero feature row; texts of
any length are read whole; repeated rows get repeated scores; rows with null
labels are not learned from; with no labelled rows, or labels of one value, the
score is the smoothed share of label 1; an empty table gives an empty result;
other columns pass through, but for those of the result's names; a score equal
to the threshold predicts 1.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, ship, text_of

#: Most labelled rows that the model is fitted on.
SAMPLE = 20_000
MARKS = b"#$%&*!|.,;:?-<>{}()[]=@/_\\+^~\"'"
THRESHOLD = 0.3


def features(text: str | None) -> list[float]:
    """What the model sees of a text: shares of kinds of bytes and of repeated words, and sizes."""
    b = (text or "").encode("utf-8", "surrogatepass")
    if not b:
        return [0.0] * len(NAMES)
    n = len(b)
    c = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
    w = b.split()
    k = max(1, len(w))
    lines = b.split(b"\n")
    share = lambda x: float(x) / n
    return [
        float(np.log1p(n)),
        float(np.log1p(len(w))),
        share(c[65:91].sum()),
        share(c[97:123].sum()),
        share(c[48:58].sum()),
        share(c[9:14].sum() + c[32]),
        share(c[128:].sum()),
        share(c[:9].sum() + c[14:32].sum() + c[127]),
        n / k,
        len(set(w)) / k,
        sum(map(eq, w, w[1:])) / k,
        len(set(zip(w[::3], w[1::3], w[2::3], strict=False))) / max(1, len(w) // 3),
        len(set(lines)) / len(lines),
        len(lines) / k,
        *(c[list(MARKS)] / n).tolist(),
    ]


NAMES = ["log_bytes", "log_words", "upper", "lower", "digit", "space", "non_ascii", "control", "word_bytes", "distinct_words", "doubled_words", "distinct_triples", "distinct_lines", "lines_per_word", *(chr(m) for m in MARKS)]


@dataclass
class AdditiveModel:
    """bias, a table for each feature, and a table for each chosen pair."""

    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for f, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(e, x[:, f], side="right")]
        for a, b, t in self.pairs:
            total += t[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1.0 / (1.0 + np.exp(-total))


def cut_points(v: np.ndarray, bins: int) -> np.ndarray:
    u = np.unique(v)
    if len(u) <= bins:
        return (u[1:] + u[:-1]) / 2
    return np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))


def best_cut(g: np.ndarray, h: np.ndarray, least: float, ridge: float) -> tuple[float, int]:
    """(gain, bins left of the cut) of the best cut of a row of bins."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain[(hl < least) | (hr < least)] = 0
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, least: float, ridge: float, leaves: int = 3) -> np.ndarray:
    """Leaf values spread over the bins."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(*best_cut(g[a:b], h[a:b], least, ridge), p) for p, (a, b) in enumerate(parts)]
        gain, k, p = max(cuts)
        if gain <= 0:
            break
        a, b = parts[p]
        parts[p : p + 1] = [(a, a + k), (a + k, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, least: float, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut of both axes of a grid: (gain, leaf values spread over the grid)."""
    gc, hc = (np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for m in (g, h))
    i, j = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    if not i.size or not j.size:
        return 0.0, np.zeros_like(g)

    def quarters(c):
        a = c[i, j]
        return a, c[i, -1] - a, c[-1, j] - a, c[-1, -1] - c[i, -1] - c[-1, j] + a

    gs, hs = quarters(gc), quarters(hc)
    gain = sum(a**2 / (b + ridge) for a, b in zip(gs, hs, strict=True)) - gc[-1, -1] ** 2 / (hc[-1, -1] + ridge)
    at = np.unravel_index(int(gain.argmax()), gain.shape)
    v = [a[at] / (b[at] + ridge) if b[at] >= least else 0.0 for a, b in zip(gs, hs, strict=True)]
    out = np.empty_like(g)
    p, q = at[0] + 1, at[1] + 1
    out[:p, :q], out[:p, q:], out[p:, :q], out[p:, q:] = v
    return float(gain[at]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, bins: int = 64, pairs: int = 8, pair_bins: int = 8, pair_rounds: int = 40, least: float = 4.0, ridge: float = 2.0) -> AdditiveModel:
    """Fit by cyclic boosting of the log-loss; deterministic for given rows in a given order."""
    n, k = x.shape if len(x) else (0, 0)
    share = (y.sum() + 1.0) / (n + 2.0)
    m = AdditiveModel(bias=float(np.log(share / (1 - share))))
    if n == 0 or y.min() == y.max():
        return m
    m.edges = [cut_points(x[:, f], bins) for f in range(k)]
    m.coarse = [cut_points(x[:, f], pair_bins) for f in range(k)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    at = [np.searchsorted(m.edges[f], x[:, f], side="right") for f in range(k)]
    logit = np.full(n, m.bias)
    slopes = lambda: (y - (p := 1 / (1 + np.exp(-logit))), p * (1 - p))
    for _ in range(rounds):
        for f in range(k):
            size = len(m.tables[f])
            if size < 2:
                continue
            g, h = (np.bincount(at[f], weights=v, minlength=size) for v in slopes())
            step = rate * shallow_tree(g, h, least, ridge)
            m.tables[f] += step
            logit += step[at[f]]
    two = [np.searchsorted(m.coarse[f], x[:, f], side="right") for f in range(k)]
    size = [len(m.coarse[f]) + 1 for f in range(k)]
    grid = lambda a, b, v: np.bincount(two[a] * size[b] + two[b], weights=v, minlength=size[a] * size[b]).reshape(size[a], size[b])
    g, h = slopes()
    ranked = sorted(((pair_tree(grid(a, b, g), grid(a, b, h), least, ridge)[0], a, b) for a in range(k) for b in range(a + 1, k) if size[a] > 1 and size[b] > 1), key=lambda r: (-r[0], r[1:]))
    m.pairs = [(a, b, np.zeros((size[a], size[b]))) for _, a, b in ranked[:pairs]]
    for _ in range(pair_rounds):
        for a, b, t in m.pairs:
            g, h = slopes()
            step = rate * pair_tree(grid(a, b, g), grid(a, b, h), least, ridge)[1]
            t += step
            logit += step[two[a], two[b]]
    return m


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y): at most `most` labelled rows outside the held-out fold, by hash of doc_id.

    The ids are a bounded list, so they are sent to the texts, not the texts to
    them. Where ids repeat, so that there would be more rows, each text of an id
    counts once and the rows are bounded by hash of id and text.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    chosen = cut(rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most))
    found = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    if docs.select("doc_id").join(F.broadcast(chosen), "doc_id").count() <= most:
        return found
    found = found.withColumn("mark", F.xxhash64("text"))
    keys = cut(found.select("doc_id", "mark", "y").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "mark", "y").limit(most))
    return found.join(F.broadcast(keys), ["doc_id", "mark", "y"]).dropDuplicates(["doc_id", "mark", "y"]).select("doc_id", "text", "y")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, **how) -> AdditiveModel:
    """Fit on features of the bounded sample; the driver gets features of at most `most` rows."""
    ship(docs.sparkSession)

    def shapes(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "x": [features(t) for t in pdf["text"]]})

    rows = labelled_sample(docs, labels, label, most).mapInPandas(shapes, "doc_id long, y int, x array<double>").toPandas()
    rows = rows.assign(x=rows["x"].map(tuple)).sort_values(["doc_id", "y", "x"], kind="stable")
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(NAMES))
    return fit(x, rows["y"].to_numpy(dtype=float), **how)


def score_quality(docs: DataFrame, model: AdditiveModel, text: str = "text", threshold: float = THRESHOLD, into: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with `into` (double, 0 to 1) and `predicted` (1 from threshold on)."""
    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts], dtype=float).reshape(len(texts), len(NAMES))
        return pd.Series(model.scores(x))

    keep = [c for c in docs.columns if c not in (into, predicted)]
    return docs.select(*keep, score(text_of(text)).alias(into)).withColumn(predicted, (F.col(into) >= threshold).cast("int"))
