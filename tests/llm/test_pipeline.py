"""The pipeline against the same stages in plain Python, on a small corpus."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from docloom.llm import pieces, quality, similar
from docloom.llm.queries import vocabulary

from .conftest import lower
from .test_operators import plain_contamination, plain_fingerprint


def plain_near(texts):
    """find(i) of near copies, and how many similar pairs differ in more than two bits."""
    words = [lower(t).split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in words]
    prints = [plain_fingerprint(t, 5) for t in texts]
    root = list(range(len(texts)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    far = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            near = len(a & b) >= 0.8 * len(a | b)
            bits = (prints[i] ^ prints[j]).bit_count()
            far += near and bits > 2
            if near or bits <= 2:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return find, far


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    home = str(tmp_path_factory.mktemp("corpus"))
    rng = np.random.default_rng(8)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "rt", "l")]
    text = lambda n=80: " ".join(rng.choice(words, n)) + "."
    docs = [(i, text()) for i in range(300)]
    labels = [(i, 1) for i in range(0, 300, 2)]
    for i in range(300, 400):
        docs.append((i, " ".join(w + "$$$" for w in text().split())))
        labels.append((i, 0))
    item = text(20)
    docs += [(400, docs[3][1].upper()), (401, docs[3][1]), (402, docs[5][1] + " extra"), (403, f"{text()} {item} {text()}"), (404, None), (405, ""), (405, ""), (406, docs[7][1]), (406, text())]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], schema).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    return home, docs, [(1, item)]


def test_pipeline_equals_plain_stages(spark, corpus):
    home, docs, items = corpus
    model = quality.train(spark.read.parquet(f"{home}/documents.parquet"), spark.read.parquet(f"{home}/labels.parquet"))
    x = np.array([quality.features(t) for _, t in docs])
    kept = [d for d, s in zip(docs, model.scores(x), strict=True) if s >= quality.THRESHOLD]
    assert len(kept) < len(docs) - 90
    best = {}
    for i, t in kept:
        best[lower(t)] = max(best.get(lower(t), i), i)
    kept = list(dict.fromkeys((i, lower(t)) for i, t in kept if best[lower(t)] == i))
    kept.sort()
    find, _ = plain_near([t for _, t in kept])
    kept = [d for k, d in enumerate(kept) if find(k) == k]
    hit = {k[0] for k in plain_contamination(kept, items) if k[5]}
    want = sorted(i for i, t in kept if i not in hit)
    got = corpus_pipeline.run(spark, home).collect()
    assert sorted(r.doc_id for r in got) == want
    coder = pieces.coder(vocabulary("piece_bpe_32k.model"))
    texts = {}
    for i, t in docs:
        texts.setdefault(i, []).append(t or "")
    for r in got:
        assert r.lossless and r.n_pieces == len(r.piece_ids) and coder.decode(r.piece_ids) in texts[r.doc_id]
        assert hashlib.sha256(np.array(r.piece_ids, "<i4").tobytes()).hexdigest() == r.pieces_sha256


def test_stages_keep_columns_and_take_empty_tables(spark, corpus):
    home, _, _ = corpus
    docs = spark.read.parquet(f"{home}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.where("false"), home)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), home).count() == 0


def test_stages_keep_columns_of_any_name_and_odd_rows(spark, corpus):
    home, _, _ = corpus
    names = ["predicted", "score", "_score", "sha", "_sha", "doc_id_", "mark", "text_sha256"]
    rows = [(1, None), (2, ""), (3, "bina dortu " * 20000), (3, "bina dortu " * 20000), (4, "Bina Dortu " * 20000), (5, "gela"), (5, "gela")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, *["own"] * len(names)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, home)
        assert out.columns == docs.columns
        assert all(r[n] == "own" for r in out.collect() for n in names)
    kept = corpus_pipeline.keep_one_exact(spark, docs, home).collect()
    assert sorted(r.doc_id for r in kept) == [2, 4, 5]  # of equal texts the largest id, of repeats one
    assert corpus_pipeline.keep_quality(spark, docs, home).columns == docs.columns


def test_near_copies_beyond_two_bits_are_one_group(spark):
    rng = np.random.default_rng(3)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "rt", "l")]
    line = " ".join(rng.choice(words, 12))
    docs = []
    for k in range(60):
        w = list(rng.choice(words, int(rng.integers(3, 90))))
        docs += [w, w[:30] + line.split() + w[30:]]
        for n in (1, 2, 3):
            other = list(w)
            for at in rng.integers(0, len(w), n):
                other[at] = f"x{k}"
            docs.append(other)
    find, far = plain_near([" ".join(w) for w in docs])
    assert far > 20
    table = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.keep_one_near(spark, table, "").collect()
    assert sorted(r.doc_id for r in got) == [i for i in range(len(docs)) if find(i) == i]


def test_pairs_of_a_large_group_stay_in_proportion(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "rt", "l")]
    base, docs = list(rng.choice(words, 150)), []
    for k in range(400):  # copies of one text with 0 to 9 words changed
        w = list(base)
        for n, at in enumerate(rng.integers(0, len(w), k % 10)):
            w[at] = f"x{k}y{n}"
        docs.append(" ".join(w))
    find, _ = plain_near(docs)
    table = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long")
    pairs, cut = [], similar.cut

    def counted(df):
        out = cut(df)
        pairs.append(out.count() if out.columns == ["u", "v"] else 0)
        return out

    monkeypatch.setattr(similar, "cut", counted)
    got = corpus_pipeline.keep_one_near(spark, table, "").collect()
    assert sorted(r.doc_id for r in got) == [i for i in range(len(docs)) if find(i) == i]
    assert len(got) > 20 and 300 < sum(pairs) < 5 * len(docs)
