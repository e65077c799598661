"""The packed, partitioned model against a dictionary of counts."""

import random
from collections import Counter
from math import log10

import pytest
from pyspark.sql import functions as F

from strandline.llm import katz
from strandline.llm.common import WORD, ascii_lower


def brute(docs, train):
    tok = [WORD.findall(ascii_lower(t or "")) + [None] for t in docs]
    uni, big = Counter(), Counter()
    for t, w in zip(tok, train):
        if w:
            uni.update(t)
            big.update(zip([None] + t[:-1], t))
    n, v = sum(uni.values()), len(uni)

    def of(counts):
        import numpy as np

        c = np.zeros(katz.K + 3)
        for x in counts.values():
            c[min(x, katz.K + 2)] += 1
        return katz.discounts(c)

    d1, d2 = of(uni), of(big)
    k = katz.K
    star = lambda r, d: r * d[r] if r <= k else r - katz.LEAST
    unknown = sum(c - star(c, d1) for c in uni.values()) / n if n else 1.0
    p1 = lambda w: star(uni[w], d1) / n if uni[w] else unknown
    after = {}
    for a, b in big:
        after.setdefault(a, []).append(b)

    def p2(w, a):
        r = big[a, w]
        if r:
            return star(r, d2) / uni[a]
        if not uni[a]:
            return p1(w)
        return alpha(a) * p1(w)

    def alpha(a):
        return (1 - sum(star(big[a, b], d2) for b in after[a]) / uni[a]) / (1 - sum(p1(b) for b in after[a]))

    out = []
    for t in tok:
        score = sum(log10(p2(b, a)) for a, b in zip([None] + t[:-1], t))
        base = sum(log10((uni[w] + 1) / (n + v + 1)) for w in t)
        out.append((len(t), sum(uni[w] > 0 for w in t), n, base, score))
    words = list(uni) + ["\x00unseen"]
    sums = [sum(p2(w, a) for w in words) for a in after]
    return out, sums


@pytest.mark.parametrize("hot", [0, 3, 1023])
def test_against_brute_force(spark, monkeypatch, hot):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    texts = [" ".join(vocab[int(rnd.paretovariate(0.7)) % 60] for _ in range(rnd.randint(0, 40))) for _ in range(120)]
    texts[3], texts[4], texts[5] = None, "", "Never Met Before"
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(7, texts[7], "x"), (None, "w1 w2", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    real = katz.frequent_words
    monkeypatch.setattr(katz, "frequent_words", lambda d: real(d)[:hot])
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 300)
    held = F.coalesce(F.col("doc_id") % 3 == 1, F.lit(False))
    got = katz.train_and_score(df, held).collect()
    want, sums = brute([r[1] for r in rows], [not (r[0] is not None and r[0] % 3 == 1) for r in rows])
    assert sums and all(abs(s - 1) < 1e-9 for s in sums)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted([(r[0], *w) for r, w in zip(rows, want)], key=key)
    got = sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:4] == w[:4]
        assert g[4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("texts", [["a b"] * 50 + ["a c", "b"], ["a b a b a b"] * 9, ["x"], ["a b c d e f g"], [None, ""], ["word " * 30_000 + "end", "end word"]])
def test_contexts_of_frequent_pairs_sum_to_one(spark, texts):
    """Where every pair of a context is frequent, or every count is 1, it frees something too."""
    got = katz.train_and_score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.col("doc_id") == len(texts) - 1).collect()
    want, sums = brute(texts, [i < len(texts) - 1 for i in range(len(texts))])
    assert all(abs(s - 1) < 1e-9 for s in sums)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id][3:], rel=1e-9)
    assert all(r.score > -12 * r.n_tokens for r in got)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert katz.train_and_score(df, F.lit(False)).count() == 0
