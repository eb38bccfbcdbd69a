"""Near-duplicates by similarity against all pairs."""

import random

import corpus_pipeline
import pytest

from tidemill.llm import similar
from tests.llm.conftest import DOCS


def brute_kept(texts):
    """The least id of each component of the pairs with five-word similarity of at least 0.8."""
    sets = {}
    for i, t in texts.items():
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted({find(i) for i in texts})


@pytest.mark.parametrize("hot", [similar.HOT, 6])
def test_near_copies_go(spark, hot):
    r = random.Random(3)
    texts = {}
    for _ in range(12):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randint(60, 200))]
        for _ in range(10):
            copy = list(words)
            for _ in range(r.randint(0, len(words) // 40)):
                copy[r.randrange(len(copy))] = "changed"
            texts[len(texts)] = " ".join(copy)
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in texts.items()], DOCS)
    wanted = brute_kept(texts)
    assert len(wanted) < 60
    assert sorted(r.doc_id for r in similar.keep_one(docs, hot=hot).collect()) == wanted
    assert sorted(r.doc_id for r in similar.keep_one(docs, hot_bytes=9000).collect()) == wanted
    if hot == similar.HOT:
        assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, "").collect()) == wanted


def test_pairs_at_the_limit_share_a_block():
    """Of pairs with a similarity of 0.8 to 0.82, hardly one shares no block or is told apart by SimHash."""
    import numpy as np

    r, lost = np.random.default_rng(2), 0
    for _ in range(1500):
        both = r.choice(2**32, 500, replace=False).astype(np.uint32)
        a, b = np.sort(both[:450]), np.sort(both[50:])
        assert similar.similar(a, b)
        far = (similar.majority(similar._stirred(a.astype(np.uint64))) ^ similar.majority(similar._stirred(b.astype(np.uint64)))).bit_count() > similar.FAR
        lost += far or not (similar.blocks(a) == similar.blocks(b)).any()
    assert lost <= 2


def test_odd_texts(spark):
    rows = [(3, None), (1, ""), (2, " \t"), (4, "a b"), (5, "A  b"), (6, "a b c"), (None, "a b c"), (7, "a b c")]
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], DOCS).selectExpr("*", "1 AS fp", "2 AS keys", "3 AS row", "4 AS kept", "5 AS key", "6 AS sim")
    found = similar.keep_one(docs)
    assert found.columns == docs.columns
    assert sorted(r.doc_id for r in found.collect()) == [1, 4, 6]
    assert similar.keep_one(docs.where("doc_id < 0")).count() == 0
