"""Sets with too many shingles of their own go before sets are compared."""

import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm import jaccard as J

from .test_text_operators import component_brute


def test_passing_likeness_makes_no_candidates(spark, monkeypatch):
    """An order that tells nothing, as counts do in a large corpus: texts that share a few words with others chain up, but none is a candidate."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8))
    shared = [[word() for _ in range(6)] for _ in range(200)]
    texts = [[w for i in range(20) for w in ([*rng.choice(shared)] if i % 4 == 0 else [word() for _ in range(6)])] for _ in range(200)]
    texts += [[*t[:-1], "changed"] for t in texts[:5]]
    texts += texts[10:15]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    looked_at, bitmap = [], J._bitmap
    monkeypatch.setattr(J, "_bitmap", lambda ids: (looked_at.append(ids.count()), bitmap(ids))[1])
    monkeypatch.setattr(J, "_order_of", lambda counts: np.zeros(1 << J.COUNT_BITS, np.uint16))
    got = J.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), words=4, num=85, den=100).collect()
    assert sorted(map(tuple, got)) == component_brute(rows, 4, 85, 100)
    assert looked_at[-1] == 10


@given(st.lists(st.lists(st.integers(0, 40), max_size=30), min_size=1, max_size=6), st.integers(0, 10**6))
@settings(max_examples=100, deadline=None)
def test_shingles_held_alone(blocks, seed):
    """By blocks of texts: what several texts hold, of one block or of two, is never held alone."""
    pool = J.mix(np.arange(1, 42).astype(np.uint64) + np.uint64(seed * 100))
    sets = [[np.unique(pool[x : x + 1 + seed % 5]) for x in block] for block in blocks]
    holders = Counter(s for block in sets for one in block for s in one.tolist())
    entries = [J.told(np.concatenate([J.counted_shingles(s, np.full(len(s), at)) for at, s in enumerate(block)] or [pool[:0]])) for block in sets]
    alone = np.split(J.held_alone(np.concatenate(entries)), np.cumsum([len(e) for e in entries])[:-1])
    for block, e, a in zip(sets, entries, alone, strict=True):
        found = Counter((e[a] & np.uint64(J.BLOCK_TEXTS - 1)).tolist())
        assert found == Counter(at for at, one in enumerate(block) for s in one.tolist() if s % 2 == 0 and holders[s] == 1)
