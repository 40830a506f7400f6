"""The language models of the quality rules: what they catch, and that nothing they count is lost."""

import math
import os

import pytest

from gleanery.llm import quality as Q

from .test_corpus_operators import kn_brute


def test_words_with_junk_behind_them_go(spark):
    """Junk that is common enough for the character model to learn it; labels tell good from bad."""
    path = "/root/testdata/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("the driver's tables are not here")
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    symbols = r"text RLIKE '(?s)([#]{3}|%%%|[$]{3}|&&&|[*]{3})(\\s.*){20}'"
    rows = Q.judge(docs).where("NOT base_failed").join(labels, "doc_id").join(docs.select("doc_id", "text"), "doc_id").selectExpr("kept", "quality", f"{symbols} AS symbols").collect()
    junk, good = [r.kept for r in rows if r.symbols and not r.quality], [r.kept for r in rows if r.quality]
    assert len(junk) >= 5 and sum(junk) <= 0.1 * len(junk)
    assert sum(good) >= 0.98 * len(good)


def test_words_and_runs_cost_the_same_wherever_they_are_looked_up(spark, docs, odd):
    for frame in (docs, odd):
        rows = lambda common: sorted(map(repr, Q.judge(frame, common=common, common_runs=common).collect()))  # noqa: B023, E731
        assert rows(1) == rows(200) == rows(1 << 40)


def test_word_costs_are_of_all_words(spark):
    texts = ["a b a", "a c", "d d a"]
    costs, common = Q.word_costs(spark.createDataFrame([(t, "en") for t in texts], "text string, lang string"), common=1 << 40)
    assert costs.count() == 0 and len(common["=en"][0]) == 4
    costs, common = Q.word_costs(spark.createDataFrame([(t, "en") for t in texts], "text string, lang string"), common=3)
    assert costs.count() == 3 and len(common["=en"][0]) == 1


def test_every_counted_run_is_in_the_model(spark):
    """A language that is rare in the corpus keeps its rarest runs, with the costs of a plain model of its own."""
    main, rare = ["abracadabra abra", "cadabra bar", "a bar abba"] * 400 + ["zebra"], ["éa éb", "éa ùzz"]
    docs = spark.createDataFrame([(t, "en") for t in main] + [(t, "fr") for t in rare], "text string, lang string")
    costs, sent = Q.run_costs(docs, common=100)
    got = {(r.l, r.key): r.cost for r in costs.collect()}
    assert got and not {(lang, k) for lang in sent for k in sent[lang][0].tolist()} & set(got)
    got |= {(lang, k): c for lang, (keys, prices) in sent.items() for k, c in zip(keys.tolist(), prices.tolist())}
    for lang, texts in (("=en", main), ("=fr", rare)):
        own, seen = kn_brute(texts), set()
        for t in set(texts):
            keys, s = Q.run_keys([t])[0].tolist(), chr(Q.START) * 3 + t
            for i, k in enumerate(keys):
                assert abs(got[lang, k] + math.log(own(s[i : i + 4])) * Q.UNITS) <= 1
                seen.add(k)
        assert seen == {k for l, k in got if l == lang}
