import pytest
from pyspark.sql import functions as F

from gleanery.api import Corpus, Principal, SearchRequest
from gleanery.operators.semantic import hash_embedding
from gleanery.plans.planner import QueryError
from gleanery.sources import prepare

from .test_engine import NOTES, files


@pytest.fixture(scope="module")
def corpus(spark):
    hidden = files(spark, {"secret.md": "river river river"}, "v", "hidden")
    chunks = prepare.chunks(prepare.prepare(files(spark, NOTES).unionByName(hidden))).cache()
    vectors = chunks.select("chunk_id", hash_embedding("content").alias("embedding")).where(F.size("embedding") == 32).cache()
    embed = lambda q: spark.createDataFrame([(q,)], "t string").select(hash_embedding("t").alias("v")).first().v
    return Corpus(chunks, vectors, embed)


def test_modes_stay_inside_the_resources(corpus):
    who = Principal((("v", "r"),))
    for mode in ("lexical", "semantic", "hybrid"):
        rows = corpus.search(SearchRequest("river stone", mode), who).orderBy("rank").collect()
        assert rows and "secret.md" not in {r.path for r in rows}
        assert [r.rank for r in rows] == list(range(1, len(rows) + 1))
    assert "secret.md" in {r.path for r in corpus.search(SearchRequest("river")).collect()}


def test_requests_are_checked(corpus):
    for bad in (SearchRequest(" "), SearchRequest("a", "other"), SearchRequest("a", limit=0), SearchRequest("a", limit=101), SearchRequest("a", cursor="x"), SearchRequest("a", path_prefix="/x")):
        with pytest.raises(QueryError):
            corpus.search(bad)
    with pytest.raises(QueryError):
        Corpus(corpus.chunks).search(SearchRequest("a", "semantic"))
    with pytest.raises(QueryError):
        corpus.search(SearchRequest("a", limit=50), Principal(None, 10))
