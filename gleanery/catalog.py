"""Registry of the retrieval queries and their oracle SQL.

Every query runs over whole tables. Chunks are made of ``documents`` unless a
name says otherwise; see ``tables``. Queries of the readers and of stored and
changing state are in modules of their own.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import text as X
from .operators import evaluate as E
from .operators import index as I
from .operators import manifest as M
from .operators import properties as R
from .operators import search as S
from .operators import semantic as V
from .plans import planner as P
from .registry import ORACLES, QUERIES, query
from .session import keep, table
from .sources import prepare as PR
from .sources.formats import COVERAGE, format_of
from .streaming import reconcile as ST
from .tables import document_chunks, document_sources

# SQL that the oracles share: chunks, fields, postings, lengths, statistics

C = """c AS (SELECT 'c' || lpad(doc_id::VARCHAR, 10, '0') AS chunk_id, doc_id, source AS vault_id, lang AS room,
 lang || '/' || doc_id || '.txt' AS path, split_part(text, chr(10), 1) AS heading, text AS content FROM documents)"""
FLD = """f AS (SELECT chunk_id, vault_id, room, 'content' AS field, content AS txt FROM c UNION ALL SELECT chunk_id, vault_id, room, 'heading', heading FROM c
 UNION ALL SELECT chunk_id, vault_id, room, 'filename', doc_id || '.txt' FROM c UNION ALL SELECT chunk_id, vault_id, room, 'stem', doc_id::VARCHAR FROM c
 UNION ALL SELECT chunk_id, vault_id, room, 'tags', room FROM c)"""
TOK = r"regexp_extract_all(strip_accents(lower(txt)), '[\p{L}\p{N}]+')"
OCC = f"o AS (SELECT chunk_id, vault_id, room, field, unnest(l) AS term, generate_subscripts(l, 1) - 1 AS position FROM (SELECT chunk_id, vault_id, room, field, {TOK} AS l FROM f)), o2 AS (SELECT * FROM o WHERE strlen(term) < 40)"
POST = "p AS (SELECT chunk_id, vault_id, room, field, term, count(*) AS tf FROM o2 GROUP BY ALL)"
LEN = "len AS (SELECT field, chunk_id, sum(tf) AS len FROM p GROUP BY ALL), st AS (SELECT field, count(*) AS n_docs, sum(len) AS total_len FROM len GROUP BY ALL), n AS (SELECT count(*)::DOUBLE AS n FROM c)"
DF = "df AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL)"
W = "w AS (SELECT * FROM (VALUES ('filename', 5.0), ('stem', 6.0), ('aliases', 6.0), ('title', 6.0), ('heading', 3.0), ('tags', 2.0), ('content', 1.0)) t(field, weight))"
BM = "(ln(1 + (n.n - df.df + 0.5) / (df.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (1 - 0.75 + 0.75 * len.len / (st.total_len / n.n))))"
BASE = f"WITH {C}, {FLD}, {OCC}, {POST}, {LEN}, {DF}, {W}"
SCORED = f"sc AS (SELECT p.chunk_id, p.term, max(w.weight::DOUBLE * {BM}) AS score FROM p JOIN df USING (field, term) JOIN len USING (field, chunk_id) JOIN st USING (field) JOIN w USING (field), n GROUP BY ALL)"


def _index(spark, sf_dir, resources=None) -> S.Index:
    return S.Index(document_chunks(spark, sf_dir), resources=resources)


def _content(chunks):
    return chunks.select("chunk_id", "vault_id", "room", "path", F.lit("content").alias("field"), F.col("content").alias("text"))


# Projections


@query(rf"WITH {C}, f AS (SELECT chunk_id, vault_id, room, 'content' AS field, content AS txt FROM c), {OCC} SELECT chunk_id, term, count(*)::BIGINT AS tf, min(position)::INT AS first_position FROM o2 GROUP BY ALL")
def token_postings(spark, sf_dir):
    p = I.postings(_content(document_chunks(spark, sf_dir)))
    return p.select("chunk_id", "term", "tf", F.element_at("positions", 1).alias("first_position"))


@query(f"{BASE} SELECT field, n_docs::BIGINT AS n_docs, total_len::BIGINT AS total_len FROM st")
def field_stats(spark, sf_dir):
    return I.field_stats(I.fields(document_chunks(spark, sf_dir)))


@query(f"{BASE} SELECT term, count(DISTINCT chunk_id)::BIGINT AS df, sum(tf)::BIGINT AS occurrences, max((field <> 'content')::INT)::INT AS in_metadata FROM p GROUP BY term")
def vocabulary(spark, sf_dir):
    return I.vocabulary(document_chunks(spark, sf_dir))


@query(r"""SELECT doc_id, unnest(list_distinct(list_transform(list_filter(regexp_extract_all(text, '(?i)\b(?:cve(?:-\d{4}-\d+| \d{4} \d+)|rfc(?:[- ]?\d+)|[a-z0-9][a-z0-9._/:+\-]{2,})\b'),
 lambda x: regexp_matches(x, '[0-9]') AND (regexp_matches(x, '\p{L}') OR regexp_matches(x, '[-_./:+ ]'))), lambda x: lower(x)))) AS identifier FROM documents""")
def technical_identifiers(spark, sf_dir):
    return document_chunks(spark, sf_dir).select("doc_id", F.explode(X.identifiers(F.col("content"))).alias("identifier"))


@query("SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$') AS filename, regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS stem FROM pages")
def path_parts(spark, sf_dir):
    path = F.regexp_replace("url", r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", X.filename(path).alias("filename"), X.stem(path).alias("stem"))


@query("""WITH k AS (SELECT doc_id, source AS v, lang || '/' || doc_id || '.txt' AS p FROM documents)
SELECT doc_id, sha256('gleanery source 1' || chr(10) || strlen(v) || ':' || v || strlen(p) || ':' || p) AS source_key,
 sha256('gleanery chunk 1' || chr(10) || strlen(v) || ':' || v || strlen(p) || ':' || p || '2:[]1:0') AS chunk_id FROM k""")
def content_free_ids(spark, sf_dir):
    c = document_chunks(spark, sf_dir)
    none = F.array().cast("array<string>")
    return c.select("doc_id", I.source_key(F.col("vault_id"), F.col("path")).alias("source_key"), I.chunk_id(F.col("vault_id"), F.col("path"), none, F.lit(0)).alias("chunk_id"))


@query("SELECT conv_id, turn, sha256(conv_id || ' > ' || role || chr(10) || text) AS text_digest FROM conversations")
def embedding_texts(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    heads = F.array(F.col("conv_id").cast("string"), "role")
    return t.select("conv_id", "turn", F.sha2(I.embedding_text(heads, F.col("text")), 256).alias("text_digest"))


@query("SELECT doc_id, left(text, 240) || CASE WHEN length(text) > 240 THEN '…' ELSE '' END AS excerpt FROM documents")
def excerpts(spark, sf_dir):
    return document_chunks(spark, sf_dir).select("doc_id", X.excerpt(F.col("content")).alias("excerpt"))


@query(r"SELECT doc_id, CASE WHEN length(v) > 0 AND strlen(v) <= 4096 THEN v END AS normalized FROM (SELECT doc_id, strip_accents(lower(trim(regexp_replace(split_part(text, chr(10), 1), '[\x09-\x0d \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')))) AS v FROM documents)")
def normalized_headings(spark, sf_dir):
    return document_chunks(spark, sf_dir).select("doc_id", X.normalized(F.element_at("heading_path", 1)).alias("normalized"))


@query(r"SELECT o_orderkey, regexp_matches(d, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AND try_cast(d AS DATE) IS NOT NULL AS is_date FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-') || lpad((o_orderkey % 33)::VARCHAR, 2, '0') AS d FROM orders)")
def calendar_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    made = F.concat(F.date_format("o_orderdate", "yyyy-MM-"), F.lpad((F.col("o_orderkey") % 33).cast("string"), 2, "0"))
    return o.select("o_orderkey", X.is_calendar_date(made).alias("is_date"))


@query(r"""SELECT p_partkey, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all('see [[' || p_name || '|x]] and [[' || p_brand || '#part]] or [[ #x]]', '\[\[([^\[\]]+)\]\]', 1),
 lambda t: trim(split_part(split_part(t, '|', 1), '#', 1))), lambda t: t <> ''))) AS links FROM part""")
def wikilinks(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    body = F.concat(F.lit("see [["), "p_name", F.lit("|x]] and [["), "p_brand", F.lit("#part]] or [[ #x]]"))
    return p.select("p_partkey", X.wikilinks(body).alias("links"))


# Scoring

ONE = f"{BASE}, {SCORED}"


@query(rf"""WITH {C}, f AS (SELECT chunk_id, vault_id, room, 'content' AS field, content AS txt FROM c), {OCC}, {POST}, {LEN}, {DF},
s AS (SELECT p.chunk_id, round(sum({BM}), 6) AS score FROM p JOIN df USING (field, term) JOIN len USING (field, chunk_id) JOIN st USING (field), n WHERE term IN ('the', 'of') GROUP BY p.chunk_id HAVING count(*) = 2)
SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id)::INT AS rank FROM s ORDER BY score DESC, chunk_id LIMIT 10""")
def bm25_two_terms(spark, sf_dir):
    return _best(_index(spark, sf_dir).all_terms([P.Term("the"), P.Term("of")], ("content",)), 10)


def _best(rows, k: int):
    rows = rows.select("chunk_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "chunk_id").limit(k)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))


@query(rf"""{ONE}, a AS (SELECT chunk_id, round(sum(score), 6) AS score FROM sc WHERE term IN ('en', 'the') GROUP BY chunk_id HAVING count(*) = 2)
SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id)::INT AS rank FROM a ORDER BY score DESC, chunk_id LIMIT 25""")
def dismax_multi_field(spark, sf_dir):
    return _best(_index(spark, sf_dir).all_terms([P.Term("en"), P.Term("the")]), 25)


@query(rf"""{ONE}, a AS (SELECT chunk_id, round(sum(score), 6) AS score FROM sc WHERE term IN ('and') GROUP BY chunk_id HAVING count(*) = 1)
SELECT chunk_id, path, 'all_terms' AS tier, score, row_number() OVER (ORDER BY score DESC, chunk_id, path)::INT AS rank FROM a JOIN c USING (chunk_id) WHERE vault_id = 'src1' AND room = 'en' AND path LIKE 'en/1%' ORDER BY score DESC, chunk_id LIMIT 10""")
def bm25_topk_filtered(spark, sf_dir):
    """Filters change neither scores nor statistics."""
    ix = _index(spark, sf_dir)
    plan = P.Plan("and", "ordinary", "ready", (P.Term("and"),), stages=(P.Stage("all_terms", (0,)),))
    return ix.ladder(plan, S.Filters("src1", "en", "en/1"), 10)


PHRASE = r"""ph AS (SELECT a.field, a.chunk_id, count(*) AS tf FROM o2 a JOIN o2 b ON a.chunk_id = b.chunk_id AND a.field = b.field AND b.position = a.position + 1 WHERE a.term = '{0}' AND b.term = '{1}' GROUP BY ALL),
x AS (SELECT ph.chunk_id, max(w.weight::DOUBLE * 4 * (ln(1 + (n.n - d1.df + 0.5) / (d1.df + 0.5)) + ln(1 + (n.n - d2.df + 0.5) / (d2.df + 0.5))) * (ph.tf * 2.2 / (ph.tf + 1.2 * (1 - 0.75 + 0.75 * len.len / (st.total_len / n.n))))) AS score
 FROM ph JOIN df d1 ON d1.field = ph.field AND d1.term = '{0}' JOIN df d2 ON d2.field = ph.field AND d2.term = '{1}' JOIN len ON len.field = ph.field AND len.chunk_id = ph.chunk_id JOIN st ON st.field = ph.field JOIN w ON w.field = ph.field, n GROUP BY ph.chunk_id)"""


@query(f"{BASE}, {PHRASE.format('of', 'the')} SELECT chunk_id, round(score, 6) AS score FROM x")
def phrase_match(spark, sf_dir):
    return _index(spark, sf_dir).phrase(["of", "the"]).select("chunk_id", F.round("score", 6).alias("score"))


LADDER = rf"""{ONE}, {PHRASE.format('the', 'and')},
a AS (SELECT chunk_id, sum(score) AS score FROM sc WHERE term IN ('the', 'and') GROUP BY chunk_id HAVING count(*) = 2),
u AS (SELECT chunk_id, round(score, 6) AS score, 1 AS t FROM x UNION ALL SELECT chunk_id, round(score, 6), 5 FROM a),
s AS (SELECT u.*, path, row_number() OVER (PARTITION BY t ORDER BY score DESC, chunk_id, path) AS i FROM u JOIN c USING (chunk_id)),
b AS (SELECT *, row_number() OVER (ORDER BY t, i) AS place FROM s WHERE i <= 256),
d AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY place) AS nth FROM b WHERE place <= 512)
SELECT chunk_id, path, CASE t WHEN 1 THEN 'exact_phrase' ELSE 'partial_coverage' END AS tier, score, row_number() OVER (ORDER BY place)::INT AS rank FROM d WHERE nth = 1 ORDER BY place LIMIT 100"""


@query(LADDER.replace("x UNION ALL", "x WHERE false UNION ALL").replace("'the'", "'is'").replace("'and'", "'of'"))
def evidence_ladder(spark, sf_dir):
    """A whole query: planned, probed, and answered by its stages; one word has no evidence and is relaxed."""
    return _index(spark, sf_dir).search("is qj of", limit=100)


@query(LADDER.replace("'partial_coverage'", "'all_terms'"))
def ladder_phrase_first(spark, sf_dir):
    """Phrase hits stand before better-scored hits of all terms."""
    plan = P.Plan("the and", "ordinary", "ready", (P.Term("the"), P.Term("and")), stages=(P.Stage("exact_phrase"), P.Stage("all_terms", (0, 1))))
    return _index(spark, sf_dir).ladder(plan, limit=100)


@query(rf"""{BASE}, v AS (SELECT term, max((field <> 'content')::INT) AS named FROM p WHERE starts_with(term, 'th') GROUP BY term ORDER BY term LIMIT 256)
SELECT term, named::INT AS named FROM v ORDER BY named DESC, length(term), term LIMIT 16""")
def prefix_expansions(spark, sf_dir):
    return _index(spark, sf_dir).expansions("th")


@query(f"""{ONE}, e AS (SELECT chunk_id, term FROM p WHERE starts_with(term, 'tho') GROUP BY ALL) SELECT chunk_id, count(*)::BIGINT AS terms FROM e GROUP BY chunk_id""")
def explicit_prefix(spark, sf_dir):
    ix = _index(spark, sf_dir).asked(dict.fromkeys(P.TEXT_FIELDS, I.Asked(ranges=frozenset(["tho"]))))
    found = ix.matches(P.parse_explicit("tho*"))
    words = ix.postings.where(F.startswith("term", F.lit("tho"))).select("chunk_id", "term").distinct()
    return found.join(words, "chunk_id").groupBy("chunk_id").agg(F.count("*").alias("terms"))


@query(f"""{BASE}, t AS (SELECT chunk_id, list(DISTINCT term) AS ts, list(DISTINCT term) FILTER (WHERE field = 'tags') AS tg FROM p GROUP BY chunk_id)
SELECT chunk_id FROM t WHERE ((list_contains(ts, 'the') AND list_contains(ts, 'was')) OR list_contains(coalesce(tg, []), 'de')) AND NOT list_contains(ts, 'with')""")
def explicit_boolean(spark, sf_dir):
    return _index(spark, sf_dir).matches(P.parse_explicit("((the AND was) OR tags:de) NOT with")).select("chunk_id")


@query(rf"""WITH {C}, i AS (SELECT chunk_id, unnest(list_distinct(list_transform(list_filter(regexp_extract_all(content, '(?i)\b(?:cve(?:-\d{{4}}-\d+| \d{{4}} \d+)|rfc(?:[- ]?\d+)|[a-z0-9][a-z0-9._/:+\-]{{2,}})\b'),
 lambda x: regexp_matches(x, '[0-9]') AND (regexp_matches(x, '\p{{L}}') OR regexp_matches(x, '[-_./:+ ]'))), lambda x: lower(x)))) AS v FROM c),
e AS (SELECT chunk_id, 'filename' AS field, doc_id || '.txt' AS v, 12.0 AS s FROM c UNION ALL SELECT chunk_id, 'stem', doc_id::VARCHAR, 12.0 FROM c
 UNION ALL SELECT chunk_id, 'heading', strip_accents(lower(regexp_replace(trim(heading), '\s+', ' ', 'g'))), 3.0 FROM c UNION ALL SELECT chunk_id, 'identifier', v, 5.0 FROM i)
SELECT chunk_id, max(s)::DOUBLE AS score FROM e WHERE v = '17' GROUP BY chunk_id""")
def exact_metadata(spark, sf_dir):
    return _index(spark, sf_dir).exact("17").select("chunk_id", "score")


@query(f"{C and ''}WITH {C} SELECT chunk_id FROM c WHERE path LIKE 'fr/2%'")
def path_prefix_filter(spark, sf_dir):
    return document_chunks(spark, sf_dir).where(S.Filters(path_prefix="fr/2").condition()).select("chunk_id")


@query(f"WITH {C} SELECT chunk_id FROM c WHERE room = 'es'")
def tag_filter(spark, sf_dir):
    return document_chunks(spark, sf_dir).where(S.Filters(tags=("es",)).condition()).select("chunk_id")


@query("SELECT o_orderkey FROM orders WHERE coalesce(o_orderstatus, '') = 'F' AND coalesce(NULL, '') = ''")
def frontmatter_filter(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(None).cast("string").alias("title"), F.col("o_orderpriority").alias("description"))
    return o.where(S.Filters(frontmatter={"status": "F", "title": ""}).condition()).select("o_orderkey")


@query(f"""WITH {C}, k AS (SELECT * FROM c WHERE (vault_id = 'src1' AND room = 'en') OR (vault_id = 'src2' AND room = 'fr')), f AS (SELECT chunk_id, vault_id, room, 'content' AS field, content AS txt FROM k), {OCC}, {POST}
SELECT term, count(DISTINCT chunk_id)::BIGINT AS df, (SELECT count(*) FROM k)::BIGINT AS n FROM p GROUP BY term""")
def authorized_stats(spark, sf_dir):
    """Statistics of the authorised rooms alone."""
    c = S.authorised(document_chunks(spark, sf_dir), [("src1", "en"), ("src2", "fr"), ("nowhere", None)])
    n = c.agg(F.count("*").alias("n"))
    return I.postings(_content(c)).groupBy("term").agg(F.countDistinct("chunk_id").alias("df")).join(F.broadcast(n))


@query(f"""{BASE}, v AS (SELECT term, count(*)::BIGINT AS df FROM p WHERE field <> 'tags' GROUP BY term),
n40 AS (SELECT * FROM v WHERE starts_with(term, 'nich') AND strlen(term) <= 96 AND regexp_full_match(term, '[a-z]+') ORDER BY df DESC, term LIMIT 40)
SELECT term, df FROM n40 WHERE levenshtein(term, 'nichz') = 1 ORDER BY df DESC, term LIMIT 1""")
def typo_suggestion(spark, sf_dir):
    """Among the 40 commonest terms of the prefix, by the sum over fields."""
    return S.typo_suggestion(I.typo_vocabulary(I.fields(document_chunks(spark, sf_dir))), "nichz")


@query("""WITH h AS (SELECT *, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::INT AS rank FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100),
g AS (SELECT l_suppkey::VARCHAR AS path, min(rank) AS best_rank, count(*)::BIGINT AS hits FROM h GROUP BY 1)
SELECT row_number() OVER (ORDER BY best_rank)::INT AS "group", 'v' AS vault_id, path, hits, best_rank FROM g ORDER BY best_rank LIMIT 20""")
def source_groups(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    order = [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"]
    top = li.orderBy(*order).limit(100).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return S.group_sources(top.select("rank", F.lit("v").alias("vault_id"), F.col("l_suppkey").cast("string").alias("path")))


# Semantic and hybrid


def _vector(spark, sf_dir, vec_id: int) -> list[float]:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first().embedding


KNN = "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, round({}, 6) AS score FROM embeddings, q) SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id)::INT AS rank FROM s ORDER BY score DESC, vec_id LIMIT {}"


@query(KNN.format("1 - list_distance(embedding::DOUBLE[], q)", 40))
def knn_l2(spark, sf_dir):
    return V.knn(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 7), 40)


@query(KNN.format("list_cosine_similarity(embedding::DOUBLE[], q)", 40))
def knn_cosine(spark, sf_dir):
    return V.knn(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 7), 40, "cosine")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id IN (1, 2, 3, 4, 5)),
s AS (SELECT query_id, vec_id, round(list_distance(embedding::DOUBLE[], q), 6) AS distance FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM s) SELECT query_id, vec_id, rank FROM r WHERE rank <= 10 AND vec_id <> query_id""")
def knn_batch(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    queries = {r.vec_id: r.embedding for r in e.where(F.col("vec_id").isin(1, 2, 3, 4, 5)).collect()}
    return V.knn_batch(e, queries, 10).where("vec_id <> query_id").select("query_id", "vec_id", "rank")


@query(rf"""{ONE}, a AS (SELECT chunk_id, round(sum(score), 6) AS score FROM sc WHERE term = 'that' GROUP BY chunk_id),
l AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r1 FROM a ORDER BY score DESC, chunk_id LIMIT 100),
q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 3), d AS (SELECT 'c' || lpad(vec_id::VARCHAR, 10, '0') AS chunk_id, round(1 - list_distance(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q),
s AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS r2 FROM d ORDER BY score DESC, chunk_id LIMIT 100),
u AS (SELECT chunk_id, coalesce(r1, 0)::INT AS r1, coalesce(r2, 0)::INT AS r2, round(coalesce(1.0::DOUBLE / (60 + r1), 0) + coalesce(1.0::DOUBLE / (60 + r2), 0), 9) AS score FROM l FULL JOIN s USING (chunk_id))
SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id)::INT AS rank FROM u ORDER BY score DESC, chunk_id LIMIT 20""")
def rrf_hybrid(spark, sf_dir):
    lex = _index(spark, sf_dir).all_terms([P.Term("that")]).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "chunk_id").limit(V.LEG)
    lex = lex.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))
    sem = V.knn(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 3), V.LEG)
    sem = sem.withColumn("chunk_id", F.concat(F.lit("c"), F.lpad(F.col("vec_id").cast("string"), 10, "0")))
    return V.fuse(lex, sem)


# Properties and reranking


@query("""WITH e AS (SELECT event_id, props, unnest(json_keys(props)) AS property FROM events), v AS (SELECT event_id, property, props, json_extract(props, '$."' || property || '"') AS j FROM e)
SELECT event_id, property, '' AS pointer, CASE json_type(j) WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'bool' WHEN 'DOUBLE' THEN 'f64' ELSE 'i64' END AS scalar_type,
 json_extract_string(props, '$."' || property || '"') AS exact_value, CASE WHEN json_type(j) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN j::DOUBLE END AS numeric_value FROM v""")
def property_scalars(spark, sf_dir):
    return R.property_scalars(table(spark, sf_dir, "events"), "event_id", "props").drop("date_value")


PROFILE = R.Profile(90, 2, 1, None, 1, (("en", 2), ("fr", -1)), (R.PropertyRule("q", "quality", 4, "i64", "1"), R.PropertyRule("t", "toxic", -2, "i64", low=1, high=1)))
NOW = 1_700_000_000
POINTS_SQL = """(CASE WHEN 1700000000 - doc_id * 3600 > 0 AND 1700000000 - doc_id * 3600 <= 1700000000 AND doc_id * 3600 <= 90 * 86400 THEN 2 ELSE 0 END + 1 + CASE WHEN lang = 'en' THEN 2 WHEN lang = 'fr' THEN -1 ELSE 0 END
 + CASE WHEN quality = 1 THEN 4 ELSE 0 END + CASE WHEN toxic = 1 THEN -2 ELSE 0 END)::INT"""


def _label_scalars(spark, sf_dir):
    s = document_sources(spark, sf_dir)
    pairs = F.array(*[F.struct(F.lit(n).alias("property"), F.col(n).cast("long").alias("v")) for n in ("quality", "toxic")])
    rows = s.select("source_key", F.explode(pairs).alias("p")).where("p.v IS NOT NULL")
    return rows.select("source_key", "p.property", F.lit("").alias("pointer"), F.lit("i64").alias("scalar_type"), F.col("p.v").cast("string").alias("exact_value"), F.col("p.v").cast("double").alias("numeric_value"), F.lit(None).cast("string").alias("date_value"))


@query("SELECT 's' || lpad(doc_id::VARCHAR, 10, '0') AS source_key, ((CASE WHEN quality = 1 THEN 4 ELSE 0 END) + (CASE WHEN toxic = 1 THEN -2 ELSE 0 END))::INT AS points FROM labels JOIN documents USING (doc_id)")
def property_ranges(spark, sf_dir):
    return R.property_points(_label_scalars(spark, sf_dir), list(PROFILE.properties))


RERANK = f"""WITH h AS (SELECT d.*, row_number() OVER (ORDER BY n_chars DESC, doc_id)::INT AS rank FROM documents d ORDER BY n_chars DESC, doc_id LIMIT 100),
j AS (SELECT 'c' || lpad(doc_id::VARCHAR, 10, '0') AS chunk_id, lang || '/' || doc_id || '.txt' AS path, rank, CASE WHEN rank <= 30 THEN 0 ELSE 1 END AS tier_no, {POINTS_SQL} AS points FROM h LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER (ORDER BY tier_no, points DESC, rank)::INT AS new_rank FROM j)"""


def _reranked(spark, sf_dir):
    s = document_sources(spark, sf_dir)
    d = table(spark, sf_dir, "documents").orderBy(F.desc("n_chars"), "doc_id").limit(100)
    d = d.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")))
    key = lambda c: F.concat(F.lit(c), F.lpad(F.col("doc_id").cast("string"), 10, "0"))
    hits = d.select(key("c").alias("chunk_id"), key("s").alias("source_key"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "rank", F.when(F.col("rank") <= 30, 0).otherwise(1).alias("tier_no"))
    return R.rerank(hits, s, PROFILE, NOW, _label_scalars(spark, sf_dir))


@query(f"{RERANK} SELECT chunk_id, path, tier_no, points, rank, new_rank FROM r")
def metadata_rerank(spark, sf_dir):
    return _reranked(spark, sf_dir).select("chunk_id", "path", "tier_no", "points", "rank", "new_rank")


@query(f"{RERANK} SELECT chunk_id, path, rank AS text_rank, new_rank AS balanced_rank, rank - new_rank AS moved, points, CASE WHEN rank > new_rank THEN 'raised' WHEN rank < new_rank THEN 'lowered' ELSE 'unmoved' END AS verdict FROM r")
def ranking_comparison(spark, sf_dir):
    return R.compare_rankings(_reranked(spark, sf_dir))


@query("SELECT page_id, length(regexp_replace(p, '[^/]', '', 'g'))::INT AS depth, starts_with(p, 'en/') AS in_folder FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '[?#].*$', '') AS p FROM pages)")
def folder_tests(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*/?", ""), r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", R.folder_depth(path).alias("depth"), R.within_folder(path, "en").alias("in_folder"))


@query("SELECT doc_id FROM documents WHERE 1700000000 - doc_id * 3600 > 0 AND doc_id * 3600 <= 7 * 86400")
def recency_filter(spark, sf_dir):
    return document_sources(spark, sf_dir).where(R.is_recent(F.col("mtime"), NOW, 7)).select("doc_id")


# Maintenance


def _manifests(spark, sf_dir):
    """Two states of the documents: some sources left, some came, some changed."""
    s = document_sources(spark, sf_dir)
    old = s.where("doc_id % 11 <> 3").select("source_key", "vault_id", F.when(F.col("doc_id") % 7 == 1, "stale").otherwise(F.col("content_hash")).alias("content_hash"))
    new = s.where("doc_id % 13 <> 5").select("source_key", "vault_id", "content_hash")
    vaults = s.select("vault_id").distinct().select("vault_id", (F.col("vault_id") != "src4").alias("complete"))
    return old, new, vaults


DIFF = """WITH s AS (SELECT 's' || lpad(doc_id::VARCHAR, 10, '0') AS source_key, doc_id, source AS vault_id, sha256(text) AS h FROM documents),
o AS (SELECT source_key, vault_id, CASE WHEN doc_id % 7 = 1 THEN 'stale' ELSE h END AS h FROM s WHERE doc_id % 11 <> 3), n AS (SELECT source_key, vault_id, h FROM s WHERE doc_id % 13 <> 5),
d AS (SELECT coalesce(o.source_key, n.source_key) AS source_key, coalesce(n.vault_id, o.vault_id) AS vault_id,
 CASE WHEN o.source_key IS NULL THEN 'added' WHEN n.source_key IS NULL AND o.vault_id <> 'src4' THEN 'removed' WHEN n.source_key IS NULL THEN 'retained' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS change
 FROM o FULL JOIN n ON o.source_key = n.source_key)"""


@query(f"{DIFF} SELECT * FROM d")
def manifest_diff(spark, sf_dir):
    return M.manifest_diff(*_manifests(spark, sf_dir))


@query(f"{DIFF} SELECT source_key FROM d WHERE change = 'removed'")
def deletion_inference(spark, sf_dir):
    return M.manifest_diff(*_manifests(spark, sf_dir)).where("change = 'removed'").select("source_key")


@query(f"{DIFF} SELECT source_key, vault_id, h AS content_hash FROM n UNION ALL SELECT o.source_key, o.vault_id, o.h FROM o JOIN d USING (source_key) WHERE change = 'retained'")
def reconciled_manifest(spark, sf_dir):
    return M.reconcile(*_manifests(spark, sf_dir))


def _observed(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey", F.lit("p").alias("path"), F.lit("r").alias("registration"), F.lit("f").alias("format_identity"), F.lit("x").alias("outcome"), F.lit("h").alias("content_hash"), F.lit("m").alias("room"),
        F.lit(10).alias("byte_length"), (k % 50).cast("long").alias("mtime"), F.lit(20).cast("long").alias("observed_at"), (k % 19 == 0).alias("touched"),
        F.when(k % 3 != 0, k).alias("old_source_key"), F.when(k % 5 == 0, "q").otherwise("p").alias("old_path"), F.when(k % 7 == 0, "q").otherwise("r").alias("old_registration"),
        F.when(k % 11 == 0, None).otherwise("f").alias("old_format_identity"), F.when(k % 13 == 0, 9).otherwise(10).alias("old_byte_length"), F.when(k % 17 == 0, 1).otherwise(k % 50).cast("long").alias("old_mtime"),
        F.when(k % 23 == 0, None).otherwise(F.when(k % 29 == 0, "g").otherwise("h")).alias("old_content_hash"), F.when(k % 31 == 0, "n").otherwise("m").alias("old_room"), F.when(k % 37 == 0, "y").otherwise("x").alias("old_outcome"),
    )


@query("""SELECT o_orderkey, CASE WHEN k % 3 = 0 THEN 'new' WHEN k % 5 = 0 THEN 'moved' WHEN k % 7 = 0 THEN 'registration' WHEN k % 11 = 0 THEN 'format_identity' WHEN k % 13 = 0 THEN 'size'
 WHEN k % 17 = 0 AND k % 50 <> 1 THEN 'mtime' WHEN k % 19 = 0 THEN 'event' WHEN k % 23 = 0 THEN 'backfill' WHEN 20 - k % 50 <= 2 THEN 'racy' END AS reason FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)""")
def observation_ladder(spark, sf_dir):
    return _observed(spark, sf_dir).select("o_orderkey", M.observation().alias("reason"))


@query("""SELECT o_orderkey, CASE WHEN k % 3 = 0 THEN 'new' WHEN k % 31 = 0 THEN 'resource_changed' WHEN k % 7 = 0 THEN 'registration_changed' WHEN k % 11 = 0 THEN 'format_identity_changed' WHEN k % 37 = 0 THEN 'outcome_changed'
 WHEN k % 23 = 0 OR k % 29 = 0 THEN 'content_changed' ELSE 'unchanged' END AS decision
 FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)""")
def decision_ladder(spark, sf_dir):
    return _observed(spark, sf_dir).select("o_orderkey", M.decision().alias("decision"))


FORMATS = ("markdown", "text", "base", "canvas", "excalidraw", "html", "docx", "excel", "pdf")


@query(f"""WITH s AS (SELECT {list(FORMATS)}[(l_partkey % 9 + 1)::INT] AS format, {list(COVERAGE)}[(l_linenumber % 5 + 1)::INT] AS coverage FROM lineitem)
SELECT format, coverage, count(*)::BIGINT AS n_sources FROM s GROUP BY ALL""")
def coverage_counts(spark, sf_dir):
    """All nine formats with all five coverages."""
    li = table(spark, sf_dir, "lineitem")
    at = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    return M.coverage_counts(li.select(at(FORMATS, F.col("l_partkey") % 9).alias("format"), at(COVERAGE, F.col("l_linenumber") % 5).alias("coverage")))


@query("SELECT source AS vault_id, count(*)::BIGINT AS documents, sum(ceil(greatest(n_chars, 1) / 4000))::BIGINT AS chunks, (count(*) FILTER (WHERE n_chars > 4000))::BIGINT AS warnings FROM documents GROUP BY source")
def vault_status(spark, sf_dir):
    return M.vault_status(document_sources(spark, sf_dir))


@query("SELECT o_orderkey AS generation FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey DESC LIMIT 3")
def generation_retention(spark, sf_dir):
    g = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("generation"), (F.col("o_orderstatus") == "F").alias("valid"))
    return M.retained(g).select("generation")


@query(f"{BASE} SELECT chunk_id, field, term, tf::BIGINT AS tf, len::BIGINT AS len FROM p JOIN len USING (field, chunk_id) WHERE chunk_id NOT IN (SELECT chunk_id FROM c WHERE doc_id % 13 = 4)")
def incremental_equals_rebuild(spark, sf_dir):
    """Postings of an index that was updated: a third of the sources replaced, a seventh brought in late, a thirteenth gone."""
    c = document_chunks(spark, sf_dir)
    old = c.where("doc_id % 7 <> 2").withColumn("content", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("old words "), "content")).otherwise(F.col("content")))
    changed = c.where("(doc_id % 3 = 0 OR doc_id % 7 = 2) AND doc_id % 13 <> 4")
    gone = c.where("doc_id % 13 = 4").select("vault_id", "path")
    after = I.apply_postings(I.postings(I.fields(old)), changed, gone)
    return after.select("chunk_id", "field", "term", "tf", "len")


# Streams, as tables of events

#: Times are a hundred thousand times closer together, so that events meet in batches.
BATCHES = """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 100000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 100000, event_id) AS i FROM events),
b AS (SELECT user_id, i, t, t AS first, 1 AS batch FROM e WHERE i = 1 UNION ALL
 SELECT e.user_id, e.i, e.t, CASE WHEN e.t - b.t >= 300000 OR e.t - b.first >= 2000000 THEN e.t ELSE b.first END, CASE WHEN e.t - b.t >= 300000 OR e.t - b.first >= 2000000 THEN b.batch + 1 ELSE b.batch END
 FROM b JOIN e ON e.user_id = b.user_id AND e.i = b.i + 1)"""


def _close_events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 100000)))


@query(f"{BATCHES} SELECT user_id, batch::BIGINT AS batch, count(*)::BIGINT AS n_events, min(t)::BIGINT AS first_us, max(t)::BIGINT AS last_us FROM b GROUP BY user_id, batch")
def debounce_batches(spark, sf_dir):
    """Batches that a pause of 300 ms ends, or their first event's age of 2 s."""
    b = ST.debounce_batches(_close_events(spark, sf_dir), key="user_id")
    return b.select("user_id", "batch", "n_events", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


@query("""SELECT vault_id, count(*)::BIGINT AS n_paths, count(*) > 4096 OR bool_or(event_type = 'error' AND vault_id = 'u101') AS full_rescan
 FROM (SELECT DISTINCT CASE WHEN user_id <= 100 THEN 'all' ELSE 'u' || user_id END AS vault_id, event_id, event_type FROM events) GROUP BY vault_id""")
def rescan_latch(spark, sf_dir):
    """More than 4096 paths (one vault holds most events), or an event that says so."""
    e = table(spark, sf_dir, "events").select(F.when(F.col("user_id") <= 100, F.lit("all")).otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("vault_id"), "event_id", "event_type")
    said = (F.col("event_type") == "error") & (F.col("vault_id") == "u101")
    return ST.rescan_latch(e.groupBy("vault_id").agg(F.countDistinct("event_id").alias("n_paths"), F.bool_or(said).alias("said")), said="said").drop("said")


# Evaluation

KNOWN = "SELECT item_id AS query_id, item_id % 50 AS source, CASE WHEN item_id % 2 = 0 THEN 3 ELSE 2 END AS grade, false AS hard_negative FROM benchmark UNION ALL SELECT item_id, item_id % 50 + 1, 0, true FROM benchmark"


@query(f"""WITH j AS ({KNOWN}), h AS (SELECT item_id AS query_id, r.i AS rank, (item_id + r.i * r.i) % 50 AS source FROM benchmark, range(0, 40) r(i) WHERE r.i > 0),
m AS (SELECT h.*, grade, hard_negative FROM h LEFT JOIN j USING (query_id, source)), s AS (SELECT query_id, max(k) AS k FROM (SELECT query_id, source, count(*) AS k FROM m WHERE rank <= 10 GROUP BY ALL) GROUP BY query_id)
SELECT q.query_id, coalesce(max(CASE WHEN rank = 1 AND grade = 3 THEN 1 ELSE 0 END), 0)::INT AS success_at_1, round(coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE grade = 3), 0), 6) AS reciprocal_rank,
 round(count(DISTINCT source) FILTER (WHERE grade >= 1 AND rank <= 10) / any_value(rel)::DOUBLE, 6) AS recall_at_10, round(count(DISTINCT source) FILTER (WHERE grade >= 1 AND rank <= 100) / any_value(rel)::DOUBLE, 6) AS recall_at_100,
 (count(*) FILTER (WHERE rank <= 10 AND hard_negative))::BIGINT AS hard_negatives_top_10, (count(DISTINCT source) FILTER (WHERE rank <= 10))::BIGINT AS distinct_sources_top_10, any_value(s.k)::BIGINT AS max_chunks_per_source_top_10, count(*)::BIGINT AS total_hits
FROM (SELECT query_id, count(DISTINCT source) AS rel FROM j WHERE grade >= 1 GROUP BY query_id) q JOIN m USING (query_id) JOIN s USING (query_id) GROUP BY q.query_id""")
def retrieval_metrics(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    good = b.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 50).alias("source"), F.when(F.col("item_id") % 2 == 0, 3).otherwise(2).alias("grade"), F.lit(False).alias("hard_negative"))
    bad = b.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 50 + 1).alias("source"), F.lit(0).alias("grade"), F.lit(True).alias("hard_negative"))
    hits = b.select(F.col("item_id").alias("query_id"), F.explode(F.sequence(F.lit(1), F.lit(39))).alias("rank")).withColumn("source", (F.col("query_id") + F.col("rank") * F.col("rank")) % 50)
    return E.retrieval_metrics(hits, good.unionByName(bad))


@query("SELECT quantile_cont(value, 0.95) AS p95 FROM events")
def latency_p95(spark, sf_dir):
    return E.latency_percentile(table(spark, sf_dir, "events"), "value")


# Readers


@query("""SELECT doc_id, CASE lower(regexp_extract(p, '[^/]\\.([^./]+)$', 1)) WHEN 'md' THEN 'markdown' WHEN 'txt' THEN 'text' WHEN 'html' THEN 'html' WHEN 'xlsm' THEN 'excel' END AS format
 FROM (SELECT doc_id, 'a/b' || doc_id || '.' || ['MD', 'txt', 'Html', 'xlsm', 'zip'][doc_id % 5 + 1] AS p FROM documents)""")
def format_classification(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("a/b"), F.col("doc_id").cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, ("MD", "txt", "Html", "xlsm", "zip"))), (F.col("doc_id") % 5 + 1).cast("int"))).alias("p"))
    return d.select("doc_id", format_of(F.col("p")).alias("format"))


@query()
def html_sections(spark, sf_dir):
    """Chunks of all web pages, with headings and roles."""
    c = PR.chunks(PR.prepare(PR.pages_as_files(table(spark, sf_dir, "pages"))))
    return c.select("path", "chunk_ix", "heading_path", "role", "content", "chunk_id")


@query()
def page_search(spark, sf_dir):
    """A query over the sections of web pages, hits as a reader sees them."""
    c = keep(PR.chunks(PR.prepare(PR.pages_as_files(table(spark, sf_dir, "pages")))), "chunks")
    return S.Index(c).hits("of", limit=20).select("rank", "tier", "score", "path", "chunk_id", "heading_path", "coverage", "excerpt")


from . import catalog_sources, catalog_state  # noqa: E402  they use what stands above

__all__ = ["ORACLES", "QUERIES", "catalog_sources", "catalog_state"]
