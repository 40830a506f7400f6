"""Queries of stored indexes, planning, ladders, maintenance, streams and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import api
from .catalog import BASE, BATCHES, BM, SCORED, C, _best, _close_events, _index
from .functions import text as X
from .operators import index as I
from .operators import manifest as M
from .operators import properties as R
from .operators import search as S
from .operators import semantic as V
from .plans import planner as P
from .registry import query
from .session import keep, scratch, table
from .streaming import reconcile as ST
from .tables import document_chunks, document_sources


def _frame(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _values(rows: list[tuple], columns: str) -> str:
    """A table of fixed rows, as SQL."""
    say = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(say, r)) + ')' for r in rows)}) t({columns})"


# Digests and encodings


@query("""SELECT doc_id, sha256('gleanery embedding source 1' || chr(10) || strlen(h) || ':' || h || strlen(f) || ':' || f) AS identity FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h, lang || '/1/2' AS f FROM documents)""")
def embedding_identities(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", V.source_identity(F.sha2(F.coalesce("text", F.lit("")), 256), F.concat("lang", F.lit("/1/2"))).alias("identity"))


@query("""SELECT s_suppkey, sha256('gleanery registration 1' || chr(10) || strlen(a) || ':' || a || strlen(b) || ':' || b || strlen(c) || ':' || c) AS fingerprint
 FROM (SELECT s_suppkey, s_name AS a, '/vault/' || s_suppkey AS b, CASE WHEN s_nationkey % 3 = 0 THEN '' ELSE 'n' || s_nationkey END AS c FROM supplier)""")
def registration_fingerprints(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    room = F.when(F.col("s_nationkey") % 3 != 0, F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
    return s.select("s_suppkey", M.registration_fingerprint(F.col("s_name"), F.concat(F.lit("/vault/"), F.col("s_suppkey").cast("string")), room).alias("fingerprint"))


@query("SELECT c_custkey, sha256('gleanery subject 1' || chr(10) || strlen(c_name) || ':' || c_name) AS digest FROM customer")
def subject_digests(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.subject_digest(F.col("c_name")).alias("digest"))


@query("SELECT event_id, lpad(lower(to_hex(((CASE WHEN event_id % 2 = 0 THEN value ELSE -value END)::DOUBLE::BIT)::UBIGINT)), 16, '0') AS bits FROM events")
def double_bits(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", X.f64_bits(F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(-F.col("value"))).alias("bits"))


# Statistics


@query(f"""{BASE}, q AS (SELECT field, CASE WHEN len < 40 THEN len ELSE 24 + ((len::BIGINT - 24) >> greatest(floor(log2(len - 24))::INT - 3, 0)) * (1::BIGINT << greatest(floor(log2(len - 24))::INT - 3, 0)) END AS step FROM len)
SELECT field, count(*)::BIGINT AS n_docs, sum(step)::BIGINT AS total_len FROM q GROUP BY field""")
def quantised_lengths(spark, sf_dir):
    """Collection lengths as 256 steps can hold them."""
    return I.quantised_stats(I.fields(document_chunks(spark, sf_dir)))


@query(f"{BASE} SELECT term, count(*)::BIGINT AS df FROM p WHERE field <> 'tags' GROUP BY term")
def typo_vocabulary(spark, sf_dir):
    return I.typo_vocabulary(I.fields(document_chunks(spark, sf_dir)))


@query("SELECT (count(*) FILTER (WHERE o_orderstatus <> 'F'))::BIGINT AS documents, sum(CASE WHEN o_orderstatus <> 'F' THEN o_orderkey % 7 ELSE 0 END)::BIGINT AS chunks FROM orders")
def manifest_totals(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    left_out = F.col("o_orderstatus") == "F"
    return M.manifest_totals(o.select(F.when(left_out, "skipped").otherwise("indexed").alias("outcome"), F.when(left_out, 0).otherwise(F.col("o_orderkey") % 7).alias("chunk_count")))


ROLES = ("primary", "supporting", "latent")
IDENTIFIERS = r"""list_distinct(list_transform(list_filter(regexp_extract_all(content, '(?i)\b(?:cve(?:-\d{4}-\d+| \d{4} \d+)|rfc(?:[- ]?\d+)|[a-z0-9][a-z0-9._/:+\-]{2,})\b'),
 lambda x: regexp_matches(x, '[0-9]') AND (regexp_matches(x, '\p{L}') OR regexp_matches(x, '[-_./:+ ]'))), lambda x: lower(x)))"""


@query(rf"""WITH {C}, k AS (SELECT *, doc_id % 3 = 0 OR (doc_id // 3) % 3 > 1 AS full_boost FROM c)
SELECT chunk_id, 'heading' AS field, NULL AS identifier FROM k WHERE full_boost AND heading <> '' UNION ALL SELECT chunk_id, 'identifier', unnest({IDENTIFIERS}) FROM k WHERE full_boost""")
def boosted_sections(spark, sf_dir):
    """Sections of pages and sheets that aren't primary keep their text and lose headings and identifiers; in other formats they keep them."""
    c = document_chunks(spark, sf_dir)
    at = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    c = c.withColumns({"role": at(ROLES, F.col("doc_id") % 3), "format": at(("html", "excel", "docx"), F.floor(F.col("doc_id") / 3) % 3)})
    heads = I.fields(c).where("field = 'heading'").select("chunk_id", "field", F.lit(None).cast("string").alias("identifier"))
    return heads.unionByName(I.identifier_rows(c).select("chunk_id", F.lit("identifier").alias("field"), "identifier"))


# Planning

PLANS = [
    # query, words the corpus knows (comma-separated), prefix expansions (term=a|b), kind, execution, terms (! anchor, # identifier), stages
    ("river stone", "river,stone", "", "ordinary", "ready", "river stone", "exact_metadata exact_phrase all_terms"),
    ("river", "river", "", "ordinary", "ready", "river", "exact_metadata all_terms"),
    ("kindly river zzyx", "kindly,river", "", "ordinary", "ready", "kindly river zzyx", "exact_metadata exact_phrase all_terms partial_coverage"),
    ("river ston", "river", "ston=stone|stonework", "ordinary", "ready", "river ston", "exact_metadata exact_phrase prefix_metadata all_terms prefix partial_coverage"),
    ("abc def", "", "", "ordinary", "empty_no_evidence", "abc def", ""),
    ("RFC 7230 notes", "rfc 7230,notes", "", "identifier", "ready", "rfc 7230!# notes", "exact_metadata exact_phrase all_terms"),
    ("RFC 7230 notes", "notes", "", "identifier", "empty_no_evidence", "rfc 7230!# notes", ""),
    ("ABX 2 missing", "abx,2", "", "identifier", "ready", "abx! 2! missing", "exact_metadata exact_phrase all_terms partial_coverage"),
    ("v2.4.1", "v2.4.1", "", "identifier", "ready", "v2.4.1!#", "exact_metadata all_terms"),
    ("page 2 line", "page,2,line", "", "ordinary", "ready", "page 2 line", "exact_metadata exact_phrase all_terms"),
    ("Résumé_Café, snake_case", "resume_cafe,snake_case", "", "ordinary", "ready", "resume_cafe snake_case", "exact_metadata exact_phrase all_terms"),
    ("river stone?", "river,stone", "", "ordinary", "ready", "river stone", "exact_metadata exact_phrase all_terms"),
    ("river (draft)", "river,draft", "", "ordinary", "ready", "river draft", "exact_metadata exact_phrase all_terms"),
    ("river AND stone", "", "", "explicit", "explicit_bypass", "", ""),
    ("title:river", "", "", "explicit", "explicit_bypass", "", ""),
    ("riv*", "", "", "explicit", "explicit_bypass", "", ""),
    ("+river", "", "", "explicit", "explicit_bypass", "", ""),
    ("what? ever", "", "", "explicit", "explicit_bypass", "", ""),
    ('"river stone"', "", "", "explicit", "explicit_bypass", "", ""),
    ("...", "", "", "ordinary", "empty_no_evidence", "", ""),
    (" ", "", "", "refused", "invalid_query", "", ""),
    ("x" * 4097, "", "", "refused", "invalid_query", "", ""),
    (" ".join(["a"] * 129), "", "", "refused", "invalid_query", "", ""),
]


def _planned(query_text: str, known: str, expansions: str) -> tuple:
    try:
        plan = P.prepare(query_text)
    except P.QueryError as e:
        return "refused", e.code, "", ""
    has = set(known.split(","))
    grown = dict(x.split("=") for x in expansions.split(",") if x)
    evidence = P.Evidence({i: int(t.text in has) for i, t in enumerate(plan.terms)}, {i: tuple(grown[t.text].split("|")) for i, t in enumerate(plan.terms) if t.text in grown})
    done = P.finalize(plan, evidence)
    terms = " ".join(t.text + "!" * t.anchor + "#" * t.identifier for t in done.terms)
    return done.kind, done.execution, terms, " ".join(s.kind for s in done.stages)


@query(_values([(i, *p[3:]) for i, p in enumerate(PLANS)], "n, kind, execution, terms, stages"))
def query_plans(spark, sf_dir):
    """From query text and evidence to terms, anchors and stages."""
    return _frame(spark, [(i, *_planned(*p[:3])) for i, p in enumerate(PLANS)], "n int, kind string, execution string, terms string, stages string")


REQUESTS = [
    (api.SearchRequest("river"), None), (api.SearchRequest(" "), "invalid_query"), (api.SearchRequest("a", "other"), "mode_unavailable"), (api.SearchRequest("a", limit=0), "invalid_limit"), (api.SearchRequest("a", limit=101), "invalid_limit"),
    (api.SearchRequest("a", cursor="x"), "invalid_cursor"), (api.SearchRequest("a", path_prefix="/x"), "invalid_filter"), (api.SearchRequest("a", path_prefix="a/../b"), "invalid_filter"), (api.SearchRequest("a", frontmatter={"other": "x"}), "invalid_filter"),
    (api.SearchRequest("a", path_prefix="a/b", tags=("t",), frontmatter={"status": "open"}), None),
]


@query(_values([(i, code) for i, (_, code) in enumerate(REQUESTS)], "n, error"))
def request_checks(spark, sf_dir):
    def outcome(request):
        try:
            request.validate()
        except P.QueryError as e:
            return e.code
        return None

    return _frame(spark, [(i, outcome(r)) for i, (r, _) in enumerate(REQUESTS)], "n int, error string")


NOW = 1_700_000_000
CLAIMS = {"iss": "i", "aud": "a", "sub": "s", "actor": "r", "jti": "j", "tenant": "t", "actions": ["search"], "resources": [["t", "v", "r"]], "max_limit": 50, "iat": NOW - 10, "nbf": NOW - 10, "exp": NOW + 100}
CAPABILITIES = [
    ({}, None), ({"exp": NOW}, "unauthorized"), ({"nbf": NOW + 5}, "unauthorized"), ({"exp": NOW + 4000}, "unauthorized"), ({"aud": "x"}, "unauthorized"), ({"sub": "r"}, "unauthorized"), ({"jti": " "}, "unauthorized"),
    ({"tenant": "x"}, "forbidden"), ({"actions": ["search", "write"]}, "forbidden"), ({"resources": []}, "forbidden"), ({"resources": [["t", "v", "r"]] * 2}, "forbidden"), ({"resources": [["t", "v", str(i)] for i in range(257)]}, "forbidden"),
    ({"resources": [["x", "v", "r"]]}, "forbidden"), ({"max_limit": 101}, "forbidden"), ({"resources": [["t", "v", str(i)] for i in range(256)]}, None),
]


@query(_values([(i, code) for i, (_, code) in enumerate(CAPABILITIES)], "n, error"))
def capability_checks(spark, sf_dir):
    """What a capability must say to name resources and a limit; its signature is checked where it comes in."""
    rules = api.CapabilityRules("i", "a", "t", 3600)

    def outcome(change):
        try:
            rules.principal(CLAIMS | change, NOW)
        except P.QueryError as e:
            return e.code
        return None

    return _frame(spark, [(i, outcome(c)) for i, (c, _) in enumerate(CAPABILITIES)], "n int, error string")


WINDOWS = [
    # stage limits and hits, limit of the result, what is told
    ([(256, "ab")], 5, "exhausted", 2), ([(256, "abc")], 2, "more_available", 3), ([(2, "ab")], 2, "candidate_limit_reached", 2), ([(256, "ab"), (256, "c")], 2, "unknown", 2), ([(256, "a"), (256, "ab")], 2, "exhausted", 3),
    ([(2, "ab"), (256, "c")], 5, "candidate_limit_reached", 3), ([(256, "a"), (256, "abc")], 2, "more_available", 4), ([], 5, "exhausted", 0),
]


@query(_values([(i, state, n) for i, (_, _, state, n) in enumerate(WINDOWS)], "n, state, candidates"))
def candidate_windows(spark, sf_dir):
    told = [(i, *S.candidate_window([(k, list(h)) for k, h in stages], limit)) for i, (stages, limit, _, _) in enumerate(WINDOWS)]
    return _frame(spark, told, "n int, state string, candidates int")


@query(_values([(k, v) for k, v in sorted(R.SIGNAL_STATES.items())], "state, verdict"))
def signal_states(spark, sf_dir):
    states = _frame(spark, [(s, s) for s in R.SIGNAL_STATES], "case_id string, state string")
    return R.evaluation_verdict(states).select(F.col("case_id").alias("state"), "verdict")


STATES = list(R.SIGNAL_STATES)


@query(f"""WITH s AS (SELECT l_orderkey, {STATES}[(l_partkey % 12 + 1)::INT] AS state FROM lineitem),
v AS (SELECT l_orderkey, CASE WHEN state IN ('matched', 'nonmatched', 'absent') THEN 0 WHEN state IN ('unsupported', 'stale', 'unavailable', 'untrusted') THEN 1 ELSE 2 END AS r FROM s)
SELECT l_orderkey, ['strict', 'neutralized', 'fatal'][max(r) + 1] AS verdict, (count(*) FILTER (WHERE r = 1))::BIGINT AS neutralized_signals FROM v GROUP BY l_orderkey""")
def evaluation_verdicts(spark, sf_dir):
    """The gravest state of a case's signals decides."""
    li = table(spark, sf_dir, "lineitem")
    state = F.element_at(F.array(*map(F.lit, STATES)), (F.col("l_partkey") % 12 + 1).cast("int"))
    return R.evaluation_verdict(li.select("l_orderkey", state.alias("state")), key="l_orderkey")


# Ladders over stored tables


def published(spark, sf_dir) -> M.Generations:
    """The documents' index as a generation under the shared folder."""
    s = document_sources(spark, sf_dir).withColumn("chunk_count", F.lit(1).cast("long"))
    kept = M.Generations(spark, scratch(spark, "generations"))
    kept.publish_index(s, document_chunks(spark, sf_dir))
    return kept


@query(rf"""{BASE}, {SCORED}, a AS (SELECT chunk_id, round(sum(score), 6) AS score FROM sc WHERE term IN ('the', 'of') GROUP BY chunk_id HAVING count(*) = 2)
SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id)::INT AS rank FROM a ORDER BY score DESC, chunk_id LIMIT 50""")
def stored_search(spark, sf_dir):
    """Two terms over a published index: postings by term, statistics as a few rows."""
    return _best(S.Index.opened(published(spark, sf_dir).reader()).all_terms([P.Term("the"), P.Term("of")]), 50)


@query(f"""WITH {C}, k AS (SELECT * FROM c WHERE (vault_id = 'src1' AND room = 'en') OR (vault_id = 'src2' AND room = 'fr')), f AS (SELECT chunk_id, vault_id, room, 'content' AS field, content AS txt FROM k)
SELECT 'chunks' AS part, count(*)::BIGINT AS n FROM k UNION ALL SELECT 'scope', count(*)::BIGINT FROM k UNION ALL SELECT 'folders', count(DISTINCT (vault_id, room))::BIGINT FROM k""")
def stored_resources(spark, sf_dir):
    """Authorised resources of a published index, by the folders of its partitions."""
    read = published(spark, sf_dir).reader()
    who = [("src1", "en"), ("src2", "fr"), ("nowhere", None)]
    ix = S.Index.opened(read, who)
    folders = S.authorised(read("postings"), who).select(M.PARTITION).distinct()
    count = lambda part, frame: frame.agg(F.lit(part).alias("part"), F.count("*").alias("n")).select("part", "n")
    return count("chunks", ix.chunks).unionByName(ix.scope.select(F.lit("scope").alias("part"), "n")).unionByName(count("folders", folders))


@query("SELECT * FROM (VALUES ('chunks_without_source', 0), ('postings_without_chunk', 0), ('repeated_chunks', 0), ('sources_without_chunk', 0)) t(problem, n)")
def stored_integrity(spark, sf_dir):
    """A published index holds every row's counterpart."""
    read = published(spark, sf_dir).reader()
    chunks = read("chunks").withColumn("source_key", F.regexp_replace("chunk_id", "^c", "s"))
    found = M.check_integrity(chunks, read("postings"), read("sources"))
    return _frame(spark, sorted(found.items()), "problem string, n int")


@query("""WITH k AS (SELECT doc_id FROM documents WHERE doc_id % 7 <> 2 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 7 <> 2 AND doc_id % 11 = 3)
SELECT 'chunks_without_source' AS problem, (count(*) FILTER (WHERE doc_id % 5 = 1))::INT AS n FROM k UNION ALL SELECT 'postings_without_chunk', (count(*) FILTER (WHERE doc_id % 7 = 2))::INT FROM documents
 UNION ALL SELECT 'repeated_chunks', (count(*) FILTER (WHERE doc_id % 11 = 3 AND doc_id % 7 <> 2))::INT FROM documents UNION ALL SELECT 'sources_without_chunk', (count(*) FILTER (WHERE doc_id % 7 = 2 AND doc_id % 5 <> 1))::INT FROM documents""")
def broken_integrity(spark, sf_dir):
    """What the checks count where rows were lost or doubled."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chunk_id"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("source_key"), F.lit(1).alias("chunk_count"))
    chunks = d.where("doc_id % 7 <> 2")
    chunks = chunks.unionByName(chunks.where("doc_id % 11 = 3"))
    return _frame(spark, sorted(M.check_integrity(chunks, d, d.where("doc_id % 5 <> 1")).items()), "problem string, n int")


@query(rf"""{BASE}, {SCORED}, x AS (SELECT p.term FROM p WHERE starts_with(p.term, 'tho') GROUP BY p.term ORDER BY p.term LIMIT 256), xp AS (SELECT x.term FROM x JOIN p USING (term) GROUP BY x.term ORDER BY max((field <> 'content')::INT) DESC, length(x.term), x.term LIMIT 16),
m AS (SELECT chunk_id, max(score) AS score FROM sc WHERE term IN (SELECT term FROM xp) GROUP BY chunk_id), a AS (SELECT chunk_id, score FROM sc WHERE term = 'the')
SELECT chunk_id, path, 'prefix' AS tier, round(m.score + a.score, 6) AS score, row_number() OVER (ORDER BY round(m.score + a.score, 6) DESC, chunk_id, path)::INT AS rank FROM m JOIN a USING (chunk_id) JOIN c USING (chunk_id) ORDER BY rank LIMIT 100""")
def ladder_prefix_stage(spark, sf_dir):
    """A required word, and the best expansion of a prefix."""
    ix = _index(spark, sf_dir).asked(dict.fromkeys(P.TEXT_FIELDS, I.Asked(frozenset(["the"]), frozenset(["tho"]))))
    grown = tuple(sorted(r.term for r in ix.expansions("tho").collect()))
    plan = P.Plan("the tho", "ordinary", "ready", (P.Term("the"), P.Term("tho")), stages=(P.Stage("prefix", (0,), (1,)),), expansions={1: grown})
    return ix.ladder(plan, limit=100)


@query(rf"""{BASE}, i AS (SELECT chunk_id, unnest({IDENTIFIERS}) AS v FROM c), b AS (SELECT v FROM i GROUP BY v ORDER BY count(*) DESC, v LIMIT 1), h AS (SELECT DISTINCT chunk_id FROM i WHERE v = (SELECT v FROM b)),
k AS (SELECT count(*)::DOUBLE AS df FROM h), e AS (SELECT chunk_id, path, round(5 * ln(1 + (n.n - k.df + 0.5) / (k.df + 0.5)), 6) AS score FROM h JOIN c USING (chunk_id), n, k)
SELECT chunk_id, path, 'all_terms' AS tier, score, row_number() OVER (ORDER BY score DESC, chunk_id, path)::INT AS rank FROM e ORDER BY rank LIMIT 100""")
def ladder_identifier(spark, sf_dir):
    """An identifier that must stand in the text: the commonest one of the documents."""
    ix = _index(spark, sf_dir)
    ix.names = keep(ix.names.where("field = 'identifier'"), "names")
    best = ix.names.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").first()
    name = best.value if best else "none-0"
    plan = P.Plan(name, "identifier", "ready", (P.Term(name, True, True),), stages=(P.Stage("all_terms", (0,)),))
    return ix.ladder(plan, limit=100)


@query(f"""{BASE} SELECT DISTINCT chunk_id FROM p WHERE field = 'content' AND term >= 'tha' AND term < 'the' UNION SELECT DISTINCT chunk_id FROM p WHERE field = 'tags' AND term > 'en'""")
def explicit_ranges(spark, sf_dir):
    """Terms between two, with either end in or out, and an open end."""
    return _index(spark, sf_dir).matches(P.parse_explicit("content:[tha TO the} OR tags:>en")).select("chunk_id")


@query(rf"""{BASE}, {SCORED}, t AS (SELECT chunk_id, sum(score) FILTER (WHERE term = 'the') AS a, sum(score) FILTER (WHERE term = 'and') AS b, bool_or(term = 'with') AS w FROM sc WHERE term IN ('the', 'and', 'with') GROUP BY chunk_id)
SELECT chunk_id, round(2.5 * a + coalesce(b, 0), 6) AS score FROM t WHERE a IS NOT NULL AND NOT w""")
def explicit_signs(spark, sf_dir):
    """What must match, boosted, what may, and what must not."""
    rows = _index(spark, sf_dir).matches(P.parse_explicit("+the^2.5 and -with"))
    return rows.select("chunk_id", F.round("score", 6).alias("score"))


@query(f"""WITH {C} SELECT chunk_id, path, vault_id, room, [heading] AS heading_path, left(content, 240) || CASE WHEN length(content) > 240 THEN '…' ELSE '' END AS excerpt FROM c WHERE doc_id = 17""")
def hit_shaping(spark, sf_dir):
    """A hit by its name: stored columns, and the start of the text where no word of the query stands in it."""
    hits = _index(spark, sf_dir).hits("17", limit=1)
    return hits.select("chunk_id", "path", "vault_id", "room", "heading_path", "excerpt")


IN_SCOPE = BASE.replace("c AS (SELECT 'c'", "c0 AS (SELECT 'c'").replace("text AS content FROM documents)", "text AS content FROM documents), c AS (SELECT * FROM c0 WHERE room = 'en' AND vault_id IN ('src1', 'src2'))")


@query(f"""{IN_SCOPE}, s AS (SELECT chunk_id, round({BM}, 6) AS score FROM p JOIN df USING (field, term) JOIN len USING (field, chunk_id) JOIN st USING (field), n WHERE term = 'that' AND field = 'content')
SELECT chunk_id, path, 'explicit' AS tier, score, row_number() OVER (ORDER BY score DESC, chunk_id, path)::INT AS rank FROM s JOIN c USING (chunk_id) ORDER BY rank LIMIT 30""")
def api_search(spark, sf_dir):
    """The request surface: a principal's resources bound what is read and what statistics see."""
    who = api.Principal((("src1", "en"), ("src2", "en")))
    return api.Corpus(document_chunks(spark, sf_dir)).search(api.SearchRequest("content:that", limit=30), who)


# Sources and chunks


@query(f"""WITH {C} SELECT vault_id, room, count(*)::BIGINT AS chunks, sum(length(content))::BIGINT AS characters, (count(*) FILTER (WHERE quality = 1))::BIGINT AS good FROM c LEFT JOIN labels USING (doc_id) GROUP BY vault_id, room""")
def chunks_with_sources(spark, sf_dir):
    """Chunks beside the facts of their sources."""
    c = document_chunks(spark, sf_dir).select("vault_id", "room", "content", F.regexp_replace("chunk_id", "^c", "s").alias("source_key"))
    rows = c.join(document_sources(spark, sf_dir).select("source_key", "quality"), "source_key")
    return rows.groupBy("vault_id", "room").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("characters"), F.count_if(F.col("quality") == 1).alias("good"))


BIG = 2**53


@query(f"""WITH j AS (SELECT o_orderkey, {BIG}::HUGEINT + o_orderkey % 5 AS n, CASE WHEN o_orderkey % 3 = 0 THEN 18446744073709551615::HUGEINT - o_orderkey % 7 END AS u FROM orders)
SELECT o_orderkey AS source_key, (CASE WHEN n >= {BIG + 1} AND n <= {BIG + 3} THEN 2 ELSE 0 END + CASE WHEN u >= 18446744073709551613::HUGEINT THEN 4 ELSE 0 END)::INT AS points FROM j""")
def whole_number_ranges(spark, sf_dir):
    """Ranges of whole numbers that doubles can't tell apart."""
    o = table(spark, sf_dir, "orders")
    u = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(', "u": '), (F.lit("18446744073709551615").cast("decimal(20,0)") - (F.col("o_orderkey") % 7)).cast("decimal(20,0)").cast("string"))).otherwise("")
    rows = o.select(F.col("o_orderkey").alias("source_key"), F.concat(F.lit('{"n": '), (F.lit(BIG) + F.col("o_orderkey") % 5).cast("string"), u, F.lit("}")).alias("j"))
    rules = [R.PropertyRule("n", "n", 2, "i64", low=BIG + 1, high=BIG + 3), R.PropertyRule("u", "u", 4, "u64", low=18446744073709551613)]
    return R.property_points(R.property_scalars(rows, "source_key", "j"), rules)


PROFILE = R.Profile(90, 2, 1, None, 1, (("en", 2), ("fr", -1)))


@query("""SELECT doc_id, array_to_string(list_filter(['depth=1', CASE WHEN lang = 'en' THEN 'folder=2' WHEN lang = 'fr' THEN 'folder=-1' END, CASE WHEN 1700000000 - doc_id * 3600 > 0 AND doc_id * 3600 <= 90 * 86400 THEN 'recency=2' END], lambda x: x IS NOT NULL), ' ') AS why FROM documents""")
def ranking_explained(spark, sf_dir):
    """Which signals of a profile moved a source, and by how much."""
    why = F.transform(R.explained(PROFILE, NOW), lambda s: F.concat(s["signal"], F.lit("="), s["points"].cast("string")))
    return document_sources(spark, sf_dir).select("doc_id", F.array_join(why, " ").alias("why"))


# Vectors


def _vectors(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    k = F.col("vec_id")
    return e.select(k.alias("chunk_id"), (k % 100).alias("source_key"), F.when(k % 100 < 50, "old").otherwise("same").alias("source_identity"), F.lit("hash/1/64").alias("fingerprint"), "label")


@query("""WITH v AS (SELECT vec_id AS chunk_id, vec_id % 100 AS source_key, CASE WHEN vec_id % 100 < 50 THEN 'old' ELSE 'same' END AS source_identity, label FROM embeddings)
SELECT chunk_id, source_key, source_identity, label FROM v WHERE NOT (source_key BETWEEN 30 AND 49 AND source_key % 2 = 0) UNION ALL SELECT chunk_id + 1000000, source_key, 'new', -1 FROM v WHERE source_key BETWEEN 30 AND 49 AND source_key % 2 = 0""")
def vector_replacement(spark, sf_dir):
    """Vectors of changed sources are replaced whole; a source whose identity is the same is left alone."""
    v = _vectors(spark, sf_dir)
    changed = v.where("source_key >= 30 AND chunk_id % 2 = 0").withColumns({"chunk_id": F.col("chunk_id") + 1000000, "label": F.lit(-1), "source_identity": F.when(F.col("source_key") < 50, "new").otherwise("same")})
    return V.replace_vectors(v, changed).select("chunk_id", "source_key", "source_identity", "label")


@query("SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id % 100 % 3 = 0 AND vec_id % 100 < 70")
def vector_upkeep(spark, sf_dir):
    """Vectors of sources that are gone leave, and all of another embedder."""
    v = _vectors(spark, sf_dir).withColumn("fingerprint", F.when(F.col("source_key") < 70, F.col("fingerprint")).otherwise("other/1/64"))
    live = v.select("source_key").distinct().where("source_key % 3 = 0")
    return V.fingerprint_matches(V.retain_vectors(v, live), "hash/1/64").select("chunk_id")


# Passes and streams


@query("""WITH RECURSIVE s AS (SELECT 's' || lpad(doc_id::VARCHAR, 10, '0') AS k, strlen(text)::BIGINT AS n FROM documents), o AS (SELECT k, n, row_number() OVER (ORDER BY k <= 's0000000120', k) AS i FROM s),
w AS (SELECT 0::BIGINT AS i, 0 AS taken, 60000::BIGINT AS rest, NULL::VARCHAR AS k UNION ALL SELECT o.i, w.taken + (o.n <= w.rest AND w.taken < 16)::INT, CASE WHEN o.n <= w.rest AND w.taken < 16 THEN w.rest - o.n ELSE w.rest END, CASE WHEN o.n <= w.rest AND w.taken < 16 THEN o.k END FROM w JOIN o ON o.i = w.i + 1)
SELECT k AS source_key FROM w WHERE k IS NOT NULL""")
def rolling_audit(spark, sf_dir):
    """The next 16 sources behind a cursor that fit a budget together; too large ones are passed over, however many."""
    return _frame(spark, [(k,) for k in M.rolling_audit(document_sources(spark, sf_dir), "s0000000120", budget=60000)], "source_key string")


@query("""SELECT doc_id, doc_id % 9 = 4 OR doc_id IN (5, 6) AS touched FROM documents""")
def scoped_pass(spark, sf_dir):
    """Touched paths and audited sources are read again; no candidate is left out."""
    s = document_sources(spark, sf_dir)
    touched = s.where("doc_id % 9 = 4").select("vault_id", "path")
    touched = touched.unionByName(touched).unionByName(touched.select(F.lit("elsewhere").alias("vault_id"), "path"))
    return M.with_scope(s, touched, ["s0000000005", "s0000000006"]).select("doc_id", "touched")


KINDS = ("edit", "create", "remove", "error", "config")


@query("""WITH e AS (SELECT event_id, ['edit', 'create', 'remove', 'error', 'config'][event_id % 5 + 1] AS kind, ['/w/a/', '/w/a/b/', '/x/', '/w/ab/'][event_id % 4 + 1] || 'f' || user_id AS path FROM events),
r AS (SELECT * FROM (VALUES ('one', '/w/a'), ('two', '/w/a/b'), ('three', '/x')) t(vault_id, root))
SELECT event_id, vault_id, CASE WHEN kind NOT IN ('error', 'config') THEN substring(path, length(root) + 2) END AS path, kind IN ('error', 'config') AS rescan FROM e JOIN r ON starts_with(path, root || '/') OR kind IN ('error', 'config')""")
def event_classification(spark, sf_dir):
    """An event touches a path under each root that holds it; errors and configuration rescan every vault."""
    e = table(spark, sf_dir, "events")
    at = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % n + 1).cast("int"))
    events = e.select("event_id", at(KINDS, 5).alias("kind"), F.concat(at(("/w/a/", "/w/a/b/", "/x/", "/w/ab/"), 4), F.lit("f"), F.col("user_id").cast("string")).alias("path"), "ts")
    roots = _frame(spark, [("one", "/w/a"), ("two", "/w/a/b"), ("three", "/x")], "vault_id string, root string")
    return ST.classify(events, roots, keep=("event_id",)).select("event_id", "vault_id", "path", "rescan")


@query("""WITH b AS (SELECT user_id, 'p' || event_id % 9 AS p, event_type = 'error' AND event_id % 11 = 0 AS said FROM events)
SELECT user_id AS vault_id, CASE WHEN bool_or(said) THEN [] ELSE list_sort(list(DISTINCT p)) END AS paths, bool_or(said) AS full_rescan FROM b GROUP BY user_id""")
def failed_pass_merged(spark, sf_dir):
    """The batch of a failed pass joins what came meanwhile."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("vault_id"), "event_id", F.concat(F.lit("p"), (F.col("event_id") % 9).cast("string")).alias("p"), ((F.col("event_type") == "error") & (F.col("event_id") % 11 == 0)).alias("said"))
    batch = lambda rows: rows.groupBy("vault_id").agg(F.collect_list("p").alias("paths"), F.bool_or("said").alias("full_rescan"))
    return ST.merge_back(batch(e.where("event_id % 2 = 0")), batch(e.where("event_id % 2 = 1")))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events), m AS (SELECT max(epoch_us(ts)) AS z FROM events)
SELECT user_id, unnest(range(1, ((coalesce(n, z) - t - 1) // 21600000000 + 1)::BIGINT)) * 21600000000 + t AS due_us FROM e, m WHERE (coalesce(n, z) - t - 1) // 21600000000 >= 1""")
def safety_passes(spark, sf_dir):
    """A full pass falls due wherever none ran for six hours."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    until = F.lit(e.agg(F.max("ts")).first()[0])
    due = ST.safety_passes(e, until, every=6 * 3600, key="user_id")
    return due.select("user_id", F.unix_micros("ts").alias("due_us"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'unavailable' WHEN o_orderkey % 7 = 0 THEN 'reconciling' WHEN o_orderkey % 300 > 120 THEN 'stale' ELSE 'current' END AS state FROM orders""")
def freshness_states(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", ST.freshness_state(F.when(k % 10 != 0, k % 300), k % 7 == 0).alias("state"))


@query(f"""{BATCHES}, k AS (SELECT user_id, batch, count(*)::BIGINT AS n_events, min(t) // 1000 AS first_ms FROM b GROUP BY ALL), l AS (SELECT *, max(batch) OVER (PARTITION BY user_id) AS last FROM k)
SELECT 'u' || user_id AS vault_id, n_events, first_ms::BIGINT AS first_ms FROM l WHERE batch < last""".replace("epoch_us(ts) // 100000", "epoch_us(ts) // 100000 // 1000 * 1000"))
def streamed_batches(spark, sf_dir):
    """The debounce rule as a stream with state: every batch that a later event has ended."""
    root = scratch(spark, "stream")
    e = _close_events(spark, sf_dir).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("vault_id"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), "ts", F.lit(False).alias("rescan"))
    e.coalesce(1).write.parquet(f"{root}/in")
    events = spark.readStream.schema(e.schema).parquet(f"{root}/in")
    done = ST.run_reconcile(ST.pending_batches(events), lambda frame, epoch: frame.write.mode("append").parquet(f"{root}/out"), f"{root}/state", available_now=False)
    ST.drain(done)
    out = spark.read.parquet(f"{root}/out").select("vault_id", "n_events", "first_ms")
    # what the end of the stream closes by time is not said by any event: the last batch of a vault
    return out.join(_ended(e), "vault_id").where("first_ms < last_first").drop("last_first")


def _ended(events: DataFrame) -> DataFrame:
    """When each vault's last batch begins, by the rule over the finished table."""
    timed = events.withColumns({"ts": F.timestamp_millis(F.unix_millis("ts")), "event_id": F.col("path")})
    return ST.debounce_batches(timed).groupBy("vault_id").agg(F.unix_millis(F.max("first_ts")).alias("last_first"))
