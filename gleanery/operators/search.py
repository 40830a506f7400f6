"""Lexical search: the evidence ladder over an inverted index.

Two jobs a query, whatever its number of terms: one answers all probes
(document frequencies, identifiers, prefix expansions, the metadata probe), one
runs the union of at most six stages. Stages fill the result window in order; a
chunk counts for the first stage that finds it.

An index is either made from chunks or opened from stored tables. One that is
made reads its chunks once a query: what the query asks for is kept in the
shared folder, and all its probes and stages read that. Stored postings are sorted by term and carry their field's length, so a query reads
its own terms' row groups and a few rows of statistics, and shuffles hits only.

Scores are BM25 per field, the best field per token, summed over tokens;
rounded to six places before ordering, ties by chunk id and path.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import excerpt, highlight_terms, normalize_text, snippet, tokenize
from ..plans import planner as P
from ..session import keep
from . import index as I
from .manifest import PARTITION, partition_id

K1, B = 1.2, 0.75
DIGITS = 6


@dataclass(frozen=True)
class Filters:
    """Filters of a request; they never change scores or statistics."""

    vault_id: str | None = None
    room: str | None = None
    path_prefix: str | None = None
    tags: tuple[str, ...] = ()
    frontmatter: dict[str, str] = field(default_factory=dict)

    ALLOWED = ("title", "description", "status", "date")

    def __post_init__(self):
        p = self.path_prefix
        if p is not None and (p.startswith("/") or ".." in p.split("/") or "//" in p):
            raise P.QueryError("invalid_filter", "the path prefix is not a normalised relative path")
        if unknown := set(self.frontmatter) - set(self.ALLOWED):
            raise P.QueryError("invalid_filter", f"no filter on {sorted(unknown)}")

    @property
    def of_chunks(self) -> bool:
        """Whether it asks for more than postings know."""
        return bool(self.tags or self.frontmatter)

    def place(self) -> Column:
        """What vault, room and path alone decide."""
        out = F.lit(True)
        if self.vault_id is not None:
            out &= F.col("vault_id") == self.vault_id
        if self.room is not None:
            out &= F.col("room") == self.room
        if self.path_prefix:
            out &= F.startswith(F.col("path"), F.lit(self.path_prefix))
        return out

    def condition(self) -> Column:
        out = self.place()
        if self.tags:
            out &= F.forall(F.array(*map(F.lit, self.tags)), lambda t: F.array_contains("tags", t))
        for k, v in self.frontmatter.items():
            out &= F.coalesce(F.col(k), F.lit("")) == v
        return out


def bm25(tf: Column, length: Column, df: Column, n: Column, total: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / (total / n)))


def authorised(frame: DataFrame, resources: list[tuple[str, str | None]] | None, tenant: str = "local") -> DataFrame:
    """Rows of the named (vault, room) pairs alone; None: all. Before any statistic; stored tables by folder."""
    if resources is None:
        return frame
    allowed = F.lit(False)
    for vault, room in dict.fromkeys(resources):
        allowed |= (F.col("vault_id") == vault) & F.col("room").eqNullSafe(F.lit(room))
    if PARTITION in frame.columns:
        allowed &= F.col(PARTITION).isin([partition_id(tenant, *r) for r in dict.fromkeys(resources)])
    return frame.where(allowed)


def _back(places: int):
    return lambda x: x - places


CHUNK = ["chunk_id", "path"]
EVERYWHERE = Filters()


class Index:
    """The tables that a query reads, for one set of resources."""

    def __init__(self, chunks: DataFrame, field_postings: DataFrame | None = None, resources=None, stored: dict[str, DataFrame] | None = None):
        self.chunks = authorised(chunks, resources)
        #: Whether postings are still to be made of the chunks
        self.open = stored is None and field_postings is None
        # N is the number of chunks in scope, for every field
        if stored is not None:
            self.postings, self.names, words, stats, scopes = (authorised(stored[t], resources) for t in ("postings", "names", "vocabulary", "stats", "scopes"))
            self.totals = stats.groupBy("field").agg(F.sum("total_len").alias("total_len"))
            self.scope = scopes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
            self.words = words.groupBy("term").agg(F.max("in_metadata").alias("named"))
            return
        self.names = I.exact_rows(self.chunks, I.SCOPE)
        self.scope = self.chunks.agg(F.count("*").alias("n"))
        self._use(authorised(field_postings, resources) if field_postings is not None else I.postings(I.fields(self.chunks)))

    def _use(self, rows: DataFrame) -> None:
        self.postings = rows
        self.totals = rows.groupBy("field").agg(F.sum("tf").alias("total_len"))
        self.words = rows.groupBy("term").agg(F.max((F.col("field") != "content").cast("int")).alias("named"))

    @classmethod
    def opened(cls, read, resources=None) -> Index:
        """Opens what a generation holds; ``read`` gives a table by its name."""
        return cls(read("chunks"), resources=resources, stored={t: read(t) for t in I.STORED})

    def cached(self) -> Index:
        self._use(self.postings.cache())
        self.open = False
        return self

    def asked(self, fields: dict[str, I.Asked], names: set[str] = frozenset()) -> Index:
        """An index that is made: the same with the rows alone that a query asks for. Any other: itself."""
        if not self.open:
            return self
        out = copy.copy(self)
        out.open = False
        if fields:
            rows = keep(I.asked_postings(I.fields(self.chunks), fields), "hits")
            out._use(I.hit_postings(rows))
            out.totals = rows.groupBy("field").agg(F.sum("len").alias("total_len"))
        if names:
            every = self.names if any(map(I.may_be_identifier, names)) else I.exact_rows(self.chunks, I.SCOPE, False)
            out.names = keep(every.where(F.col("value").isin(sorted(names))), "names")
        return out

    def _asked_by(self, plan: P.Plan, fields: tuple[str, ...] = P.TEXT_FIELDS) -> Index:
        """What a plan's probes and stages read."""
        words = {x for t in plan.terms if not t.identifier for x in tokenize(t.text)} | {x for v in plan.expansions.values() for x in v}
        one = I.Asked(frozenset(words), frozenset(_stems(plan).values() if plan.execution == "awaiting_evidence" else ()))
        names = {t.text for t in plan.terms if t.identifier} | {plan.exact} - {None}
        return self.asked(dict.fromkeys(fields, one) if words or one.starts else {}, names)

    def _of(self, tokens: list[str], fields: tuple[str, ...]) -> DataFrame:
        return self.postings.where(F.col("term").isin(tokens) & F.col("field").isin(*fields))

    def _with_stats(self, rows: DataFrame) -> DataFrame:
        """One row of statistics per field, and the number of chunks."""
        return rows.join(F.broadcast(self.totals), "field").join(F.broadcast(self.scope))

    def scored(self, tokens: list[str], fields: tuple[str, ...], weights: dict[str, float] = P.WEIGHTS, within: Filters = EVERYWHERE) -> DataFrame:
        """(chunk_id, path, term, score): the best weighted field per token."""
        hits = self._of(tokens, fields)
        # at most a row for each token and field
        df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
        rows = self._with_stats(hits.where(within.place()).select(*CHUNK, "field", "term", "tf", "len").join(F.broadcast(df), ["field", "term"]))
        weight = F.element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))]), F.col("field"))
        score = weight * bm25(F.col("tf"), F.col("len"), F.col("df"), F.col("n"), F.col("total_len"))
        return rows.groupBy(*CHUNK, "term").agg(F.max(score).alias("score"))

    def identifier_hits(self, names: list[str], within: Filters = EVERYWHERE) -> DataFrame:
        rows = self.names.where((F.col("field") == "identifier") & F.col("value").isin(names))
        df = rows.groupBy("value").agg(F.count("*").alias("df"))
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        rows = rows.where(within.place()).join(F.broadcast(df), "value").join(F.broadcast(self.scope))
        return rows.select(*CHUNK, F.col("value").alias("term"), (P.IDENTIFIER_WEIGHT * idf).alias("score"))

    # Evidence

    def evidence(self, plan: P.Plan) -> P.Evidence:
        """All probes of a plan in one job."""
        if plan.execution != "awaiting_evidence":
            return P.Evidence({})
        wanted = {i: tokenize(t.text) for i, t in enumerate(plan.terms) if not t.identifier}
        names = {t.text: i for i, t in enumerate(plan.terms) if t.identifier}
        every = sorted({x for v in wanted.values() for x in v})
        stems = _stems(plan)
        self = self._asked_by(plan)
        parts = []
        if every:
            parts.append(self._frequencies(wanted, every, plan.metadata_probe))
        if names:
            found = self.names.where((F.col("field") == "identifier") & F.col("value").isin(list(names))).groupBy("value").agg(F.count("*").alias("n"))
            parts.append(found.select(F.lit("identifier").alias("kind"), F.lit(-1).alias("i"), F.col("value").alias("term"), "n"))
        if stems:
            at = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("stem")) for i, v in stems.items()])
            starts = F.filter(at, lambda x: F.startswith(F.col("term"), x["stem"]))
            one_of = F.lit(False)
            for v in stems.values():
                one_of |= F.startswith("term", F.lit(v))
            rows = self.words.where(one_of).select("term", "named", F.explode(starts).alias("s")).select("s.i", "term", "named")
            parts.append(_expanded(rows, "i").select(F.lit("expansion").alias("kind"), "i", "term", F.lit(0).cast("long").alias("n")))
        if not parts:
            return P.Evidence({})
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        # at most a row for each term and MAX_EXPANSIONS for each prefix
        frequency, expansions, match = dict.fromkeys(wanted, 0) | dict.fromkeys(names.values(), 0), {}, False
        for r in rows.collect():
            if r.kind == "frequency":
                frequency[r.i] = r.n
            elif r.kind == "identifier":
                frequency[names[r.term]] = r.n
            elif r.kind == "probe":
                match = r.n > 0
            else:
                expansions.setdefault(r.i, []).append(r.term)
        expansions = {i: tuple(sorted(v)) for i, v in expansions.items() if any(len(t) > len(stems[i]) for t in v)}
        return P.Evidence(frequency, expansions, match)

    def _frequencies(self, wanted: dict[int, list[str]], every: list[str], probe: bool) -> DataFrame:
        """Rows (frequency, term's number, chunks that hold all its tokens), and whether some chunk's names hold all tokens."""
        has = lambda column, words: F.forall(F.array(*map(F.lit, words)), lambda x: F.array_contains(column, x)).cast("long")
        rows = self.postings.where(F.col("term").isin(every)).groupBy("chunk_id").agg(F.collect_set("term").alias("terms"), F.collect_set(F.when(F.col("field") != "content", F.col("term"))).alias("named"))
        asked = [("frequency", i, has("terms", v)) for i, v in wanted.items() if v]
        if probe:
            asked.append(("probe", -1, has("named", every)))
        sums = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"c{k}") for k, (_, _, c) in enumerate(asked)])
        out = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("i"), F.lit("").alias("term"), F.col(f"c{k}").alias("n")) for k, (kind, i, _) in enumerate(asked)])
        return sums.select(F.explode(out).alias("r")).select("r.*")

    def expansions(self, prefix: str) -> DataFrame:
        """Of the first terms in byte order that start so, those kept: metadata terms first, short, then in order."""
        self = self.asked(dict.fromkeys(P.TEXT_FIELDS, I.Asked(ranges=frozenset([prefix]))))
        found = self.words.where(F.startswith("term", F.lit(prefix))).select(F.lit(0).alias("i"), "term", "named")
        return _expanded(found, "i").select("term", "named")

    # Stages: frames of (chunk_id, path, score)

    def all_terms(self, terms: list[P.Term], fields: tuple[str, ...] = P.TEXT_FIELDS, within: Filters = EVERYWHERE) -> DataFrame:
        """Every token of every term; the sum of the tokens' scores."""
        parts = [(tokenize(t.text), t) for t in terms]
        words = sorted({x for v, t in parts if not t.identifier for x in v})
        names = sorted({t.text for _, t in parts if t.identifier})
        if any(not v and not t.identifier for v, t in parts):
            return self._none()
        self = self.asked(dict.fromkeys(fields, I.Asked(frozenset(words))) if words else {}, set(names))
        hits = [self.scored(words, fields, within=within)] if words else []
        hits += [self.identifier_hits(names, within)] if names else []
        if not hits:
            return self._none()
        rows = hits[0] if len(hits) == 1 else hits[0].unionByName(hits[1])
        return rows.groupBy(*CHUNK).agg(F.count("*").alias("k"), F.sum("score").alias("score")).where(F.col("k") == len(words) + len(names)).select(*CHUNK, "score")

    def _none(self) -> DataFrame:
        return self.chunks.select(*CHUNK, F.lit(0.0).alias("score")).where(F.lit(False))

    def phrase(self, terms: list[str], fields: tuple[str, ...] = P.TEXT_FIELDS, within: Filters = EVERYWHERE) -> DataFrame:
        """Adjacent tokens in one field: the terms' idf by the phrase's frequency, the best field."""
        words = [x for t in terms for x in tokenize(t)]
        if not words:
            return self._none()
        self = self.asked(dict.fromkeys(fields, I.Asked(frozenset(words))))
        some = self._of(sorted(set(words)), fields)
        df = some.groupBy("field", "term").agg(F.count("*").alias("df"))
        rows = some.where(within.place()).select(*CHUNK, "field", "term", "positions", "len").join(F.broadcast(df), ["field", "term"])
        rows = rows.groupBy("field", *CHUNK, "len").agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("positions", "df")))).alias("m"))
        at = lambda w: F.element_at("m", F.lit(w))
        starts = at(words[0])["positions"]
        for i, w in enumerate(words[1:], 1):
            starts = F.array_intersect(starts, F.transform(at(w)["positions"], _back(i)))
        rows = self._with_stats(rows.where(F.size("m") == len(set(words))).withColumn("tf", F.size(starts)).where("tf > 0"))
        idf = sum((F.log(1 + (F.col("n") - at(w)["df"] + 0.5) / (at(w)["df"] + 0.5)) for w in words), F.lit(0.0))
        part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / (F.col("total_len") / F.col("n"))))
        weight = F.element_at(F.create_map(*[x for k, v in P.WEIGHTS.items() for x in (F.lit(k), F.lit(v * P.PHRASE_WEIGHT))]), F.col("field"))
        return rows.groupBy(*CHUNK).agg(F.max(weight * idf * part).alias("score"))

    def exact(self, value: str, within: Filters = EVERYWHERE) -> DataFrame:
        """Equality with a name, title, heading or identifier: the best of fixed weights."""
        self = self.asked({}, {value})
        weight = F.element_at(F.create_map(*[x for k, v in P.EXACT_WEIGHTS.items() for x in (F.lit(k), F.lit(v))]), F.col("field"))
        return self.names.where((F.col("value") == value) & within.place()).groupBy(*CHUNK).agg(F.max(weight).alias("score"))

    def prefixed(self, plan: P.Plan, stage: P.Stage, fields: tuple[str, ...], within: Filters = EVERYWHERE) -> DataFrame:
        """Required terms, and for each prefix term its best expansion."""
        groups = [(i, sorted(set(plan.expansions[i]))) for i in stage.prefixes]
        parts = [self.scored(v, fields, within=within).groupBy(*CHUNK).agg(F.max("score").alias("score")) for _, v in groups]
        if stage.required:
            parts.append(self.all_terms([plan.terms[i] for i in stage.required], fields, within))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return rows.groupBy(*CHUNK).agg(F.count("*").alias("k"), F.sum("score").alias("score")).where(F.col("k") == len(parts)).select(*CHUNK, "score")

    def _stage(self, plan: P.Plan, stage: P.Stage, within: Filters) -> DataFrame:
        if stage.kind == "exact_metadata":
            return self.exact(plan.exact, within)
        if stage.kind == "exact_phrase":
            return self.phrase([t.text for t in plan.terms], within=within)
        if stage.kind in ("prefix", "prefix_metadata"):
            return self.prefixed(plan, stage, P.TEXT_FIELDS if stage.kind == "prefix" else P.NAME_FIELDS, within)
        return self.all_terms([plan.terms[i] for i in stage.required], within=within)

    def _live(self, rows: DataFrame, filters: Filters) -> DataFrame:
        """Hits that the request's filters let through: chunks are looked at only where their own columns are asked for."""
        if filters.of_chunks:
            rows = rows.join(self.chunks.where(filters.condition()).select("chunk_id"), "chunk_id", "left_semi")
        return rows.withColumn("score", F.round("score", DIGITS))

    def candidates(self, plan: P.Plan, filters: Filters = EVERYWHERE) -> DataFrame:
        """What the stages find, at most 6 * 256 rows: tier_no, chunk_id, path, score, and the stage's limit."""
        self = self._asked_by(plan)
        frames = []
        anchors = [t for t in plan.terms if t.anchor]
        eligible = self.all_terms(anchors, within=filters).select("chunk_id") if anchors else None
        for stage in plan.stages:
            rows = self._live(self._stage(plan, stage, filters), filters)
            if eligible is not None:
                rows = rows.join(eligible, "chunk_id", "left_semi")
            rows = rows.orderBy(F.desc("score"), *CHUNK).limit(stage.limit)
            frames.append(rows.select(*CHUNK, "score", F.lit(P.STAGES.index(stage.kind)).alias("tier_no"), F.lit(stage.limit).alias("stage_limit")))
        if not frames:
            return self._none().select(*CHUNK, "score", F.lit(0).alias("tier_no"), F.lit(0).alias("stage_limit"))
        rows = frames[0]
        for f in frames[1:]:
            rows = rows.unionByName(f)
        return rows

    def ladder(self, plan: P.Plan, filters: Filters = EVERYWHERE, limit: int = 20) -> DataFrame:
        """chunk_id, path, tier (the stage's name), score and rank of the first ``limit`` chunks."""
        # a stage may add what the candidate budget leaves; hits count before they are deduplicated
        order = Window.orderBy("tier_no", F.desc("score"), *CHUNK)
        rows = self.candidates(plan, filters).withColumn("place", F.row_number().over(order)).where(F.col("place") <= P.TOTAL_CANDIDATES)
        first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("chunk_id").orderBy("place"))).where("nth = 1")
        names = F.array(*map(F.lit, P.STAGES))
        out = first.withColumn("rank", F.row_number().over(Window.orderBy("place"))).where(F.col("rank") <= limit)
        return out.select(*CHUNK, F.element_at(names, F.col("tier_no") + 1).alias("tier"), "score", "rank")

    def matches(self, node: tuple, within: Filters = EVERYWHERE) -> DataFrame:
        """(chunk_id, path, score) of an explicit query's tree: set operations over match sets."""
        self = self.asked(_asked_by_tree(node))
        kind = node[0]
        if kind == "and":
            a, b = self.matches(node[1], within), self.matches(node[2], within)
            return a.join(b.withColumnRenamed("score", "score2"), CHUNK).select(*CHUNK, (F.col("score") + F.col("score2")).alias("score"))
        if kind == "or":
            return self.matches(node[1], within).unionByName(self.matches(node[2], within)).groupBy(*CHUNK).agg(F.sum("score").alias("score"))
        if kind == "not":
            return self.matches(node[1], within).join(self.matches(node[2], within), "chunk_id", "left_anti")
        if kind == "should":  # what is asked for stays; what else matches adds to its score
            a, b = self.matches(node[1], within), self.matches(node[2], within).withColumnRenamed("score", "score2")
            return a.join(b, CHUNK, "left").select(*CHUNK, (F.col("score") + F.coalesce("score2", F.lit(0.0))).alias("score"))
        if kind == "boost":
            return self.matches(node[1], within).withColumn("score", F.col("score") * F.lit(float(node[2])))
        if kind == "every":
            return self.chunks.where(within.place()).select(*CHUNK, F.lit(1.0).alias("score"))
        if kind == "range":
            return self._range(*node[1:], within)
        _, name, value = node
        if name == "path":
            wanted = value if kind != "phrase" else " ".join(value)
            return self.chunks.where(F.contains(F.lower("path"), F.lit(wanted)) & within.place()).select(*CHUNK, F.lit(1.0).alias("score"))
        fields = (name,) if name else P.TEXT_FIELDS
        if kind == "prefix":
            words = self.postings.where(F.startswith("term", F.lit(value)) & F.col("field").isin(*fields) & within.place())
            return words.groupBy(*CHUNK).agg(F.lit(1.0).alias("score"))
        if kind == "phrase":
            return self.phrase(list(value), fields, within)
        return self.all_terms([P.Term(value)], fields, within)

    def _range(self, name: str | None, low: str | None, high: str | None, low_in: bool, high_in: bool, within: Filters) -> DataFrame:
        """Chunks with a term between two, in the order of their bytes; an open end is None."""
        inside = F.col("field").isin(name) if name else F.col("field").isin(*P.TEXT_FIELDS)
        inside &= I.in_range(F.col("term"), low, high, low_in, high_in)
        return self.postings.where(inside & within.place()).groupBy(*CHUNK).agg(F.lit(1.0).alias("score"))

    def explicit(self, query: str, filters: Filters = EVERYWHERE, limit: int = 20) -> DataFrame:
        rows = self._live(self.matches(P.parse_explicit(query), filters), filters)
        rows = rows.orderBy(F.desc("score"), *CHUNK).limit(limit)
        return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *CHUNK))).select(*CHUNK, F.lit("explicit").alias("tier"), "score", "rank")

    def search(self, query: str, filters: Filters = EVERYWHERE, limit: int = 20) -> DataFrame:
        """Any query text: planned, probed and answered."""
        if not 1 <= limit <= 100:
            raise P.QueryError("invalid_limit", "the limit lies in 1 to 100")
        plan = P.prepare(query)
        if plan.execution == "explicit_bypass":
            return self.explicit(query, filters, limit)
        ix = self._asked_by(plan)
        return ix.ladder(P.finalize(plan, ix.evidence(plan)), filters, limit)

    def hits(self, query: str, filters: Filters = EVERYWHERE, limit: int = 20) -> DataFrame:
        """Search hits with what a reader is shown; contents are joined for final rows only.

        The excerpt is the window round the first word of the query, marked; without one, the start of the text.
        A stored row that isn't where the index says fails the query.
        """
        found = self.search(query, filters, limit)
        columns = [c for c in ("vault_id", "room", "heading_path", "format", "coverage", "locator", "title") if c in self.chunks.columns]
        shown = self.chunks.select("chunk_id", F.col("path").alias("stored_path"), *columns, "content")
        rows = F.broadcast(found).join(shown, "chunk_id")
        same = F.when(F.col("path") == F.col("stored_path"), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("the index and the stored chunk differ: "), "chunk_id")))
        marked = F.coalesce(snippet(highlight_terms(query))(F.col("content")), excerpt(F.col("content")))
        return rows.select("chunk_id", same.alias("path"), "tier", "score", "rank", *columns, marked.alias("excerpt")).orderBy("rank")


def _stems(plan: P.Plan) -> dict[int, str]:
    """The terms whose expansions a plan asks for, by their numbers."""
    words = {i: tokenize(t.text) for i, t in enumerate(plan.terms) if not t.identifier}
    stems = {i: v[0] for i, v in words.items() if len(v) == 1 and len(plan.terms[i].text) >= P.MIN_PREFIX_CHARS and not plan.terms[i].anchor}
    return dict(list(stems.items())[: P.MAX_PREFIX_TERMS])


def _asked_by_tree(node: tuple) -> dict[str, I.Asked]:
    """What an explicit query's tree asks of each field."""
    kind = node[0]
    if kind in ("and", "or", "not", "should", "boost"):
        out: dict[str, I.Asked] = {}
        for part in node[1 : 2 if kind == "boost" else 3]:
            for f, a in _asked_by_tree(part).items():
                out[f] = out.get(f, I.Asked()) | a
        return out
    if kind == "every" or node[1] == "path":
        return {}
    if kind == "range":
        one = I.Asked(ranges=frozenset([tuple(node[2:])]))
    elif kind == "prefix":
        one = I.Asked(ranges=frozenset([node[2]]))
    else:
        one = I.Asked(frozenset(x for t in (node[2] if kind == "phrase" else [node[2]]) for x in tokenize(t)))
    return dict.fromkeys((node[1],) if node[1] else P.TEXT_FIELDS, one)


def _expanded(rows: DataFrame, by: str) -> DataFrame:
    """Of (by, term, named): the first ``EXPANSION_SCAN`` terms in byte order, of them ``MAX_EXPANSIONS``: metadata terms first, short, in order."""
    scan = rows.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy("term"))).where(F.col("nth") <= P.EXPANSION_SCAN)
    best = scan.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("named"), F.length("term"), "term")))
    return best.where(F.col("nth") <= P.MAX_EXPANSIONS).select(by, "term", "named")


def candidate_window(stages: list[tuple[int, list[str]]], limit: int, most: int = P.TOTAL_CANDIDATES) -> tuple[str, int]:
    """What a result window says of what lies beyond it, from each stage's limit and its hits in order.

    ``more_available``: a stage found a chunk that no longer fits;
    ``candidate_limit_reached``: a stage ended at its limit, so more may lie
    behind it; ``exhausted``: every stage was searched to its end; ``unknown``:
    the window is full and stages are left. Beside it the candidates counted.
    """
    shown: dict[str, None] = {}
    counted, cut = 0, False
    for number, (stage_limit, hits) in enumerate(stages, 1):
        room = min(stage_limit, most - counted)
        if room < 1:
            return "candidate_limit_reached", counted
        hits = hits[:room]
        counted += len(hits)
        cut |= len(hits) == room
        new = [h for h in dict.fromkeys(hits) if h not in shown]
        shown |= dict.fromkeys(new[: limit - len(shown)])
        if any(h not in shown for h in new):
            return "more_available", counted
        if len(shown) == limit and not cut and number < len(stages):
            return "unknown", counted
        if len(shown) == limit:
            break
    return ("candidate_limit_reached" if cut else "exhausted"), counted


def typo_suggestion(vocabulary: DataFrame, query: str) -> DataFrame:
    """The commonest term one edit away, among the commonest ``TYPO_CANDIDATES`` that share the prefix.

    ``vocabulary``: (term, df), df the sum over fields (``index.typo_vocabulary``).
    """
    word = P.typo_word(query)
    if word is None:
        return vocabulary.where(F.lit(False)).select("term", "df")
    near = vocabulary.where(F.startswith("term", F.lit(word[: P.TYPO_PREFIX])) & (F.octet_length("term") <= P.TYPO_CANDIDATE_BYTES) & F.col("term").rlike("^[a-z]+$"))
    window = near.select("term", "df").orderBy(F.desc("df"), "term").limit(P.TYPO_CANDIDATES)
    return window.where(F.levenshtein("term", F.lit(word)) == 1).orderBy(F.desc("df"), "term").limit(1)


def group_sources(hits: DataFrame, limit: int = 20) -> DataFrame:
    """Hits of one source under its first hit, sources in order of first hits."""
    by = Window.partitionBy("vault_id", "path")
    rows = hits.withColumns({"first": F.min("rank").over(by), "hits": F.count("*").over(by)}).where("rank = first")
    return rows.withColumn("group", F.dense_rank().over(Window.orderBy("first"))).where(F.col("group") <= limit).select("group", "vault_id", "path", "hits", F.col("first").alias("best_rank"))


def normalise_query(query: str) -> str | None:
    return normalize_text(query)
