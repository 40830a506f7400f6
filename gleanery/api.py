"""The request surface: one search call with three modes, and status; no server."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import manifest, semantic
from .operators.search import Filters, Index
from .plans.planner import QueryError

MODES = ("lexical", "semantic", "hybrid")


@dataclass(frozen=True)
class Principal:
    """Who asks, already verified: the (vault, room) pairs that may be read, and a limit."""

    resources: tuple[tuple[str, str | None], ...] | None = None
    max_limit: int = 100


MAX_RESOURCES, MAX_LIMIT = 256, 100
SEARCH = "search"


@dataclass(frozen=True)
class CapabilityRules:
    """What the claims of a capability must say. Its signature is verified where it comes in, not here."""

    issuer: str
    audience: str
    tenant: str
    max_ttl_seconds: int

    def principal(self, claims: dict, now: int) -> Principal:
        """Who the claims name; raises ``unauthorized`` for a capability that is not valid now, ``forbidden`` for one that asks too much."""
        text = {k: str(claims.get(k, "")).strip() for k in ("iss", "aud", "sub", "actor", "jti", "tenant")}
        issued, begins, ends = (int(claims.get(k, 0)) for k in ("iat", "nbf", "exp"))
        named = (text["iss"], text["aud"]) == (self.issuer, self.audience) and all(text[k] for k in ("sub", "actor", "jti")) and text["sub"] != text["actor"]
        in_time = max(issued, begins) <= now < ends and 0 <= ends - issued <= self.max_ttl_seconds and begins <= ends
        if not (named and in_time):
            raise QueryError("unauthorized", "the capability is not valid")
        resources = [tuple(map(str, r)) for r in claims.get("resources", [])]
        whole = all(t == self.tenant and t.strip() and v.strip() and r.strip() for t, v, r in resources) and len(set(resources)) == len(resources)
        bounded = 1 <= len(resources) <= MAX_RESOURCES and 1 <= int(claims.get("max_limit", 0)) <= MAX_LIMIT
        if text["tenant"] != self.tenant or claims.get("actions") != [SEARCH] or not (whole and bounded):
            raise QueryError("forbidden", "the capability does not allow this search")
        return Principal(tuple(sorted((v, r) for _, v, r in resources)), int(claims["max_limit"]))


@dataclass(frozen=True)
class SearchRequest:
    q: str
    mode: str = "lexical"
    limit: int = 20
    cursor: str | None = None
    vault_id: str | None = None
    room: str | None = None
    path_prefix: str | None = None
    tags: tuple[str, ...] = ()
    frontmatter: dict[str, str] = field(default_factory=dict)

    def validate(self, modes: tuple[str, ...] = MODES, principal: Principal = Principal()) -> Filters:
        if not self.q.strip():
            raise QueryError("invalid_query", "the query is empty")
        if self.mode not in modes:
            raise QueryError("mode_unavailable", f"{self.mode} is not available")
        if not 1 <= self.limit <= min(100, principal.max_limit):
            raise QueryError("invalid_limit", "the limit is out of bounds")
        if self.cursor is not None:
            raise QueryError("invalid_cursor", "results have no further pages")
        return Filters(self.vault_id, self.room, self.path_prefix, tuple(self.tags), dict(self.frontmatter))


class Corpus:
    """Chunks and, where there are any, vectors (chunk_id, embedding) with the function that embeds a query.

    ``read`` gives a generation's stored tables by name (``Generations.reader``): searches then read the stored index.
    """

    def __init__(self, chunks: DataFrame | None = None, vectors: DataFrame | None = None, embed_query=None, read=None):
        self.chunks, self.vectors, self.embed_query, self.read = chunks, vectors, embed_query, read
        self.modes = MODES if vectors is not None and embed_query is not None else MODES[:1]

    def _semantic(self, request: SearchRequest, filters: Filters, index: Index, limit: int) -> DataFrame:
        # authorised and filtered before distances are looked at
        live = index.chunks.where(filters.condition()).select("chunk_id", "path")
        some = self.vectors.join(live.select("chunk_id"), "chunk_id", "left_semi")
        found = semantic.knn(some, self.embed_query(request.q), limit, id_col="chunk_id")
        return F.broadcast(found).join(live, "chunk_id").withColumn("tier", F.lit("semantic"))

    def search(self, request: SearchRequest, principal: Principal = Principal()) -> DataFrame:
        """chunk_id, path, tier, score and rank."""
        filters = request.validate(self.modes, principal)
        resources = list(principal.resources) if principal.resources is not None else None
        index = Index.opened(self.read, resources) if self.read else Index(self.chunks, resources=resources)
        columns = ("chunk_id", "path", "tier", "score", "rank")
        if request.mode == "lexical":
            return index.search(request.q, filters, request.limit).select(*columns)
        if request.mode == "semantic":
            return self._semantic(request, filters, index, request.limit).select(*columns)
        lexical = index.search(request.q, filters, semantic.LEG)
        fused = semantic.fuse(lexical, self._semantic(request, filters, index, semantic.LEG), limit=request.limit)
        return F.broadcast(fused).join(index.chunks.select("chunk_id", "path"), "chunk_id").withColumn("tier", F.lit("hybrid")).select(*columns)

    def status(self, sources: DataFrame) -> DataFrame:
        return manifest.vault_status(sources)
