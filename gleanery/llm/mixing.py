"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a keyed hash and get running word counts.
A copy's virtual finish time is that count with the copy's own words, carried
on over repeat passes, divided by the source's target, so every source would
spend its target at time 1. The copies of all sources are ordered by virtual
finish time over the whole corpus, and the order is cut where the total budget
is spent: copies before the cut are taken whole. The copy that stands across it
is taken if that comes nearer to the budget. So a source's words differ from
its share of the budget by less than one document.

Scale. Running sums have three levels: rows are ordered inside hash ranges of
about ``rows_per_range`` rows only, ranges are summed, and ``GROUP`` ranges at
a time are summed again, so a source with a third of all rows spreads over
many tasks and no window holds more than a group, or a row for each group.
Copies that finish so late that the cut can't reach them are left out of the
queue. No text is shuffled for the plan: sizes are counted once and kept by a
checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import WORD

KEY = "__row_key"
GROUP = 1024


def _ahead(sums: DataFrame, keys: list[str], at: str, value: str, into: str) -> DataFrame:
    """Rows (keys, at) with the sum of ``value`` over smaller ``at``, by way of groups of ``GROUP``; keys are not null."""
    rows = sums.withColumn("__group", F.floor(F.col(at) / GROUP))
    before = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    groups = rows.groupBy(*keys, "__group").agg(F.sum(value).alias("__sum"))
    groups = groups.select(*keys, "__group", F.coalesce(F.sum("__sum").over(before(keys, "__group")), F.lit(0)).alias("__far"))
    rows = rows.withColumn("__near", F.coalesce(F.sum(value).over(before([*keys, "__group"], at)), F.lit(0)))
    return rows.join(groups, [*keys, "__group"]).select(*keys, at, (F.col("__far") + F.col("__near")).alias(into))


def _targets(stats: DataFrame, weights: Sequence[float], max_repeats: int) -> DataFrame:
    """One row per source: its weight, and its target by water-filling.

    A source is capped when the level that the sources with smaller cap-to-weight
    ratios leave would lift it to its cap or above; the rest share by weight.
    """
    order = Window.orderBy(F.col("__s").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = stats.withColumn("__w", w).withColumn("__cap", F.lit(max_repeats) * F.col("source_size"))
    by = Window.orderBy((F.col("__cap") / F.col("__w")).asc(), F.col("__s").asc_nulls_last())
    before, every = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({
        "__level": (F.sum("source_size").over(every) - F.coalesce(F.sum("__cap").over(before), F.lit(0))) / (F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))),
    })
    s = s.withColumn("__capped", F.col("__level") * F.col("__w") >= F.col("__cap"))
    level = F.min(F.when(~F.col("__capped"), F.struct((F.col("__cap") / F.col("__w")).alias("r"), F.col("__s").isNull().alias("o"), F.col("__s").alias("s"), F.col("__level").alias("v")))).over(every)
    return s.withColumn("target", F.when(F.col("__capped"), F.col("__cap").cast("double")).otherwise(level.getField("v") * F.col("__w"))).select("__s", "__n", "source_size", "n_docs", "target")


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3, budget: float = 1.0, seed: str = "mix", rows_per_range: int = 1024, carry: str | None = None) -> DataFrame:
    """One row per copy of a document that stands in the queue, and per document whose first copy doesn't.

    Columns: the id, ``size``, ``source_size``, ``target``, ``__src``, ``pass``
    (0 first), ``virtual_finish`` (null: never queued), ``take`` (its words, or
    0), ``before`` (words that the queue holds before it), ``__rng`` and
    ``__rn`` (with ``__src``, they name the row).

    ``carry`` names a column of ``docs`` to pass on.
    ``budget`` is a share of all words; sources' targets sum to all words.

    Defined cases. Null or empty text: size 0, never queued. Null ids and null
    sources are kept; a null source is one source, last in order. Rows that
    repeat an id are documents of their own. Equal finish times go by source,
    pass, shuffled place. No rows: no rows.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))))
    source = F.col(f"`{source_col}`").cast("string")
    name = F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))  # never null, and no two alike
    sized = cut(docs.select(F.col(f"`{id_col}`").alias("__id"), source.alias("__s"), name.alias("__n"), *([carry] if carry else []), key.alias("__k"), F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    stats = sized.groupBy("__s", "__n").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"), F.max("size").alias("most"))
    total, n, slack = stats.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("most"), F.lit(0))).first()
    spend = int(total * budget)
    # at this time every source has spent its share of the budget and a document more: the cut lies before it
    late = budget + 2.0 * slack / max(total, 1)
    # broadcast is left to the planner, which checks the size: one row per source
    target = cut(_targets(stats, weights, max_repeats))
    u = F.conv(F.substring("__k", 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    rows = sized.drop("__s").join(target, "__n").withColumn("__rng", F.floor(u * F.ceil(F.col("n_docs") / rows_per_range)))
    sums = rows.groupBy("__n", "__rng").agg(F.sum("size").alias("__sum"))
    rows = rows.join(_ahead(sums, ["__n"], "__rng", "__sum", "__ahead"), ["__n", "__rng"])
    inside = Window.partitionBy("__n", "__rng").orderBy("__k", F.col("__id").asc_nulls_last(), "size")
    rows = rows.withColumns({"__rn": F.row_number().over(inside), "__in": F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    rows = cut(rows)  # without texts; the queue reads them twice, and the driver plans each half by itself
    copies = rows.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    start = F.col("pass") * F.col("source_size") + F.col("__ahead") + F.col("__in")
    copies = copies.withColumn("virtual_finish", F.when((F.col("size") > 0) & (F.col("target") > 0), (start + F.col("size")) / F.col("target")))
    copies = copies.withColumn("__queued", F.coalesce(F.col("virtual_finish") <= late, F.lit(False))).where("pass = 0 OR __queued")

    slices = max(1, -(-n // rows_per_range))
    # rows outside the queue need no order: they are spread over slices of their own
    copies = copies.withColumn("__vt", F.when(F.col("__queued"), F.floor(F.col("virtual_finish") * slices)).otherwise(-1 - F.pmod(F.xxhash64("__k"), F.lit(slices))))
    held = copies.where("__queued").groupBy("__vt").agg(F.sum("size").alias("__sum"))
    copies = copies.join(_ahead(held, [], "__vt", "__sum", "__vahead"), "__vt", "left")
    order = Window.partitionBy("__vt").orderBy("virtual_finish", F.col("__s").asc_nulls_last(), "pass", "__rng", "__rn").rowsBetween(Window.unboundedPreceding, -1)
    before = F.when(F.col("__queued"), F.col("__vahead") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    copies = copies.withColumn("before", before)
    take = F.when(2 * (F.lit(spend) - F.col("before")) >= F.col("size"), F.col("size")).otherwise(0).cast("long")
    return copies.select(F.col("__id").alias(id_col), F.col("__s").alias("__src"), "size", "source_size", "target", "pass", F.when(F.col("__queued"), F.col("virtual_finish")).alias("virtual_finish"), take.alias("take"), "before", "__rng", "__rn", *([carry] if carry else []))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Per document row: the id, ``size``, ``source_size``, ``target`` and ``taken`` words, repeats counted."""
    id_col = options.get("id_col", "doc_id")
    plan = mix_plan(docs, **options)
    out = plan.groupBy("__src", "__rng", "__rn", id_col, "size", "source_size", "target").agg(F.sum("take").alias("taken"))
    return out.select(id_col, F.col("size").cast("long"), F.col("source_size").cast("long"), "target", F.col("taken").cast("long"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: a row of ``docs`` for each copy that is taken, whole, in the order of virtual finish times over all partitions.

    Rows that are equal in id, source and text share their copies. Defined
    cases are those of ``mix_plan``; columns stay as they are.
    """
    columns, key = docs.columns, F.xxhash64(F.col(f"`{source_col}`"), F.col(f"`{text_col}`"))
    mine = docs.select(F.struct("*").alias("__row"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("__i"), key.alias("__h"))
    plan = mix_plan(docs.withColumn(KEY, key), id_col=id_col, text_col=text_col, source_col=source_col, carry=KEY, **options)
    taken = plan.where("take > 0").select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("__i2"), F.col(KEY).alias("__h2"), F.struct("virtual_finish", "__src", "pass", "__rng", "__rn").alias("__copy"))
    taken = taken.groupBy("__i2", "__h2").agg(F.array_sort(F.collect_list("__copy")).alias("__copies"))
    equal = Window.partitionBy("__i", "__h").orderBy("__i")
    rows = mine.join(taken, (F.col("__i") == F.col("__i2")) & (F.col("__h") == F.col("__h2"))).withColumns({"__at": F.row_number().over(equal) - 1, "__n": F.count("*").over(Window.partitionBy("__i", "__h"))})
    rows = rows.select("__row", F.explode(F.filter("__copies", lambda c, i: i % F.col("__n") == F.col("__at"))).alias("__copy"))
    out = rows.orderBy("__copy.virtual_finish", F.col("__copy.__src").asc_nulls_last(), "__copy.pass", "__copy.__rng", "__copy.__rn")
    return out.select(*[F.col("__row").getField(c).alias(c) for c in columns])


def op7_mixing(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))


OP7_SQL = r"""
WITH z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM z GROUP BY source),
w AS (SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS weight, 3 * source_size AS cap FROM s),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, level * weight >= cap AS capped, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS i FROM v),
t AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE (SELECT arg_min(level, i) FROM f WHERE NOT capped) * weight END AS target FROM f),
c AS (SELECT z.doc_id, z.source, z.k, z.size, t.source_size, t.target, row_number() OVER () AS i,
        coalesce(sum(z.size) OVER (PARTITION BY z.source ORDER BY z.k, z.doc_id, z.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
      FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, (pass * source_size + c + size)::DOUBLE / target AS finish FROM c, range(3) p(pass) WHERE size > 0 AND target > 0),
b AS (SELECT *, coalesce(sum(size) OVER (ORDER BY finish, source NULLS LAST, pass, k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q),
n AS (SELECT i, sum(size) AS taken FROM b WHERE 2 * ((SELECT sum(size) FROM z) - before) >= size GROUP BY i)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM c LEFT JOIN n USING (i)
"""

QUERIES = {"op7_mixing": op7_mixing}
ORACLES = {"op7_mixing": OP7_SQL}
