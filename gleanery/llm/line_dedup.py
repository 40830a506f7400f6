"""Line dedup: drop lines that other documents hold too.

Explode the lines, hash each normalised key, find the keys of at least
``min_docs`` documents, mark their lines and reassemble every text by line
position. Everything runs on DataFrame expressions.

Scale. The count is an aggregate with map-side partial sums, so a line that a
third of all documents hold costs one row per key and map task. Marking is a
sort-merge join between two exchanges of its own, which adaptive execution may
split where a key is hot. No group of lines is ever collected: only the marked
positions of one document are, beside its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, lower_ascii

#: Any odd constant: it makes the join key differ from the aggregate's key, so
#: that both sides of the join get an exchange that can be split where skewed.
_REKEY = 0x5851F42D


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Return ``docs`` with ``text_col`` replaced by its kept lines, and ``n_lines``, ``n_dropped``.

    A key of at least ``min_chars`` code points that at least ``min_docs``
    documents hold keeps its lines in the smallest id alone.

    Defined cases. Null or empty text: one empty line, kept. A null id sorts
    last and all null ids are one document. Rows that repeat an id are one
    document when documents are counted, but each row gets its own result.
    No rows: no rows. Input columns named like an added column are replaced.
    """
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("__d"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__t"))
    lines = base.select("__d", F.xxhash64("__t").alias("__v"), F.split("__t", "\n", -1).alias("__ls")).select("__d", "__v", F.posexplode("__ls").alias("__p", "__l"))
    key = line_key(F.col("__l"))
    # two chained 64-bit hashes: 128 bits, so that no two keys of a huge corpus meet
    keys = lines.where(F.length(key) >= min_chars).select("__d", "__v", "__p", F.xxhash64(key).alias("__h"), F.xxhash64(F.lit(97), key).alias("__g"))
    # a null id sorts after all others; where all ids are null, there is no first and no line goes
    if min_docs <= 2:
        shared = keys.groupBy("__h", "__g").agg(F.min("__d").alias("__first"), F.max("__d").alias("__last"), F.bool_or(F.isnull("__d")).alias("__none"))
        shared = shared.where("__first < __last OR __none") if min_docs == 2 else shared
    else:
        shared = keys.groupBy("__h", "__g", "__d").agg(F.lit(1).alias("__one")).groupBy("__h", "__g").agg(F.min("__d").alias("__first"), F.count("*").alias("__n")).where(F.col("__n") >= min_docs)
    shared = shared.where("__first IS NOT NULL")
    shared = shared.select(F.col("__h").bitwiseXOR(F.lit(_REKEY)).alias("__h2"), F.col("__g").alias("__g2"), "__first")
    marked = keys.select("__d", "__v", "__p", F.col("__h").bitwiseXOR(F.lit(_REKEY)).alias("__h2"), F.col("__g").alias("__g2"))
    drops = marked.join(shared, ["__h2", "__g2"]).where("coalesce(__d > __first, true)").groupBy("__d", "__v").agg(F.array_sort(F.collect_set("__p")).alias("__drop"))

    out = docs.select(F.struct("*").alias("__row"), F.col(f"`{id_col}`").cast("long").alias("__d"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__t")).withColumn("__v", F.xxhash64("__t"))
    drops = drops.select(F.col("__d").alias("__d2"), F.col("__v").alias("__v2"), "__drop")
    out = out.join(drops, F.col("__d").eqNullSafe(F.col("__d2")) & (F.col("__v") == F.col("__v2")), "left")
    n = F.length(F.col("__t")) - F.length(F.replace(F.col("__t"), F.lit("\n"), F.lit(""))) + 1
    out = out.select("__row", "__t", n.cast("long").alias("__n"), "__drop")
    # kept lines are the runs between dropped positions: -1, d1, d2, .., n
    bounds = F.concat(F.array(F.lit(-1)), F.col("__drop"), F.array(F.col("__n").cast("int")))
    out = out.withColumns({"__b": F.when(F.col("__drop").isNotNull(), bounds), "__ls": F.when(F.col("__drop").isNotNull(), F.split("__t", "\n", -1))})
    runs = F.transform(F.sequence(F.lit(0), F.size("__b") - 2), lambda i: F.slice(F.col("__ls"), F.get(F.col("__b"), i) + 2, F.get(F.col("__b"), i + 1) - F.get(F.col("__b"), i) - 1))
    kept = F.when(F.size("__ls") > 0, F.array_join(F.flatten(runs), "\n")).otherwise(F.col("__t"))
    dropped = F.when(F.col("__b").isNotNull(), F.size("__b") - 2).otherwise(F.lit(0)).cast("long")
    new = {"n_lines": F.col("__n"), "n_dropped": dropped}
    cols = [kept.alias(c) if c == text_col else F.col("__row").getField(c).alias(c) for c in docs.columns if c not in new]
    return out.select(*cols, *[v.alias(k) for k, v in new.items()])


def op1_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = line_dedup(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line,
        translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id > s.first, false) AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLES = {"op1_line_dedup": OP1_SQL}
