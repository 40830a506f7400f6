"""Corpus pipeline: quality rules, line dedup, near copies, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before it kept; all but the last return the columns of documents.

Defined cases, for every stage. No rows: no rows. Null ids, sources and
languages are values of their own; a null text counts as empty. Rows that
repeat an id are documents of their own, except where their texts are near
copies. Texts of any length are worked on whole. Columns beside those of
``documents`` pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.llm.jaccard import drop_near_copies
from gleanery.llm.line_dedup import line_dedup
from gleanery.llm.mixing import mix_documents
from gleanery.llm.packing import pack_digest
from gleanery.llm.quality import keep_good
from gleanery.session import scratch


def quality_rules(spark, docs, sf_dir):
    """Documents that pass the base rules and their language's bands; the others go. Null and empty texts fail the base rules."""
    return keep_good(docs)


def drop_repeated_lines(spark, docs, sf_dir):
    """Every document, without the lines that one with a smaller id holds too. A null id is the largest; a null text becomes an empty one."""
    out = line_dedup(docs)
    new = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark, docs, sf_dir):
    """One document of each group of near copies, that with the smallest id; texts without words are in no group."""
    return drop_near_copies(docs, words=5, num=80, den=100)


def mix_sources(spark, docs, sf_dir):
    """Whole copies of documents, up to three each, in the order of the queue; texts without words are in none."""
    return mix_documents(docs)


def pack_sequences(spark, docs, sf_dir):
    """A row for each piece of a document in a sequence; a null or empty text is its end token alone."""
    return pack_digest(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: The language model, the tokenizer and the packing heuristic can't be said in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = scratch(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{root}/{i}")
            docs = spark.read.parquet(f"{root}/{i}")
    return docs
