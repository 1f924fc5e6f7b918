"""An inverted index of texts: which documents hold a word, without reading the texts again.

A posting is (token, day, doc, further columns).  Postings are stored in the order of their token, below
folders of token buckets, so a search opens the folders of its words and skips all row groups of
others.  Each micro-batch adds a sorted part; parts are folded like those of other stream tables.
A word that most documents hold spreads over many files, as the order goes on by day and document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.functions.once import compute_once
from canvass.functions.text import NOT_A_TERM, terms
from canvass.sinks.tables import read_batches, write_batch

BUCKETS = 32
#: The token that every document holds, also one without a word: an empty search matches all.
EVERY = ""


def bucket_of(token):
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def postings(docs: DataFrame, doc: str, text: str = "text", day: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(bucket, token, day, doc, further columns): a row for each different lower-case word of each document.

    A document without text has the token of all documents only.  The words of a text are made
    different within its row, so nothing is shuffled for that.
    """
    words = F.array_distinct(F.concat(F.array(F.lit(EVERY)), F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), NOT_A_TERM)))
    date = F.col(day).cast("date") if day else F.lit(None).cast("date")
    rows = compute_once(docs, F.col(doc).alias("doc"), date.alias("day"), *keep, words=words)
    rows = rows.select("doc", "day", *keep, F.explode("words").alias("token"))
    return rows.select(bucket_of(F.col("token")).alias("bucket"), "token", "day", "doc", *keep)


def clustered(rows: DataFrame) -> DataFrame:
    """Files by ranges of (bucket, token, day, doc), each in that order."""
    order = ["bucket", "token", "day", "doc"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def add_to_index(docs: DataFrame, path: str, batch_id: int, doc: str, text: str = "text", day: str | None = None,
                 keep: tuple[str, ...] = ()) -> None:
    """Extend the index at ``path`` by a batch; a repeated batch replaces what it added before."""
    write_batch(postings(docs, doc, text, day, keep), path, batch_id, ["bucket"], arrange=clustered)


def hits(spark: SparkSession, path: str, query: str) -> DataFrame:
    """The postings of a search's words; an empty search gives every document, one without a word none."""
    words = terms(query) if query else [EVERY]
    numbers = [r[0] for r in spark.range(1).select(F.explode(F.array(*(bucket_of(F.lit(w)) for w in words)))).collect()] if words else []
    return read_batches(spark, path).filter(F.col("bucket").isin(*numbers) & F.col("token").isin(*words))


def matching(spark: SparkSession, path: str, query: str) -> DataFrame:
    """One row (doc, day, further columns) for each document with at least one of the words."""
    found = hits(spark, path, query)
    columns = [c for c in found.columns if c not in ("bucket", "token", "batch_id")]
    return found.select(*columns).distinct()


def hits_by_day(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(day, docs): how many documents of each day match, from the postings alone."""
    return matching(spark, path, query).groupBy("day").agg(F.count("*").alias("docs"))
