"""Tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.scalars import field, null_if
from riskloom.queries.registry import query, table
from riskloom.session import stage_path
from riskloom.sources.tables import read_csv, stage, write_csv

_ORDERS_SQL = """
    SELECT o_orderkey, NULLIF(o_custkey % 100, 7) AS custkey, NULLIF(o_orderstatus, 'P') AS status,
           CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END AS price, o_orderpriority
    FROM orders
"""


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with gaps in a whole-number, a text and a fractional column."""
    status = field("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        null_if(field("o_custkey") % 100, 7).alias("custkey"),
        null_if(status, "P").alias("status"),
        F.when(status != "O", field("o_totalprice")).alias("price"),
        "o_orderpriority",
    )


@query(_ORDERS_SQL)
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "orders_csv")
    write_csv(_orders(spark, sf_dir), path)
    declared = T.StructType(
        [T.StructField("o_orderkey", T.LongType()), T.StructField("status", T.StringType())]
    )
    # The other three columns are inferred: bigint with gaps, double with gaps, text.
    return read_csv(spark, path, declared)


@query(_ORDERS_SQL)
def stage_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(_orders(spark, sf_dir), "orders")


@query(
    """
    SELECT doc_id, md5(NULLIF(text, '')) AS digest, CAST(length(NULLIF(text, '')) AS INTEGER) AS n_chars, lang, source
    FROM documents
    """
)
def csv_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with quotes and line breaks, written and read again in ranges that cut through them."""
    path = stage_path(spark, "documents_csv")
    write_csv(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), path)
    texts = T.StructType([T.StructField(c, T.StringType()) for c in ("text", "lang", "source")])
    back = read_csv(spark, path, T.StructType([T.StructField("doc_id", T.LongType()), *texts.fields]))
    digest = F.md5(field("text").cast("binary")).alias("digest")
    return back.select("doc_id", digest, F.length("text").alias("n_chars"), "lang", "source")
