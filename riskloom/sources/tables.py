"""Reading and writing headered CSV, and Parquet stage tables between pipeline steps."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.scalars import drop_nan, field, quoted
from riskloom.session import stage_path
from riskloom.sources.line_breaks import read_with_line_breaks

# Texts that the usual CSV readers for data frames take as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType)


def _present(name: str) -> Column:
    c = field(name)
    return F.when(~c.isin(*NA_TOKENS), c)


def _typed(name: str, data_type: T.DataType) -> Column:
    text = _present(name)
    if isinstance(data_type, _INTEGRAL):
        # Writers store an integer column that has gaps as 12.0. A decimal keeps every digit of a bigint;
        # what has a fraction, or is no number, fails.
        number = text.try_cast("decimal(38,18)")
        wrong = F.raise_error(F.concat(F.lit(f"{name} is no whole number: "), text)).cast(data_type)
        return F.when(text.isNull(), None).when(number == F.floor(number), number.cast(data_type)).otherwise(wrong)
    if isinstance(data_type, _FRACTIONAL):
        return drop_nan(text.cast(data_type))
    return text.cast(data_type)


# Quoted or not, an empty field must arrive as an empty text and not as NULL.
_OPTIONS = {"escape": '"', "nullValue": "\u0000", "emptyValue": ""}


def _read_text(spark: SparkSession, path: str, line_breaks: bool) -> DataFrame:
    plain = spark.read.csv(path, header=True, multiLine=line_breaks, **_OPTIONS)
    return read_with_line_breaks(spark, path, plain.columns, _OPTIONS) if line_breaks else plain


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, line_breaks: bool = True
) -> DataFrame:
    """Scan a headered CSV with missing tokens as NULL; columns are matched by header name.

    Quoted texts may hold line breaks; large files are split over tasks all the same. ``line_breaks=False``
    saves the pass that looks for them and is right only for files without such texts.

    Text that is neither missing nor of the declared type fails the job. Columns of the file that
    the schema does not name are read with an inferred type, after the named ones.
    """
    raw = _read_text(spark, path, line_breaks)
    declared = {f.name: f.dataType for f in schema.fields} if schema else {}
    missing = [name for name in declared if name not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    others = [c for c in raw.columns if c not in declared]
    types = declared | _infer(raw, others)
    return raw.select(*[_typed(name, dt).alias(name) for name, dt in types.items()])


def _infer(raw: DataFrame, names: list[str]) -> dict[str, T.DataType]:
    """bigint if every value is a whole number, double if every value is a number, else string.

    One distributed aggregate over all columns returns one row.
    """
    if not names:
        return {}
    checks = []
    for i, name in enumerate(names):
        text = _present(name)
        checks += [
            F.count(text).alias(f"n{i}"),
            F.count(text.try_cast("bigint")).alias(f"i{i}"),
            F.count(text.try_cast("double")).alias(f"d{i}"),
        ]
    row = raw.agg(*checks).first()

    def kind(i: int) -> T.DataType:
        if row[f"n{i}"] and row[f"i{i}"] == row[f"n{i}"]:
            return T.LongType()
        return T.DoubleType() if row[f"d{i}"] == row[f"n{i}"] else T.StringType()

    return {name: kind(i) for i, name in enumerate(names)}


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Headered CSV, no row index; missing values are empty fields, empty texts are quoted."""
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).csv(path, header=True, escape='"', nullValue="", **spaces)


def write_stage(df: DataFrame, path: str, partition_by: str | None = None) -> DataFrame:
    """Write a stage table as Parquet and return it re-read, with its lineage cut."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).selectExpr(*map(quoted, df.columns))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a stage table to a fresh path in the shared folder and return it re-read."""
    return write_stage(df, stage_path(df.sparkSession, name))


def stage_buckets(df: DataFrame, name: str, keys: Sequence[str], dealt: bool = False) -> DataFrame:
    """Write a stage table in as many buckets of its keys as a shuffle has partitions, and return it re-read.

    Joins and aggregates by these keys, or by these and more, read it without a shuffle. The table lies under a path of
    the shared folder; the session's catalogue only knows its buckets. Rows that a shuffle by these keys has just ``dealt``
    lie in tasks of whole buckets already.
    """
    spark, path = df.sparkSession, stage_path(df.sparkSession, name)
    buckets = write_buckets(df, path, keys, dealt)
    return register_buckets(spark, path, df.schema, keys, buckets).selectExpr(*map(quoted, df.columns))


def write_buckets(df: DataFrame, path: str, keys: Sequence[str], dealt: bool = False) -> int:
    """Parquet in buckets at a path; returns their number."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Dealt like the buckets, so that a bucket is one file.
    rows = df if dealt else df.repartition(buckets, *[field(k) for k in keys])
    known_as = f"riskloom_{uuid.uuid4().hex}"
    rows.write.mode("overwrite").bucketBy(buckets, *keys).option("path", path).saveAsTable(known_as)
    spark.sql(f"DROP TABLE {known_as}")  # the files of an external table stay
    return buckets


def register_buckets(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], buckets: int) -> DataFrame:
    """A bucketed table that lies at a path, as the session's catalogue has to know it."""
    known_as = f"riskloom_{uuid.uuid4().hex}"

    columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    by = ", ".join(quoted(k) for k in keys)
    where = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {known_as} ({columns}) USING parquet CLUSTERED BY ({by}) INTO {buckets} BUCKETS LOCATION '{where}'")
    return spark.table(known_as)


def normalise_nan(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating-point column, for sources that are not CSV."""
    floats = {
        f.name: drop_nan(field(f.name)) for f in df.schema.fields if isinstance(f.dataType, _FRACTIONAL)
    }
    return df.withColumns(floats) if floats else df
