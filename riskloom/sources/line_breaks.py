"""CSV files whose quoted texts may hold line breaks, read in parallel ranges.

A line break is the end of a row only outside quotes, and inside is what follows an odd number of quote characters (a quote
in a text is written twice, which changes nothing). So each range of a file counts its quotes, a running sum over the
ranges of the file says for each whether it starts inside a text, and rows that lie in several ranges are put together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import materialise

# Descriptions of ranges up to this number are broadcast to the scan: 128 TB in ranges of 128 MB.
BROADCAST_RANGES = 1_000_000
# A whole row, and parts of one that fills, ends in, or starts in a range, as the header row may.
WHOLE, FILLS, ENDS, STARTS, HEADER = range(5)
_PIECE = "file string, start long, kind int, text string"


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Physical lines with their file and the offset of their range; rows of a range come in order."""
    lines = spark.read.text(paths, lineSep="\n")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    return lines.select(*place, F.col("value").alias("text"))


def _quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def scan_ranges(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, start, odd: lines with an odd number of quotes, inside: does the range start inside a text, returns: lines
    with a carriage return elsewhere than at their end.

    Combined before the shuffle, so a range is one row.
    """
    text = F.col("text")
    bare = F.contains(F.regexp_replace(text, "\r$", ""), F.lit("\r"))
    counts = _lines(spark, paths).groupBy("file", "start").agg(
        F.sum(F.pmod(_quotes(text), F.lit(2))).alias("odd"), F.count_if(bare).alias("returns")
    )
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.pmod(F.coalesce(F.sum("odd").over(before), F.lit(0)), F.lit(2)) == 1
    return materialise(counts.withColumn("inside", inside))


def _put_together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of ranges to rows without the header rows; only lines of quoted breaks are touched one by one."""
    at = None  # the range being read
    open_lines: list[str] = []  # of a row that is not complete
    opened = FILLS  # whether that row started in this range
    header = within = False

    def unfinished() -> list[pa.RecordBatch]:
        return [_pieces(at, ["\n".join(open_lines)], [opened])] if open_lines else []

    for batch in batches:
        if not batch.num_rows:
            continue
        files, starts = batch.column("file").to_pylist(), batch.column("start").to_numpy()
        changes = [i for i in range(1, len(files)) if starts[i] != starts[i - 1] or files[i] != files[i - 1]]
        for low, high in zip([0, *changes], [*changes, len(files)]):
            if at != (files[low], int(starts[low])):
                yield from unfinished()
                at = (files[low], int(starts[low]))
                within = batch.column("inside")[low].as_py()
                open_lines, opened, header = [], FILLS, at[1] == 0
            lines = batch.column("text").slice(low, high - low).cast(pa.string())
            odd = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False) % 2
            after = (np.cumsum(odd) + within) % 2
            before = np.concatenate(([int(within)], after[:-1]))
            alone = (before == 0) & (after == 0)
            texts, kinds = [], []
            for i in np.nonzero(~alone)[0]:
                line = lines[int(i)].as_py()
                if not before[i]:
                    first_row = header and i == 0
                    open_lines, opened = [line], HEADER if first_row else STARTS
                    continue
                open_lines.append(line)
                if not after[i]:
                    if opened != HEADER:
                        texts.append("\n".join(open_lines))
                        kinds.append(ENDS if opened == FILLS else WHOLE)
                    open_lines, opened = [], FILLS
            if header and alone[0]:
                alone[0] = False
            header, within = False, bool(after[-1])
            whole = lines.filter(pa.array(alone))
            yield _pieces(at, pa.concat_arrays([whole, pa.array(texts, pa.string())]), [WHOLE] * len(whole) + kinds)
    yield from unfinished()


def _pieces(at: tuple[str, int], texts: pa.Array | list[str], kinds: list[int]) -> pa.RecordBatch:
    n = len(texts)
    columns = [pa.array([at[0]] * n, pa.string()), pa.array([at[1]] * n, pa.int64()), pa.array(kinds, pa.int32())]
    return pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], ["file", "start", "kind", "text"])


def rows_of(spark: SparkSession, files: list[str], ranges: DataFrame) -> DataFrame:
    """One ``text`` per CSV row of the files, without header rows and empty rows, in parallel over their ranges.

    ``ranges`` of these files are broadcast to the scan, whose lines have to stay in order.
    """
    states = F.broadcast(ranges.select("file", "start", "inside"))
    pieces = _lines(spark, files).join(states, ["file", "start"]).mapInArrow(_put_together, _PIECE)
    # A row starts in one range, may fill others, and ends in one more: at most two parts of rows a range.
    begins = F.col("kind").isin(STARTS, HEADER)
    order = Window.partitionBy("file").orderBy("start", begins)
    parts = pieces.where(F.col("kind") != WHOLE).withColumn("row", F.sum(begins.cast("int")).over(order))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("start", "text"))), lambda p: p["text"])
    glued = parts.groupBy("file", "row").agg(F.array_join(texts, "\n").alias("text"), F.max("kind").alias("kind"))
    rows = pieces.where(F.col("kind") == WHOLE).select("text").unionByName(glued.where(F.col("kind") != HEADER).select("text"))
    return rows.select(F.regexp_replace("text", "\r$", "").alias("text")).where("text <> ''")


def read_with_line_breaks(spark: SparkSession, path: str, columns: list[str], options: dict[str, str]) -> DataFrame:
    """Every column as text, from headered files that have these columns in this order.

    Files without a break inside quotes are left to Spark's own reader, which splits them. A file is well formed if quotes stand
    around texts only, and rows end with a line feed, with or without a carriage return before it.
    """
    ranges = scan_ranges(spark, path)
    files = ranges.groupBy("file").agg(F.sum(F.col("odd") + F.col("returns")).alias("breaks"), F.count("*").alias("n")).collect()
    plain = [unquote(f["file"]) for f in files if not f["breaks"]]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    ddl = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    frames = []
    if plain:
        frames.append(spark.read.csv(plain, schema=schema, header=True, enforceSchema=False, **options))
    group: list[str] = []
    held = 0
    broken = [f for f in files if f["breaks"]]
    for i, f in enumerate(broken):
        group.append(f["file"])
        held += f["n"]
        if i + 1 == len(broken) or held + broken[i + 1]["n"] > BROADCAST_RANGES:
            rows = rows_of(spark, [unquote(g) for g in group], ranges.where(F.col("file").isin(group)))
            parsed = rows.select(F.from_csv("text", ddl, options | {"multiLine": "true"}).alias("row"))
            frames.append(parsed.select("row.*"))
            group, held = [], 0
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)
