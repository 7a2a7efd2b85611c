"""Shards of near-equal size: range partitioning by splitters drawn from a size-weighted sample of the keys.

Built of DataFrame functions alone. The key of a record is a hash of its text, so copies of a text lie next to each
other and stay together, unless their range is overfull and has to be divided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm._common import staged

LAW = "bytes"
# Ranges of the first cut, draws for each, and ranges over this multiple of their share are divided.
RANGES = 2048
DRAWS = 16
OVERFULL = 2
# Rows numbered by one task at a time.
CELL_ROWS = 100_000
_CHUNK = 64


def _fraction(*columns: Column | str) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(2**32)) / F.lit(float(2**32))


def _range_of(key: Column, splitters: list[int]) -> Column:
    """Number of splitters up to the key: those before its chunk, and those in its chunk."""
    chunks = [splitters[i : i + _CHUNK] for i in range(0, len(splitters), _CHUNK)]
    if not chunks:
        return F.lit(0)
    heads = F.lit([c[0] for c in chunks])
    chunk = F.size(F.filter(heads, lambda s: s <= key))
    inside = F.size(F.filter(F.element_at(F.lit(chunks), chunk), lambda s: s <= key))
    return F.when(chunk == 0, 0).otherwise((chunk - 1) * _CHUNK + inside)


def _splitters(light: DataFrame, total: int, ranges: int) -> list[int]:
    """Quantiles of the keys of a sample in which a record is drawn in proportion to its size.

    A key drawn for several quantiles in a row fills ranges alone: it gets one of its own.
    """
    wanted = F.col("size") * F.lit(DRAWS * ranges / total) + _fraction(F.lit("draw"), "ident", "key", "row")
    drawn = light.select(F.explode(F.array_repeat("key", F.floor(wanted).cast("int"))).alias("key"))
    at = [i / ranges for i in range(1, ranges)]
    found = drawn.agg(F.percentile_approx("key", at, 100_000).alias("at")).first()["at"] or []
    alone = {a + 1 for a, b in zip(found, found[1:]) if a == b}
    return sorted(set(found) | alone)


def assign(
    docs: DataFrame,
    shards: int = 16,
    ident: str = "doc_id",
    text: str = "text",
    row: str | None = None,
    ranges: int = RANGES,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Shard and place of every record: ident, size, text_crc32, shard, slot and, if named, ``row``.

    A record has the bytes of its text and one more as its size. Splitters cut the keys into ``ranges``; exact sizes of the
    ranges are added up, overfull ones are divided (those of one key by record, others by key), and neighbouring
    pieces fill one shard after another. So a shard differs from its share by about one piece, ``1 / ranges`` of all,
    and by a record that is larger than that. ``slot`` counts from 0 in each shard, in order of range and key.

    Only keys, sizes and hashes are shuffled. The driver holds one number per range; a piece is numbered in cells of about
    ``cell_rows`` rows, so a text that a third of all records have is spread over tasks like any other rows.

    Odd rows: a null text has no bytes (size 1, checksum 0) and its own key; null idents, repeated and equal rows are records of
    their own; an empty table gives no rows; other columns are ignored. Reruns agree on the same files.
    """
    given = F.monotonically_increasing_id() if row is None else F.col(row)
    light = staged(
        docs.select(
            F.col(ident).alias("ident"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("crc"),
            # 53 bits: quantiles are taken in double precision.
            F.shiftrightunsigned(F.xxhash64(text), 11).alias("key"),
            given.alias("row"),
        ),
        "sizes",
    )
    total = light.agg(F.sum("size")).first()[0] or 1
    ranged = light.withColumn("range", _range_of(F.col("key"), _splitters(light, total, ranges)))

    # At most two rows a range: every table below is small enough to broadcast at any size of the input.
    share = -(-total // ranges)
    sizes = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.min("key").alias("low"), F.max("key").alias("high"))
    parts = F.when(F.col("bytes") > OVERFULL * share, F.ceil(F.col("bytes") / share)).otherwise(1)
    sizes = sizes.select("range", parts.cast("long").alias("parts"), (F.col("low") == F.col("high")).alias("alone"))
    by_record = F.xxhash64(F.lit("part"), "ident", "key", "row")
    part = F.pmod(F.when(F.col("alone"), by_record).otherwise(F.xxhash64(F.lit("part"), "key")), F.col("parts"))
    pieces = ranged.join(F.broadcast(sizes), "range").withColumn("part", part).drop("parts", "alone")

    upto = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    filled = pieces.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    middle = 2 * F.coalesce(F.sum("bytes").over(upto), F.lit(0)) + F.col("bytes")
    shard = F.least(F.lit(shards - 1), F.floor(middle * F.lit(shards) / F.lit(2 * total))).cast("int")
    filled = filled.select(
        "range", "part", shard.alias("shard"), F.ceil(F.col("n") / cell_rows).cast("long").alias("cells")
    )
    cell = F.pmod(F.xxhash64(F.lit("cell"), "ident", "key", "row"), F.col("cells"))
    placed = pieces.join(F.broadcast(filled), ["range", "part"]).withColumn("cell", cell)

    # Cells are many where rows are many. The window and the join below share one clustering.
    cells = placed.groupBy("shard", "range", "part", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range", "part", "cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("range", "part", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("range", "part", "cell").orderBy("key", "ident", "row")
    numbered = placed.withColumn("place", F.row_number().over(inside) - 1).join(cells, ["range", "part", "cell"])
    return numbered.select(
        F.col("ident").alias(ident),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("offset") + F.col("place")).cast("long").alias("slot"),
        *([] if row is None else [F.col("row").alias(row)]),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, file_rows: int = CELL_ROWS, **options) -> None:
    """The records themselves, one folder a shard, in files of about ``file_rows`` rows in order of ``slot``.

    All columns stay; those named ``shard`` and ``slot`` are replaced.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "slot")]
    ident, text = options.get("ident", "doc_id"), options.get("text", "text")
    packed = docs.select(F.struct(*columns).alias("_doc"), F.col(ident).alias(ident), F.col(text).alias(text))
    packed = staged(packed.withColumn("_row", F.monotonically_increasing_id()), "rows")
    at = assign(packed, shards, row="_row", **options).select("_row", "shard", "slot")
    rows = packed.join(at, "_row").select("_doc.*", "shard", "slot")
    dealt = rows.withColumn("_file", F.floor(F.col("slot") / file_rows)).repartition("shard", "_file")
    dealt.sortWithinPartitions("shard", "slot").drop("_file").write.partitionBy("shard").parquet(path)
