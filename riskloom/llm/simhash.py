"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from riskloom.llm._blocks import block_pairs, spanning_links
from riskloom.llm._common import sliced, staged, words_of
from riskloom.llm._components import connected_components

BITS = 64
SEED = 42


def fingerprint(text: str | None, size: int = 3) -> int:
    """Majority bits of the XXH64 hashes of the shingles of ``size`` lower-cased words."""
    words = words_of(text, lower=True)
    if not words:
        return 0
    data = b" ".join(words)
    if len(words) <= size:
        shingles = [data]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        shingles = [data[s:e] for s, e in zip(starts[: -size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(shingles))
    votes = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        octets = part.astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 bit masks; two words that differ in at most ``radius`` bits agree under one.

    Bit i gets the nonzero vector (i mod (2^(radius+1) - 1)) + 1 over GF(2); mask v keeps the bits whose
    vector has an odd product with v. The vectors of any ``radius`` bits span less than the whole
    space, so some v is orthogonal to all of them and its mask drops all those bits.
    """
    top = (1 << (radius + 1)) - 1
    return [
        sum(1 << i for i in range(BITS) if ((i % top + 1) & v).bit_count() % 2) for v in range(1, top + 1)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprint(docs: DataFrame, text: str = "text", size: int = 3, out: str = "_fp") -> DataFrame:
    """All columns plus the fingerprint as a signed 64-bit number."""
    at = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, StructField(out, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fps = [_signed(fingerprint(t, size)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(fps, pa.int64())], names=[*batch.schema.names, out]
            )

    return docs.mapInArrow(run, schema)


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v = [], []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            ids = [m["_fp"] for m in a] + [m["_fp"] for m in b or ()]
            x = np.array(ids, np.int64).view(np.uint64)
            if len(x) == 2:
                near = [(1, 0)] if (ids[0] ^ ids[1]) & (2**64 - 1) and ((ids[0] ^ ids[1]) & (2**64 - 1)).bit_count() <= radius else []
            else:
                near = spanning_links(np.bitwise_count(x[:, None] ^ x[None, :]) <= radius)
            u += [ids[i] for i, _ in near]
            v += [ids[j] for _, j in near]
        yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def near_duplicate_components(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", radius: int = 3, size: int = 3, block_rows: int = 1024
) -> DataFrame:
    """(ident, fingerprint hex, component_id) for each row: fingerprints link at ``radius`` or fewer bits.

    component_id is the smallest ident reachable over links. Equal fingerprints are one node, so groups of
    exact copies never meet as pairs; each distinct fingerprint goes to one bucket per covering mask,
    so no pair within the radius is missed. Buckets are compared in blocks and give only the links
    that connect their members. Null texts count as empty; texts without a word have fingerprint 0
    and link like others; rows with a null ident get their group's component and do not name one;
    repeated rows come back each; an empty table gives an empty result. An ident may be a struct, which is
    compared field by field; of other kinds it is taken as a long.
    """
    key = F.col(ident) if isinstance(docs.schema[ident].dataType, StructType) else F.col(ident).cast("long")
    plain = docs.select(key.alias("_id"), F.col(text).alias("_text"))
    marked = staged(with_fingerprint(plain, "_text", size).select("_id", "_fp"), "fingerprints")
    nodes = staged(marked.groupBy("_fp").agg(F.min("_id").alias("_least")), "distinct-fingerprints")
    masks = F.array(*[F.struct(F.lit(k).alias("t"), F.lit(_signed(m)).alias("m")) for k, m in enumerate(covering_masks(radius))])
    members = nodes.select("_fp", F.explode(masks).alias("x")).select(
        F.col("x.t").alias("_table"), F.col("_fp").bitwiseAND(F.col("x.m")).alias("_key"), "_fp"
    )
    blocks = block_pairs(members, ["_table", "_key"], "_fp", ["_fp"], block_rows)
    links = blocks.select("a", "b").mapInArrow(lambda it: _links(it, radius), "u long, v long")
    parts = connected_components(links)
    named = nodes.join(parts, F.col("_fp") == F.col("node"), "left").select(
        "_fp", "_least", F.coalesce("component", "_fp").alias("_part")
    )
    named = staged(named, "parts")
    least = staged(named.groupBy("_part").agg(F.min("_least").alias("component_id")), "part-names")
    by_fp = staged(named.join(least, "_part").select("_fp", "component_id"), "named-fingerprints")
    return marked.join(by_fp, "_fp").select(
        F.col("_id").alias(ident),
        F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )
