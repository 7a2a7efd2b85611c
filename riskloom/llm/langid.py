"""Language identification by compression with one raw-content zstandard dictionary per language."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm._common import sliced

_HAS_LETTER = re.compile(r"[^\W\d_]").search
_LETTERS_ONLY = re.compile(r"[\W\d_]+").sub
UNKNOWN = "und"
# The last bytes of every text are also compressed with each quarter of the dictionaries, since the
# sizes of a few words under whole dictionaries are often equal.
TAIL = 256


def plain(text: str) -> bytes:
    """Lower-case words of letters with one space between; marks and digits name no language."""
    return _LETTERS_ONLY(" ", text.lower()).strip().encode("utf-8", "surrogatepass")


class DictionarySizer:
    """Compressed sizes of a text under each dictionary, summed over windows of its bytes."""

    def __init__(self, contents: list[bytes], window: int, level: int) -> None:
        parameters = zstandard.ZstdCompressionParameters.from_level(
            level, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS
        )
        self.window = window
        self.compress = []
        for content in contents:
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=parameters)
            self.compress.append(zstandard.ZstdCompressor(dict_data=words, compression_params=parameters).compress)

    def windows(self, data: bytes) -> np.ndarray:
        """One row per window, one column per dictionary."""
        parts = [data[i : i + self.window] for i in range(0, max(1, len(data)), self.window)]
        return np.array([[len(c(p)) for c in self.compress] for p in parts], np.int64)

    def sizes(self, data: bytes) -> np.ndarray:
        """Sums over the windows. A window counts at least 0.75 of its median size: languages differ by
        less, while a copy of a wrongly labelled text in a dictionary would shrink to nothing."""
        found = self.windows(data).astype(float)
        return np.maximum(found, 0.75 * np.median(found, axis=1, keepdims=True)).sum(axis=0)


def sample_by_label(docs: DataFrame, label: str, order: Column, each: int) -> DataFrame:
    """At most ``each`` rows of every label, those with the smallest hashes.

    Labels with many rows are thinned by their hash first, so that no window holds a whole label.
    """
    from pyspark.sql import Window

    counts = docs.groupBy(label).agg(F.count("*").alias("_rows"))
    share = (F.xxhash64(F.lit("thin"), order).bitwiseAND(F.lit((1 << 31) - 1))) / float(1 << 31)
    thinned = docs.join(F.broadcast(counts), label).where(share * F.col("_rows") <= 3.0 * each + 50)
    place = Window.partitionBy(label).orderBy(F.xxhash64(F.lit("thin"), order).bitwiseAND(F.lit((1 << 31) - 1)), order)
    return thinned.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= each).drop("_place", "_rows")


class LanguageModel:
    """Dictionaries by language, most frequent language first."""

    def __init__(self, contents: dict[str, bytes], window: int = 2048, level: int = 8, min_margin: float = 0.01) -> None:
        self.languages = list(contents)
        self.contents = [c.ljust(8) for c in contents.values()]
        self.window, self.level, self.min_margin = window, level, min_margin

    def scorer(self) -> Callable[[str | None], tuple[str, float, float, bool]]:
        sizer = DictionarySizer(self.contents, self.window, self.level)
        quarters = [
            DictionarySizer([c[len(c) * i // 4 : len(c) * (i + 1) // 4].ljust(8) for c in self.contents], self.window, self.level)
            for i in range(4)
        ]

        def score(text: str | None) -> tuple[str, float, float, bool]:
            """Language, score, margin, accepted."""
            if not self.languages or not text or not _HAS_LETTER(text):
                return UNKNOWN, 0.0, 0.0, False
            data = plain(text)
            cut = max(0, len(data) - TAIL)
            sizes = (sizer.sizes(data[cut:]) + sum(q.sizes(data[cut:]) for q in quarters)) / 5
            if cut:
                sizes = sizes + sizer.sizes(data[:cut])
            best = int(sizes.argmin())  # of equal sizes the more frequent language
            # Bytes over the best count as evidence, damped with the size, as they are not independent.
            weight = np.exp(-(sizes - sizes[best]) / (1.0 + 0.01 * sizes[best]))
            rest = np.delete(sizes, best)
            margin = 1.0 if not len(rest) else float(rest.min() / sizes[best] - 1.0)
            return self.languages[best], float(1.0 / weight.sum()), margin, margin >= self.min_margin

        return score


def fit(
    docs: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "lang",
    docs_each: int = 400, characters_each: int = 300, **options: object,
) -> LanguageModel:
    """Dictionaries from a bounded sample: ``characters_each`` characters of ``docs_each`` rows a language.

    Rows without a label or a letter do not count. The number of languages is taken to be small; their
    dictionaries (120,000 characters each) are all that comes to the driver.
    """
    known = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).cast("string").alias("_label"),
        F.xxhash64(F.col(ident).cast("string"), F.col(text)).alias("_order"),
        F.col(text).alias("_text"),
    )
    # A slice of each sampled text, from a place chosen by its hash.
    at = F.pmod(F.col("_order"), F.greatest(F.length("_text") - characters_each, F.lit(1))).cast("int")
    slices = known.withColumn("_text", F.substring(F.col("_text"), at + 1, F.lit(characters_each)))
    counts = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    rows = sample_by_label(slices, "_label", F.col("_order"), docs_each).collect()
    by: dict[str, list[bytes]] = {language: [] for language in counts}
    for r in sorted(rows, key=lambda r: (r["_order"], r["_text"])):
        if data := plain(r["_text"]):
            by[r["_label"]].append(data)
    by = {x: by[x] for x in sorted(by, key=lambda x: (-counts[x], x)) if by[x]}
    return LanguageModel({x: b" ".join(parts) for x, parts in _agreeing(by).items()}, **options)


def _agreeing(slices: dict[str, list[bytes]], margin: float = 0.01) -> dict[str, list[bytes]]:
    """Slices without those that the dictionaries of the other half give clearly to another language.

    A few wrongly labelled rows would otherwise draw their copies to the wrong language.
    """
    kept: dict[str, list[bytes]] = {x: [] for x in slices}
    for half in (0, 1):
        model = [b" ".join(parts[1 - half :: 2]).ljust(8) for parts in slices.values()]
        sizer = DictionarySizer(model, 2048, 8)
        for own, (language, parts) in enumerate(slices.items()):
            for data in parts[half::2]:
                sizes = sizer.sizes(data)
                if sizes[own] <= sizes.min() * (1 + margin):
                    kept[language].append(data)
    return {x: kept[x] or slices[x] for x in slices}


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", prefix: str = "") -> DataFrame:
    """All columns plus lang_pred, score, margin, accepted, each after ``prefix``.

    The whole text is compressed in windows with every dictionary, its last ``TAIL`` bytes apart as the mean of
    five sizes, one under the whole dictionary and one under each quarter; texts of all lengths go by this rule. The
    language with the smallest total wins, ties going to the more frequent one. accepted is false where the next language's total is
    within ``min_margin`` of the best, and for ``und``: a null or empty text, one without a letter, or
    no learned language. score lies between 0 and 1. Repeated rows get equal values; an empty table gives
    none. Columns of the input with one of the four names are replaced.
    """
    out = [prefix + c for c in ("lang_pred", "score", "margin", "accepted")]
    docs = docs.drop(*out)
    at = docs.columns.index(text)
    names = docs.columns
    schema = docs.select("*", *[F.lit(v).alias(c) for c, v in zip(out, ("", 0.0, 0.0, True), strict=True)]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in sliced(batches):
            found = [score(t) for t in batch.column(at).to_pylist()]
            columns = list(zip(*found, strict=True)) if found else [(), (), (), ()]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*names, *out])

    return docs.mapInArrow(run, schema)
