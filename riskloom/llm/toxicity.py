"""Toxicity by compression distance: windows under a toxic and an ordinary zstandard dictionary."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm._common import sliced, staged, union_all
from riskloom.llm.langid import DictionarySizer, plain

LEVEL = 9
# Each window, a word, stands in a frame that both dictionaries hold, so that it always compresses, and
# before some more bytes, since zstandard starts no match in the last eight.
_FRAME = b"#0123456789abcdefghijklmnopqrstuvwxyz# "
_REST = b" 0123456789 "
# Windows whose saving a worker keeps.
CACHE_WORDS = 300_000
STEPS = (4, 6, 8)  # bytes saved
FEATURES = 2 * len(STEPS) + 2
PREFIXES = (4, 5, 6, 7, 8)  # letters
AT_MOST = 4  # occurrences of a term that count in one text


def coded(word: str) -> bytes:
    """The word's first ten letters, each after a capital that tells its place.

    So a term is found at the beginning of a word only, and twice as many bytes tell it from others.
    """
    return "".join(p + c for p, c in zip("ABCDEFGHIJ", word, strict=False)).encode("utf-8", "surrogatepass")


class Distances:
    """Bytes that the toxic dictionary saves over the ordinary one, by window."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self.toxic, self.ordinary = DictionarySizer([toxic, ordinary], 1 << 30, LEVEL).compress
        self.known: dict[bytes, int] = {}

    def saved(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            window = _FRAME + coded(word.decode("utf-8", "surrogatepass")) + _REST
            found = self.known[word] = len(self.ordinary(window)) - len(self.toxic(window))
        return found

    def features(self, text: str | None) -> list[float]:
        """For each step, windows that save so much per thousand, up to 12 and up to 30; length; constant."""
        words = plain(text or "").split()
        saved = Counter(map(self.saved, words))
        out = []
        for least in STEPS:
            rate = 1000 * sum(n for s, n in saved.items() if s >= least) / (len(words) + 20)
            out += [min(rate, 12) / 12, min(rate, 30) / 30]
        return [*out, min(len(words), 50) / 50, 1.0]


@dataclass(frozen=True)
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]

    def scorer(self) -> Callable[[str | None], float]:
        distances = Distances(self.toxic, self.ordinary)

        def score(text: str | None) -> float:
            z = sum(w * x for w, x in zip(self.weights, distances.features(text), strict=True))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return score


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of word beginnings in toxic and ordinary texts, added up over a task's batch."""
    for batch in sliced(batches):
        counts: list[Counter[str]] = [Counter(), Counter()]
        texts: Counter[str] = Counter()
        words = [0, 0]
        for toxic, text in zip(batch.column("_toxic").to_pylist(), batch.column("_text").to_pylist(), strict=True):
            found: Counter[str] = Counter()
            for word in plain(text or "").decode("utf-8", "surrogatepass").split():
                words[toxic] += 1
                for n in PREFIXES:
                    if len(word) >= n:
                        found[word[:n]] += 1
            counts[toxic].update({t: min(n, AT_MOST) for t, n in found.items()})
            if toxic:
                texts.update(found.keys())
        terms = [*set(counts[0]) | set(counts[1]), ""]  # the empty term counts all words
        counts[0][""], counts[1][""] = words
        yield pa.RecordBatch.from_pydict(
            {
                "term": pa.array(terms, pa.string()),
                "t": pa.array([counts[1][x] for x in terms], pa.int64()),
                "o": pa.array([counts[0][x] for x in terms], pa.int64()),
                "texts": pa.array([texts[x] for x in terms], pa.int64()),
            }
        )


def _marking_terms(sample: DataFrame, terms: int, least: int, evidence: float) -> tuple[list[str], list[str]]:
    """Word beginnings that mark toxic texts, and as many that mark ordinary ones.

    A term marks toxic texts if at least ``least`` of them have it, it is 4 times as frequent there, and the
    log-likelihood ratio is at least ``evidence``; of terms that begin one another the strongest stays.
    """
    rows = sample.select("_toxic", "_text").mapInArrow(_term_counts, "term string, t long, o long, texts long")
    counts = staged(rows.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("t", "o", "texts")]), "term-counts")
    all_toxic, all_ordinary = counts.where("term = ''").select("t", "o").first()
    share = all_toxic / max(1, all_toxic + all_ordinary)
    odds = F.log((F.col("t") + 0.5) / (all_toxic + 1)) - F.log((F.col("o") + 0.5) / (all_ordinary + 1))

    def part(n: str, expected: float) -> Column:
        return F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / ((F.col("t") + F.col("o")) * expected))).otherwise(0.0)

    ranked = counts.where("term != ''").withColumn("odds", odds)
    ranked = ranked.withColumn("g", 2 * (part("t", share) + part("o", 1 - share)))
    toxic = ranked.where((F.col("odds") > 1.4) & (F.col("texts") >= least) & (F.col("g") >= evidence))
    chosen: list[str] = []
    for r in toxic.orderBy(F.desc(F.round("g")), F.desc(F.length("term")), "term").limit(20 * terms).collect():
        if len(chosen) < terms and not any(r["term"].startswith(c) or c.startswith(r["term"]) for c in chosen):
            chosen.append(r["term"])
    shared = {c[i : i + 4] for c in chosen for i in range(len(c) - 3)}
    ordinary = ranked.where(F.col("odds") < -0.1).orderBy(F.asc(F.col("o") * F.col("odds")), "term").limit(20 * terms)
    others = [r["term"] for r in ordinary.collect()]
    others = [x for x in others if not any(x[i : i + 4] in shared for i in range(len(x) - 3))]
    return chosen, others[: max(8, len(chosen))]


def fit(
    docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "toxic",
    sample: int = 6000, terms: int = 64, least: int = 8, evidence: float = 40.0,
) -> ToxicityModel:
    """Dictionaries and calibration from a bounded sample of the labelled rows of ``docs``.

    ``sample`` labelled ids of each class are used, those with the smallest hashes; equal texts count once.
    The toxic and the ordinary dictionary hold the terms that mark their class, in one frame and
    padded to one length, so that a window's two sizes differ only by what marks it. The weights of the savings
    are a logistic fit on the same texts. Without both classes every score is their smoothed share.
    """
    marks = (
        labels.where(F.col(label).isNotNull() & F.col(ident).isNotNull())
        .groupBy(F.col(ident).alias("_of")).agg(F.max((F.col(label) > 0).cast("int")).alias("_toxic"))
    )
    # The sampled ids, 2 x ``sample`` at most, are broadcast; the texts are never shuffled as a whole.
    ids = union_all(
        [marks.where(F.col("_toxic") == c).orderBy(F.xxhash64(F.lit("toxicity"), "_of")).limit(sample) for c in (0, 1)]
    )
    known = docs.where(F.col(text).isNotNull()).select(F.col(ident).alias("_id"), F.col(text).alias("_text"))
    found = known.join(F.broadcast(ids), F.col("_id") == F.col("_of")).select("_toxic", "_text")
    chosen = staged(found.groupBy("_text").agg(F.max("_toxic").alias("_toxic")), "toxicity-sample")
    sizes = {r[0]: r[1] for r in chosen.groupBy("_toxic").count().collect()}
    none = (0.0,) * (FEATURES - 1)
    share = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
    if not sizes.get(0) or not sizes.get(1):
        return ToxicityModel(_FRAME, _FRAME, (*none, math.log(share / (1 - share))))
    marked = [b" " + b" ".join(map(coded, words)) + b" " for words in _marking_terms(chosen, terms, least, evidence)]
    length = max(map(len, marked))
    contents = [m.rjust(length) + _FRAME for m in marked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = Distances(*contents)
        for batch in sliced(batches):
            x = [distances.features(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_toxic"), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = chosen.select("_toxic", "_text").mapInArrow(run, "toxic int, x array<double>").collect()
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), FEATURES)
    y = np.array([r["toxic"] for r in rows], float)
    # The sample has more toxic rows than the labels; weights put both classes back to their shares.
    counts = {r[0]: r[1] for r in marks.groupBy("_toxic").count().collect()}
    real = [counts[c] / sum(counts.values()) for c in (0, 1)]
    n = np.where(y == 1, real[1] / y.mean(), real[0] / (1 - y.mean()))
    w = np.zeros(FEATURES)
    for _ in range(30):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x.T * (n * p * (1 - p))) @ x + np.eye(FEATURES) * 0.1, x.T @ (n * (y - p)) - 0.1 * w)
    return ToxicityModel(contents[0], contents[1], tuple(w.tolist()))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """All columns plus score (0 to 1, higher: more likely toxic) and predicted (1 from 0.5 on).

    The whole text is read in windows of one word; each is compressed with both dictionaries, and the
    rates of windows that the toxic one shortens by 4, 6 and 8 bytes are weighed. A null or empty text has
    no window and gets the score of no evidence. Repeated rows get equal scores; an empty table gives
    none; columns named score or predicted are replaced.
    """
    docs = docs.drop("score", "predicted")
    at, names = docs.columns.index(text), docs.columns
    schema = docs.selectExpr("*", "0D AS score").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in sliced(batches):
            found = [score(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*names, "score"])

    return docs.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
