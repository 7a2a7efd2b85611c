"""Personal data by weak supervision: labelers vote on candidate spans, a classifier decides."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm._common import sliced, staged

KINDS = ("email", "ip", "card", "phone")
REDACTED = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

# --- base spans: the patterns, leftmost and non-overlapping per kind ---
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_LOCAL_CHARACTER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# The lookbehind and the possessive digits keep a long run of digits from being read again from each digit.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")
# --- looser shapes, for spans that the base patterns leave out ---
_SAID_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}"
    r"(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{1,63}){1,4}"
)
_LOCAL_PHONE = re.compile(r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])")
_LONG_IP = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])")
_HAS_ANY = re.compile(r"[0-9@]|[\[(]at[\])]").search

# Cue words and gazetteers of the labelers, fixed values.
CUES = {
    "email": ("email", "e-mail", "mail", "contact", "write", "reply", "address", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "client", "login", "from", "remote"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "carte", "tarjeta", "karte", "number"),
    "phone": ("call", "phone", "tel", "mobile", "cell", "fax", "contact", "telefon", "teléfono", "téléphone"),
}
AGAINST = ("version", "order", "invoice", "isbn", "token", "sha", "build", "commit", "chapter", "section", "total", "sum")
TOP_LEVELS = frozenset("com org net edu gov mil int info io de fr es uk eu us ca ch at it nl example test".split())
SEEN_LABELERS = 6


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    base: bool
    valid: int  # vote of the pattern's own check


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern would match, but from each @ outwards, so that long words cost no more than once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARACTER:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    out = [Span("email", a, b, True, 1) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m.group().split(".")):
            out.append(Span("ip", *m.span(), True, 1))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGITS.sub("", m.group())
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append(Span("card", *m.span(), True, 1))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGITS.sub("", m.group())) <= 15:
            out.append(Span("phone", *m.span(), True, 1))
    return out


def candidates(text: str) -> list[Span]:
    """Base spans, and loose or failing shapes that touch none of them."""
    if not _HAS_ANY(text):
        return []
    base = base_spans(text)
    taken = sorted((s.start, s.end) for s in base)
    loose = [Span("email", *m.span(), False, 0) for m in _SAID_EMAIL.finditer(text)]
    loose += [Span("phone", *m.span(), False, 0) for m in _LOCAL_PHONE.finditer(text)]
    loose += [Span("ip", *m.span(), False, 1) for m in _LONG_IP.finditer(text)]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGITS.sub("", m.group())
        if 13 <= len(digits) <= 19 and not _luhn(digits):
            loose.append(Span("card", *m.span(), False, -1))
    for m in _IP.finditer(text):
        loose.append(Span("ip", *m.span(), False, -1))
    out, at, end = list(base), 0, -1
    for s in sorted(loose, key=lambda s: (s.start, s.end, s.kind)):
        while at < len(taken) and taken[at][1] <= s.start:
            at += 1
        near = any(a < s.end and s.start < b for a, b in taken[at : at + 8])
        if not near and s.start >= end:
            out.append(s)
            end = s.end
    return out


def _context(text: str, s: Span) -> list[str]:
    return re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)*", text[max(0, s.start - 40) : s.start].lower())


def votes(text: str, s: Span) -> str:
    """One sign per labeler: + personal, - not, 0 no opinion."""
    got = text[s.start : s.end]
    words = _context(text, s)[-4:]
    digits = _NOT_DIGITS.sub("", got)
    check = s.valid
    if s.kind == "email":
        gazetteer = 1 if re.split(r"[.\s\])]+", got.lower())[-1] in TOP_LEVELS else 0
        shape = 1 if re.search(r"[A-Za-z]", got.split("@")[0]) else -1
    elif s.kind == "ip":
        first = int(got.split(".")[0][-3:]) if "." in got else 1
        gazetteer = -1 if first == 0 or first > 239 else 1 if ":" not in got else 0
        shape = -1 if any(len(x) > 1 and x[0] == "0" for x in got.split(".")) else 0
    elif s.kind == "card":
        gazetteer = 1 if digits[:1] in "3456" else -1  # leading digits of card issuers
        shape = 1 if re.fullmatch(r"[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}", got) else -1
    else:
        gazetteer = 1 if got[:1] == "+" and got[1:2] in "123456789" else 0
        shape = 1 if re.search(r"[ ().-]", got) else -1
    cue = 1 if any(w in CUES[s.kind] for w in words) else 0
    against = -1 if any(w in AGAINST for w in words) else 0
    glued = -1 if text[s.start - 1 : s.start].isalnum() or text[s.end : s.end + 1].isalnum() else 0
    return "".join("-0+"[v + 1] for v in (check, gazetteer, shape, cue, against, glued))


FEATURES = 64


def features(text: str, s: Span) -> list[int]:
    """Indices of the features that hold: kind, shape, and the two words before, hashed."""
    got = text[s.start : s.end]
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", got))[:12]
    words = _context(text, s)[-2:]
    named = [f"shape={s.kind}:{shape}", f"base={s.kind}:{s.valid}", *(f"word={w}" for w in words)]
    return [KINDS.index(s.kind), *(len(KINDS) + zlib.crc32(x.encode()) % (FEATURES - len(KINDS)) for x in named)]


@dataclass(frozen=True)
class SpanModel:
    weights: tuple[float, ...]  # one per feature, then one per vote sign and labeler, then the constant
    threshold: float = 0.9

    def probability(self, vote: str, holding: list[int]) -> float:
        z = self.weights[-1] + sum(self.weights[i] for i in holding)
        z += sum(self.weights[FEATURES + 3 * i + "-0+".index(v)] for i, v in enumerate(vote))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def reliabilities(patterns: dict[tuple[str, str], int], rounds: int = 50) -> dict[tuple[str, str], float]:
    """Probability that a span of a kind and vote pattern is personal, by expectation-maximisation.

    Each labeler has its own chance of each vote for personal and other spans; votes are taken as
    independent given the class. Starts from the majority of the votes; chances are smoothed by one.
    """
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    codes = np.array([["-0+".index(c) for c in k[1]] for k in keys]).reshape(len(keys), SEEN_LABELERS)
    p = 1 / (1 + np.exp(-(codes - 1).sum(axis=1) + 0.5))
    for _ in range(rounds):
        log = np.zeros((len(keys), 2))
        for c, weight in enumerate((n * (1 - p), n * p)):
            log[:, c] = math.log((weight.sum() + 1) / (n.sum() + 2))
            for j in range(SEEN_LABELERS):
                chance = np.bincount(codes[:, j], weights=weight, minlength=3) + 1
                log[:, c] += np.log(chance / chance.sum())[codes[:, j]]
        p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -30, 30)))
    return dict(zip(keys, p.tolist(), strict=True))


def fit(docs: DataFrame, text: str = "text", sample: int = 20_000, threshold: float = 0.9) -> SpanModel:
    """Votes of all candidates of all texts are counted by pattern (at most 4 x 3^6 rows) for the estimate;
    the classifier learns from at most ``sample`` candidates, those with the smallest hashes."""
    schema = "kind string, vote string, holding array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for t in batch.column(0).to_pylist():
                for s in candidates(t or ""):
                    rows.append((s.kind, votes(t, s), features(t, s)))
            kind, vote, holding = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(kind, pa.string()), pa.array(vote, pa.string()), pa.array(holding, pa.list_(pa.int32()))],
                names=["kind", "vote", "holding"],
            )

    found = docs.select(F.col(text).alias("_text")).mapInArrow(run, schema)
    counted = staged(found.groupBy("kind", "vote", "holding").agg(F.count("*").alias("n")), "votes")
    patterns = {(r[0], r[1]): r[2] for r in counted.groupBy("kind", "vote").agg(F.sum("n")).collect()}
    size = FEATURES + 3 * SEEN_LABELERS + 1
    if not patterns:
        return SpanModel((0.0,) * size, threshold)
    soft = reliabilities(patterns)
    rows = counted.orderBy(F.xxhash64("kind", "vote", "holding"), "kind", "vote", "holding").limit(sample).collect()
    x = np.zeros((len(rows), size))
    for i, r in enumerate(rows):
        x[i, r["holding"]] = 1
        for j, v in enumerate(r["vote"]):
            x[i, FEATURES + 3 * j + "-0+".index(v)] = 1
    x[:, -1] = 1
    y = np.array([soft[r["kind"], r["vote"]] for r in rows])
    n = np.array([r["n"] for r in rows], float)
    n = np.minimum(n / n.mean(), 20)
    w = np.zeros(size)
    for _ in range(25):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(size) * 0.5
        w += np.linalg.solve(hessian, x.T @ (n * (y - p)) - 0.5 * w)
    return SpanModel(tuple(w.tolist()), threshold)


def spans_of(text: str | None, model: SpanModel) -> list[tuple[str, int, int, bool, float]]:
    """(kind, start, end, base, score) by start and kind: base spans, and others the model is sure of."""
    out = []
    for s in candidates(text or ""):
        p = model.probability(votes(text, s), features(text, s))
        # What a pattern's own check turns down stays out whatever the model says.
        if s.base or (s.valid >= 0 and p >= model.threshold):
            out.append((s.kind, s.start, s.end, s.base, p))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def detect(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """All columns plus pii, an array of structs (kind, start, end, base, score) in order of start.

    Offsets count code points of the whole text, end exclusive. Base spans follow the patterns; the
    others are shapes that the fitted classifier finds personal. A null or empty text has none;
    repeated rows get equal spans; an empty table gives none; a column named pii is replaced.
    """
    docs = docs.drop("pii")
    at, names = docs.columns.index(text), docs.columns
    kind = "array<struct<kind:string,start:bigint,end:bigint,base:boolean,score:double>>"
    schema = docs.withColumn("pii", F.array().cast(kind)).schema
    arrow = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [
                [dict(zip(("kind", "start", "end", "base", "score"), s, strict=True)) for s in spans_of(t, model)]
                for t in batch.column(at).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow)], names=[*names, "pii"])

    return docs.mapInArrow(run, schema)


def redact(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """The columns of ``docs`` with each span of the text replaced by its kind in brackets.

    Overlapping spans become one, named after the first. Texts without a span stay as they are.
    """
    at, names = docs.columns.index(text), docs.columns

    def clean(t: str | None) -> str | None:
        out, end = [], 0
        for kind, a, b, _, _ in spans_of(t, model):
            if a >= end:
                out += [t[end:a], REDACTED[kind]]
            end = max(end, b)
        return "".join([*out, t[end:]]) if out else t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns = list(batch.columns)
            columns[at] = pa.array([clean(t) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
