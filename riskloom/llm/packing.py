"""Mixture-controlled packing of documents into fixed-length token sequences."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm._common import sliced, staged

_CUT = re.compile(r"(?<=\S) (?=\S)").split
_FIRST = "\x00"  # before units that no space leads: the first of a text and, with their break, those of its lines
_LINE_BREAK = re.compile(r"\n(?=\S)(?<=\S\n)").sub
_TAIL = ",.;:!?#&*%"
# Units kept by each worker in each of two generations, besides those of one slice of texts; about 100 MB together.
CACHE_UNITS = 200_000
SLICE_BYTES = 4_000_000  # of texts that are cut at once
_UNITS_AT_ONCE = 50
_GROUPS_AT_ONCE = 20  # the tokenizer's results are large: few are held
# Letters whose kind no version of Unicode changes; their bytes have these signs in a byte-level vocabulary.
_OLD_LETTERS = "\u0240"
_OTHERS = iter(range(256, 512))
_SIGNS = np.array([b if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else next(_OTHERS) for b in range(256)], "<u4")
_SPACE = chr(_SIGNS[32])


class UnitEncoder:
    """Token ids of texts by a byte-level BPE tokenizer, with a bounded cache of space-led units.

    A byte-level BPE vocabulary never merges across a space between two other characters, so a text is
    cut there and each distinct unit is encoded once. Texts with white space next to a space are cut
    only where that holds. A tokenizer that cuts words by the usual byte-level pattern does not merge across a line break
    between two other characters or between a letter and punctuation after it either: lines are cut as well,
    and a unit that ends in punctuation has the ids of the unit without it and those of its end. A unit of letters is one
    word of that pattern, so its bytes meet the merges without it.
    Ids equal those of ``encode(text, add_special_tokens=False)``.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        self.wide = size > 1 << 16
        self.dtype = np.dtype("<u4") if self.wide else np.dtype("<u2")
        self.starts, self.breaks = np.zeros(size, bool), np.zeros(size, bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.starts[number] = token.startswith(_SPACE)
            self.breaks[number] = token == "Ċ"  # and of a line feed
        made = json.loads(self.tokenizer.to_str())
        cutting = made["pre_tokenizer"] or {}
        self.usual = made["normalizer"] is None and cutting.get("type") == "ByteLevel" and cutting.get("use_regex", True)
        self.letters = None
        if self.usual and not cutting.get("add_prefix_space") and all(t["special"] for t in made["added_tokens"]):
            self.letters = Tokenizer(self.tokenizer.model)
            self.letters.pre_tokenizer = pre_tokenizers.Split(_SPACE, "merged_with_next")
        self.tails: dict[str, bytes] = {}  # of up to three characters
        self.new: dict[str, bytes | None] = {"": None}
        self.old: dict[str, bytes | None] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _tail(self, tail: str) -> bytes:
        if len(tail) > 3:
            return self._whole(tail)
        if tail not in self.tails:
            self.tails[tail] = self._whole(tail)
        return self.tails[tail]

    def _learn(self, units: Iterable[str]) -> None:
        new, old = self.new, self.old
        words, plain, lines, ended = set(), set(), [], []

        def cut_off(unit: str, core: str) -> None:
            ended.append((unit, core))
            if core not in new:
                if (ids := old.get(core)) is not None:
                    new[core] = ids
                else:
                    (words if core.isalpha() else plain).add(core)

        for unit in units:
            if (ids := old.get(unit)) is not None:
                new[unit] = ids
            elif unit.isalpha():
                words.add(unit)
            elif self.usual and (core := unit.rstrip(_TAIL)).isalpha() and core[-1] < "\u0250":
                cut_off(unit, core)
            elif len((parts := unit.split())) != 1 or parts[0] != unit:
                line = unit[:2] == "\x00\n" and parts[-1] == unit[2:]
                if line and self.usual and len(parts) == 2:
                    lines.append(unit)
                elif unit[0] == _FIRST:
                    new[unit] = self._whole(unit[1:])
                elif unit[0].isspace() or unit[-1].isspace():
                    new[unit] = None  # not a unit: its text is cut by the slower rule
                else:
                    new[unit] = self._whole(" " + unit)
            elif unit[0] == _FIRST:
                new[unit] = self._whole(unit[1:])
            else:
                core = unit.rstrip(_TAIL) if self.usual else unit
                if len(core) == len(unit) or not (core[-1:].isalpha() and core[-1] < "\u0250"):
                    plain.add(unit)
                else:
                    cut_off(unit, core)
        if self.letters:
            later = {word for word in words if not word.isascii() and max(word) >= _OLD_LETTERS}
            self._learn_joined(list(words - later), _SPACE, self.starts)
            words = later
        self._learn_joined([*plain, *words], " ", self.starts)
        self._learn_joined(lines, _FIRST, self.breaks)
        for unit, core in ended:
            new[unit] = new[core] + self._tail(unit[len(core) :])

    def _learn_joined(self, units: list[str], lead: str, starts: np.ndarray) -> None:
        """Encode many units at a time; a unit's ids begin at a token of ``starts``. Lines hold their lead themselves."""
        lines, letters = lead == _FIRST, lead == _SPACE
        tokenizer = self.letters if letters else self.tokenizer
        before = " " if letters else lead
        for at in range(0, len(units), _UNITS_AT_ONCE * _GROUPS_AT_ONCE):
            some = units[at : at + _UNITS_AT_ONCE * _GROUPS_AT_ONCE]
            groups = [some[i : i + _UNITS_AT_ONCE] for i in range(0, len(some), _UNITS_AT_ONCE)]
            joined = ["".join(group).replace(_FIRST, "") if lines else before + before.join(group) for group in groups]
            if letters:
                joined = [_SIGNS[np.frombuffer(x.encode(), np.uint8)].tobytes().decode("utf-32-le") for x in joined]
            for group, encoded in zip(groups, tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
                ids = np.array(encoded.ids, self.dtype)
                cuts = np.nonzero(starts[ids])[0].tolist()
                if len(cuts) != len(group):
                    for unit in group:
                        self.new[unit] = self._whole(unit[1:] if lines else before + unit)
                    continue
                data, width = ids.tobytes(), self.dtype.itemsize
                for unit, a, b in zip(group, cuts, [*cuts[1:], len(ids)], strict=True):
                    self.new[unit] = data[a * width : b * width]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.new) > CACHE_UNITS:
            self.old, self.new = self.new, {"": None}
        if not texts:
            return []
        known = self.new
        # The sign itself: such texts are encoded whole.
        whole = {i for i, text in enumerate(texts) if text and _FIRST in text}
        marked = [_FIRST + (text if text and i not in whole else "") for i, text in enumerate(texts)]
        if self.usual:
            marked = [_LINE_BREAK(" \x00\n", text) for text in marked]
        cut = pc.split_pattern(pa.array(marked, pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        units = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(known.get, units))
        missing = [i for i, ids in enumerate(found) if ids is None and units[i] not in known]
        self._learn([units[i] for i in missing])
        for i in missing:
            found[i] = known[units[i]]
        ids = pc.take(pa.array(found, pa.large_binary()), coded.indices)
        bounds = np.asarray(cut.offsets)
        broken = np.diff(np.cumsum(np.append(0, ~np.asarray(ids.is_valid())))[bounds]) if ids.null_count else np.zeros(len(texts))
        _, ends, data = ids.buffers()
        at, data = np.frombuffer(ends, "<i8")[bounds].tolist(), memoryview(data or b"")
        out = []
        for i, (text, slow, a, b) in enumerate(zip(texts, broken.tolist(), at, at[1:], strict=False)):
            if i in whole:
                out.append(self._whole(text))
            elif slow:
                first, *later = _CUT(text)
                parts = [self._whole(first)]
                for unit in later:
                    parts.append(known.get(unit) or self._whole(" " + unit))
                out.append(b"".join(parts))
            else:
                out.append(bytes(data[a:b]))
        return out


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One encoder per worker process, so that its cache lasts from task to task."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def _sliced_by_size(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about SLICE_BYTES of texts, or of one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(), dtype=np.int64)
        a = 0
        while a < batch.num_rows:
            before = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
            yield batch.slice(a, b - a)
            a = b


def tokenized(docs: DataFrame, ident: str, text: str, source: str, tokenizer: str, end_id: int) -> DataFrame:
    """Rows (_id, _source, _part, _before, _n, _ids): ids as little-endian unsigned 32-bit or 16-bit numbers.

    _part is the task that encoded the row and _before the tokens of the same source before it in that
    task, so that the order of each source's stream needs no sort. Written out before it is used.
    """
    plain = docs.select(
        F.col(ident).cast("long").alias("_id"), F.col(source).cast("string").alias("_source"), F.col(text).alias("_text")
    )
    schema = "_id long, _source string, _part long, _before long, _n long, _ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], own.dtype).tobytes()
        width = own.dtype.itemsize
        before: dict[str | None, int] = {}
        for rows in _sliced_by_size(batches):
            sources = rows.column("_source").to_pylist()
            ids = [x + end for x in own.encode(rows.column("_text").to_pylist())]
            sizes, starts = [len(x) // width for x in ids], []
            for s, n in zip(sources, sizes, strict=True):
                starts.append(before.get(s, 0))
                before[s] = starts[-1] + n
            yield pa.RecordBatch.from_arrays(
                [rows.column("_id"), rows.column("_source"), pa.array([part] * len(ids), pa.int64()),
                 pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                names=["_id", "_source", "_part", "_before", "_n", "_ids"],
            )

    return staged(plain.mapInArrow(run, schema), "tokens")


@dataclass(frozen=True)
class Phase:
    """A stretch of the packed stream in which the same sources are served."""

    start: int  # of the packed stream
    length: int
    taken: dict[int, int]  # tokens of each served source before this phase
    below: dict[int, int]  # weights of the served sources before it, in order
    weights: dict[int, int]
    total: int  # of the weights

    def served(self, s: int, x: int) -> int:
        """Tokens of source s among the first x of the phase: its weight's share, with what rounding
        leaves carried on, as a deficit counter does."""
        low = self.below[s]
        return x * (low + self.weights[s]) // self.total - x * low // self.total

    def lower(self, s: int, x0: int, x1: int) -> int:
        """Tokens of the sources before s among the x0-th to the x1-th of the phase."""
        low = self.below[s]
        return x1 * low // self.total - x0 * low // self.total


def phases(totals: list[int], weights: list[int]) -> list[Phase]:
    """Serve sources by weight until one is used up, then share its part among the rest, and so on."""
    left = dict(enumerate(totals))
    out, start = [], 0
    while active := [s for s, n in left.items() if n > 0]:
        if not any(weights[s] for s in active):
            shares = {s: left[s] for s in active}  # only sources without a weight are left
        else:
            shares = {s: weights[s] for s in active if weights[s]}
        total = sum(shares.values())
        length = min(left[s] * total // w for s, w in shares.items())
        if length == 0:  # less than one round: the shortest queue is served out
            s = min(shares, key=lambda s: left[s] * total // shares[s])
            shares, total, length = {s: 1}, 1, left[s]
        below, run = {}, 0
        for s in shares:
            below[s], run = run, run + shares[s]
        phase = Phase(start, length, {s: totals[s] - left[s] for s in shares}, below, shares, total)
        for s in shares:
            left[s] -= phase.served(s, length)
        out.append(phase)
        start += length
    return out


def placed(plan: list[Phase], s: int, a: int, b: int, window: int) -> Iterator[tuple[int, int, int]]:
    """Where tokens a to b (end exclusive) of source s lie: (first token, packed position, length).

    In each window the quota of each served source is one stretch, in order of the sources.
    """
    for phase in plan:
        if s not in phase.weights:
            continue
        base = phase.taken[s]
        count = phase.served(s, phase.length)
        lo, hi = max(a, base) - base, min(b, base + count) - base
        while lo < hi:
            # The window that holds the lo-th token of s in this phase: guess by its share, then step.
            x = min(phase.length - 1, lo * phase.total // phase.weights[s])
            n = (phase.start + x) // window
            while True:
                x0 = max(0, n * window - phase.start)
                x1 = min(phase.length, (n + 1) * window - phase.start)
                first, last = phase.served(s, x0), phase.served(s, x1)
                if lo < first:
                    n -= 1
                elif lo >= last:
                    n += 1
                else:
                    break
            stop = min(hi, last)
            yield base + lo, phase.start + x0 + phase.lower(s, x0, x1) + lo - first, stop - lo
            lo = stop


def pack(
    docs: DataFrame,
    tokenizer: str,
    ident: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: dict[str | None, int] | None = None,
    length: int = 2048,
    window_sequences: int = 16,
    end_id: int = 1,
) -> DataFrame:
    """Pack every token of every row into sequences of ``length`` tokens, mixed by source.

    Each source is a queue of its rows' tokens. Every window of ``window_sequences`` sequences is filled by
    deficit round-robin: a source gets its share of the window, and the fraction that whole tokens
    leave over is carried to later windows. The counters have a closed form (Phase.served), so every task
    finds the place of its own rows from the tokens before them, whichever windows and partitions
    they meet. ``weights`` (whole numbers by source; default: each source's tokens) hold while all
    queues have tokens; a queue that ends leaves its share to the rest. All sequences but the last are
    full. Only the number of tokens of each source comes to the driver.

    Returns one row per piece: ident, source, start, length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset. A null or empty text is the end id alone; a null source is a source
    of its own, last in order; repeated rows are packed each; an empty table gives no piece. A row's
    pieces are cut at sequence ends and where a window's quota ends.
    """
    tokens = tokenized(docs, ident, text, source, tokenizer, end_id)
    parts = staged(tokens.groupBy("_source", "_part").agg(F.sum("_n").alias("_sum")), "task-tokens")
    totals = {r[0]: r[1] for r in parts.groupBy("_source").agg(F.sum("_sum")).collect()}
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    wanted = totals if weights is None else {s: int(weights.get(s, 0)) for s in order}
    plan = phases([totals[s] for s in order], [wanted[s] for s in order])
    number = {s: i for i, s in enumerate(order)}
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(
        F.col("_source").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base")
    )
    # Spark broadcasts the bases while they are small (sources x tasks) and shuffles otherwise; they are
    # keyed by task as well, so a large source is no hot key.
    rows = tokens.join(bases, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p"))).select(
        "_id", "_source", (F.col("_base") + F.col("_before")).alias("_at"), "_n", "_ids"
    )
    window = length * window_sequences
    schema = (
        f"`{ident}` long, `{source}` string, start long, length long, ids binary, doc_tokens long, "
        "sequence_id long, offset long"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns = [batch.column(c).to_pylist() for c in ("_id", "_source", "_at", "_n", "_ids")]
            out: list[list] = [[] for _ in range(8)]
            for doc, src, at, n, raw in zip(*columns, strict=True):
                width = len(raw) // n
                ids = np.frombuffer(raw, "<u2" if width == 2 else "<u4").astype("<u4")
                for first, position, size in placed(plan, number[src], at, at + n, window):
                    while size:
                        here = min(size, length - position % length)
                        start = first - at
                        for column, value in zip(
                            out,
                            (doc, src, start, here, ids[start : start + here].tobytes(), n, position // length, position % length),
                            strict=True,
                        ):
                            column.append(value)
                        first, position, size = first + here, position + here, size - here
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = [ident, source, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, schema)
