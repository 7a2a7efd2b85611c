"""LM scoring by online logistic context mixing of hashed-context bit predictors."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm._common import shards_for, sliced, staged, text_characters, words_of

# A word is coded as the 8 bits of its class, a hash of the word, and then as a member of the class. The bits are
# what the context predictors mix; members follow the corpus counts, which grow with the input. Words that are not
# hot are coded among their kin, a part of the class, under the word before: these counts grow with the input as well.
BITS = 8
CLASSES = 1 << BITS
ORDERS = 2  # contexts of one and of two words before
END = b"\n"  # no word holds white space
SHARD_CHARACTERS = 48_000_000
CHUNK_WORDS = 300_000
HOT_SHARE = 1 << 18  # words with this part of all tokens or more: at most so many (4 MB), looked up in memory
MIXED_WORDS = 150_000  # words that are mixed at once
WEIGHED_WORDS = 12_000  # words that a weight step takes at once: their logits stay in the processor's cache
STEP = 0.125  # of a stored prediction, in logits
BLOCK = 32  # words between two updates of the weights
FOLDS = 4  # parts of the training texts; the weights of each are learned under the tables of the others
WEIGHT_STEPS = 2  # Newton steps, each over all training texts
LEVEL = np.arange(BITS)
NODES = (1 << LEVEL) | (np.arange(CLASSES)[:, None] >> (BITS - LEVEL))  # (CLASSES, BITS): where each bit is coded
ONES = ((np.arange(CLASSES)[:, None] >> (BITS - 1 - LEVEL)) & 1).astype(np.float32)
SIGNS = 2 * ONES - 1


HASHED_BYTES = 4_000_000  # of texts whose words are hashed at once
IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
END_HASH = np.uint64(xxhash.xxh64_intdigest(END))
P1, P2, P3, P4, P5 = (
    np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def token_hashes(text: str | None) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    words = words_of(text, lower=True)
    words.append(END)
    return np.fromiter(map(digest, words), np.uint64, len(words))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint64(by) | x >> np.uint64(64 - by)


def _xxh64(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XXH64 of the words of ``data``, all of one length at a time; words of 32 bytes and more one by one."""
    out = np.empty(len(starts), np.uint64)
    padded = np.frombuffer(data + bytes(8), np.uint8)
    eight, four = (np.ndarray(len(data), kind, padded, strides=(1,)) for kind in ("<u8", "<u4"))
    order = np.argsort(np.minimum(sizes, 32).astype(np.uint8), kind="stable")
    cuts = np.cumsum(np.bincount(np.minimum(sizes, 32), minlength=33))
    for size in range(1, 32):
        places = order[cuts[size - 1] : cuts[size]]
        if not len(places):
            continue
        at, left = starts[places], size
        h = np.full(len(at), P5 + np.uint64(size))
        while left >= 8:
            h = _turned(h ^ _turned(eight[at] * P2, 31) * P1, 27) * P1 + P4
            at, left = at + 8, left - 8
        if left >= 4:
            h = _turned(h ^ four[at] * P1, 23) * P2 + P3
            at, left = at + 4, left - 4
        for i in range(left):
            h = _turned(h ^ padded[at + i] * P5, 11) * P1
        h = (h ^ h >> np.uint64(33)) * P2
        h = (h ^ h >> np.uint64(29)) * P3
        out[places] = h ^ h >> np.uint64(32)
    for i in order[cuts[31] :].tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]])
    return out


def hashes_of(texts: list[str | None]) -> Iterator[np.ndarray]:
    """token_hashes of each text; the words of many texts are hashed together."""

    def together(some: list[bytes]) -> Iterator[np.ndarray]:
        data = b" ".join(some).lower() + b" "
        space = IS_SPACE[np.frombuffer(data, np.uint8)]
        turns = np.flatnonzero(np.diff(space, prepend=True))
        starts = turns[0::2]
        ends = np.cumsum([len(t) + 1 for t in some])
        last = np.searchsorted(starts, ends)
        out = np.full(len(starts) + len(some), END_HASH)
        out[np.arange(len(starts)) + np.repeat(np.arange(len(some)), np.diff(last, prepend=0))] = _xxh64(data, starts, turns[1::2] - starts)
        a = 0
        for b in (last + np.arange(1, len(some) + 1)).tolist():
            yield out[a:b]
            a = b

    held, size = [], 0
    for text in texts:
        held.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= HASHED_BYTES:
            yield from together(held)
            held, size = [], 0
    if held:
        yield from together(held)


def class_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def starts_of(texts: list[np.ndarray]) -> np.ndarray:
    n = np.array([len(t) for t in texts], np.int64)
    return np.cumsum(n) - n


def contexts(hashes: np.ndarray, rows: int, starts: np.ndarray) -> np.ndarray:
    """(ORDERS, tokens): hashed table rows of the words before each token; ``starts`` are the first tokens of the texts."""
    before, earlier = np.empty_like(hashes), np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[starts] = 1
    earlier[1:] = before[:-1]
    earlier[starts] = 2
    first = _scramble(before)
    second = _scramble(first + earlier * np.uint64(0x9E3779B97F4A7C15))
    return np.stack([(c % np.uint64(rows)).astype(np.int64) for c in (first, second)])


def node_logits(leaves: np.ndarray) -> np.ndarray:
    """Stored logits of a one at each node 1..255 of the class tree, from the counts of its leaves."""
    out = np.zeros(leaves.shape, np.int8)
    for level in range(BITS):
        sums = leaves.reshape(*leaves.shape[:-1], 2 << level, -1).sum(axis=-1)
        zero, one = sums[..., 0::2], sums[..., 1::2]
        logit = np.log((one + 0.4) / (zero + 0.4))
        out[..., 1 << level : 2 << level] = np.clip(np.round(logit / STEP), -127, 127)
    return out


@dataclass(frozen=True)
class MixingModel:
    rows: int  # of each hashed table
    tables: bytes  # int8 logits: order 0, then ORDERS x rows x CLASSES
    weights: tuple[float, ...]  # of the first word: (BITS, 2, 2 + ORDERS)
    member: tuple[float, ...]  # log10 of the mass of each class, for the words in it
    rate: float = 0.02

    def logits(self) -> list[np.ndarray]:
        flat = np.frombuffer(self.tables, np.int8)
        return [flat[:CLASSES], *flat[CLASSES:].reshape(ORDERS, -1)]


def _inputs(tables: list[np.ndarray], places: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Logits of each bit of the classes: (inputs, tokens, BITS) for tokens of any shape."""
    nodes = NODES[classes]
    x = np.empty((len(tables) + 1, *nodes.shape), np.float32)
    x[0] = tables[0].take(nodes)
    for i, place in enumerate(places, 1):
        x[i] = tables[i].take((place * CLASSES)[..., None] + nodes)
    x[-1] = 0.25 / STEP
    x *= STEP
    return x


def mixed_log10(model: MixingModel, tables: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Log10 probability of the class bits of each text, and the texts' final weights.

    Each bit's logit is the weighted sum of the predictors' logits; the weights are chosen by the bit's place and by
    whether the longest context has been seen. Every text starts from the model's weights, which follow
    the coding gradient after each BLOCK of words, so a text's score depends on that text alone.
    """
    inputs, all_bits = ORDERS + 2, np.ones(BITS, np.float32)
    start = np.array(model.weights, np.float32).reshape(BITS, 2, inputs).transpose(1, 2, 0)
    order = np.argsort([-len(t) for t in texts], kind="stable")
    w = np.repeat(start[:, :, None], len(texts), axis=2)  # gate, input, text, bit
    total = np.zeros(len(texts))
    if len(texts):
        flat, starts = np.concatenate(texts), starts_of(texts)[order]
        sizes = np.array([len(texts[i]) for i in order])
        places, classes = contexts(flat, model.rows, starts_of(texts)), class_of(flat)
        for a in range(0, int(sizes.max()), BLOCK):
            live = int((sizes > a).sum())
            word = a + np.arange(min(BLOCK, int(sizes[0]) - a))[:, None]
            real = word < sizes[:live]
            at = np.minimum(starts[:live] + word, len(flat) - 1)  # word, text
            x = _inputs(tables, places[:, at], classes[at])  # input, word, text, bit
            sign = SIGNS[classes[at]]
            sign[~real] = 0
            seen = (x[ORDERS] != 0).astype(np.float32)
            plain, more = w[0, :, :live], w[1, :, :live] - w[0, :, :live]
            z, added = x[0] * plain[0], x[0] * more[0]
            for i in range(1, inputs):
                z += x[i] * plain[i]
                added += x[i] * more[i]
            z += seen * added
            miss = np.exp(-sign * np.clip(z, -12, 12))
            total[:live] -= ((np.log(1 + miss) @ all_bits) * real).sum(axis=0, dtype=np.float64)
            error = sign * (miss / (1 + miss))
            error_seen = error * seen
            for i in range(inputs):
                on = (error_seen * x[i]).sum(axis=0)
                w[0, i, :live] += model.rate * ((error * x[i]).sum(axis=0) - on)
                w[1, i, :live] += model.rate * on
    out, last = np.empty(len(texts)), np.empty((len(texts), BITS, 2, inputs), np.float32)
    out[order], last[order] = total / np.log(10), w.transpose(2, 3, 0, 1)
    return out, last


def kin_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def tags_before(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """32 bits of a hash of the word before each token; texts begin after ends."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[starts] = 1
    return (_scramble(before) >> np.uint64(32)).astype(np.uint32)


def find(wanted: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of the wanted values in ``known``, which is sorted; -1 where they are not."""
    if not len(known):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, at, -1)


class KinContexts:
    """Words that are not hot, under the word before and among their kin.

    p(w | before, kin) = max(c - D, 0) / C + D N / C * p(w | kin): c counts the pair, C all words of the kin after that
    word, N those that differ, and D = n1 / (n1 + 2 n2) is the discount for pairs seen once and twice, one of each added.
    Words never seen share 0.1 of a count in each class, as in p(w | class). Where the word before
    has not been followed by this kin, p(w | kin) stands as it is.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, is_hot: np.ndarray, bits: int) -> None:
        """``words`` are sorted as signed numbers and hold all kin of each of their words."""
        self.words, self.counts, self.bits = words, counts, bits
        self.kins, self.kin_at = np.unique(kin_of(words.view(np.uint64), bits), return_inverse=True)
        mass = np.bincount(self.kin_at, np.where(is_hot, 0, counts + 0.1), len(self.kins))
        self.mass = mass + 0.1 * 2.0 ** (BITS - bits)

    def learn(self, codes: np.ndarray) -> None:
        """``codes``: of each training token, the place of its word (from 0) and in the lower 32 bits its tag."""
        self.pairs, self.times = np.unique(codes, return_counts=True)
        once, twice = int((self.times == 1).sum()) + 1, int((self.times == 2).sum()) + 1
        self.discount = once / (once + 2 * twice)
        held = self.kin_at[self.pairs >> 32] << 32 | self.pairs & 0xFFFFFFFF
        self.held, at = np.unique(held, return_inverse=True)
        self.total = np.bincount(at, self.times, len(self.held))
        self.left = self.discount * np.bincount(at, minlength=len(self.held)) / np.maximum(self.total, 1)

    def gains(self, words: np.ndarray, place: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """log10 of p(w | before, kin) / p(w | kin) for each token; ``place`` is -1 for words never seen."""
        out = np.zeros(len(words))
        if not len(self.pairs):
            return out
        tags = tags.astype(np.int64)
        kin = find(kin_of(words.view(np.uint64), self.bits), self.kins)
        held = find(kin << 32 | tags, self.held)  # a kin of -1 gives a negative number, which is not there
        some = np.nonzero(held >= 0)[0]
        held, kin, place = held[some], kin[some], place[some]
        pair = find(place << 32 | tags[some], self.pairs)
        c = np.where(pair >= 0, self.times[pair], 0)
        plain = (np.where(place >= 0, self.counts[place], 0) + 0.1) / self.mass[kin]
        out[some] = np.log10(np.maximum(c - self.discount, 0) / self.total[held] / plain + self.left[held])
        return out


def _pack(value: object) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(value, protocol=5))


def _unpack(data: bytes) -> dict:
    # Only bytes that this module wrote in the same job are read here.
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def word_counts(training: DataFrame) -> DataFrame:
    """(word, c): hashes of all tokens of the training texts and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list[np.ndarray]) -> pa.RecordBatch:
            words, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts.astype(np.int64))], names=["word", "c"])

        held, size = [], 0
        for batch in sliced(batches):
            for hashes in hashes_of(batch.column("_text").to_pylist()):
                held.append(hashes)
                size += len(held[-1])
                if size >= 4 * CHUNK_WORDS:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    return training.select("_text").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _by_fold(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Texts of (_key, _text), about so many words at a time. Equal texts are of one fold."""
    held: list[list[np.ndarray]] = [[] for _ in range(FOLDS)]
    size = [0] * FOLDS
    for batch in sliced(batches):
        for key, hashes in zip(batch.column("_key").to_pylist(), hashes_of(batch.column("_text").to_pylist()), strict=True):
            fold = key % FOLDS
            held[fold].append(hashes)
            size[fold] += len(held[fold][-1])
            if size[fold] >= words:
                yield fold, held[fold]
                held[fold], size[fold] = [], 0
    yield from ((fold, texts) for fold, texts in enumerate(held) if texts)


def context_tables(training: DataFrame, rows: int, slabs: int = 32) -> list[tuple[int, int, int, bytes]]:
    """Logits of the hashed tables, as (without, order, slab, bytes): each task counts all its texts into whole tables,
    which are added up slab by slab as a stream. The tables without a fold count all texts but its own;
    those without fold FOLDS, which no text has, count all."""
    each = -(-rows // slabs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((FOLDS, ORDERS, each * slabs * CLASSES), np.uint16)
        spill: dict[tuple[int, int, int], int] = {}
        some = False
        for fold, texts in _by_fold(batches, CHUNK_WORDS):
            some = True
            hashes = np.concatenate(texts)
            classes = class_of(hashes)
            for order, place in enumerate(contexts(hashes, rows, starts_of(texts))):
                own = tables[fold, order]
                slot, n = np.unique(place * CLASSES + classes, return_counts=True)
                full = own[slot].astype(np.int64) + n
                over = full > 65535
                for s, v in zip(slot[over].tolist(), full[over].tolist(), strict=True):
                    spill[fold, order, s] = spill.get((fold, order, s), 0) + v
                own[slot] = np.where(over, 0, full)
        if not some:
            return
        for fold in range(FOLDS):
            for order in range(ORDERS):
                more = {s: v for (f, o, s), v in spill.items() if (f, o) == (fold, order)}
                for slab in range(slabs):
                    a, b = slab * each * CLASSES, (slab + 1) * each * CLASSES
                    part = tables[fold, order][a:b]
                    slots = np.nonzero(part)[0].astype(np.uint32)
                    extra = {s - a: v for s, v in more.items() if a <= s < b}
                    blob = _pack({"slots": np.diff(slots, prepend=np.uint32(0)), "n": part[slots], "extra": extra})
                    yield row(fold, order, slab, blob)

    def row(fold: int, order: int, slab: int, blob: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"fold": pa.array([fold]), "ord": pa.array([order]), "slab": pa.array([slab]), "blob": pa.array([blob])})

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for fold, order, slab, blob in zip(*(batch.column(c).to_pylist() for c in ("fold", "ord", "slab", "blob")), strict=True):
                own = sums.setdefault((order, slab), np.zeros((FOLDS, each * CLASSES), np.int64))[fold]
                got = _unpack(blob)
                own[np.cumsum(got["slots"])] += got["n"]
                for s, v in got["extra"].items():
                    own[s] += v
        for (order, slab), own in sums.items():
            every = own.sum(axis=0)
            for fold in range(FOLDS + 1):
                left = every - own[fold] if fold < FOLDS else every
                yield row(fold, order, slab, node_logits(left.reshape(each, CLASSES)).tobytes())

    schema = "fold long, ord long, slab long, blob binary"
    parts = training.select("_key", "_text").mapInArrow(count, schema).repartition(ORDERS * slabs, "ord", "slab").mapInArrow(add_up, schema)
    return [tuple(r) for r in parts.collect()]


def _weight_step(training: DataFrame, without: list[MixingModel], weights: np.ndarray) -> np.ndarray:
    """One Newton step of the weights on the coding cost of all training texts, each under the tables without its fold."""
    inputs = ORDERS + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logits = [m.logits() for m in without]
        sums = np.zeros((BITS, 2, inputs, inputs + 1))  # second derivatives, then the first
        for fold, texts in _by_fold(batches, MIXED_WORDS):
            flat = np.concatenate(texts)
            places, classes = contexts(flat, without[fold].rows, starts_of(texts)), class_of(flat)
            for at in range(0, len(flat), WEIGHED_WORDS):
                part = slice(at, at + WEIGHED_WORDS)
                every, ones = _inputs(logits[fold], places[:, part], classes[part]), ONES[classes[part]].T
                for x, one, w, out in zip(np.ascontiguousarray(every.transpose(2, 0, 1)), ones, weights, sums, strict=True):
                    seen = (x[ORDERS] != 0).astype(np.float32)
                    plain, other = w @ x
                    p = 1 / (1 + np.exp(-np.clip(plain + seen * (other - plain), -12, 12)))
                    error, curve = one - p, p * (1 - p)
                    for gate, own in enumerate((1 - seen, seen)):
                        out[gate, :, :-1] += (x * (curve * own)) @ x.T
                        out[gate, :, -1] += x @ (error * own)
        flat_sums = sums.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat_sums))), pa.array(flat_sums)], names=["cell", "v"])

    sums = np.zeros(BITS * 2 * inputs * (inputs + 1))
    for r in training.select("_key", "_text").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        sums[r["cell"]] = r["v"]
    sums = sums.reshape(BITS, 2, inputs, inputs + 1)
    step = np.linalg.solve(sums[..., :-1] + np.eye(inputs), sums[..., -1:])[..., 0]
    # Rounded, since sums of doubles may differ in their last digits from run to run.
    return np.round(weights + step, 5).astype(np.float32)


def fit(training: DataFrame, counts: DataFrame, total: int, most_bits: int = 13) -> MixingModel:
    """The mixing model of all training texts (columns _key, _text) and their word counts.

    The tables have a row for about 1,024 tokens, at most 2^``most_bits`` rows, the bound of what is
    broadcast (2 MB an order, once for all texts and once for each fold left out); contexts share rows by their hash. The tables
    that score count every training text. The first weights are learned on every training text as well,
    under context tables that count the texts of the other folds.
    """
    bits = min(most_bits, max(4, int(total).bit_length() - 10))
    rows = 1 << bits
    slabs = min(32, rows)
    each = -(-rows // slabs)
    tables = np.zeros((FOLDS + 1, ORDERS, slabs, each, CLASSES), np.int8)
    for fold, order, slab, data in context_tables(training, rows, slabs):
        tables[fold, order, slab] = np.frombuffer(data, np.int8).reshape(each, CLASSES)
    sizes = counts.groupBy(F.shiftrightunsigned("word", 64 - BITS).alias("cls")).agg(F.sum("c").alias("c"), F.count("*").alias("v"))
    mass, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sizes.collect():
        mass[r["cls"]], distinct[r["cls"]] = r["c"], r["v"]
    # A class also has the words that the corpus lacks, a tenth of a count for each class.
    order0 = node_logits(np.maximum(mass + 0.1 * (distinct + 1), 1e-9)[None])
    member = np.log10(mass + 0.1 * (distinct + 1))
    weights = np.zeros((BITS, 2, ORDERS + 2), np.float32)
    weights[..., 0] = 0.8
    weights[..., 1:-1] = 0.2
    flat = [order0.tobytes() + t.reshape(ORDERS, -1, CLASSES)[:, :rows].tobytes() for t in tables]
    *without, whole = (MixingModel(rows, data, (), tuple(member.tolist())) for data in flat)
    for _ in range(WEIGHT_STEPS):
        weights = _weight_step(training, without, weights)
    return replace(whole, weights=tuple(weights.ravel().tolist()))


def score_texts(
    docs: DataFrame, training: Column, ident: str = "doc_id", text: str = "text", hot_share: int = HOT_SHARE
) -> DataFrame:
    """ident, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each row.

    Learns from the rows for which ``training`` holds (a null counts as not). Tokens are lower-cased words and one end
    for each text. base_score is the additive unigram's log10 probability, score the mixing model's: each word's
    class bits under the mixed contexts, and the word within its class by the same counts as the base, for words that
    are not hot corrected by the counts of pairs of words (KinContexts). Pairs are counted in the shards, whose number grows
    with the input, from the same rows that are scored. Words are told apart by 64-bit hashes, words before by 32 bits. A null or empty text is its end alone; repeated rows get equal
    values; without training rows every word is unknown; an empty table gives an empty result.
    """
    plain = docs.select(
        F.col(ident).alias("_id"), F.xxhash64(text).alias("_key"), F.col(text).alias("_text"),
        F.coalesce(training, F.lit(False)).alias("_train"),
    )
    learned = plain.where("_train")
    shards = shards_for(text_characters(docs, text), SHARD_CHARACTERS, least=12)
    counts = staged(word_counts(learned), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    model = fit(learned, counts, total)
    # At most hot_share words have so large a share; with them apart, no word is a hot key below.
    found = counts.where(F.col("c") * hot_share >= total).toArrow()
    hot, hot_counts = (found.column(x).to_numpy().astype(np.int64) for x in ("word", "c"))
    hot, hot_counts = hot[np.argsort(hot)], hot_counts[np.argsort(hot)]

    # Kin are in one shard: classes as long as a shard has several, then parts of them.
    kin_bits = max(BITS, int(shards).bit_length() + 2)

    def look_up(words: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Counts of the words, 0 where unknown; ``known`` is sorted."""
        at = find(words, known)
        return np.where(at >= 0, values[at], 0) if len(known) else np.zeros(len(words), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, member = model.logits(), np.array(model.member)

        def rows(held: list[tuple]) -> pa.RecordBatch:
            ids, keys, train, texts, size = zip(*held, strict=True)
            groups, size_of = [[]], 0
            for t in texts:
                if size_of >= MIXED_WORDS:
                    groups.append([])
                    size_of = 0
                groups[-1].append(t)
                size_of += len(t)
            bits = np.concatenate([mixed_log10(model, tables, g)[0] for g in groups])
            flat = np.concatenate(texts)
            n = np.array([len(t) for t in texts])
            owner = np.repeat(np.arange(len(texts)), n)
            classes = np.bincount(owner, weights=member[class_of(flat)], minlength=len(texts))
            words = flat.view(np.int64)
            c = look_up(words, hot, hot_counts)
            is_hot = c > 0
            log = np.where(is_hot, np.log10(c + 0.1), 0)
            logs = np.bincount(owner, weights=log, minlength=len(texts))
            known = np.bincount(owner[is_hot], minlength=len(texts))
            whole = {"id": ids, "key": keys, "train": train, "n": n, "known": known, "logs": logs, "mix": bits - classes, "bytes": size}
            # Other words go out to the shards that hold their counts and those of their kin, with the words before.
            rest = np.nonzero(~is_hot)[0]
            tags = tags_before(flat, np.cumsum(n) - n)[rest]
            distinct, which = np.unique(words[rest], return_inverse=True)
            shard = np.mod(kin_of(distinct.view(np.uint64), kin_bits), shards)[which]
            order = np.argsort(shard * max(len(distinct), 1) + which, kind="stable")
            out: list[tuple[int, bytes]] = []
            cuts = np.searchsorted(shard[order], np.arange(shards + 1))
            mine = int(np.mod(keys[0] or 0, shards))
            for s in range(shards):
                part = order[cuts[s] : cuts[s + 1]]
                if not len(part) and s != mine:
                    continue
                members, first = np.unique(which[part], return_index=True)
                blob = {
                    "words": distinct[members], "first": first.astype(np.uint32), "owner": owner[rest[part]].astype(np.uint32),
                    "tags": tags[part], "ids": ids, "keys": keys, "train": train, "whole": whole if s == mine else None,
                }
                out.append((s, _pack(blob)))
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], names=["shard", "blob"])

        held, size = [], 0
        for batch in sliced(batches):
            ids, keys, texts, train = (batch.column(c).to_pylist() for c in ("_id", "_key", "_text", "_train"))
            for i, k, t, tr, hashes in zip(ids, keys, texts, train, hashes_of(texts), strict=True):
                held.append((i, k, tr, hashes, len((t or "").encode("utf-8", "surrogatepass"))))
                size += len(hashes)
                if size >= CHUNK_WORDS:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    names = ("_id", "_key", "_train", "_n", "_known", "_logs", "_gain", "_mix", "_bytes", "_rows")
    out_kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), *(pa.float64(),) * 3, pa.int64(), pa.int64())
    out_schema = "_id long, _key long, _train boolean, _n long, _known long, _logs double, _gain double, _mix double, _bytes long, _rows long"

    def add(blobs: pa.Table, known: pa.Table) -> pa.Table:
        words, c = (known.column(x).to_numpy().astype(np.int64) for x in ("word", "c"))
        order = np.argsort(words)
        words, c = words[order], c[order]
        kin = KinContexts(words, c, c * hot_share >= total, kin_bits)

        def tokens(data: bytes) -> tuple[dict, np.ndarray, np.ndarray]:
            """The blob, the place of each token's word in ``words``, and the words."""
            b = _unpack(data)
            times = np.diff(np.append(b["first"], len(b["owner"])).astype(np.int64))
            return b, np.repeat(find(b["words"], words), times), np.repeat(b["words"], times)

        # Blobs are opened twice, since all pairs have to be counted before the first is scored.
        learned_codes = [np.zeros(0, np.int64)]
        for data in blobs.column("blob"):
            b, place, _ = tokens(data.as_py())
            mine = np.array(b["train"], bool)[b["owner"]] & (place >= 0)
            learned_codes.append(place[mine] << 32 | b["tags"][mine].astype(np.int64))
        kin.learn(np.concatenate(learned_codes))
        del learned_codes
        columns: list[list] = [[] for _ in names]
        for data in blobs.column("blob"):
            b, place, every = tokens(data.as_py())
            each = np.where(place >= 0, c[place], 0) if len(c) else np.zeros(len(place), np.int64)
            n = len(b["ids"])
            logs = np.bincount(b["owner"], weights=np.log10(each + 0.1), minlength=n)
            gains = np.bincount(b["owner"], weights=kin.gains(every, place, b["tags"]), minlength=n)
            hits = np.bincount(b["owner"], weights=each > 0, minlength=n).astype(np.int64)
            some = np.nonzero(np.bincount(b["owner"], minlength=n))[0] if len(b["owner"]) else np.zeros(0, np.int64)
            fill = len(some)
            parts = ([b["ids"][i] for i in some], [b["keys"][i] for i in some], [None] * fill, [0] * fill,
                     hits[some].tolist(), logs[some].tolist(), gains[some].tolist(), [0.0] * fill, [0] * fill, [0] * fill)
            for column, part in zip(columns, parts, strict=True):
                column.extend(part)
            if (w := b["whole"]) is not None:
                parts = (w["id"], w["key"], w["train"], w["n"].tolist(), w["known"].tolist(), w["logs"].tolist(), [0.0] * n, w["mix"].tolist(), w["bytes"], [1] * n)
                for column, part in zip(columns, parts, strict=True):
                    column.extend(part)
        return pa.table([pa.array(x, k) for x, k in zip(columns, out_kinds, strict=True)], names=list(names))

    routed = plain.withColumn("_id", F.col("_id").cast("long")).mapInArrow(run, "shard long, blob binary")
    by_shard = counts.withColumn("shard", F.pmod(F.shiftrightunsigned("word", 64 - kin_bits), F.lit(shards).cast("long")))
    parts = routed.groupBy("shard").cogroup(by_shard.groupBy("shard")).applyInArrow(add, out_schema)
    sums = parts.groupBy("_id", "_key").agg(
        F.max("_train").alias("_train"), *[F.sum(c).alias(c) for c in ("_n", "_known", "_logs", "_gain", "_mix", "_bytes", "_rows")]
    )
    # Rows with one ident and text have been added up; each gets its part.
    rows = F.col("_rows")
    n = (F.col("_n") / rows).cast("long")
    logs = F.col("_logs") / rows
    floor = float(np.log10(total + 0.1 * (distinct + 1)))
    score = logs + (F.col("_gain") + F.col("_mix")) / rows
    return sums.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), rows))).select(
        F.col("_id").alias(ident),
        (~F.col("_train")).alias("held_out"),
        n.alias("n_tokens"),
        (F.col("_known") / rows).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (logs - n * floor).alias("base_score"),
        score.alias("score"),
        F.when(F.col("_bytes") > 0, -score * float(np.log2(10)) * rows / F.col("_bytes")).alias("bits_per_byte"),
    )
