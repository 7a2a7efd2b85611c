"""Substring deduplication: an FM-index per shard, searched backwards over a wavelet matrix."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from riskloom.llm._common import shards_for, sliced, text_characters, words_of

ANCHOR = 3  # words of an anchor
CHUNK_WORDS = 1_000_000
SHARD_CHARACTERS = 12_000_000
WORD_BITS = 40  # of a word's hash in the index: a one-word difference is missed once in 10^12
_ODD = np.uint64(0x9E3779B97F4A7C15)  # multiplier of the rolling hash
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, so that their order is as good as random."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class WaveletMatrix:
    """Rank of a symbol before a position, from one bit vector a level with counts every 64 bits."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.levels = max(1, (size - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        row = symbols.astype(np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bits = ((row >> np.uint32(level)) & np.uint32(1)).astype(np.uint8)
            padded = np.concatenate([bits, np.zeros(64 - len(bits) % 64, np.uint8)])
            words = np.packbits(padded, bitorder="little").view("<u8")
            counts = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64))
            self.zeros.append(int(len(bits) - bits.sum(dtype=np.int64)))
            row = np.concatenate([row[bits == 0], row[bits == 1]])
        self.first = self._descend(np.arange(size, dtype=np.int64), np.zeros(size, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            word = at >> 6
            low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.before[i][word] + np.bitwise_count(self.words[i][word] & low)
            at = np.where((symbol >> level) & 1, self.zeros[i] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._descend(symbol, at) - self.first[symbol]


class FMIndex:
    """Backward search for windows of up to 16 symbols in a text of small numbers, 0 being a separator.

    Suffixes are sorted by their first 16 symbols, which is all that shorter patterns can tell apart.
    """

    def __init__(self, text: np.ndarray, window: int) -> None:
        n = len(text)
        rank = {1: text.astype(np.int64)}
        length = 1
        while length < 16:
            rank[2 * length] = self._pairs(rank[length], rank[length], length)
            length *= 2
        order = np.argsort(rank[16], kind="stable")
        size = int(text.max()) + 1 if n else 1
        self.start = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))]).astype(np.int64)
        self.tree = WaveletMatrix(text[order - 1], size)
        self.order, self.n = order, n
        shorter = self._prefix(rank, window - 1)[order]
        # First and last row of the suffixes that share their first ``window - 1`` symbols with a row.
        new = np.concatenate([[True], shorter[1:] != shorter[:-1]])
        starts = np.nonzero(new)[0]
        group = np.cumsum(new) - 1
        self.low = starts[group]
        self.high = np.concatenate([starts[1:], [n]])[group]

    @staticmethod
    def _pairs(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
        later = np.zeros(len(b), np.int64)
        later[: len(b) - shift] = b[shift:] + 1
        return np.unique(a * (int(b.max(initial=0)) + 2) + later, return_inverse=True)[1]

    def _prefix(self, rank: dict[int, np.ndarray], length: int) -> np.ndarray:
        out, done = None, 0
        for part in (8, 4, 2, 1):
            if length & part:
                out = rank[part] if out is None else self._pairs(out, rank[part], done)
                done += part
        return out

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the suffixes that begin with the symbol and then what [low, high) begins with."""
        ranks = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        base = self.start[symbol]
        return base + ranks[: len(symbol)], base + ranks[len(symbol) :]


def matching_windows(index: FMIndex, segments: list[np.ndarray] | np.ndarray, at: np.ndarray, sizes: np.ndarray, window: int):
    """Yield (segments' numbers, window start, low, high): the rows of each window of each segment.

    ``at`` and ``sizes`` place the segments in one array of symbols. All segments are read backwards together,
    a step for a word: after a window's rows are known, its last word is dropped by widening the rows
    to those that share the other words, and the word before is put in front.
    """
    number = np.arange(len(at))
    low, high = np.zeros(len(at), np.int64), np.full(len(at), index.n, np.int64)
    for step in range(int(sizes.max(initial=0))):
        live = np.nonzero(sizes > step)[0]
        if step >= window:
            row = low[live]
            low[live], high[live] = index.low[row], index.high[row]
        place = sizes[live] - 1 - step
        symbol = segments[at[live] + place].astype(np.int64)
        low[live], high[live] = index.extend(symbol, low[live], high[live])
        if step >= window - 1:
            yield number[live], place, low[live], high[live]


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    """Integer arrays as differences, byte by byte of each place, so that what is small or alike compresses."""
    parts = []
    for name, a in arrays.items():
        a = a.astype(np.int64)
        kind = "d" if name in DELTA else "p"
        if kind == "d":
            a = np.diff(a, prepend=np.int64(0))
            a = (a << 1) ^ (a >> 63)  # small numbers of either sign become small
        width = 8 if a.min(initial=0) < 0 else max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
        planes = a.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T
        parts.append((name, kind, len(a), width, planes.tobytes()))
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(parts, protocol=5))


DELTA = {"vocabulary", "which", "text", "start", "doc"}


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    out = {}
    # Only bytes that this module wrote in the same job are read here.
    for name, kind, n, width, planes in pickle.loads(zstandard.ZstdDecompressor().decompress(data)):
        octets = np.zeros((n, 8), np.uint8)
        octets[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
        a = octets.view("<i8").ravel()
        if kind == "d":
            a = np.cumsum((a.view(np.uint64) >> np.uint64(1)).astype(np.int64) ^ -(a & 1))
        out[name] = a.astype(np.int32) if name == "codes" else a
    return out


def _content(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each stretch [start, end) of the values."""
    n = len(values)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), _ODD)]), dtype=np.uint64)[:n]
    back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), _BACK)]), dtype=np.uint64)[:n]
    total = np.concatenate([[np.uint64(0)], np.cumsum(values * power, dtype=np.uint64)])
    return _mixed((total[end] - total[start]) * back[start]) ^ (end - start).astype(np.uint64)


def _grams(values: np.ndarray) -> np.ndarray:
    """Hashes of ANCHOR values from each place on, but for the last ones."""
    n = len(values)
    gram = values.copy()
    for i in range(1, ANCHOR):
        gram[: n - i] = gram[: n - i] * _ODD + values[i:]
    return _mixed(gram[: max(0, n - ANCHOR + 1)])


def _merged(doc: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Overlapping or touching stretches of one text become one."""
    if not len(doc):
        return [doc, key, start, end]
    order = np.lexsort((start, key, doc))
    doc, key, start, end = doc[order], key[order], start[order], end[order]
    other = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
    # Ends run up within a text only: texts are put on stretches of their own first.
    lift = (np.cumsum(other) - 1) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    new = other | np.concatenate([[True], (start + lift)[1:] > reach[:-1]])
    first = np.nonzero(new)[0]
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return [doc[first], key[first], start[first], reach[last] - lift[first]]


def segments_of(texts: list[tuple[int, int, list[bytes]]], window: int, shards: int) -> Iterator[tuple[int, bytes]]:
    """Cut texts (ident, text hash, words) into segments and route them: (shard, blob).

    A segment is a run of windows with one anchor, the run of ANCHOR words in the window with the least hash. Equal
    windows have equal anchors, so they meet in one shard. Segments that several texts of the chunk share go
    out once, for the smallest ident; in the others all their windows are known to be repeated.
    """
    sizes = np.array([len(w) for _, _, w in texts], np.int64)
    if not len(sizes):
        return
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w) for _, _, words in texts for w in words), np.uint64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    doc = np.array([d for d, _, _ in texts], np.int64)
    text_key = np.array([k for _, k, _ in texts], np.int64)
    n = len(hashes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    # The shards see these bits of the words only, and find the same anchors by them.
    small = hashes >> np.uint64(64 - WORD_BITS)
    gram = _grams(small)
    places = window - ANCHOR + 1
    if len(gram) < places:
        return
    least = np.empty(len(gram) - places + 1, np.int64)
    for a in range(0, len(least), 1 << 16):
        view = np.lib.stride_tricks.sliding_window_view(gram[a : a + (1 << 16) + places - 1], places)
        least[a : a + (1 << 16)] = view.argmin(axis=1) + np.arange(a, a + len(view))
    first = np.nonzero(np.arange(len(least)) + window <= ends[owner[: len(least)]])[0]
    anchor = least[first]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[first[1:]] != owner[first[:-1]])]) if len(first) else np.zeros(0, bool)
    begin = np.nonzero(new)[0]
    if not len(begin):
        return
    stop = np.concatenate([begin[1:], [len(first)]]) - 1
    start, end, text = first[begin], first[stop] + window, owner[first[begin]]
    mark = gram[anchor[begin]]
    content = _content(hashes, start, end)
    from_text = np.concatenate([[0], ends[:-1]])
    order = np.lexsort((start, doc[text], content))
    content, start, end, text, mark = content[order], start[order], end[order], text[order], mark[order]
    group_new = np.concatenate([[True], content[1:] != content[:-1]])
    head = np.nonzero(group_new)[0]
    group = np.cumsum(group_new) - 1
    own = doc[text] == doc[text[head]][group]
    known = ~own
    done = _merged(doc[text[known]], text_key[text[known]], (start - from_text[text])[known], (end - from_text[text])[known])
    shard_of_group = (mark[head] % np.uint64(shards)).astype(np.int64)
    kept = np.nonzero(own)[0]
    shard_of = shard_of_group[group[kept]]
    in_order = np.lexsort((start[kept], shard_of))  # texts follow one another in the chunk
    kept, shard_of = kept[in_order], shard_of[in_order]
    cuts = np.nonzero(np.concatenate([[True], shard_of[1:] != shard_of[:-1]]))[0]
    for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(kept)], strict=True)):
        rows = kept[a:b]
        heads, first_row, which = np.unique(group[rows], return_index=True, return_inverse=True)
        place = np.argsort(first_row)  # segments in the order of their first occurrence
        number = np.empty(len(place), np.int64)
        number[place] = np.arange(len(place))
        s, e = start[head[heads[place]]], end[head[heads[place]]]
        lengths = e - s
        flat = np.repeat(s - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(int(lengths.sum()))
        vocabulary, codes = np.unique(small[flat], return_inverse=True)
        used, text_number = np.unique(text[rows], return_inverse=True)
        blob = {
            "vocabulary": vocabulary, "codes": codes, "lengths": lengths, "which": number[which], "text": text_number,
            "start": (start - from_text[text])[rows], "doc": doc[used], "key": text_key[used],
        }
        if i == 0:
            blob |= dict(zip(("done_doc", "done_key", "done_start", "done_end"), done, strict=True))
        yield int(shard_of[a]), _packed(blob)


def repeated_in_shard(blobs: list[dict], window: int) -> list[np.ndarray]:
    """Stretches (ident, text hash, start, end) of the shard's segments that repeat from smaller idents."""
    out = [[np.zeros(0, np.int64)] * 4]
    out += [[b[c] for c in ("done_doc", "done_key", "done_start", "done_end")] for b in blobs if "done_doc" in b]
    # Blob by blob, as most segments go right after: hashes of the segments, and of each anchor (the least
    # gram) with the words after it and with those before it. A window that two documents share has one
    # of the two in common, since it reaches half of its other words to one side.
    content, sides = [], ([], [])
    reach = (window - ANCHOR + 1) // 2
    for b in blobs:
        values = b["vocabulary"].astype(np.uint64)[b["codes"]]
        begins = np.cumsum(b["lengths"]) - b["lengths"]
        ends = begins + b["lengths"]
        content.append(_content(values, begins, ends))
        grams = _grams(values)
        least = np.minimum.reduceat(np.append(grams, np.uint64(2**64 - 1)), np.stack([begins, ends - ANCHOR + 1], axis=1).ravel())[::2]
        at = np.nonzero(np.append(grams, np.zeros(ANCHOR - 1, np.uint64)) == np.repeat(least, b["lengths"]))[0]
        anchor = at[np.searchsorted(at, begins)]
        for side, low, high in ((sides[0], anchor, anchor + ANCHOR + reach), (sides[1], anchor - reach, anchor + ANCHOR)):
            inside = (low >= begins) & (high <= ends)
            low, high = np.where(inside, low, begins), np.where(inside, high, begins + 1)
            side.append(np.where(inside, _content(values, low, high), np.uint64(0)))
    content = np.concatenate(content)
    lengths = np.concatenate([b["lengths"] for b in blobs])
    shift = np.concatenate([[0], np.cumsum([len(b["lengths"]) for b in blobs])[:-1]])
    which = np.concatenate([b["which"] + s for b, s in zip(blobs, shift, strict=True)])
    doc, key = (np.concatenate([b[c][b["text"]] for b in blobs]) for c in ("doc", "key"))
    start = np.concatenate([b["start"] for b in blobs])
    shared = np.zeros(len(lengths), bool)
    for side in sides:
        names, of_segment = np.unique(np.concatenate(side), return_inverse=True)
        smallest, largest = np.full(len(names), np.iinfo(np.int64).max), np.full(len(names), np.iinfo(np.int64).min)
        np.minimum.at(smallest, of_segment[which], doc)
        np.maximum.at(largest, of_segment[which], doc)
        shared |= ((smallest != largest) & (names != 0))[of_segment]
    # Equal segments of several chunks are indexed once, for the smallest ident.
    texts, of_text = np.unique(content, return_inverse=True)
    owner = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(owner, of_text[which], doc)
    keep = shared[which]
    which, doc, key, start = which[keep], doc[keep], key[keep], start[keep]
    if not len(which):
        return _merged(*map(np.concatenate, zip(*out, strict=True)))
    later = doc > owner[of_text[which]]
    out.append([doc[later], key[later], start[later], start[later] + lengths[which[later]]])
    which, doc, key, start = which[~later], doc[~later], key[~later], start[~later]
    used, one = np.unique(of_text[which], return_index=True)
    segment = which[one]  # one copy of each distinct segment
    sizes = lengths[segment]
    at = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    home = np.searchsorted(shift, segment, side="right") - 1
    for i in np.unique(home):
        b, here = blobs[i], np.nonzero(home == i)[0]
        n = sizes[here]
        begins = (np.cumsum(b["lengths"]) - b["lengths"])[segment[here] - shift[i]]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        # 0 is the separator, so words are told apart by their hash plus one.
        text[np.repeat(at[here], n) + within] = b["vocabulary"][b["codes"][np.repeat(begins, n) + within]] + 1
    symbols, text = np.unique(text, return_inverse=True)
    owners = owner[used]
    index = FMIndex(text, window)
    row_owner = np.repeat(owners, sizes + 1)[index.order]
    repeats = np.zeros((len(segment), int(sizes.max())), bool)
    for number, place, low, high in matching_windows(index, text, at, sizes, window):
        # The smallest ident among the rows of each window's interval.
        bounds = np.stack([low, high], axis=1).ravel()
        least = np.minimum.reduceat(np.append(row_owner, np.iinfo(np.int64).max), bounds)[::2]
        repeats[number, place] = least < owners[number]
    occurrence, place = np.nonzero(repeats[np.searchsorted(used, of_text[which])])
    out.append([doc[occurrence], key[occurrence], start[occurrence] + place, start[occurrence] + place + window])
    return _merged(*map(np.concatenate, zip(*out, strict=True)))


def repeated_stretches(docs: DataFrame, ident: str, text: str, window: int) -> DataFrame:
    """(_id, _key, _start, _end): stretches of words covered by windows that a smaller ident also has."""
    shards = shards_for(text_characters(docs, text), SHARD_CHARACTERS, least=24)
    plain = docs.where(F.col(ident).isNotNull() & F.col(text).isNotNull()).select(
        F.col(ident).cast("long").alias("_id"), F.xxhash64(text).alias("_key"), F.col(text).alias("_text")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list) -> pa.RecordBatch:
            made = list(segments_of(held, window, shards))
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([s for s, _ in made], pa.int64()), "blob": pa.array([b for _, b in made], pa.binary())}
            )

        held, words = [], 0
        for batch in sliced(batches):
            for i, k, t in zip(*(batch.column(c).to_pylist() for c in ("_id", "_key", "_text")), strict=True):
                found = words_of(t)
                if len(found) >= window:
                    held.append((i, k, found))
                    words += len(found)
                if words >= CHUNK_WORDS:
                    yield rows(held)
                    held, words = [], 0
        yield rows(held)

    def search(table: pa.Table) -> pa.Table:
        blobs = [_unpacked(b) for b in table.column("blob").to_pylist()]
        found = repeated_in_shard(blobs, window)
        return pa.table([pa.array(c, pa.int64()) for c in found], names=["_id", "_key", "_start", "_end"])

    routed = plain.mapInArrow(cut, "shard long, blob binary")
    return routed.groupBy("shard").applyInArrow(search, "_id long, _key long, _start long, _end long")


def remove_repeated(docs: DataFrame, ident: str = "doc_id", text: str = "text", window: int = 13) -> DataFrame:
    """All columns plus n_words, n_removed, kept_text: without words of windows that a smaller ident has.

    A window is ``window`` (at most 16) consecutive words of one text; words are runs without ASCII white space. All
    windows are judged on the input. kept_text joins the kept words by one space. Windows are compared by
    WORD_BITS bits of the hashes of their words. A null text has no words; a text with fewer words than a window loses none;
    rows with a null ident neither lose words nor take them from others; rows with one ident do not take words
    from each other; an empty table gives an empty result. Columns with the three names are replaced.
    """
    if not ANCHOR <= window <= 16:
        raise ValueError("the window must have 3 to 16 words")
    out = ("n_words", "n_removed", "kept_text")
    docs = docs.drop(*out)
    names = docs.columns
    found = repeated_stretches(docs, ident, text, window)
    spans = found.groupBy("_id", "_key").agg(F.collect_list(F.struct("_start", "_end")).alias("_spans"))
    at = names.index(text)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3).compress
        for batch in sliced(batches):
            columns = list(batch.columns)
            data = [None if t is None else small(t.encode("utf-8", "surrogatepass")) for t in columns[at].to_pylist()]
            columns[at] = pa.array(data, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    # The texts cross the shuffle compressed one by one, which takes half as much as Spark's own codec.
    keyed = docs.withColumn("_of", F.col(ident).cast("long")).withColumn("_hash", F.xxhash64(text))
    small = StructType([StructField(f.name, BinaryType()) if f.name == text else f for f in keyed.schema.fields])
    joined = keyed.mapInArrow(squeeze, small).join(
        spans, (F.col("_of") == F.col("_id")) & (F.col("_hash") == F.col("_key")), "left"
    ).select(*[F.col(f"`{c}`") for c in names], "_spans")
    schema = docs.selectExpr("*", "0L AS n_words", "0L AS n_removed", "'' AS kept_text").schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = zstandard.ZstdDecompressor().decompress
        for batch in sliced(batches):
            columns: list[list] = [[], [], []]
            texts = [None if t is None else whole(t).decode("utf-8", "surrogatepass") for t in batch.column(at).to_pylist()]
            given = list(batch.columns[:-1])
            given[at] = pa.array(texts, pa.string())
            for t, stretches in zip(texts, batch.column("_spans").to_pylist(), strict=True):
                words = words_of(t)
                keep = np.ones(len(words), bool)
                for s in stretches or ():
                    keep[s["_start"] : s["_end"]] = False
                kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k] if stretches else words
                for c, v in zip(columns, (len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "surrogatepass")), strict=True):
                    c.append(v)
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*given, *arrays], names=[*names, *out])

    return joined.mapInArrow(cut, schema)


