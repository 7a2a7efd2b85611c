"""Operators on texts against plain versions, on odd rows and on empty tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import langid, lm_scoring, mixing, packing, pii, simhash, substrings, toxicity
from riskloom.llm._common import tokenizer_path, words_of
from riskloom.queries.registry import table

TOKENIZER = tokenizer_path("byte_bpe_50k.json")


def test_every_pair_within_the_radius_meets():
    masks = simhash.covering_masks(3)
    rng = np.random.default_rng(0)
    for _ in range(300):
        flip = sum(1 << int(i) for i in rng.choice(64, rng.integers(0, 4), replace=False))
        assert any(flip & m == 0 for m in masks)


def test_components_equal_brute_force(spark, sf_dir):
    got = {r.doc_id: r for r in simhash.near_duplicate_components(table(spark, sf_dir, "documents")).collect()}
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    prints = {i: simhash.fingerprint(t) for i, t in texts.items()}
    label = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for i in texts:
            low = min(label[j] for j in texts if (prints[i] ^ prints[j]).bit_count() <= 3)
            changed |= low != label[i]
            label[i] = low
    assert {i: got[i].component_id for i in texts} == label
    assert all(got[i].fingerprint == f"{prints[i]:016x}" for i in texts)


def test_simhash_odd_rows(odd, none):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicate_components(odd).collect()}
    assert got[3, "0" * 16] == got[4, "0" * 16] == got[5, "0" * 16] == 3
    assert simhash.near_duplicate_components(none).isEmpty()


def removed_plainly(rows, window=13):
    first, out = {}, {}
    for i, t in rows:
        w = words_of(t)
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            first[key] = min(first.get(key, i), i)
    for i, t in rows:
        w = words_of(t)
        keep = [True] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                keep[j : j + window] = [False] * window
        out[i] = (len(w), len(w) - sum(keep), b" ".join(x for x, k in zip(w, keep) if k).decode())
    return out


def test_repeated_windows_equal_brute_force(spark, sf_dir, odd, none):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    expected = removed_plainly([tuple(r) for r in docs.collect()])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_repeated(docs).collect()}
    assert got == expected
    rows = substrings.remove_repeated(odd).collect()
    assert len(rows) == odd.count() and {r.n_removed for r in rows if r.doc_id == 2} == {14}
    assert {(r.doc_id, r.n_words) for r in rows if not r.text} == {(3, 0), (4, 0)}
    assert substrings.remove_repeated(none).isEmpty()


def test_fm_index_counts():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 5, 400)
    index = substrings.FMIndex(np.append(text, 0), 6)
    at, sizes = np.array([0, 100]), np.array([60, 40])
    for number, place, low, high in substrings.matching_windows(index, text, at, sizes, 6):
        for k, p, a, b in zip(number, place, low, high):
            w = text[at[k] + p : at[k] + p + 6]
            assert b - a == sum((text[i : i + 6] == w).all() for i in range(395))


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


@pytest.mark.parametrize("text", [
    "a@b@c.de x@y.z.w. @q.r a@b.com@d.org", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4", "4417744280351547 4417 7442 8035 1547 4417744280351548",
    "+1 (171) 555-2028, +12 +1 2 3 4 5 6 7 8 9 0 ((", "é 9.9.9.9 ü a.b@c.d", "5 -- 5 5", "",
])
def test_base_spans_equal_the_patterns(text):
    expected = set()
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                expected.add((kind, *m.span()))
    assert {(s.kind, s.start, s.end) for s in pii.base_spans(text)} == expected


def test_pii_odd_rows(odd, none):
    model = pii.fit(odd)
    rows = {(r.doc_id, r.text): r.pii for r in pii.detect(odd, model).collect()}
    kinds = [[s.kind for s in v] for (i, _), v in rows.items() if i == 7]
    assert kinds == [["ip", "email"]]
    assert pii.redact(odd, model).where("doc_id = 7").first().text == "Straße Ü [IP] mail [EMAIL] now"
    assert pii.detect(none, pii.fit(none)).isEmpty() and pii.redact(odd, model).columns == odd.columns


def test_languages_are_told_apart(spark, odd, none):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    asked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = langid.identify(docs.where(asked), langid.fit(docs.where(~asked)))
    assert found.where("lang = lang_pred").count() >= 0.95 * found.count()
    assert found.where("accepted").count() >= 0.97 * found.count()
    rows = langid.identify(odd, langid.fit(odd)).collect()
    assert all(r.lang_pred == "und" and not r.accepted for r in rows if r.doc_id in (3, 4, 5, 8)) and len(rows) == odd.count()
    assert {r.lang_pred for r in langid.identify(odd, langid.fit(none)).collect()} == {"und"}
    assert langid.identify(none, langid.fit(none)).isEmpty()


def test_toxic_texts_are_found(spark, odd, none):
    sf = "/root/testdata/sf0.1"
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = toxicity.fit(docs.where(~held), labels.where(~held))
    scored = toxicity.score_toxicity(docs.where(held).join(labels, "doc_id"), model)
    n = {(r.toxic, r.predicted): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.8 * (n[1, 1] + n[1, 0]) and n.get((0, 1), 0) <= 0.02 * (n[0, 0] + n.get((0, 1), 0))
    rows = toxicity.score_toxicity(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert toxicity.score_toxicity(none, toxicity.fit(none, labels)).isEmpty()


def check_packing(rows, texts, end=1):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(TOKENIZER)
    encode.encode_special_tokens = True
    ids = {i: [*encode.encode(t or "", add_special_tokens=False).ids, end] for i, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        got = np.frombuffer(r.ids, "<u4").tolist()
        assert len(got) == r.length and r.doc_tokens == len(ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, got))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {i: sum((g for _, g in sorted(p)), []) for i, p in by_doc.items()} == ids
    for number, pieces in by_sequence.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 2048 or number == max(by_sequence)


def test_packing_is_a_round_trip(spark, sf_dir, odd, none):
    docs = table(spark, sf_dir, "documents")
    check_packing(packing.pack(docs, TOKENIZER).collect(), {r.doc_id: r.text for r in docs.collect()})
    once = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = packing.pack(once, TOKENIZER, weights={"a": 3, None: 1}).collect()
    check_packing(rows, {r.doc_id: r.text for r in once.collect()})
    assert packing.pack(odd, TOKENIZER).agg(F.sum("length")).first()[0] > sum(r.length for r in rows)
    assert packing.pack(none, TOKENIZER).isEmpty()


def test_cached_units_give_the_tokenizers_ids():
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(TOKENIZER)
    encode.encode_special_tokens = True
    texts = ["a  b", " a", "a ", "x\ny z", "it's  \n\n ok no", "\x00 é ü", None, "", "a b a b", "日本 語", "\x1c q"]
    got = packing.UnitEncoder(TOKENIZER).encode(texts)
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [encode.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_lines_and_punctuation_are_cut_without_changing_ids(monkeypatch):
    from tokenizers import Tokenizer

    single = []
    whole = packing.UnitEncoder._whole
    monkeypatch.setattr(packing.UnitEncoder, "_whole", lambda self, text: single.append(text) or whole(self, text))
    rng = np.random.default_rng(3)
    pieces = ["ab", "Né", "x1", "don't", "l'été", "中文", "\u0301", "9", ",", ".", "###", "!?", "'s", "\n", "\n", "\n", " ", " ", " ", "\t", "\r\n", "\u00a0", "\x1c", "\x85"]
    texts = ["".join(pieces[i] for i in rng.integers(0, len(pieces), 12)) for _ in range(3000)]
    texts += ["a \x00bc d", "\x00\nab cd", "ab\n\x00cd", "a \nb", "\nab\ncd", "ab,\ncd.", "<|endoftext|>,\nab"]
    own, plain = packing.UnitEncoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    plain.encode_special_tokens = True
    for some in (texts[:1500], texts[1500:]):
        for text, ids in zip(some, own.encode(some), strict=True):
            assert np.frombuffer(ids, own.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
    # Words at the starts of lines are encoded in groups, words with punctuation after them as the word.
    own, single[:] = packing.UnitEncoder(TOKENIZER), []
    words = [chr(97 + i % 26) + chr(97 + i // 26) for i in range(500)]
    own.encode(["\n".join(f"w{w} v{w}," for w in words)])
    assert len(single) < 5 and own.new["vab"] + own.tails[","] == own.new["vab,"]

def test_words_of_letters_meet_the_merges_without_the_pattern(monkeypatch):
    from tokenizers import Tokenizer

    own, plain = packing.UnitEncoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    rng = np.random.default_rng(4)
    letters = [chr(c) for c in range(0x260) if chr(c).isalpha()] + ["日", "\u0301", "ʰ", "я"]
    words = ["".join(letters[i] for i in rng.integers(0, len(letters), 1 + n % 4)) for n in range(3000)]
    texts = ["w " + " ".join(words[a : a + 30]) + ", w" for a in range(0, 3000, 30)]
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, own.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert own.encode([]) == []
    own._tail(",")
    own.tokenizer = None
    own._learn(["vvab", "Ñandúé,"])
    for unit in ("vvab", "Ñandúé", "Ñandúé,"):
        assert np.frombuffer(own.new[unit], own.dtype).tolist() == plain.encode(" " + unit, add_special_tokens=False).ids
    # Texts are cut at once by their size, not by their number.
    monkeypatch.setattr(packing, "SLICE_BYTES", 10)
    rows = pa.RecordBatch.from_pydict({"_text": ["a" * 4, None, "b" * 6, "c", "d" * 30, None, "", "e"]})
    assert [len(b.column(0)) for b in packing._sliced_by_size([rows.slice(0, 0), rows, rows.slice(3)])] == [3, 1, 1, 3, 1, 1, 3]


def test_the_tree_deals_the_blocks(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    mixes = [{r.doc_id: r for r in mixing.mix(docs, blocks=64, tree_seed=t).collect()} for t in (1, 1, 2)]
    assert mixes[0] == mixes[1]
    assert {i: r.taken for i, r in mixes[0].items()} == {i: r.taken for i, r in mixes[2].items()}
    places = [{(i, k.first, p.shard, p.position) for i, r in m.items() for k in r.kept for p in k.places} for m in mixes]
    moved = places[0] - places[2]
    assert len(moved) > 0.1 * len(places[0])
    for m in mixes:
        # A block is one stretch of words of its source: its place is the same in every document that it meets.
        by_place = {}
        for r in m.values():
            for k in r.kept:
                assert k.times == len(k.places)
                for p in k.places:
                    by_place.setdefault((p.shard, p.position), set()).add(r.source)
        assert all(len(sources) == 1 for sources in by_place.values())
        sizes = [sum(1 for s, _ in by_place if s == shard) for shard in range(16)]
        assert max(sizes) - min(sizes) <= 1
        assert all({p for s, p in by_place if s == shard} == set(range(sizes[shard])) for shard in range(16))


def test_mixing_meets_its_targets(spark, odd, none):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = mixing.mix(docs).collect()
    assert sorted(r.doc_id for r in rows) == list(range(docs.count())) and all(r.taken <= 2 * r["size"] for r in rows)
    total, by = sum(r["size"] for r in rows), {}
    for r in rows:
        by.setdefault(r.source, [r.target, r.source_size, 0, 0])
        by[r.source][2] += r.taken
        by[r.source][3] += r["size"]
    assert abs(sum(v[0] for v in by.values()) - 1.5 * total) < 1e-6 * total
    assert all(v[1] == v[3] and abs(v[2] - v[0]) <= 0.002 * v[1] + 2 for v in by.values())
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    odd_rows = mixing.mix(odd).collect()
    assert len(odd_rows) == odd.count() and all(r.taken == 0 for r in odd_rows if r["size"] == 0)
    copies = mixing.mixed_documents(odd)
    assert copies.columns == odd.columns
    assert sum(len(words_of(r.text)) for r in copies.collect()) == sum(r.taken for r in odd_rows)
    assert mixing.mix(none).isEmpty() and mixing.mixed_documents(none).isEmpty()


def test_splitting_tree_keeps_quotas(spark):
    start = spark.createDataFrame([(1, [700, 0, 51, 1000])], "node long, quotas array<long>")
    leaves = [r.quotas for r in mixing.shard_quotas(start, 8, 3).collect()]
    assert np.array(leaves).sum(axis=0).tolist() == [700, 0, 51, 1000]
    assert {sum(q) for q in leaves} <= {1751 // 8, 1751 // 8 + 1} and np.std([q[0] for q in leaves]) > 0


def test_lm_counts_equal_plain_ones(spark, sf_dir, odd, none):
    docs = table(spark, sf_dir, "documents")
    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    rows = {r.doc_id: r for r in lm_scoring.score_texts(docs, training).collect()}
    words = {r.doc_id: [*words_of(r.text, lower=True), b"\n"] for r in docs.collect()}
    count = {}
    for i, w in words.items():
        for x in w if zlib.crc32(str(i).encode()) % 10 else ():
            count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, w in words.items():
        base = sum(np.log10((count.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in count for x in w), n)
        assert r.base_score == pytest.approx(base) and r.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)
    assert sum(r.score for r in rows.values()) > sum(r.base_score for r in rows.values())
    got = lm_scoring.score_texts(odd, F.col("doc_id") < 6).collect()
    assert len(got) == odd.count() and {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    assert lm_scoring.score_texts(none, F.lit(True)).isEmpty()


def test_lm_learns_from_every_training_text(spark, sf_dir):
    """The tables that score count all training texts, and the first weights are the best of all of them."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), F.col("text").alias("_text"))
    counts = lm_scoring.word_counts(docs)
    model = lm_scoring.fit(docs, counts, counts.agg(F.sum("c")).first()[0])
    texts = [(r._key, lm_scoring.token_hashes(r._text)) for r in docs.collect()]

    def context_rows(hashes):
        return lm_scoring.contexts(hashes, model.rows, np.zeros(1, int))

    def tables(texts):
        leaves = np.zeros((2, model.rows, 256), int)
        for hashes in texts:
            for own, place in zip(leaves, context_rows(hashes), strict=True):
                np.add.at(own, (place, lm_scoring.class_of(hashes)), 1)
        return list(lm_scoring.node_logits(leaves).reshape(2, -1))

    whole = model.logits()
    assert all((a == b).all() for a, b in zip(whole[1:], tables([h for _, h in texts]), strict=True))
    weights = np.array(model.weights).reshape(8, 2, 4)
    slope = {"first": np.zeros((8, 2, 4)), "learned": np.zeros((8, 2, 4))}
    for fold in range(lm_scoring.FOLDS):
        logits = [whole[0], *tables([h for k, h in texts if k % lm_scoring.FOLDS != fold])]
        for key, hashes in texts:
            if key % lm_scoring.FOLDS != fold:
                continue
            classes = lm_scoring.class_of(hashes)
            x = lm_scoring._inputs(logits, context_rows(hashes), classes)
            gate = (x[2] != 0).astype(int)
            for name, w in (("first", np.broadcast_to([0.8, 0.2, 0.2, 0], (8, 2, 4))), ("learned", weights)):
                z = np.einsum("inb,nbi->nb", x, w[np.arange(8), gate])
                error = (classes[:, None] >> (7 - np.arange(8)) & 1) - 1 / (1 + np.exp(-z))
                for g in (0, 1):
                    slope[name][:, g] += np.einsum("nb,inb->bi", error * (gate == g), x)
    assert len(texts) > 100 and np.abs(slope["learned"]).sum() < 0.02 * np.abs(slope["first"]).sum()


def test_words_are_hashed_together_with_the_same_hashes(monkeypatch):
    rng = np.random.default_rng(5)
    pieces = ["a", "B", "É", "日", "\x00", "\x1c", "\xa0", " ", "\t", "\n", "\x0b\x0c", "abcdefgh"]
    texts = ["".join(pieces[i] for i in rng.integers(0, len(pieces), n % 90)) for n in range(900)]
    texts += ["x" * n for n in range(70)] + [None, "", " ", "\ud800 a", "Q" * 32 + " " + "é" * 40]
    plain = [lm_scoring.token_hashes(text) for text in texts]
    for most in (1, 300, 1 << 20):
        monkeypatch.setattr(lm_scoring, "HASHED_BYTES", most)
        for one, other in zip(lm_scoring.hashes_of(texts), plain, strict=True):
            assert one.dtype == other.dtype and one.tolist() == other.tolist()
    assert list(lm_scoring.hashes_of([])) == []
    single = []
    digest = lm_scoring.xxhash.xxh64_intdigest
    monkeypatch.setattr(lm_scoring.xxhash, "xxh64_intdigest", lambda word: single.append(word) or digest(word))
    list(lm_scoring.hashes_of(["short words, " * 50 + "x" * 31, "y" * 32]))
    assert single == [b"y" * 32]


def test_class_bits_are_a_distribution():
    model = lm_scoring.MixingModel(4, np.random.default_rng(0).integers(-40, 40, 256 + 2 * 4 * 256).astype(np.int8).tobytes(),
                                   (0.5,) * (8 * 2 * 4), (0.0,) * 256)
    texts = [np.array([c << 56], np.uint64) for c in range(256)]
    log10, _ = lm_scoring.mixed_log10(model, model.logits(), texts)
    assert (10**log10).sum() == pytest.approx(1, abs=1e-5)


def test_words_after_a_word_are_a_distribution():
    rng = np.random.default_rng(1)
    words = np.unique(rng.integers(-(2**63), 2**63 - 1, 3000))
    counts = rng.integers(1, 9, len(words))
    is_hot = counts == 8
    kin = lm_scoring.KinContexts(words, counts, is_hot, 8)
    rare = np.nonzero(~is_hot)[0]
    kin.learn(rng.choice(rare, 6000) << 32 | rng.integers(0, 5, 6000))
    own = lm_scoring.kin_of(words.view(np.uint64), 8)
    for k in (0, 100, 255):
        members = np.nonzero((own == k) & ~is_hot)[0]
        new = np.array([k << 56 | 12345], np.uint64).view(np.int64)
        for tag in (1, 4, 99):  # 99: a word before that was never seen
            each = np.append(words[members], new)
            place = np.append(members, -1)
            gain = kin.gains(each, place, np.full(len(each), tag, np.uint32))
            plain = (np.append(counts[members], 0) + 0.1) / kin.mass[list(kin.kins).index(k)]
            assert (plain * 10**gain).sum() == pytest.approx(1)
            assert tag != 99 or not gain.any()


def test_lm_pairs_equal_plain_counts(spark, sf_dir):
    """With few hot words, scores differ from those without pairs by gains counted in plain dictionaries."""
    training = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    docs = table(spark, sf_dir, "documents")
    docs = docs.unionByName(docs.where("doc_id % 9 = 0").withColumn("doc_id", F.col("doc_id") + 10**6))
    rows = {r.doc_id: r for r in lm_scoring.score_texts(docs, training, hot_share=256).collect()}
    plain = {r.doc_id: r for r in lm_scoring.score_texts(docs, training).collect()}  # all words are hot in a table this small
    tokens = {r.doc_id: lm_scoring.token_hashes(r.text).tolist() for r in docs.collect()}
    learned = {i for i in tokens if zlib.crc32(str(i).encode()) % 10}
    count = Counter(w for i in learned for w in tokens[i])
    total = sum(count.values())
    hot = {w for w, c in count.items() if c * 256 >= total}
    pairs = Counter((u, w) for i in learned for u, w in zip([1, *tokens[i][:-1]], tokens[i], strict=True) if w not in hot)
    seen = {}
    for (u, w), c in pairs.items():
        n, k = seen.get((u, w >> 56), (0, 0))
        seen[u, w >> 56] = n + c, k + 1
    mass = {}
    for w, c in count.items():
        mass[w >> 56] = mass.get(w >> 56, 0.1) + (0 if w in hot else c + 0.1)
    discount = []
    for shard in range(12):
        once, twice = (sum(c == t and (w >> 56) % 12 == shard for (_, w), c in pairs.items()) + 1 for t in (1, 2))
        discount.append(once / (once + 2 * twice))
    for i, words in tokens.items():
        gain = 0.0
        for u, w in zip([1, *words[:-1]], words, strict=True):
            if w not in hot and (u, w >> 56) in seen:
                n, k = seen[u, w >> 56]
                d = discount[(w >> 56) % 12]
                gain += np.log10(max(pairs[u, w] - d, 0) / n / ((count[w] + 0.1) / mass[w >> 56]) + d * k / n)
        assert rows[i].score - plain[i].score == pytest.approx(gain, abs=1e-6)
        assert rows[i].base_score == pytest.approx(plain[i].base_score) and rows[i].n_known == plain[i].n_known


def test_sha_of_no_spans_is_that_of_nothing(spark, sf_dir):
    from riskloom.llm.queries import QUERIES

    row = QUERIES["op2_pii_weak_supervision"](spark, sf_dir).where("spans = ''").first()
    assert row.base_sha256 == hashlib.sha256(b"").hexdigest()
