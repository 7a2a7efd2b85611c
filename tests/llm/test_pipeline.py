"""The stages of the pipeline, one by one and together."""

import corpus_pipeline
from odd_tables import SCHEMA
from riskloom.llm import simhash
from riskloom.llm.queries import ORACLES, QUERIES


def test_stages_keep_the_columns(spark, odd, none):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, "")
        assert out.columns == odd.columns, name
        assert out.collect() is not None
        assert stage(spark, none, "").isEmpty()


def test_one_of_each_group_stays(spark, odd):
    kept = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, odd, "").collect()]
    assert sorted(i for i in kept if i is not None and i > 2) == [3, 6, 7, 8, 9] and kept.count(2) <= 1 and kept.count(None) == 1


def test_run(spark, sf_dir):
    pieces = corpus_pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert pieces.count() > 0 and pieces.select("doc_id").join(docs, "doc_id", "left_anti").isEmpty()
    assert len([q for q in QUERIES if q.startswith("op")]) == 13 and set(ORACLES) <= set(QUERIES)


def near_copies(spark):
    """Long texts and copies with a few words replaced, so that fingerprints lie on both sides of three bits."""
    rows, at = [], 0
    for group in range(30):
        words = [f"w{group}x{i}" for i in range(40 + 60 * group)]
        for n in range(1 + group % 5):
            own = list(words)
            for k in range(n):
                own[(k * 37 + 11) % len(own)] = f"new{group}y{n}z{k}"
            rows.append((at, " ".join(own), "en", "a", 1, 1, 0.5))
            at += 1
    return spark.createDataFrame(rows, SCHEMA)


def test_one_of_each_group_of_fingerprints_stays(spark):
    docs = near_copies(spark)
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in docs.collect()}
    part = {i: i for i in prints}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    for _ in prints:
        for a, b in links:
            part[a] = part[b] = min(part[a], part[b])
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert links and got == sorted({part[i] for i in prints}) and 30 < len(got) < len(prints)


def test_a_column_named_like_the_key_comes_back(spark, odd):
    named = odd.withColumn("_row", odd.doc_id)
    out = corpus_pipeline.drop_near_duplicates(spark, named, "")
    assert out.schema == named.schema and out.where("NOT (_row <=> doc_id)").isEmpty()


def test_texts_that_share_an_id_and_copies_without_one(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, text, "en", "a", 1, 1, 0.5), (1, "quite another text under the same number as before", "en", "a", 1, 1, 0.5),
            (None, text, "en", "a", 1, 1, 0.5), (None, "only here", "en", "a", 1, 1, 0.5), (None, "only here", "de", "a", 1, 1, 0.5)]
    got = {(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert got == {(1, text), (1, rows[1][1]), (None, "only here")}
