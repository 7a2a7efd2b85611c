"""CSV files with line breaks inside quotes, read in many ranges, against Spark's one-task reader."""

import random

import pytest

from riskloom.sources.line_breaks import rows_of, scan_ranges
from riskloom.sources.tables import read_csv, write_csv

from comparable import rows

OPTIONS = {"header": True, "escape": '"', "nullValue": "\u0000", "emptyValue": "", "multiLine": True}


@pytest.fixture
def ranges_of(spark):
    """Sets the length of a range of a file, in bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def set_to(length):
        for n in names:
            spark.conf.set(n, str(length))

    yield set_to
    for n, v in before.items():
        spark.conf.set(n, v)


def field(rng):
    parts = ["word", "\n", '"', ",", "é漢", " ", "\n\n", "x" * 40, "'", "\t"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(12)))


def quoted(text):
    return '"' + text.replace('"', '""') + '"'


def written(path, table, end="\n", header=("id", "a", "b")):
    lines = [",".join(quoted(c) if c not in ("id", "b") else c for c in header)]
    lines += [f"{i},{quoted(a)},{quoted(b) if set(b) & set(',') or '\n' in b or '\"' in b else b}" for i, a, b in table]
    path.write_bytes(end.join(lines).encode() + end.encode())
    return str(path)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equal_to_one_task(spark, tmp_path, ranges_of, end):
    rng = random.Random(3)
    table = [(i, field(rng), field(rng)) for i in range(700)]
    table[100] = (100, "a text that fills ranges\n" * 200, "end")  # rows that start, fill and end ranges
    table[101] = (101, '"\n' * 500, "")
    path = written(tmp_path / "in.csv", table, end)
    ranges_of(1000)
    found = scan_ranges(spark, path)
    assert found.count() > 20 and found.where("inside").count() > 3
    whole = rows_of(spark, [path], found)
    assert whole.rdd.getNumPartitions() > 20
    got = read_csv(spark, path)
    assert got.count() == len(table)
    one_task = spark.read.csv(path, **OPTIONS)
    texts = got.selectExpr("cast(id as string) as id", "a", "b")
    kept = one_task.selectExpr("id", "nullif(a, '') as a", "nullif(b, '') as b")
    assert rows(texts) == rows(kept)
    by_id = {r.id: (r.a, r.b) for r in got.collect()}
    assert all(by_id[i] == (a or None, b or None) for i, a, b in table)


def test_files_with_and_without_breaks(spark, tmp_path, ranges_of):
    rng = random.Random(4)
    folder = tmp_path / "files with blanks"
    folder.mkdir()
    plain = [(i, f"text {i}", "b") for i in range(300)]
    broken = [(1000 + i, field(rng), "b") for i in range(300)]
    broken_head = [(2000 + i, "a\nb", "c") for i in range(30)]
    written(folder / "p.csv", plain)
    written(folder / "q.csv", broken)
    written(folder / "r.csv", broken_head)
    ranges_of(500)
    got = read_csv(spark, str(folder))
    assert sorted(r.id for r in got.collect()) == sorted(r[0] for r in plain + broken + broken_head)
    assert {r.id: r.a for r in got.collect()} == {i: a or None for i, a, _ in plain + broken + broken_head}


def test_header_with_a_line_break(spark, tmp_path, ranges_of):
    table = [(i, "x\ny", "z") for i in range(50)]
    path = written(tmp_path / "in.csv", table, header=("id", "a\nname " + "long " * 30, "b"))
    ranges_of(60)
    got = read_csv(spark, path)
    assert len(got.columns) == 3 and got.columns[1].startswith("a\nname")
    assert sorted(r[0] for r in got.collect()) == list(range(50))


def test_last_row_without_an_end_and_empty_files(spark, tmp_path):
    (tmp_path / "in.csv").write_text('a,b\n1,"x\ny"\n\n2,"z\n\n"')
    got = read_csv(spark, str(tmp_path / "in.csv"))
    assert sorted(map(tuple, got.collect())) == [(1, "x\ny"), (2, "z\n\n")]
    (tmp_path / "head.csv").write_text("a,b\n")
    assert read_csv(spark, str(tmp_path / "head.csv")).count() == 0


def test_spaces_and_breaks_come_back(spark, tmp_path, ranges_of):
    df = spark.createDataFrame([(i, f"  {i}\n\" , \n" + "t" * (i % 50) + " ") for i in range(400)], "id long, s string")
    write_csv(df, str(tmp_path / "csv"))
    ranges_of(800)
    assert rows(read_csv(spark, str(tmp_path / "csv"), df.schema)) == rows(df)
