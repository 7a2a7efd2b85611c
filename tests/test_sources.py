import pytest
from pyspark.sql import types as T

from riskloom.sources.schemas import SOURCES
from riskloom.sources.tables import normalise_nan, read_csv, stage, write_csv, write_stage

from comparable import rows


def write(tmp_path, text):
    path = tmp_path / "in.csv"
    path.write_text(text)
    return str(path)


def schema(**types):
    return T.StructType([T.StructField(k, v) for k, v in types.items()])


def test_missing_tokens_and_whole_numbers_with_gaps(spark, tmp_path):
    path = write(tmp_path, 'id,n,x,s\n1,12.0,NaN,XNA\n9007199254740993,NA,1.5,\n3,,null,"a ""b"", c"\n4,7,-nan,nan\n')
    df = read_csv(spark, path, schema(id=T.LongType(), n=T.IntegerType(), x=T.DoubleType(), s=T.StringType()))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, 12, None, "XNA"), (3, None, None, 'a "b", c'), (4, 7, None, None), (9007199254740993, None, 1.5, None),
    ]


def test_columns_are_matched_by_name_and_others_inferred(spark, tmp_path):
    path = write(tmp_path, "extra,b,a,mixed,empty\n1,x,5,1,\n2.5,y,6,q,\n")
    df = read_csv(spark, path, schema(a=T.LongType(), b=T.StringType()))
    assert df.dtypes == [("a", "bigint"), ("b", "string"), ("extra", "double"), ("mixed", "string"), ("empty", "double")]
    assert [r.a for r in df.orderBy("a").collect()] == [5, 6]


def test_text_in_a_number_column_fails(spark, tmp_path):
    path = write(tmp_path, "a\n1\nabc\n")
    with pytest.raises(Exception, match="abc"):
        read_csv(spark, path, schema(a=T.DoubleType())).collect()


def test_whole_numbers_are_exact_or_fail(spark, tmp_path):
    path = write(tmp_path, "a\n9007199254740993.0\n-9223372036854775808\n")
    assert {r.a for r in read_csv(spark, path, schema(a=T.LongType())).collect()} == {9007199254740993, -(2**63)}
    with pytest.raises(Exception, match="12.7"):
        read_csv(spark, write(tmp_path, "a\n12.7\n"), schema(a=T.IntegerType())).collect()


def test_texts_with_line_breaks_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb"), (2, 'q"\n\n,x'), (3, "c")], "id long, s string")
    write_csv(df, str(tmp_path / "csv"))
    assert rows(read_csv(spark, str(tmp_path / "csv"), df.schema)) == rows(df)


def test_missing_columns_are_reported(spark, tmp_path):
    with pytest.raises(ValueError, match="b"):
        read_csv(spark, write(tmp_path, "a\n1\n"), schema(b=T.LongType()))


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, None), (3, 'q"x', -0.25)], "id long, s string, x double")
    write_csv(df, str(tmp_path / "csv"))
    assert rows(read_csv(spark, str(tmp_path / "csv"), df.schema)) == rows(df)
    staged = write_stage(df, str(tmp_path / "stage"), partition_by="id")
    assert staged.columns == df.columns and rows(staged) == rows(df)
    assert rows(stage(df, "t")) == rows(df)


def test_nan_is_normalised(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf"))], "id int, x double")
    assert rows(normalise_nan(df)) == [("1", "None"), ("2", "inf")]


def test_every_source_has_its_key_first():
    for name, source in SOURCES.items():
        assert source.fields[0].name.startswith("SK_ID"), name
