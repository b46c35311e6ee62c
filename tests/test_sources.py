import pytest
from pyspark.errors import PySparkException

from gaugeframe.session import cut_lineage, ensure_checkpoint_dir
from gaugeframe.sources import flatfiles
from tests.helpers import day, rows


def test_csv_with_schema_and_by_inference(spark, tmp_path):
    path = tmp_path / "weather.csv"
    path.write_text("Date,City,Temperature,Humidity,Wind Speed,Rainfall\n2023-01-01,Oslo,1.5,NaN,3.0,0\n2023-01-02,Lima,,60.0,4.5,15\n")
    df = flatfiles.read_csv(spark, str(path), flatfiles.WEATHER)
    assert rows(df) == [(day("2023-01-01"), "Oslo", 1.5, None, 3.0, 0), (day("2023-01-02"), "Lima", None, 60.0, 4.5, 15)]
    inferred = flatfiles.read_csv(spark, str(path))
    assert dict(inferred.dtypes)["Temperature"] == "double" and inferred.count() == 2
    wrong = tmp_path / "wrong.csv"
    wrong.write_text("City,Date,Temperature,Humidity,Wind Speed,Rainfall\nOslo,2023-01-01,1.5,1.0,3.0,0\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        flatfiles.read_csv(spark, str(wrong), flatfiles.WEATHER).collect()


def test_csv_round_trip_and_yearly_parquet(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, day("2020-05-01")), ("b", None, day("2021-05-01"))], "k string, prediction double, d date")
    flatfiles.write_csv(df, str(tmp_path / "out"))
    assert rows(flatfiles.read_csv(spark, str(tmp_path / "out"), df.schema)) == rows(df)
    with pytest.raises(PySparkException):
        flatfiles.write_csv(df, str(tmp_path / "out"))
    flatfiles.write_yearly(df, str(tmp_path / "years"), "d")
    assert spark.read.parquet(str(tmp_path / "years")).where("year = 2021").count() == 1
    assert {p.name for p in (tmp_path / "years").iterdir() if p.is_dir()} == {"year=2020", "year=2021"}


def test_csv_reads_what_was_written(spark, tmp_path):
    """Quotes, line breaks, padding, empty and missing texts, and columns that hold a missing word."""
    odd = [(1, 'a "b", c', 1.5), (2, "line\nbreak", None), (3, " pad ", float("nan")), (4, "", -2.0), (5, None, 0.0), (6, "back\\slash", 3.0), (7, '"', 1.0)]
    df = spark.createDataFrame(odd, "i long, t string, x double").coalesce(1)
    flatfiles.write_csv(df, str(tmp_path / "out"))
    for schema in (df.schema, None):
        back = flatfiles.read_csv(spark, str(tmp_path / "out"), schema, line_breaks=True)
        assert dict(back.dtypes) == {"i": "bigint", "t": "string", "x": "double"}
        assert rows(back, "i") == [(i, t, None if x is None or x != x else x) for i, t, x in odd]
    path = tmp_path / "words.csv"
    path.write_text('n,t,b,d\n1,"x ""y"", z",True,2024-01-01\nNA,N/A,,2024-02-01\n3, v ,False,\n')
    got = flatfiles.read_csv(spark, str(path))
    assert dict(got.dtypes) == {"n": "bigint", "t": "string", "b": "boolean", "d": "date"}
    assert [r.t for r in got.orderBy("d").collect()] == [" v ", 'x "y", z', None] and got.where("n is null").count() == 1


def test_a_rewritten_table_shows_its_new_column(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.sql("select 1 as a, double('nan') as x, float(2.5) as f").write.parquet(path)
    first = flatfiles.read_table(spark, str(tmp_path), "t")
    assert first.first().x is None and dict(first.dtypes)["f"] == "float"
    spark.sql("select 1 as a, 2 as b").write.mode("overwrite").parquet(path)
    assert flatfiles.read_table(spark, str(tmp_path), "t").columns == ["a", "b"]


def test_lineage_is_cut_in_the_checkpoint_folder(spark):
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir()
    assert folder
    assert cut_lineage(spark.range(5)).count() == 5
    ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir() == folder


def test_ragged_and_mistyped_records_are_set_apart(spark, tmp_path):
    """Typed rows and quarantine add up to the file, whatever is read of them."""
    lines = ["1,Oslo,1.5", "2,Lima", "3,Rome,2.5,x", "four,Bern,3.5", '5,"a ""b"", c",warm', "NA,,", "7, Bonn ,NaN", '8,"",9.5', "x,y,z"]
    (tmp_path / "f").mkdir()
    for i, part in enumerate((lines[:4], lines[4:])):
        (tmp_path / "f" / f"{i}.csv").write_text("\n".join(["n,city,broken", *part]) + "\n")
    good, bad = flatfiles.read_csv_checked(spark, str(tmp_path / "f"), flatfiles.T.StructType.fromDDL("n long, city string, broken double"))
    assert rows(good, "n") == [(None, None, None), (1, "Oslo", 1.5), (7, " Bonn ", None), (8, "", 9.5)]
    found = {r.text: (r.file.rsplit("/", 1)[1], r.reason) for r in bad.collect()}
    assert found == {
        "2,Lima": ("0.csv", "wrong number of fields"), "3,Rome,2.5,x": ("0.csv", "wrong number of fields"), "four,Bern,3.5": ("0.csv", "n: no bigint"),
        '5,"a ""b"", c",warm': ("1.csv", "broken: no double"), "x,y,z": ("1.csv", "n: no bigint; broken: no double"),
    }
    assert good.count() + bad.count() == len(lines) and good.select("city").count() == 4 and bad.select("reason").count() == 5
    inferred, rest = flatfiles.read_csv_checked(spark, str(tmp_path / "f"), least=0.6)
    assert dict(inferred.dtypes) == {"n": "bigint", "city": "string", "broken": "double"} and rest.count() == 5
    strict, none = flatfiles.read_csv_checked(spark, str(tmp_path / "f"), least=1.0)
    assert dict(strict.dtypes)["n"] == "string" and none.count() == 2 and strict.count() == 7
    with pytest.raises(Exception, match="CSV header does not conform"):
        flatfiles.read_csv_checked(spark, str(tmp_path / "f"), flatfiles.T.StructType.fromDDL("city string, n long, broken double"))[0].collect()
