"""Readers (S1-S3, S5) and the streaming audit."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import audit
from evenkeel.sources import read_census_csv, read_credit_csv, write_csv
from evenkeel.sources.readers import CORRUPT, load_table, preview, write_table
from evenkeel.streaming import start_audit_monitor


def test_census_reader(spark, tmp_path):
    a = tmp_path / "adult.data"
    a.write_text("39, State-gov, 77516, Bachelors, 13, Never-married, Adm-clerical, Not-in-family, "
                 "White, Male, 2174, 0, 40, United-States, <=50K\n"
                 "50, ?, 83311, Bachelors, 13, Married, Exec, Husband, White, Male, 0, 0, 13, ?, >50K\n")
    b = tmp_path / "adult.test"
    b.write_text("|1x3 Cross validator\n"
                 "25, Private, 226802, 11th, 7, Never-married, Machine-op, Own-child, Black, Male, "
                 "0, 0, 40, United-States, <=50K.\n")
    df = read_census_csv(spark, str(a)).unionByName(read_census_csv(spark, str(b), skip_first_line=True))
    rows = df.orderBy("age").collect()
    assert len(rows) == 3
    assert [r.income for r in rows] == ["<=50K", "<=50K", ">50K"]
    assert rows[2].workclass is None and rows[2].native_country is None
    assert rows[1].workclass == "State-gov"


def test_credit_reader(spark, tmp_path):
    p = tmp_path / "german.data"
    p.write_text("A11 6 A34 A43 1169 A65 A75 4 A93 A101 4 A121 67 A143 A152 2 A173 1 A192 A201 1\n"
                 "A12 48 A32 A43 5951 A61 A73 2 A92 A101 2 A121 22 A143 A152 1 A173 1 A191 A201 2\n")
    rows = read_credit_csv(spark, str(p)).orderBy("age").collect()
    assert (rows[0].sex, rows[0].age_group, rows[0].credit_risk) == ("female", "young", 0)
    assert (rows[1].sex, rows[1].age_group, rows[1].credit_risk) == ("male", "adult", 1)
    assert "personal_status_sex" not in rows[0].asDict()


def test_credit_numbers_and_broken_lines(spark, tmp_path):
    """A number with a decimal point is that number, no number is null, a short line keeps its raw text."""
    line = "A11 {} A34 A43 1169 A65 A75 4 A93 A101 4 A121 {} A143 A152 2 A173 1 A192 A201 {}"
    p = tmp_path / "german.data"
    p.write_text("\n".join([line.format("24.0", "30", "1"), line.format("x", "40.0", "2.0"), "A11 6 A34"]) + "\n")
    rows = {r.duration if r[CORRUPT] is None else "broken": r for r in read_credit_csv(spark, str(p)).collect()}
    assert (rows[24].age, rows[24].credit_risk, rows[24].age_group) == (30, 1, "adult")
    assert (rows[None].age, rows[None].credit_risk) == (40, 0)
    assert rows["broken"][CORRUPT] == "A11 6 A34" and rows["broken"].duration == 6 and rows["broken"].age is None


def test_tables_and_preview(spark, tmp_path):
    df = spark.range(20).withColumn("g", F.col("id") % 2)
    write_table(df, str(tmp_path / "t"), partition_by=["g"])
    write_table(df.where("id < 12"), str(tmp_path / "t"), partition_by=["g"])
    back = load_table(spark, str(tmp_path / "t"))
    assert sorted(r.id for r in back.collect()) == list(range(12))
    assert back.where("g = 1").count() == 6
    assert preview(back).count() == 8 and preview(back, 30).count() == 12


def test_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    write_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.collect()[0].y == "a"


def test_stream_audit_matches_batch(spark, tmp_path):
    rows = [("m", "A", 1, 1)] * 30 + [("m", "A", 0, 1)] * 10 + [("m", "B", 1, 0)] * 10 + [("m", "B", 0, 0)] * 5
    df = spark.createDataFrame(rows, "model string, g string, y_true int, y_pred int")
    src = str(tmp_path / "src")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    got = {}

    def keep(summary, batch_id):
        got["rows"] = summary.collect()

    q = start_audit_monitor(stream, ["g"], keep, {"g": "A"}, checkpoint=str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    batch = audit.summary(audit.group_stats(df, ["g"], {"g": "A"})).collect()
    assert sorted(map(tuple, got["rows"])) == sorted(map(tuple, batch))
