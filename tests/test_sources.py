from __future__ import annotations

import pytest
from dqspark.sources import readers


def write(path, data: bytes) -> str:
    path.write_bytes(data)
    return str(path)


def test_csv(spark, tmp_path):
    path = write(tmp_path / "a.csv", "﻿ id , name,note\n1,Zoë,NA\n2,\"a,b\",null\n3,,x\n".encode())
    df = readers.validate_frame(readers.read_csv(spark, path))
    assert df.columns == ["id", "name", "note"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", "Zoë", None), ("2", "a,b", None), ("3", None, "x")]


def test_csv_record_over_two_lines(spark, tmp_path):
    path = write(tmp_path / "m.csv", b'id,note\n1,"a\nb"\n2,"say ""hi"""\n')
    assert [tuple(r) for r in readers.read_csv(spark, path).orderBy("id").collect()] == [("1", "a\nb"), ("2", 'say "hi"')]


def test_csv_latin1(spark, tmp_path):
    path = write(tmp_path / "b.csv", "id,prénom\n1,Zoë\n".encode("latin-1"))
    assert readers.read_csv(spark, path).first()["prénom"] == "Zoë"
    path = write(tmp_path / "c.csv", "id,name\n1,Zoe\n2,Zoë\n".encode("latin-1"))
    assert sorted(r["name"] for r in readers.read_csv(spark, path).collect()) == ["Zoe", "Zoë"]


@pytest.mark.parametrize("text", [b"id,id\n1,2\n", b"id,,x\n1,2,3\n", b" , \n1,2\n", b""])
def test_bad_headers(spark, tmp_path, text):
    with pytest.raises(readers.IngestionError):
        readers.read_csv(spark, write(tmp_path / "c.csv", text))


def test_missing_file_and_empty_table(spark, tmp_path):
    with pytest.raises(readers.IngestionError):
        readers.read_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(readers.IngestionError):
        readers.validate_frame(spark.createDataFrame([], "a int"))


def test_formats_and_preview(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 2.0)], "i int, x double")
    for form in ("parquet", "orc", "json"):
        df.write.format(form).save(str(tmp_path / form))
        assert readers.read_table(spark, str(tmp_path / form), form).count() == 2
    assert sorted(str(r["x"]) for r in readers.preview(df, 50).collect()) == ["2.0", "None"]
    for limit in (0, 51):
        with pytest.raises(ValueError):
            readers.preview(df, limit)


def test_csv_row_with_too_many_fields_is_refused(spark, tmp_path):
    path = write(tmp_path / "long.csv", b"id,name\n1,x\n2,y,EXTRA\n3\n")
    with pytest.raises(Exception, match="more than 2 fields"):
        readers.read_csv(spark, path).select("id").collect()
    path = write(tmp_path / "short.csv", b"id,name\n1,x\n3\n")
    assert [tuple(r) for r in readers.read_csv(spark, path).orderBy("id").collect()] == [("1", "x"), ("3", None)]


def test_csv_files_must_share_their_header(spark, tmp_path):
    (tmp_path / "d").mkdir()
    write(tmp_path / "d" / "a.csv", b"id,name\n1,x\n")
    write(tmp_path / "d" / "b.csv", b"name,id\ny,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_csv(spark, str(tmp_path / "d")).collect()


def single(spark, path):
    """The same file by Spark's own reader in one task."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_over_several_lines_are_read_by_several_tasks(spark, tmp_path, end):
    import random

    draw = random.Random(7)
    field = lambda: draw.choice(["", "x", "a,b", 'say "hi"', f"one{end}two", f"{end}{end}", 'ends with "', f'"{end}', "Zo\u00eb", "long " * 30, '""', f'"quoted"{end}line,'])
    plain = lambda v: v and not any(c in v for c in '",\r\n')
    rows = [[str(i), field(), field()] for i in range(400)]
    rows[200][1] = end.join(["a very long field"] * 200)  # over many splits
    text = end.join(["id,a,b", *[",".join(v if plain(v) and draw.random() < 0.7 or v == "" else '"' + v.replace('"', '""') + '"' for v in r) for r in rows]])
    for name, more in (("a", ""), ("b", end), ("c", f'{end}400,6" pipe,x{end}{end}401,"open{end}end')):
        path = write(tmp_path / f"{name}.csv", (text + more).encode())
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            got = readers.read_csv(spark, path, na_tokens=())
            assert got.rdd.getNumPartitions() > 5
            mine = {r["id"]: tuple(r) for r in got.collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        theirs = {r["id"]: tuple(r) for r in single(spark, path).collect()}
        assert mine == theirs
        for r in rows:
            assert mine[r[0]] == tuple(v.replace("\r\n", "\n") or None for v in r)


def test_records_over_several_lines_in_several_files_and_latin1(spark, tmp_path):
    (tmp_path / "d").mkdir()
    write(tmp_path / "d" / "a.csv", 'id,note\n1,"é\nb"\n'.encode("latin-1"))
    write(tmp_path / "d" / "b.csv", 'id,note\n2,"x\n\ny"\n3,z\n'.encode("latin-1"))
    assert sorted(map(tuple, readers.read_csv(spark, str(tmp_path / "d")).collect())) == [("1", "é\nb"), ("2", "x\n\ny"), ("3", "z")]
    write(tmp_path / "d" / "c.csv", b'other,note\n4,"x\ny"\n')
    with pytest.raises(Exception, match="header"):
        readers.read_csv(spark, str(tmp_path / "d")).collect()
    long = write(tmp_path / "long.csv", b'id,note\n1,"x\ny",EXTRA\n')
    with pytest.raises(Exception, match="more than 2 fields"):
        readers.read_csv(spark, long).collect()
    path = write(tmp_path / "q.csv", b'id,name\n1,6" pipe\n2,x\n')
    assert [tuple(r) for r in readers.read_csv(spark, path).orderBy("id").collect()] == [("1", '6" pipe'), ("2", "x")]
