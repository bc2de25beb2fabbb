"""Readers and writers on files."""

import hashlib
import io
import tracemalloc
from zipfile import ZIP_DEFLATED, ZipFile

import pytest
from pyspark.sql import functions as F

from tidemill.sources import archives


def test_zip_archives(spark, tmp_path):
    with ZipFile(tmp_path / "AB-1h-2024-01.zip", "w") as z:
        z.writestr("AB-1h-2024-01.csv", "1704067200000,1,2,0.5,1,10\n\n1704070800000,1,2,0.5,1,10\n")
    with ZipFile(tmp_path / "AB-1h-2024-02.zip", "w") as z:
        z.writestr("a.csv", "1\n")
        z.writestr("b.csv", "2\n")
    (tmp_path / "AB-1h-2024-03.zip").write_bytes(b"no zip")
    got = archives.read_kline_archives(spark, f"file://{tmp_path}/*.zip").orderBy("archive", "row_no").collect()
    assert [(r.archive[-6:-4], r.members, r.row_no, len(r.fields or [])) for r in got] == [("01", 1, 1, 6), ("01", 1, 2, 0), ("01", 1, 3, 6), ("02", 2, None, 0), ("03", 0, None, 0)]
    names = archives.with_archive_symbol(spark.createDataFrame([(r.archive,) for r in got], "archive string"), F.lit("AB"))
    assert all(r.archive_symbol == "AB" and not r.mismatch for r in names.collect())
    digest = hashlib.sha256((tmp_path / "AB-1h-2024-03.zip").read_bytes()).hexdigest()
    assert digest in {r.sha256 for r in archives.hash_files(spark, f"file://{tmp_path}/*.zip").collect()}


def test_large_members_are_streamed(spark, tmp_path):
    """A member of 40 MB is read in some of memory; a damaged one gives no rows."""
    line = "1704067200000,1,2,0.5,1,10\n"
    packed = io.BytesIO()
    with ZipFile(packed, "w", ZIP_DEFLATED) as z:
        z.writestr("a.csv", line * 1_500_000)
    tracemalloc.start()
    rows = largest = last = 0
    for batch in archives._archive_batches("x/a.zip", packed.getvalue()):
        rows, largest, last = rows + batch.num_rows, max(largest, batch.num_rows), batch.column(3)[-1].as_py()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (rows, largest, last) == (1_500_000, 20_000, 1_500_000) and peak < 30e6
    broken = bytearray(packed.getvalue())
    broken[len(broken) // 2] ^= 255
    got = [b.to_pylist() for b in archives._archive_batches("b.zip", bytes(broken))]
    assert got == [[{"archive": "b.zip", "member": None, "members": 0, "row_no": None, "fields": None}]]


def test_csv_counts_blank_rows(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n\n , \nc,d,e\n")
    got = archives.read_kline_csv(spark, f"file://{tmp_path}/x.csv").orderBy("row_no").collect()
    assert [(r.archive, r.row_no, r.fields) for r in got if r.fields[0].strip()] == [("x.csv", 1, ["a", "b"]), ("x.csv", 4, ["c", "d", "e"])]


def test_pages_payloads_histories(spark, tmp_path):
    (tmp_path / "p.json").write_text('[["1","2"],["3","4"],["1","2"]]')
    assert archives.read_kline_json(spark, f"file://{tmp_path}/p.json").count() == 2
    df = spark.createDataFrame([('{"bars":{"A":[{"t":"2024-01-31T00:00:00Z","c":1.5},{"t":"2024-02-05","c":2}],"B":[]}}',)], "payload string")
    assert [(r.symbol, str(r.date), r.close) for r in archives.flatten_bar_payload(df, "2024-02-10").collect()] == [("A", "2024-01-31", 1.5)]
    df = spark.createDataFrame([([0, 86400, 172800], [1.0, None])], "timestamp array<bigint>, equity array<double>")
    assert [(str(r.date), r.value) for r in archives.flatten_history(df).collect()] == [("1970-01-01", 1.0)]


def test_records_and_evidence(spark, tmp_path):
    df = spark.createDataFrame([("e1", "h", 0.1, 0.0)], "experiment_id string, hypothesis string, fee double, slip double")
    path = f"file://{tmp_path}/records"
    archives.append_experiment(df, path)
    archives.append_experiment(df, path)
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(ValueError):
        archives.append_experiment(df.withColumn("experiment_id", F.lit(" ")), path)
    with pytest.raises(ValueError):
        archives.append_experiment(df.withColumn("fee", F.lit(-1.0)), path)
