"""Bar archives and market payloads: readers, writers and their provenance."""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice
from zipfile import BadZipFile, ZipFile

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import delete, written

RAW = "archive string, member string, members int, row_no bigint, fields array<string>"


def _archive_batches(path: str, content: bytes, most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """An archive's rows, at most ``most`` a batch. Its one member is inflated twice, to see that it is whole and then row by row, and never held."""
    import csv

    name, names, sound = path.rsplit("/", 1)[-1], [], False
    try:
        z = ZipFile(io.BytesIO(content))
        names = [n for n in z.namelist() if not n.endswith("/")]
        if len(names) == 1:
            with io.TextIOWrapper(z.open(names[0]), encoding="utf-8", newline="") as f:
                while f.read(1 << 20):
                    pass
            sound = True
    except (BadZipFile, zlib.error, EOFError, UnicodeDecodeError):
        names = []
    member = names[0] if sound else None

    def batch(first: int, part: list[list[str] | None]) -> pa.RecordBatch:
        columns = [pa.array([x] * len(part), t) for x, t in ((name, pa.string()), (member, pa.string()), (len(names), pa.int32()))]
        numbers = pa.array([first + k if r is not None else None for k, r in enumerate(part)], pa.int64())
        return pa.RecordBatch.from_arrays([*columns, numbers, pa.array(part, pa.list_(pa.string()))], ["archive", "member", "members", "row_no", "fields"])

    if not sound:
        yield batch(1, [None])
        return
    with io.TextIOWrapper(z.open(member), encoding="utf-8", newline="") as f:
        rows, first = csv.reader(f), 1
        while part := list(islice(rows, most)):
            yield batch(first, part)
            first += len(part)


def archive_rows(files: DataFrame) -> DataFrame:
    """Rows of zip archives ``files`` (path, content): archive, member, members, row_no, fields.

    An archive with other than one member, or that is damaged or none, gives one row without ``row_no``; a damaged one counts no
    members. An empty member gives no rows. Rows are numbered from 1 as they stand, blank ones included. Files are read apart; a task holds one
    archive as it is packed, and some rows.
    """

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from _archive_batches(path, content.as_py() or b"")

    return files.select("path", "content").mapInArrow(unzip, RAW)


def read_kline_archives(spark: SparkSession, glob: str) -> DataFrame:
    """``archive_rows`` of all files that match ``glob``."""
    return archive_rows(spark.read.format("binaryFile").load(glob))


def read_kline_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of headerless CSV files: archive (file or ``archive=`` folder name), row_no, fields. Blank rows are left out but counted."""
    df = spark.read.text(path)
    file = F.col("_metadata.file_path")
    folder = F.regexp_extract(file, r"archive=([^/]+)/[^/]*$", 1)
    name = F.when(folder != "", folder).otherwise(F.regexp_extract(file, r"([^/]+)$", 1))
    df = df.select("value", name.alias("archive"), F.struct(F.col("_metadata.file_block_start").alias("a"), F.monotonically_increasing_id().alias("b")).alias("_at"))
    return number_rows(df).filter(F.trim("value") != "").select("archive", "row_no", F.split("value", ",", -1).alias("fields"))


def number_rows(df: DataFrame) -> DataFrame:
    """``df`` with ``row_no`` from 1 within each archive in the order ``_at``."""
    from pyspark.sql import Window

    return df.withColumn("row_no", F.row_number().over(Window.partitionBy("archive").orderBy("_at")).cast("bigint"))


def verify_checksums(files: DataFrame, checksums: DataFrame) -> DataFrame:
    """``files`` (archive, content) against ``checksums`` (archive, document '<64 hex>  <name>'): ``digest``, ``expected``, ``verified``, ``error``."""
    expected = F.lower(F.get(F.split(F.trim("document"), r"\s+"), F.lit(0)))
    df = files.select("archive", F.sha2("content", 256).alias("digest")).join(checksums.select("archive", expected.alias("expected")), "archive", "left")
    error = F.when(F.col("expected").isNull(), "no checksum").when(~F.col("expected").rlike("^[0-9a-f]{64}$"), "malformed checksum").when(F.col("expected") != F.col("digest"), "checksum mismatch")
    return df.withColumns({"verified": error.isNull(), "error": error})


def with_archive_symbol(df: DataFrame, expected: Column | None = None, column: str = "archive") -> DataFrame:
    """``df`` with ``archive_symbol`` from names like SYMBOL-1h-YYYY-MM.zip (or with a day), and ``mismatch`` with ``expected``; null for other names."""
    own = F.regexp_extract(column, r"^([A-Za-z0-9_ .]+(?:-[A-Za-z ]+)*?)-\d+[a-z]-\d{4}-\d{2}(?:-\d{2})?\.(?:zip|csv)$", 1)
    df = df.withColumn("archive_symbol", F.when(own != "", own))
    return df.withColumn("mismatch", ~F.coalesce(F.col("archive_symbol") == expected, F.lit(False))) if expected is not None else df


def expected_archives(spark: SparkSession, symbols: DataFrame, start: str, end: str, timeframe: str = "1h") -> DataFrame:
    """One name per symbol and month of [start, end)."""
    months = F.sequence(F.date_trunc("month", F.lit(start).cast("timestamp_ntz")), F.lit(end).cast("timestamp_ntz") - F.expr("interval 1 second"), F.expr("interval 1 month"))
    df = symbols.select("symbol").distinct().select("symbol", F.explode(months).alias("month"))
    return df.select("symbol", F.format_string(f"%s-{timeframe}-%s.zip", "symbol", F.date_format("month", "yyyy-MM")).alias("archive"))


def missing_archives(expected: DataFrame, found: DataFrame) -> DataFrame:
    return expected.join(found, "archive", "left_anti")


def kline_pages(pages: DataFrame, column: str = "page") -> DataFrame:
    """Bars of JSON pages, arrays of arrays: the page's other columns and ``fields``; of a time that several pages have, one."""
    rest = [c for c in pages.columns if c != column]
    df = pages.select(*rest, F.explode(F.from_json(column, "array<array<string>>")).alias("fields"))
    return df.withColumn("_t", F.get("fields", F.lit(0))).dropDuplicates([*rest, "_t"]).drop("_t")


def read_kline_json(spark: SparkSession, path: str) -> DataFrame:
    """``kline_pages`` of files that hold one page each."""
    return kline_pages(spark.read.text(path, wholetext=True).withColumnRenamed("value", "page"))


def flatten_bar_payload(df: DataFrame, as_of: str, column: str = "payload") -> DataFrame:
    """Closes of payloads {"bars": {symbol: [{"t", "c"}]}}: symbol, date, close; bars of ``as_of``'s month, which isn't over, are left out."""
    kind = "struct<bars: map<string, array<struct<t: string, c: double>>>>"
    rows = df.select(F.explode(F.from_json(column, kind)["bars"]).alias("symbol", "_bars")).select("symbol", F.explode("_bars").alias("_b"))
    day = F.substring("_b.t", 1, 10).try_cast("date")
    return rows.select("symbol", day.alias("date"), F.col("_b.c").alias("close")).filter(F.date_trunc("month", F.col("date")) != F.date_trunc("month", F.lit(as_of).cast("date")))


def flatten_history(df: DataFrame, times: str = "timestamp", values: str = "equity") -> DataFrame:
    """Parallel arrays of epoch seconds and values as rows (date, value); null values are left out, the longer array is cut."""
    rest = [c for c in df.columns if c not in (times, values)]
    rows = df.select(*rest, F.explode(F.arrays_zip(F.col(times).alias("t"), F.col(values).alias("v"))).alias("_z"))
    rows = rows.filter("_z.t is not null and _z.v is not null")
    return rows.select(*rest, F.to_date(F.timestamp_seconds("_z.t")).alias("date"), F.col("_z.v").alias("value"))


def write_evidence(df: DataFrame, path: str, by: tuple[str, ...] = ("symbol",), kind: str = "parquet") -> None:
    """Reports as Parquet or JSON, a folder per value of ``by``."""
    df.write.partitionBy(*by).format(kind).save(path)


def _checked(df: DataFrame, required: tuple[str, ...], costs: tuple[str, ...]) -> None:
    bad = [F.coalesce(F.trim(c) == "", F.lit(True)) for c in required] + [F.coalesce(F.col(c) < 0, F.lit(True)) for c in costs]
    wrong = bad[0]
    for b in bad[1:]:
        wrong = wrong | b
    if df.filter(wrong).limit(1).count():
        raise ValueError("experiment records need identifiers and costs of zero or more")


def append_experiment(df: DataFrame, path: str, required: tuple[str, ...] = ("experiment_id", "hypothesis"), costs: tuple[str, ...] = ("fee", "slip")) -> None:
    """Append records, all of them or none: ``required`` texts must not be blank, ``costs`` not negative. What is appended twice is there twice; see ``commit_experiments``."""
    _checked(df, required, costs)
    df.write.mode("append").parquet(path)


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _batches(spark: SparkSession, path: str) -> list[str]:
    """Committed batches, in order."""
    fs, where = _files(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(n for n in names if n.startswith("batch="))


def committed(spark: SparkSession, path: str) -> DataFrame | None:
    """All committed records; None before the first commit. What a crash left staged isn't seen."""
    names = _batches(spark, path)
    return spark.read.option("basePath", path).parquet(*[f"{path}/{n}" for n in names]).drop("batch", "_body") if names else None


def _moved(spark: SparkSession, staged: str, target: str) -> bool:
    """Renames in one step, unless the target exists."""
    jvm = spark._jvm
    fs, to = _files(spark, target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(jvm.org.apache.hadoop.fs.Path(staged), to, none)
    except Py4JJavaError as e:
        if fs.exists(to):
            return False
        raise e
    return True


def commit_experiments(df: DataFrame, path: str, key: str = "experiment_id", required: tuple[str, ...] = ("experiment_id", "hypothesis"), costs: tuple[str, ...] = ("fee", "slip")) -> int:
    """Records written once, whatever is repeated, retried or killed: the number of the batch committed, 0 if all were there.

    A record is its ``key`` and the hash of its content. Those already there are left out; another content under a known key is an
    error, and nothing is written. New records are staged beside the batches and become the next batch by one rename; if
    another writer took that number meanwhile, all is checked again. Readers see whole batches only.
    """
    _checked(df, required, costs)
    spark = df.sparkSession
    body = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    rows = df.withColumn("_body", body)
    first = rows.groupBy(key).agg(F.first(F.struct(*rows.columns)).alias("_row"), F.min("_body").alias("_low"), F.max("_body").alias("_high"))
    first = written(first, "records")
    if first.filter("_low <> _high").limit(1).count():
        raise ValueError("a record occurs with several contents")
    rows = first.select("_row.*")
    while True:
        names, new = _batches(spark, path), rows
        if names:
            old = spark.read.option("basePath", path).parquet(*[f"{path}/{n}" for n in names]).select(key, F.col("_body").alias("_old"))
            new = rows.join(old, key, "left")
            if new.filter("_old is not null and _old <> _body").limit(1).count():
                raise ValueError("a committed record can't be changed")
            new = new.filter("_old is null").select(rows.columns)
        staged = f"{path}/_staged-{uuid.uuid4().hex}"
        new.write.parquet(staged)
        number = 1 + (int(names[-1].split("=")[1]) if names else 0)
        empty = not spark.read.schema(new.schema).parquet(staged).limit(1).count()
        done = not empty and _moved(spark, staged, f"{path}/batch={number:08d}")
        if not done:
            delete(spark, staged)
        if done or empty:
            return number if done else 0


def file_hashes(files: DataFrame) -> DataFrame:
    """``files`` (path, content) as file name and SHA-256."""
    return files.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256"))


def hash_files(spark: SparkSession, glob: str) -> DataFrame:
    """``file_hashes`` of all files that match ``glob``."""
    return file_hashes(spark.read.format("binaryFile").load(glob))


def repeated_files(hashes: DataFrame) -> DataFrame:
    """Names that occur with several contents or several times."""
    return hashes.groupBy("file").agg(F.count("*").alias("n")).filter("n > 1")
