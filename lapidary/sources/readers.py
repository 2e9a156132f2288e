"""Readers: text formats come in as strings, types are inferred later from values."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as C
from ..functions import names


def detect_format(path: str) -> str:
    """The suffix, looking through a compression's."""
    base = os.path.basename(path.rstrip("/")).lower()
    for z in C.COMPRESSED:
        base = base.removesuffix(z)
    return base.rpartition(".")[2] if "." in base else ""


def checked_format(path: str) -> str:
    kind = detect_format(path)
    if kind not in C.FORMATS:
        raise ValueError(f"unsupported format: {kind or 'none'}; one of {', '.join(C.FORMATS)}")
    return kind


def detect_encoding(head: bytes) -> tuple[str, float]:
    """Encoding and confidence from the first bytes: a mark, strict UTF-8, or Latin-1 at half confidence."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")):
        if head.startswith(mark):
            return name, 1.0
    try:
        head.decode("utf-8")
        return "utf-8", 1.0
    except UnicodeDecodeError as e:
        if e.start >= len(head) - 3:  # a character cut by the end of the sample
            return "utf-8", 1.0
    return "iso-8859-1", 0.5


def head_bytes(spark: SparkSession, path: str, n: int = C.SAMPLE_BYTES) -> bytes:
    """The first bytes of a file (of a folder's first file), through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isDirectory():
        files = sorted(str(s.getPath()) for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", ".")))
        if not files:
            return b""
        p = jvm.org.apache.hadoop.fs.Path(files[0])
    size = min(n, fs.getFileStatus(p).getLen())
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)) if size else b""
    finally:
        stream.close()


def quoted_newlines(spark: SparkSession, path: str, encoding: str) -> bool:
    """Whether some line holds an odd number of quotes, so that a field may go on in the next line; always for UTF-16."""
    if encoding.lower().replace("-", "").startswith("utf16"):
        return True
    value = F.col("value")
    odd = (F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))) % 2 == 1
    return not spark.read.text(path).where(odd).isEmpty()


def read_delimited(spark: SparkSession, path: str, sep: str = ",", encoding: str | None = None) -> DataFrame:
    """All columns as strings, with reader nulls as null. The header is applied here, so repeated names become a, a.1.

    The header is the first line of the first file; lines equal to it are dropped as the other files' headers.
    Files are split among tasks unless a field holds a newline, which a pass over the lines tells.
    """
    encoding = encoding or detect_encoding(head_bytes(spark, path))[0]
    options = {"sep": sep, "encoding": encoding, "quote": '"', "escape": '"', "multiLine": quoted_newlines(spark, path, encoding), "mode": "PERMISSIVE"}
    raw = spark.read.options(**options, header=False, inferSchema=False).csv(path)
    first = raw.first()
    if first is None:
        return raw
    header = [(h if h is not None else f"Unnamed: {i}").lstrip("﻿") for i, h in enumerate(first)]
    seen: dict[str, int] = {}
    unique = []
    for h in header:
        unique.append(f"{h}.{seen[h]}" if h in seen else h)
        seen[h] = seen.get(h, 0) + 1
    schema = T.StructType([T.StructField(c, T.StringType()) for c in unique])
    body = spark.read.options(**options, header=True, enforceSchema=True).schema(schema).csv(path)
    return body.select(*[F.when(~F.col(f"`{c}`").isin(C.READER_NULLS), F.col(f"`{c}`")).alias(c) for c in unique])


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """The text lines of a zip archive's files as (name, value); one task per archive."""
    import io
    import zipfile
    from collections.abc import Iterator

    import pyarrow as pa

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for n in z.namelist():
                        with z.open(n) as f:
                            text = io.TextIOWrapper(f, "utf-8-sig", "replace", newline="\n")
                            while lines := text.readlines(1 << 20):
                                values = [x.rstrip("\r\n") for x in lines]
                                yield pa.RecordBatch.from_pydict({"name": [n] * len(values), "value": values})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "name string, value string")


def unzipped(spark: SparkSession, path: str, kind: str) -> str:
    """A new folder with the members of a zip archive that have the suffix `kind`, copied as a stream: an archive can't be split.

    It lies in the shared folder (spark.checkpoint.dir); a local session without one gets a temporary folder.
    """
    import tempfile
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("reading zip archives on a cluster needs spark.checkpoint.dir")
        top = tempfile.mkdtemp(prefix="lapidary-zip-")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder, source = f"{top.rstrip('/')}/unzipped-{uuid.uuid4().hex}", jvm.org.apache.hadoop.fs.Path(path)
    jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(conf).mkdirs(jvm.org.apache.hadoop.fs.Path(folder))
    archive = jvm.java.util.zip.ZipInputStream(source.getFileSystem(conf).open(source))
    try:
        n = 0
        while (member := archive.getNextEntry()) is not None:
            if member.isDirectory() or detect_format(member.getName()) != kind:
                continue
            to = jvm.org.apache.hadoop.fs.Path(f"{folder}/member-{n:05d}.{kind}")
            out = to.getFileSystem(conf).create(to)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(archive, out, 1 << 16, False)
            finally:
                out.close()
            n += 1
    finally:
        archive.close()
    if not n:
        raise ValueError(f"no {kind} file in {path}")
    return folder


def fingerprint(spark: SparkSession, path: str) -> str:
    """MD5 of a file's bytes, streamed through Spark's file systems (of a folder: of its files' MD5s in order)."""
    import hashlib

    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isDirectory():
        inner = sorted(str(s.getPath()) for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", ".")))
        return hashlib.md5("".join(fingerprint(spark, f) for f in inner).encode()).hexdigest()
    stream = fs.open(p)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.md5Hex(stream)
    finally:
        stream.close()


def row_estimate(spark: SparkSession, path: str) -> int:
    """Physical lines less the header; quoted newlines count, so `count()` of the table is the exact number."""
    return max(0, spark.read.text(path).count() - 1)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of records or records by line, told by the first byte."""
    array = head_bytes(spark, path, 64).lstrip(b"\xef\xbb\xbf \t\r\n").startswith(b"[")
    return spark.read.option("multiLine", array).json(path)


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    import pandas as pd

    try:
        return spark.createDataFrame(pd.read_excel(path))
    except ImportError as e:
        raise ImportError("reading Excel files needs openpyxl") from e


def load(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """A table of any supported format; not-a-number becomes null."""
    kind = checked_format(path)
    if path.lower().rstrip("/").endswith(".zip"):
        path = unzipped(spark, path, kind)
    if kind in ("csv", "tsv"):
        return read_delimited(spark, path, "\t" if kind == "tsv" else ",", encoding)
    if kind == "parquet":
        return fold_nan(spark.read.parquet(path))
    if kind == "json":
        return fold_nan(read_json(spark, path))
    return fold_nan(read_excel(spark, path))


def fold_nan(df: DataFrame) -> DataFrame:
    floats = names.of_kind(df, lambda k: isinstance(k, T.FloatType | T.DoubleType))
    return df.withColumns({c: F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")) for c in floats}) if floats else df


def normalise_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*names.normalised(df.columns))


def recommend_engine(gb: float, rows: int, override: str | None = None) -> str:
    """The backend that a table of this size would suit; execution is Spark's whatever the answer."""
    known = {"pandas": "Pandas", "polars": "Polars", "dask": "Dask", "spark": "Spark"}
    if override and override.lower() in known:
        return known[override.lower()]
    if gb >= 100:
        return "Spark"
    if gb >= 10:
        return "Dask"
    return "Polars" if rows >= 1_000_000 or rows == -1 else "Pandas"


def recommend_partitions(gb: float) -> int:
    return next((n for most, n in ((1, 1), (5, 2), (20, 4), (50, 8)) if gb < most), 16)


def human_size(n: float) -> str:
    if n <= 0:
        return "0 B"
    for unit in ("B", "KB", "MB", "GB", "TB", "PB"):
        if n < 1024 or unit == "PB":
            return f"{n:.0f} B" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024
    return ""


def safe_name(stem: str) -> str:
    return re.sub(r"[^\w.-]", "_", stem)
