"""Writers. Distributed output stays a folder of part files; single_file gathers one file for small results."""

from __future__ import annotations

import json
import os
import shutil
import tempfile

from pyspark.sql import DataFrame

#: Most rows of results that are gathered on the driver (Excel).
GATHERED_ROWS = 1_000_000


def _single(df: DataFrame, kind: str, path: str, bom: bool = False, **options) -> str:
    """One file at a local path, from one part file."""
    folder = tempfile.mkdtemp(prefix="lapidary-", dir=os.path.dirname(path) or ".")
    try:
        df.coalesce(1).write.mode("overwrite").options(**options).format(kind).save(f"{folder}/out")
        part = next(f for f in sorted(os.listdir(f"{folder}/out")) if f.startswith("part-"))
        with open(f"{folder}/out/{part}", "rb") as src, open(path, "wb") as dst:
            if bom:
                dst.write(b"\xef\xbb\xbf")
            shutil.copyfileobj(src, dst)
    finally:
        shutil.rmtree(folder)
    return path


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> str:
    """UTF-8; a single file starts with a byte-order mark."""
    if single_file:
        return _single(df, "csv", path, bom=True, header=True, escape='"')
    df.write.mode("overwrite").options(header=True, escape='"').csv(path)
    return path


def write_parquet(df: DataFrame, path: str, single_file: bool = False) -> str:
    if single_file:
        return _single(df, "parquet", path, compression="snappy")
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)
    return path


def write_json(df: DataFrame, path: str, single_file: bool = False) -> str:
    """Records by line; a single file holds one array, written row by row."""
    if not single_file:
        df.write.mode("overwrite").json(path)
        return path
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for i, row in enumerate(df.toJSON().toLocalIterator()):
            f.write((",\n" if i else "\n") + json.dumps(json.loads(row), ensure_ascii=False, indent=2))
        f.write("\n]\n")
    return path


def write_excel(df: DataFrame, path: str, most: int = GATHERED_ROWS) -> str:
    """First row frozen, filters on, widths by content. At most `most` rows, else an error."""
    try:
        import openpyxl
    except ImportError as e:
        raise ImportError("writing Excel files needs openpyxl") from e
    if df.limit(most + 1).count() > most:
        raise ValueError(f"over {most} rows do not fit an Excel sheet")
    book = openpyxl.Workbook()
    sheet = book.active
    sheet.append(df.columns)
    for row in df.toLocalIterator():
        sheet.append(list(row))
    sheet.freeze_panes = "A2"
    sheet.auto_filter.ref = sheet.dimensions
    for cells in sheet.columns:
        sheet.column_dimensions[cells[0].column_letter].width = max(10, 3 + max(len(str(c.value or "")) for c in cells))
    book.save(path)
    return path


def export(df: DataFrame, folder: str, stem: str, kind: str = "parquet", single_file: bool = True) -> list[str]:
    """cleaned_<stem>.<ext> in one format, or all of parquet, csv, excel and json; paths written.
    A format that cannot be written is left out of "all" and raises otherwise."""
    os.makedirs(folder, exist_ok=True)
    made = {
        "parquet": (write_parquet, "parquet"),
        "csv": (write_csv, "csv"),
        "excel": (write_excel, "xlsx"),
        "json": (write_json, "json"),
    }
    if kind != "all" and kind not in made:
        return []
    out = []
    for name in made if kind == "all" else [kind]:
        write, ext = made[name]
        path = os.path.join(folder, f"cleaned_{stem}.{ext}")
        try:
            out.append(write(df, path) if name == "excel" else write(df, path, single_file))
        except ImportError:
            if kind != "all":
                raise
    return out


def checkpointed(df: DataFrame, folder: str, key: str, build) -> DataFrame:
    """build(df), written once under folder/key and read from there in later runs.

    key must name the content and the plan (see `run_key`): another table or plan has another key.
    A run that fails half-way leaves no success mark and is done again.
    """
    spark, path = df.sparkSession, f"{folder}/{key}"
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        build(df).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run_key(fingerprint: str, plan: str) -> str:
    import hashlib

    return hashlib.sha256(f"{fingerprint}\n{plan}".encode()).hexdigest()[:32]
