"""What the corpus operators share: words, row-local bindings and staged tables."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters that are not ASCII white space (tab to carriage return, space).
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row.

    A column that lambdas read several times would be computed anew at each
    reading if the optimizer inlined it; a lambda variable cannot be inlined.
    """
    return F.transform(F.array(value), body)[0]


def ship(spark: SparkSession, _done: set[str] = set()) -> None:  # noqa: B006
    """Send this package's modules to the Python workers, once an application, by way of
    the shared folder, so that executors need no installation of it."""
    sc = spark.sparkContext
    if sc.applicationId in _done:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("lapidary", os.path.relpath(full, top)))
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lapidary-modules-{uuid.uuid4().hex}.zip")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(packed.getvalue()))
    finally:
        out.close()
    sc.addPyFile(path.toString())
    _done.add(sc.applicationId)


def word_count(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def word_list(text: Column) -> Column:
    """The words of a text in order; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the context's
    checkpoint folder, or (only where neither is set, as in tests) a new one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="lapidary-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_STAGED: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run has."""
    _STAGED.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _STAGED[-1]


def release(spark: SparkSession) -> int:
    """Delete all that this process has staged; how many paths went. Frames that still read them fail afterwards."""
    gone = 0
    while _STAGED:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        gone += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def stage(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there,
    so a lost executor costs a re-read and not a re-computation."""
    path = new_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df hinted for broadcast if a count proves that it has at most `rows` rows, else df as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(name: str, taken) -> str:
    """A column name that none of `taken` equals in any case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name
