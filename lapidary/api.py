"""The fluent interface: Cleaner(spark, path).scan().auto_clean().export(...)."""

from __future__ import annotations

import logging
import os
import time
import warnings

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import report
from .functions import constants as C
from .operators import bi, numbers
from .plans import cleaning, drift, profile
from .sources import readers, writers

log = logging.getLogger("lapidary")


def with_row_id(df: DataFrame, name: str = "_row_id") -> DataFrame:
    """A row id in file order: by file and block, as Spark may pack splits in another order."""
    return df.withColumn(name, F.monotonically_increasing_id())


class Cleaner:
    """One table from file or frame to cleaned table, BI shapes, report and files.

    Methods return the object; those that need data warn where there is none.
    """

    def __init__(self, spark: SparkSession, source: str | DataFrame, partitions: int = 4, backend: str = "auto", export_format: str = "parquet", snapshot_dir: str | None = None, config: cleaning.Config | None = None, verbose: bool = True) -> None:
        self.spark, self.source, self.partitions, self.backend = spark, source, partitions, backend
        self.export_format, self.config, self.verbose = export_format, config or cleaning.Config(), verbose
        self.snapshot_dir = snapshot_dir
        if isinstance(source, str):
            readers.checked_format(source)
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
            if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
                raise FileNotFoundError(source)
        self.raw: DataFrame | None = None
        self.df: DataFrame | None = None
        self.scan_report: dict = {}
        self.validation_report: dict = {}
        self.stats: dict = {}
        self.plan = cleaning.Plan()
        self.exported: list[str] = []
        self.logs: list[str] = []
        self.began = time.time()

    def __repr__(self) -> str:
        name = self.source if isinstance(self.source, str) else "frame"
        return f"Cleaner({name!r}, {'cleaned' if self.df is not None else 'not cleaned'})"

    def _say(self, text: str) -> None:
        self.logs.append(text)
        if self.verbose:
            log.info(text)

    def _load(self) -> DataFrame:
        if self.raw is None:
            self.raw = readers.load(self.spark, self.source) if isinstance(self.source, str) else readers.fold_nan(self.source)
        return self.raw

    @property
    def stem(self) -> str:
        base = os.path.basename(self.source.rstrip("/")) if isinstance(self.source, str) else "frame"
        return readers.safe_name(base.partition(".")[0])

    def scan(self) -> Cleaner:
        """The profile before any change; the row count is exact, sizes of a sample are an estimate."""
        raw = self._load()
        size, head = 0, b""
        if isinstance(self.source, str):
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.source)
            fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            size, head = fs.getContentSummary(p).getLength(), readers.head_bytes(self.spark, self.source)
        encoding, confidence = readers.detect_encoding(head)
        columns = profile.column_profile(raw)
        rows = raw.count()
        share = profile.duplicate_share(raw)
        sample = raw.limit(C.SAMPLE_ROWS)
        per_row = profile.size_estimate(sample) / max(1, min(rows, C.SAMPLE_ROWS))
        gb = size / 2**30
        self.scan_report = {
            "path": self.source if isinstance(self.source, str) else None,
            "size": readers.human_size(size),
            "size_bytes_raw": size,
            "fingerprint": readers.fingerprint(self.spark, self.source) if isinstance(self.source, str) else None,
            "encoding": encoding,
            "encoding_confidence": confidence,
            "encoding_risk": "LOW" if confidence >= C.ENCODING_CONFIDENCE else "HIGH",
            "rows": rows,
            "columns": len(raw.columns),
            "column_names": raw.columns,
            "null_ratios": {c: p["nulls"] / p["rows"] if p["rows"] else 0.0 for c, p in columns.items()},
            "corrupted_columns": profile.corrupted(columns),
            "duplicate_share": share,
            "duplicate_risk": profile.risk(share),
            "complexity": profile.complexity(raw),
            "name_issues": profile.name_issues(raw.columns),
            "estimated_mem_gb": per_row * rows / 2**30,
            "recommended_engine": readers.recommend_engine(gb, rows, None if self.backend == "auto" else self.backend),
            "recommended_partitions": readers.recommend_partitions(gb),
        }
        if self.partitions == 4 and self.scan_report["recommended_partitions"] > 4:
            self.partitions = self.scan_report["recommended_partitions"]
        self.scan_report["pii"] = {c: k for c, k in profile.pii_rates(raw).items() if k}
        self._say(f"scanned {rows} rows, {len(raw.columns)} columns")
        return self

    def auto_clean(self, config: cleaning.Config | None = None) -> Cleaner:
        if not self.scan_report:
            self.scan()
        before = with_row_id(readers.normalise_columns(self._load()))
        nulls = sum(round(r * self.scan_report["rows"]) for r in self.scan_report["null_ratios"].values())
        cleaned, self.plan = cleaning.clean(before, config or self.config)
        self.df = cleaned.persist(StorageLevel.MEMORY_AND_DISK)
        left = self.df.count()
        missing = cleaning.reconcile(self.df.drop("_row_id"), self.scan_report["column_names"])
        drifted = {}
        if self.snapshot_dir:
            os.makedirs(self.snapshot_dir, exist_ok=True)
            drifted = drift.detect(self.df.drop("_row_id"), os.path.join(self.snapshot_dir, f"{self.stem}_cleaned_schema.json"))
        review = [{"column": c, "confidence": r} for c, r in self.plan.rates.items() if r < 1.0]
        self.validation_report = {"schema": missing, "schema_drift": drifted, "review_queue": review, "categories": self.plan.categories}
        self.stats = {
            "rows_before": self.scan_report["rows"],
            "rows_after": left,
            "duplicates_removed": self.scan_report["rows"] - left,
            "nulls_found": nulls,
            "type_conversions": self.plan.types,
            "outlier_bounds": self.plan.bounds,
            "fills": {k: str(v) for k, v in self.plan.fills.items()},
        }
        self._say(f"cleaned: {left} of {self.scan_report['rows']} rows")
        return self

    def _ready(self) -> bool:
        if self.df is None:
            warnings.warn("no data yet: call auto_clean() first", stacklevel=3)
        return self.df is not None

    def table(self) -> DataFrame:
        """The cleaned table without the row id, in row order."""
        return self.df.orderBy("_row_id").drop("_row_id") if "_row_id" in self.df.columns else self.df

    def optimize_memory(self) -> Cleaner:
        if self._ready():
            before = profile.size_estimate(self.df)
            self.df = numbers.narrow(self.df, [c for c in self.df.columns if c != "_row_id"])
            self.stats["memory"] = {"before": before, "after": profile.size_estimate(self.df)}
        return self

    def prepare_for_powerbi(self, folder: str = "powerbi", inplace: bool = True) -> Cleaner:
        if self._ready():
            shaped, _ = bi.prepare(self.table())
            out, schema = bi.power_bi(shaped)
            os.makedirs(folder, exist_ok=True)
            self.exported.append(writers.write_parquet(out, os.path.join(folder, f"powerbi_ready_{self.stem}.parquet"), True))
            self.exported.append(bi.write_json(folder, "powerbi_schema.json", schema))
            self.df = shaped if inplace else self.df
        return self

    def prepare_for_tableau(self, folder: str = "tableau", inplace: bool = True) -> Cleaner:
        if self._ready():
            shaped, _ = bi.prepare(self.table())
            out, roles, fields = bi.tableau(shaped)
            os.makedirs(folder, exist_ok=True)
            self.exported.append(writers.write_csv(out, os.path.join(folder, f"tableau_ready_{self.stem}.csv"), True))
            self.exported.append(bi.write_json(folder, "tableau_metadata.json", roles))
            self.exported.append(bi.write_json(folder, "tableau_calculated_fields.json", fields))
            self.df = shaped if inplace else self.df
        return self

    def recommend_visualizations(self) -> Cleaner:
        if self._ready():
            self.recommendations = bi.recommend(self.table())
            for r in self.recommendations:
                self._say(f"{r['priority']}: {r['chart']} - {r['title']}")
        return self

    def report(self) -> dict:
        memory = self.stats.get("memory", {"before": 0, "after": 0})
        columns = {c: {"type": k} for c, k in self.df.dtypes} if self.df is not None else {}
        meta = {"source": str(self.scan_report.get("path")), "seconds": round(time.time() - self.began, 2), "backend": "Spark"}
        return report.build(meta, self.scan_report, self.stats, memory, columns, self.validation_report, self.exported, self.logs)

    def generate_report(self, path: str = "report.html", kind: str = "html") -> Cleaner:
        if self._ready():
            self.exported.append(report.write(self.report(), path, kind))
        return self

    def export(self, kind: str | None = None, folder: str = ".") -> Cleaner:
        if self._ready():
            self.exported += writers.export(self.table(), folder, self.stem, kind or self.export_format)
        return self

    def shape(self) -> tuple[int, int]:
        df = self.table() if self.df is not None else self._load()
        return df.count(), len(df.columns)

    def head(self, n: int = 5):
        return (self.table() if self.df is not None else self._load()).limit(n).toPandas()

    def summary(self) -> str:
        """A card of the run."""
        rows, cols = self.shape()
        lines = [repr(self), f"rows {rows}, columns {cols}"]
        if self.stats:
            lines += [f"duplicates removed {self.stats['duplicates_removed']}", f"nulls found {self.stats['nulls_found']}"]
        return "\n".join(lines)


