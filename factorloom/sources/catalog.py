"""A catalogue of versioned panels: parquet data by year, and a metadata table that is the commit point.

A writer claims a version by creating its claim file, which only one writer can; versions are numbered in the order of
claims, and a version whose writer failed is free again. Readers see what the metadata names.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import remove

METADATA = (
    "datatype string, start timestamp, end timestamp, frequency string, relative_filename string, file_format string, "
    "version int, created timestamp, n_symbols int, extras map<string,string>"
)


YEAR = "panel_year"


def created(spark: SparkSession, path: str) -> bool:
    """Creates an empty file, unless it is there; of several writers one succeeds, where the file system keeps to that."""
    if path.startswith("file:"):
        local = "/" + path.removeprefix("file:").lstrip("/")
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            os.close(os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        return True
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).createNewFile(where)


@dataclass(frozen=True)
class Catalog:
    spark: SparkSession
    base: str

    def metadata_path(self) -> str:
        return f"{self.base}/metadata"

    def panel_path(self, datatype: str, version: int) -> str:
        return f"{self.base}/{self.relative(datatype, version)}"

    @staticmethod
    def relative(datatype: str, version: int) -> str:
        return f"{datatype}_{version}.parquet"

    def _exists(self, path: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def metadata(self) -> DataFrame:
        """All rows of the catalogue; none if nothing has been saved."""
        if not self._exists(self.metadata_path()):
            return self.spark.createDataFrame([], METADATA)
        return self._rows().dropDuplicates(["datatype", "version"])

    def _rows(self) -> DataFrame:
        """Each save and each compaction has a folder of its own, so that no writer meets another's temporary files."""
        return self.spark.read.schema(METADATA).option("recursiveFileLookup", True).parquet(self.metadata_path())

    def compact(self) -> None:
        """Rewrites the metadata's files as one. A reader in between sees rows twice, which count once."""
        if not self._exists(self.metadata_path()):
            return
        old = self._rows()
        files = old.inputFiles()
        if len(files) > 1:
            old.dropDuplicates(["datatype", "version"]).coalesce(1).write.parquet(f"{self.metadata_path()}/compact-{uuid.uuid4().hex}")
            for file in files:
                remove(self.spark, file)

    def next_version(self, datatype: str) -> int:
        """The version after the highest that is saved."""
        top = self.metadata().filter(F.col("datatype") == datatype).agg(F.max("version")).first()[0]
        return 0 if top is None else top + 1

    def _claimed(self, datatype: str) -> tuple[int, str]:
        """The next version that no other writer holds, and its claim."""
        version = self.next_version(datatype)
        while not created(self.spark, claim := f"{self.base}/claims/{datatype}_{version}"):
            version += 1
        return version, claim

    def save(self, panel: DataFrame, datatype: str, frequency: str, file_format: str = "parquet", **extras) -> int:
        """Writes a long panel as the next version and then its metadata row; what fails leaves nothing."""
        if file_format != "parquet":
            raise ValueError(f"unsupported file format {file_format!r}")
        if YEAR in panel.columns:
            raise ValueError(f"a panel cannot have a column {YEAR!r}")
        version, claim = self._claimed(datatype)
        path = self.panel_path(datatype, version)
        try:
            by_year = panel.withColumn(YEAR, F.year("date")).hint("rebalance", YEAR)
            by_year.write.mode("errorifexists").partitionBy(YEAR).parquet(path)
            self._describe(path, datatype, version, frequency, file_format, extras).coalesce(1).write.parquet(f"{self.metadata_path()}/{datatype}_{version}")
        except BaseException:
            for left in (path, f"{self.metadata_path()}/{datatype}_{version}", claim):
                remove(self.spark, left)
            raise
        return version

    def _describe(self, path: str, datatype: str, version: int, frequency: str, file_format: str, extras: dict) -> DataFrame:
        pairs = [x for k, v in extras.items() for x in (F.lit(k), F.lit(str(v)))]
        return self.spark.read.parquet(path).agg(
            F.min("date").cast("timestamp").alias("start"), F.max("date").cast("timestamp").alias("end"), F.countDistinct("symbol").cast("int").alias("n_symbols")
        ).select(
            F.lit(datatype).alias("datatype"), "start", "end", F.lit(frequency).alias("frequency"), F.lit(self.relative(datatype, version)).alias("relative_filename"),
            F.lit(file_format).alias("file_format"), F.lit(version).cast("int").alias("version"), F.current_timestamp().alias("created"), "n_symbols",
            (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("extras"),
        )

    def load(self, datatype: str, version: int | None = None, start=None, end=None, **conditions) -> DataFrame | None:
        """The panel of a version, or of the highest that meets the conditions; None if there is none.

        With a start or an end (both included) only the years between are read."""
        rows = self.metadata().filter(F.col("datatype") == datatype)
        known = {f.split()[0] for f in METADATA.split(", ")}
        for key, value in conditions.items():
            rows = rows.filter((F.col(key) if key in known else F.col("extras")[key]) == (value if key in known else str(value)))
        if version is not None:
            found = rows.filter(F.col("version") == version).limit(2).collect()
            if len(found) != 1:
                raise ValueError(f"{len(found)} panels of {datatype} have version {version}")
        else:
            found = rows.orderBy(F.desc("version")).limit(1).collect()
        if not found:
            return None
        rows = self.spark.read.parquet(f"{self.base}/{found[0]['relative_filename']}")
        for bound, keep in ((start, lambda x, y: x >= y), (end, lambda x, y: x <= y)):
            if bound is not None:
                day = F.lit(str(bound)[:10]).cast("date")
                rows = rows.filter(keep(F.col(YEAR), int(str(bound)[:4])) & keep(F.col("date"), day))
        return rows.drop(YEAR)

    def save_prices(self, panels: dict[str, tuple[DataFrame, str]]) -> dict[str, int]:
        """Several (panel, frequency) pairs by datatype."""
        return {name: self.save(panel, name, frequency) for name, (panel, frequency) in panels.items()}


def check_dates(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """The panel; the query fails if its dates are not those of the calendar."""
    have, want = panel.select("date").distinct(), calendar.select("date").distinct()
    odd = have.join(want, "date", "left_anti").unionByName(want.join(have, "date", "left_anti"))
    if not odd.isEmpty():
        raise ValueError("the panel's dates are not the calendar's")
    return panel


def append_results(rows: DataFrame, path: str) -> None:
    """Search results as JSON lines, added to what is there."""
    rows.write.mode("append").json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
