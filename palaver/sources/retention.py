"""A table kept by days, from which old rows go without rewriting the rest.

Every day of every write is a folder.  ``pointers`` names, version by version,
the folders that make up the table: a reader takes the latest version, so a
change counts all at once, and one that failed midway never does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palaver.session import scratch_table

C = F.col
POINTERS = "version int, day date, part string"


class DayTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, ts: str = "ts") -> None:
        self.spark, self.path, self.schema, self.ts = spark, path.rstrip("/"), schema, ts

    @classmethod
    def create(cls, rows: DataFrame, ts: str = "ts", path: str | None = None) -> DayTable:
        """A new table of ``rows``; rows without a time are of no day and stay until they are removed by hand."""
        spark = rows.sparkSession
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        table = cls(spark, path or scratch_table(spark, "days"), schema, ts)
        spark.createDataFrame([], POINTERS).write.parquet(f"{table.path}/pointers")
        table.append(rows)
        return table

    def _folders(self) -> list:
        """The folders of the latest version: one a day and write."""
        rows = self.spark.read.schema(POINTERS).parquet(f"{self.path}/pointers")
        last = rows.agg(F.max("version")).first()[0]
        return [] if last is None else rows.where((C("version") == last) & C("part").isNotNull()).orderBy("day", "part").collect()

    def _version(self) -> int:
        last = self.spark.read.schema(POINTERS).parquet(f"{self.path}/pointers").agg(F.max("version")).first()[0]
        return 0 if last is None else last + 1

    def _point(self, version: int, folders: list[tuple]) -> None:
        rows = [(version, day, part) for day, part in folders] or [(version, None, None)]
        self.spark.createDataFrame(rows, POINTERS).coalesce(1).write.mode("append").parquet(f"{self.path}/pointers")

    def _write(self, rows: DataFrame, version: int) -> list[tuple]:
        """Rows by day below a folder of this version; (day, part) of what was written."""
        folder = f"write={version}"
        keyed = rows.withColumn("_day", C(self.ts).cast("date"))
        keyed.write.mode("overwrite").partitionBy("_day").parquet(f"{self.path}/{folder}")
        days = self.spark.read.schema(f"{self.schema}, _day date").parquet(f"{self.path}/{folder}").select("_day").distinct().collect()
        return [(r["_day"], f"{folder}/_day={r['_day'] or '__HIVE_DEFAULT_PARTITION__'}") for r in days]

    def rows(self) -> DataFrame:
        """The table as the latest version has it."""
        parts = [f"{self.path}/{r['part']}" for r in self._folders()]
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame) -> None:
        version, before = self._version(), [(r["day"], r["part"]) for r in self._folders()]
        self._point(version, before + self._write(rows, version))

    def prune(self, cutoff) -> int:
        """Remove rows older than ``cutoff`` (a datetime) and return how many.

        Whole days before it are dropped by leaving them out of the next
        version; only the day of the cutoff itself is read and written again.
        """
        folders, version = self._folders(), self._version()
        old = [r for r in folders if r["day"] is not None and r["day"] < cutoff.date()]
        split = [r for r in folders if r["day"] == cutoff.date()]
        keep = [(r["day"], r["part"]) for r in folders if r not in old and r not in split]
        gone = self._read(old).count() if old else 0  # from the footers
        if split:
            day = self._read(split)
            young = day.where(C(self.ts) >= F.lit(cutoff))
            gone += day.count() - young.count()
            keep += self._write(young, version)
        self._point(version, keep)
        return gone

    def _read(self, folders: list) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{r['part']}" for r in folders])

    def unreferenced(self) -> DataFrame:
        """(part) of the folders that only older versions name; storage may remove them once no reader uses those."""
        rows = self.spark.read.schema(POINTERS).parquet(f"{self.path}/pointers").where(C("part").isNotNull())
        now = [r["part"] for r in self._folders()]
        return rows.where(~C("part").isin(now)).select("part").distinct() if now else rows.select("part").distinct()
