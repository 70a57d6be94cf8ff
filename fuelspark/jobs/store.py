"""Tables of a job below one folder, in versions by run.

A run writes whole new versions and becomes visible by its commit, an empty marker that comes last. Readers see committed
runs only, so a run that stops half-way leaves the tables of the run before as they were; repeated under its name, it
overwrites what it had begun. Runs are ordered by their names.
"""

from pyspark.sql import DataFrame, SparkSession

from fuelspark.sources.zones import partitions


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def folder(self, path: str):
        """A path and its file system."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def runs(self) -> list[str]:
        """Committed runs, the oldest first."""
        return [r for (r,) in partitions(self.spark, f"{self.root}/_commits", "run")]

    def before(self, run: str) -> str | None:
        """The newest committed run that is older than this one."""
        return max((r for r in self.runs() if r < run), default=None)

    def path(self, table: str, run: str) -> str:
        return f"{self.root}/{table}/run={run}"

    def write(self, table: str, run: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(table, run))
        return self.spark.read.parquet(self.path(table, run))

    def read(self, table: str, run: str | None = None) -> DataFrame:
        """A table of a committed run, of the newest one if none is named."""
        runs = self.runs()
        if run is None and not runs or run is not None and run not in runs:
            raise ValueError(f"no committed run {run or ''} below {self.root}")
        return self.spark.read.parquet(self.path(table, run or runs[-1]))

    def commit(self, run: str, keep: int = 2) -> None:
        """Make the run visible, and drop the versions of runs that are older than the newest ``keep``."""
        marker, files = self.folder(f"{self.root}/_commits/run={run}")
        files.mkdirs(marker)
        kept = self.runs()[-keep:]
        found, files = self.folder(f"{self.root}/*/run=*")
        for status in files.globStatus(found) or []:
            table, version = status.getPath().toString().split("/")[-2:]
            if not table.startswith("_") and version.removeprefix("run=") < kept[0]:
                files.delete(status.getPath(), True)
