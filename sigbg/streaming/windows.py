"""Running window metrics that close and reset: one current state, results, and a count of late rows.

Every micro-batch is summed by window and key and merged with the open windows.
When the watermark - the latest event time of earlier batches less ``delay`` -
passes a window's end, the window's sums go to the results and leave the state;
a later event begins nothing anew: rows of closed windows are counted by
window in a side table.

The state is a stored table of the open windows, a version a batch; older
versions are removed, so it holds open windows x keys rows however long the
stream runs.  Results and late counts are one folder a batch.  Every folder is
named by its batch and overwritten when a batch runs again, so a restart counts
nothing twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

MICROS = 1_000_000


def _fs(spark: SparkSession, path: str):
    """Spark's file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Batches that have a finished table under ``folder``."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    done = [int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")]
    return sorted(n for n in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={n}/_SUCCESS")))


class WindowStore:
    """State, results and late counts of one stream under ``path``.

    ``keys`` and ``sums`` name columns; rows are added up by (window start, keys).
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], sums: dict[str, Column], seconds: int = 86_400, delay: int = 0):
        ship_package(spark)
        self.spark, self.path, self.keys, self.sums = spark, path.rstrip("/"), list(keys), sums
        self.width, self.delay = seconds * MICROS, delay * MICROS

    def _table(self, name: str, batch: int) -> str:
        return f"{self.path}/{name}/batch={batch}"

    def state(self, before: int | None = None) -> tuple[DataFrame | None, int | None]:
        """(open windows, watermark) after the last batch (before batch ``before``)."""
        found = [v for v in versions(self.spark, f"{self.path}/state") if before is None or v < before]
        if not found:
            return None, None
        t = self.spark.read.parquet(self._table("state", found[-1]))
        mark = t.filter("win IS NULL").first()["mark"]
        return t.filter("win IS NOT NULL").drop("mark"), mark

    def add(self, batch: DataFrame, batch_id: int, ts: str = "ts") -> None:
        """One micro-batch; rows without an event time are late rows of no window."""
        old, mark = self.state(before=batch_id)
        micros = F.unix_micros(F.col(ts).cast("timestamp"))
        rows = batch.withColumn("win", (micros - F.pmod(micros, F.lit(self.width))).cast("long")).withColumn("_micros", micros)
        closed = (F.col("win") + self.width <= F.lit(mark if mark is not None else -2 ** 63).cast("long")) | F.col("win").isNull()
        late = rows.filter(closed).groupBy("win").agg(F.count(F.lit(1)).alias("n"))
        late.write.mode("overwrite").parquet(self._table("late", batch_id))
        total = [F.sum(c).alias(c) for c in self.sums]
        part = rows.filter(~closed).withColumns({f"_s_{c}": e for c, e in self.sums.items()}) \
            .groupBy("win", *self.keys).agg(*[F.sum(f"_s_{c}").alias(c) for c in self.sums])
        merged = (part if old is None else old.unionByName(part)).groupBy("win", *self.keys).agg(*total)
        top = rows.agg(F.max("_micros")).first()[0]
        seen = [m for m in (mark, None if top is None else top - self.delay) if m is not None]
        new = max(seen) if seen else None
        ends = F.col("win") + self.width <= F.lit(new if new is not None else -2 ** 63).cast("long")
        merged.filter(ends).write.mode("overwrite").parquet(self._table("closed", batch_id))
        still = merged.filter(~ends).withColumn("mark", F.lit(None).cast("long"))
        header = self.spark.createDataFrame([(new,)], "mark long")
        still.unionByName(header, allowMissingColumns=True).write.mode("overwrite").parquet(self._table("state", batch_id))
        for v in versions(self.spark, f"{self.path}/state"):
            if v < batch_id - 1:                          # the one before stays: this batch may have to run again
                fs, p = _fs(self.spark, self._table("state", v))
                fs.delete(p, True)

    def run(self, sdf: DataFrame, checkpoint: str, ts: str = "ts") -> None:
        """Consume what the stream holds; a restart goes on from ``checkpoint``."""
        q = (sdf.writeStream.foreachBatch(lambda df, i: self.add(df.persist(), i, ts)).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()

    def _all(self, name: str) -> DataFrame | None:
        found = versions(self.spark, f"{self.path}/{name}")
        return self.spark.read.parquet(*[self._table(name, v) for v in found]) if found else None

    def results(self) -> DataFrame:
        """Sums of all windows so far, ``open`` or not: (win, keys, sums, open)."""
        done, (now, _) = self._all("closed"), self.state()
        return done.withColumn("open", F.lit(False)).unionByName(now.withColumn("open", F.lit(True)))

    def late(self) -> DataFrame:
        """(win, n): rows that came after their window had closed."""
        return self._all("late").groupBy("win").agg(F.sum("n").alias("n"))


def pearson_sums(x: Column, y: Column) -> dict[str, Column]:
    """Sums that the Pearson correlation of two columns needs; rows with one missing take no part."""
    both = x.isNotNull() & y.isNotNull()
    x, y = (F.when(both, c.cast("double")) for c in (x, y))
    return {"n": both.cast("long"), "sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y}


def pearson(n: str = "n") -> Column:
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col(n)
    var = (F.col("sxx") - F.col("sx") * F.col("sx") / F.col(n)) * (F.col("syy") - F.col("sy") * F.col("sy") / F.col(n))
    return F.try_divide(cov, F.sqrt(var))
