"""Tables that cut lineage, kept in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Set while a table is written: shuffle files go with the job, and Python workers get small batches of texts.
WHILE_SAVING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. In local mode, where it is unset, an own folder; on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Parquet tables of one operator call.

    A saved table survives the loss of executors and is read again instead of being computed again.
    ``drop`` and ``clear`` remove tables; the caller does so once nothing lazy reads them any more. What a result still
    reads goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        with self._saving():
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @contextlib.contextmanager
    def _saving(self):
        """WHILE_SAVING holds inside; shuffle files would else stay until the driver collects its garbage."""
        before = {k: self.spark.conf.get(k, None) for k in WHILE_SAVING}
        for k, v in WHILE_SAVING.items():
            self.spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                if v is None:
                    self.spark.conf.unset(k)
                else:
                    self.spark.conf.set(k, v)

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}" if name else self.base)
        with contextlib.suppress(Exception):  # a table that cannot be removed only costs disk
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def clear(self) -> None:
        atexit.unregister(self.clear)
        if self.spark.sparkContext._jsc is not None:
            self.drop()
