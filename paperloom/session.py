"""Session construction and the shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "paperloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and skew handling on; ``conf`` overrides any setting."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app).config(map=settings)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir of the session.

    Only where the setting is missing and the master is a single machine is a local folder made.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    return folder


class Workspace:
    """Tables written to the shared folder to cut lineage; a superseded table can be dropped."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.step = 0

    def write(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and read it back, so that a lost executor costs no recomputation."""
        self.step += 1
        path = f"{self.root}/{self.step}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.workspace_path = path  # type: ignore[attr-defined]
        return back

    def drop(self, df: DataFrame) -> None:
        """Delete a table made by ``write`` that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.workspace_path)  # type: ignore[attr-defined]
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
