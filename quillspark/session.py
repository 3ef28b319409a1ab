"""Session defaults, and shipping of the package to Python workers."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch that goes to Python; by default it's a number of rows, whatever their length.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def session(app: str = "quillspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; conf overrides them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        _BATCH: str(BATCH_BYTES),
    }
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Makes this package importable on the executors, once per application, from the
    folder that they share. Bounds the session's Arrow batches, if it doesn't say how."""
    if not spark._jsparkSession.conf().contains(_BATCH):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root, packed = Path(__file__).resolve().parent, io.BytesIO()
        with zipfile.ZipFile(packed, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent).as_posix())
        path = f"{shared_folder(spark)}.zip"
        to = sc._jvm.org.apache.hadoop.fs.Path(path)
        out = to.getFileSystem(sc._jsc.hadoopConfiguration()).create(to, True)
        out.write(bytearray(packed.getvalue()))
        out.close()
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark


def spread(df: DataFrame, key: str = "doc_id", bytes_each: int = 16 << 20) -> DataFrame:
    """df in as many partitions as there are cores if it's read in fewer, as a small
    file is, so that work on its rows isn't one task's. Larger tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, key) if size < cores * bytes_each else df


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below spark.checkpoint.dir, which all executors see. On
    one machine, where the session names none, a folder is chosen and set."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/x-{uuid.uuid4().hex}"
