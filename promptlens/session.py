"""Session settings the library relies on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # lists of ids reach the files' Bloom filters up to this length
    "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
    # a generated method beyond this size is never compiled by the JVM: such a stage runs as smaller methods instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(app: str = "promptlens", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Fix the session time zone, as event dates are UTC dates, and the size of generated methods."""
    for key in ("spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit"):
        spark.conf.set(key, SETTINGS[key])
    return spark


#: For steps that sort whole rows: a task's share stays in memory, however compressible its input is.
SMALL_TASKS = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m", "spark.sql.files.maxPartitionBytes": "32m"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for a while; those before it come back, whatever happens."""
    before = {key: spark.conf.get(key) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a local one is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = _own.get(context.applicationId)
        if folder is None:
            folder = _own[context.applicationId] = tempfile.mkdtemp(prefix="promptlens-")
            context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/promptlens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def touch_file(spark: SparkSession, path: str) -> None:
    """Create an empty file; its name is all it says."""
    p, fs = _file(spark, path)
    fs.create(p, True).close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, in place of one that is there."""
    p, fs = _file(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def remove_file(spark: SparkSession, path: str) -> None:
    """Remove a file, or a folder with its files; one that is gone already is no error."""
    p, fs = _file(spark, path)
    fs.delete(p, True)


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names of a folder's files, sorted; none where there is no folder."""
    p, fs = _file(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def file_times(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, modification time in milliseconds) of a folder's files."""
    p, fs = _file(spark, path)
    return [(s.getPath().getName(), s.getModificationTime()) for s in fs.listStatus(p)] if fs.exists(p) else []
