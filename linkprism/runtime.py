"""Session, table and staging helpers shared by all operators."""

from __future__ import annotations

import atexit
import itertools
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SERIAL = itertools.count()
_RUN = uuid.uuid4().hex[:12]
_CLEAN: set[str] = set()
_SHIPPED: set[str] = set()


def local_session(cores: int | str = "*", app: str = "linkprism", shuffle: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application; their Python need not find it otherwise."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="linkprism-code-"), "linkprism.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    atexit.register(shutil.rmtree, target.parent, True)  # executors fetch it from the driver when they first need it


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, path object) of any path: local, hdfs, object store."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = filesystem(spark, path)
    return fs.exists(at)


def listing(spark: SparkSession, path: str, pattern: str | None = None) -> list[str]:
    """Names in a folder, sorted, those that match the pattern; none if there is no such folder."""
    fs, at = filesystem(spark, path)
    found = fs.globStatus(filesystem(spark, f"{path.rstrip('/')}/{pattern or '*'}")[1]) if fs.exists(at) else None
    return sorted(x.getPath().getName() for x in found or ())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = filesystem(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    return "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's checkpoint folder.

    Where the session names none, a temporary folder is set in local mode (tests, one
    machine). On a cluster that would lie on one machine only, so it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            found = known.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            found = tempfile.mkdtemp(prefix="linkprism-")
            spark.sparkContext.setCheckpointDir(found)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return found.rstrip("/")


def staging_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; the application's staging folder is removed when the driver ends."""
    root = f"{shared_dir(spark)}/linkprism-{_RUN}"
    if root not in _CLEAN:
        _CLEAN.add(root)
        atexit.register(_remove, spark, root)
    return f"{root}/{next(_SERIAL):04d}-{tag}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts lineage and survives lost executors; unlike a checkpoint the table
    is columnar and compressed, so later passes read only the columns they name.
    """
    spark = df.sparkSession
    path = staging_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, root: str) -> None:
    try:
        fs, path = filesystem(spark, root)
        fs.delete(path, True)
    except Exception:  # the session may be gone already; the folder is then left to its owner
        pass
