"""Tables in the folder that all executors share, used to cut lineage.

The folder is what the cluster names in ``spark.checkpoint.dir``.  Where that
is unset (tests on one machine) a temporary folder of the driver is taken.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="loomstead-")
    return _LOCAL[app]


#: Folders below the shared one that this driver has named and not deleted, in order.
_live: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _live.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    if path in _live:
        _live.remove(path)


def n_live() -> int:
    """A mark for ``forget_since``."""
    return len(_live)


def forget_since(spark: SparkSession, mark: int = 0, keep: DataFrame | None = None) -> None:
    """Delete what was written after a mark, but ``keep``; results that read it must have been written or used before."""
    for path in _live[mark:]:
        if path != getattr(keep, "_loomstead_path", None):
            delete(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the stored table, so that a lost executor costs a re-read only."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._loomstead_path = path
    return stored


def forget(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    path = getattr(df, "_loomstead_path", None)
    if path:
        delete(df.sparkSession, path)


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of what is no longer referred to, which it does when the driver collects its garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, so that their Python workers can import it."""
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="loomstead-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
