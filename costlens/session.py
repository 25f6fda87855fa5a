"""Spark session helpers.

Library code never creates its own session; it receives one.  ``get_spark`` is
for tests, the bench and command-line use.  ``checkpoint_dir`` reads the shared
checkpoint folder the cluster names in ``spark.checkpoint.dir`` and only sets a
scratch one when nothing is configured (local tests).
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.shuffle.partitions": "8",
}


def get_spark(app: str = "costlens", cpus: int | str | None = None, **conf: str) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "*")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    merged = dict(_DEFAULTS)
    merged.setdefault("spark.driver.memory", os.environ.get("COSTLENS_DRIVER_MEMORY", "16g"))
    merged.update(conf)
    for k, v in merged.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage / stage intermediate tables.

    On a cluster ``spark.checkpoint.dir`` names a shared file system folder and is
    used as is.  Only when it is unset (tests, local runs) a scratch folder is
    created and registered.
    """
    sc = spark.sparkContext
    configured = (
        spark.conf.get("spark.checkpoint.dir", None)
        or sc.getConf().get("spark.checkpoint.dir", None)
        or sc.getCheckpointDir()
    )
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="costlens-ckpt-")
    try:
        spark.conf.set("spark.checkpoint.dir", path)
    except Exception:  # core confs may be read-only at runtime; the context setting suffices
        pass
    sc.setCheckpointDir(path)
    return path


_scopes: list[list[str]] = []  # paths handed out inside each open scratch_scope, innermost last


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for intermediate tables."""
    import uuid

    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    for scope in _scopes[-1:]:
        scope.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes what :func:`scratch_path` handed out inside it, once it ends without an error.

    For work that has written its result elsewhere by then: nothing that is still lazy may read those folders later.  After
    an error they stay, as a retry or a look at them may need them."""
    scope: list[str] = []
    _scopes.append(scope)
    try:
        yield
    finally:
        _scopes.pop()
    for path in scope:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def shuffle_partitions(spark: SparkSession) -> int:
    try:
        return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    except Exception:  # pragma: no cover - conf always present in practice
        return 8


def package_zip(target_dir: str) -> str:
    """Zip the ``costlens`` sources into ``target_dir`` (for ``addPyFile``)."""
    import zipfile

    import costlens

    pkg = os.path.dirname(os.path.abspath(costlens.__file__))
    target = os.path.join(target_dir, "costlens.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    return target


def ship_package(spark: SparkSession) -> None:
    """Make ``costlens`` importable in executor Python workers (pandas UDFs,
    ``mapInPandas``, ``applyInPandasWithState``) when it was not submitted with
    ``--py-files``: the package is zipped once per application and added with
    ``addPyFile``, in local mode too (workers do not share the driver's import path)."""
    sc = spark.sparkContext
    if getattr(sc, "_costlens_shipped", False):
        return
    # a code artifact for distribution (not data): built next to the driver process
    sc.addPyFile(package_zip(tempfile.mkdtemp(prefix="costlens-code-")))
    sc._costlens_shipped = True
