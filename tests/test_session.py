import os
import sys
import zipfile

import pytest

from costlens.session import checkpoint_dir, package_zip, scratch_path, scratch_scope


def test_package_zip_is_importable(tmp_path):
    z = package_zip(str(tmp_path))
    names = zipfile.ZipFile(z).namelist()
    assert "costlens/__init__.py" in names and "costlens/operators/ordered.py" in names
    sys.path.insert(0, z)
    try:
        import importlib

        mod = importlib.import_module("costlens.functions.columns")
        assert hasattr(mod, "portable_hash")
    finally:
        sys.path.remove(z)


def test_scratch_paths_live_under_the_checkpoint_folder(spark):
    base = checkpoint_dir(spark)
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a.startswith(base) and b.startswith(base) and a != b


def test_a_scope_deletes_its_own_tables_only(spark):
    before = scratch_path(spark, "before")
    spark.range(3).write.parquet(before)
    with scratch_scope(spark):
        outer = scratch_path(spark, "outer")
        spark.range(3).write.parquet(outer)
        with scratch_scope(spark):
            inner = scratch_path(spark, "inner")
            spark.range(3).write.parquet(inner)
        assert spark.read.parquet(outer).count() == 3 and not os.path.exists(inner)
        scratch_path(spark, "never-written")
    assert spark.read.parquet(before).count() == 3 and not os.path.exists(outer)


def test_a_scope_that_fails_keeps_its_tables(spark):
    with pytest.raises(ZeroDivisionError), scratch_scope(spark):
        path = scratch_path(spark, "kept")
        spark.range(3).write.parquet(path)
        1 / 0
    assert spark.read.parquet(path).count() == 3
