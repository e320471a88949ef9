import os
from types import SimpleNamespace

import pytest

from panelforge.session import clear_scratch, pin, scratch_path, scratch_root


def stub(master, setting=None):
    context = SimpleNamespace(master=master, applicationId="app-1")
    conf = SimpleNamespace(get=lambda name, default=None: setting or default)
    return SimpleNamespace(sparkContext=context, conf=conf)


def test_shared_folder_comes_from_the_session():
    assert scratch_root(stub("yarn", "/shared/folder/")) == "/shared/folder"
    assert scratch_path(stub("yarn", "/shared"), "x").startswith("/shared/panelforge/app-1/x-")


def test_only_local_sessions_get_a_temporary_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(stub("yarn"))
    root = scratch_root(stub("local[2]"))
    assert os.path.isdir(root) and root == scratch_root(stub("local[2]"))


def test_pinned_rows_have_no_lineage(spark, rows):
    pinned = pin(spark.range(5).selectExpr("id", "id * 2 AS twice"), "test")
    plan = pinned._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "Range" not in plan
    assert rows(pinned) == [(i, 2 * i) for i in range(5)]
    assert callable(clear_scratch)


def test_pinned_rows_are_packed_tightly(spark):
    pinned = pin(spark.range(5), "test")
    assert all(".zstd." in f for f in pinned.inputFiles())
