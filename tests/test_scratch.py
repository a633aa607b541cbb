"""Where tables between steps are written."""

import os
from types import SimpleNamespace

import pytest

from cairn import scratch


def test_a_cluster_without_shared_folder_is_refused():
    conf = SimpleNamespace(get=lambda *_: None)
    spark = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://far:7077", getConf=lambda: conf))
    with pytest.raises(RuntimeError):
        scratch.shared_folder(spark)


def test_what_was_written_goes_when_it_is_left(spark):
    with scratch.Scratch(spark, "t") as s:
        assert s.write(spark.range(5)).count() == 5
        at = s.path.removeprefix("file://")
        assert os.listdir(at)
    assert not os.path.exists(at)
