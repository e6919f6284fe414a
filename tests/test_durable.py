import os
from types import SimpleNamespace

import pytest

from claimloom.plans import durable


def test_sweep_leaves_other_jobs_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(durable, "shared_dir", lambda s: f"{tmp_path}/{s.sparkContext.applicationId}")
    held = durable.cut(spark.range(5))
    assert held.count() == 5
    own = f"{tmp_path}/{spark.sparkContext.applicationId}"
    other = f"{tmp_path}/other-application/cut-1"
    os.makedirs(other)
    for name in ("stream-1", "claims-1", "generated-1", "rdd-1"):
        os.makedirs(f"{own}/{name}")
    durable.sweep(spark)
    assert os.listdir(own) == ["rdd-1"] and os.path.isdir(other)


def _session(master, setting=None):
    context = SimpleNamespace(master=master, applicationId="app-1", getConf=lambda: SimpleNamespace(get=lambda k: setting), setCheckpointDir=lambda p: None)
    context._jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True)))
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d))


def test_the_folder_is_the_cluster_s_and_the_application_s():
    assert durable.shared_dir(_session("spark://x:1", "hdfs://a/b/")) == "hdfs://a/b/app-1"
    assert durable.shared_dir(_session("local[4]")) == "/tmp/checkpoints/app-1"
    for master in ("spark://x:1", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            durable.shared_dir(_session(master))
