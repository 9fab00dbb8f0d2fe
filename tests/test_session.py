"""The shared folder: the session's own setting first, a local one only in tests."""

from types import SimpleNamespace

import pytest

from promptlens import session


def fake(setting, master="local[2]"):
    made = []
    context = SimpleNamespace(master=master, applicationId=f"{setting}-{master}", setCheckpointDir=made.append)
    conf = SimpleNamespace(get=lambda key, default=None: setting or default)
    return SimpleNamespace(conf=conf, sparkContext=context), made


def test_the_cluster_setting_wins():
    spark, made = fake("hdfs:///shared/")
    assert session.shared_dir(spark) == "hdfs:///shared" and not made


def test_a_local_folder_only_on_a_local_master():
    spark, made = fake("")
    folder = session.shared_dir(spark)
    assert made == [folder] and session.shared_dir(spark) == folder
    with pytest.raises(ValueError):
        session.shared_dir(fake("", "spark://host:7077")[0])
