from types import SimpleNamespace

import pytest

from noticeflow import session


def without_setting(spark, master):
    """The session as seen where no checkpoint folder is configured."""
    context = SimpleNamespace(master=master, applicationId="app", _jsc=spark.sparkContext._jsc)
    conf = SimpleNamespace(get=lambda key, default=None: spark.conf.get(key) if "warehouse" in key else default)
    return SimpleNamespace(conf=conf, sparkContext=context, _jvm=spark._jvm)


def test_setting_wins(spark, monkeypatch):
    fake = without_setting(spark, "yarn")
    fake.conf = SimpleNamespace(get=lambda key, default=None: "hdfs:///shared/")
    assert session.shared_root(fake) == "hdfs:///shared"


def test_cluster_needs_the_setting(spark):
    with pytest.raises(ValueError):
        session.shared_root(without_setting(spark, "yarn"))


def test_local_session_has_a_folder_of_its_own(spark):
    fake = without_setting(spark, "local[4]")
    root = session.shared_root(fake)
    assert session.shared_root(fake) == root
    first, second = session.work_dir(fake, "a"), session.work_dir(fake, "a")
    assert first != second and first.startswith(root)


def test_checkpoint_keeps_rows(spark):
    assert session.checkpointed(spark.range(10)).count() == 10
