from types import SimpleNamespace

import pytest

from tidebar import session as S


def fake(master, folder=None):
    kept = {"spark.checkpoint.dir": folder} if folder else {}
    conf = SimpleNamespace(get=lambda k, d=None: kept.get(k, d), set=kept.__setitem__)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.work_dir(fake(master))
    assert S.work_dir(fake(master, "/shared/")) == "/shared"


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_a_local_session_gets_its_own(master):
    spark = fake(master)
    assert S.work_dir(spark) == S.work_dir(spark)


def test_dropped_tables_are_gone(spark):
    t = S.materialize(spark.range(5), "x")
    fs, at = S._files(spark, t._written)
    assert t.count() == 5 and fs.exists(at)
    S.drop_table(t)
    S.drop_table(None)
    assert not fs.exists(at)
