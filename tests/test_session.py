import os
from types import SimpleNamespace

import pytest

from wardlog import session as ss


def fake(master, setting):
    conf = SimpleNamespace(get=lambda key, default=None: setting)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=master))


def test_shared_folder_comes_from_the_session():
    assert ss.shared_dir(fake("spark://host", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(RuntimeError):
        ss.shared_dir(fake("spark://host", None))
    with pytest.raises(RuntimeError):
        ss.shared_dir(fake("local-cluster[2,1,1024]", None))
    assert ss.shared_dir(fake("local[2]", None)) == ss.shared_dir(fake("local[2]", None))


def test_staged_frames_keep_schema(spark):
    df = spark.range(5).selectExpr("id", "cast(id as string) AS s", "timestamp_seconds(id) AS t")
    staged = ss.stage(df, "t")
    assert staged.dtypes == df.dtypes and staged.count() == 5


def test_scratch_removes_what_is_not_kept(spark):
    with ss.scratch(spark):
        with ss.scratch(spark):
            gone, kept = ss.stage(spark.range(3), "gone"), ss.stage(spark.range(4), "kept", keep=True)
            files = gone.inputFiles()
            assert gone.count() == 3
        assert kept.count() == 4 and ss.stage(spark.range(5), "more").count() == 5
        assert not any(os.path.exists(f.removeprefix("file:").replace("///", "/")) for f in files)
        files = kept.inputFiles()
    assert not any(os.path.exists(f.removeprefix("file:").replace("///", "/")) for f in files)
    assert ss.stage(spark.range(6), "outside").count() == 6


def test_memory_goes_back_before_the_next_operators_task(monkeypatch):
    from functools import lru_cache

    from wardlog.llm import common

    said = []
    monkeypatch.setattr(common, "give_back", lambda: said.append(f"back, {held.cache_info().currsize} kept"))

    @lru_cache
    def held():
        return object()

    @common.tidy(kept=(held,))
    def first(rows):
        held()
        yield from rows

    @common.tidy()
    def second(rows):
        said.append("begins")
        yield from rows

    list(first([1]))
    list(first([1]))
    list(second([1]))
    assert said == ["back, 1 kept", "back, 1 kept", "back, 0 kept", "begins", "back, 0 kept"]
