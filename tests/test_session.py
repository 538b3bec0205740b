"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from affinium import session


def fake(master, setting=None, app="app-1"):
    conf = SimpleNamespace(get=lambda key, default=None: setting or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=app))


def test_configured_folder_wins():
    assert session.shared_folder(fake("spark://host:1", "s3a://bucket/check/")) == "s3a://bucket/check"
    assert session.shared_folder(fake("local[2]", "/shared")) == "/shared"


def test_local_session_gets_one_folder():
    first = session.shared_folder(fake("local[2]"))
    assert session.shared_folder(fake("local[2]")) == first
    assert session.fresh_path(fake("local[2]"), "t").startswith(f"{first}/affinium/t-")


def test_cluster_without_the_setting_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(fake("yarn"))


def test_scope_deletes_its_tables(spark, tmp_path):
    from pathlib import Path

    from affinium import session

    def tables():
        return {p.name for p in Path(session.shared_folder(spark), "affinium").glob("*")}

    before = tables()
    with session.scope(spark):
        kept = session.materialise(spark.range(3), "scoped")
        assert kept.count() == 3 and len(tables() - before) == 1
        with pytest.raises(ZeroDivisionError), session.scope(spark):
            session.materialise(spark.range(3), "inner")
            1 / 0
        assert len(tables() - before) == 1
    assert tables() == before
