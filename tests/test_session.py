"""Written tables and the shared folder."""

import os

import pytest

from strataform import session


def test_written_tables_can_be_cleared(spark):
    df = session.materialize(spark, spark.range(3), "three")
    folder = session.written_dir(spark).removeprefix("file://")
    assert df.count() == 3 and os.listdir(folder)
    session.clear_written(spark)
    assert not os.path.exists(folder)
    assert session.materialize(spark, spark.range(2), "two").count() == 2


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, *_):
            return None

        def set(self, *_):
            raise AssertionError

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Session())
