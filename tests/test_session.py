"""Where settled tables go."""

import pytest

from brackish import settle
from brackish.session import durable_folder


class Named:
    """Just enough of a session: a setting and a master."""

    def __init__(self, folder, master):
        self.conf, self.sparkContext, self.master, self._folder = self, self, master, folder

    def get(self, name, default):
        return self._folder if name == "spark.checkpoint.dir" and self._folder else default


def test_folder_of_the_cluster_is_used():
    assert durable_folder(Named("hdfs:///shared", "yarn")) == "hdfs:///shared"


def test_local_session_gets_one_private_folder():
    assert durable_folder(Named(None, "local[2]")) == durable_folder(Named(None, "local[4]"))


def test_cluster_without_a_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        durable_folder(Named(None, "yarn"))


def test_settled_table_is_read_from_files(spark):
    df = settle(spark.range(10).selectExpr("id", "id % 3 AS k"))
    assert df.dtypes == [("id", "bigint"), ("k", "bigint")]
    assert df.count() == 10 and len(df.inputFiles()) > 0
