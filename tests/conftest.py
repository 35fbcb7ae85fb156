import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from postingscope.session import BASE_CONF, checkpoint_dir
    b = (SparkSession.builder.master("local[4]").appName("postingscope-tests")
         .config("spark.sql.shuffle.partitions", "4"))
    for k, v in BASE_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ps-test-ckpt-"))
    checkpoint_dir(s)
    yield s


@pytest.fixture
def tmpdir_path():
    return tempfile.mkdtemp(prefix="ps-test-")


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]
