import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from codequarry.session import configure  # noqa: E402

SCRATCH = tempfile.mkdtemp(prefix="codequarry-tests-")
# made at import, so that test modules can build columns at module level
SESSION = (SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8")
           .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
           .config("spark.checkpoint.dir", f"{SCRATCH}/checkpoints").config("spark.sql.warehouse.dir", f"{SCRATCH}/warehouse")
           .getOrCreate())
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield configure(SESSION)
    SESSION.stop()


@pytest.fixture(scope="session")
def files(spark):
    """Builds a files table from (repo, path, content) tuples; bytes stay bytes."""

    def build(*rows):
        data = [(r, p, bytearray(c.encode() if isinstance(c, str) else c)) for r, p, c in rows]
        df = spark.createDataFrame(data, "repo string, path string, content binary")
        return df.selectExpr("*", "cast(octet_length(content) as bigint) AS size_bytes")

    return build
