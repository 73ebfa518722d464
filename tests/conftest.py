import datetime as dt

import pytest

from huskwatch.functions.text import shannon_entropy
from huskwatch.session import get_spark

BASE = dt.datetime(2024, 6, 1, 12, 0, 0)
SCHEMA = ("block_id string, block_number int, block_total int, host_id string, process_id int, thread_id int, ts timestamp, "
          "path string, raw_text string, decoded_text string")


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", "local[8]", 8)
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.session.timeZone", "UTC")
    return s


@pytest.fixture(scope="session")
def make_blocks(spark):
    """Rows of (text, seconds) or dicts with overrides to a blocks DataFrame."""
    from pyspark.sql import functions as F

    def make(*items):
        rows = []
        for no, item in enumerate(items):
            d = dict(item) if isinstance(item, dict) else {"text": item[0], "sec": item[1]}
            text = d.get("text", "x")
            rows.append((d.get("id", f"b{no:04d}"), d.get("number", 1), d.get("total", 1), d.get("host", "h1"), d.get("pid", 1), 0,
                         BASE + dt.timedelta(seconds=d.get("sec", 0)), d.get("path", ""), text, d.get("decoded", text)))
        return spark.createDataFrame(rows, SCHEMA).withColumn("entropy", shannon_entropy(F.col("raw_text")))
    return make
