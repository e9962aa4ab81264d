import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracemill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, partitions=4, memory="4g")
    yield session
    session.stop()


LOG = "request_id string, timestamp string, model string, messages array<struct<role string, content string, name string>>, tool_schemas array<struct<name string, parameters array<string>>>, token_count int, cache_bucket string, provider_metadata struct<api_surface string, brokered boolean, stream boolean>"


@pytest.fixture
def make_log(spark):
    """Requests from (id, contents) or (id, contents, timestamp, bucket)."""

    def make(*rows, extra=()):
        out = []
        for r in rows:
            rid, contents, ts, bucket = (*r, None, None)[:4] if len(r) < 4 else r
            messages = None if contents is None else [None if c is ... else ("user", c, None) for c in contents]
            out.append((rid, ts, None, messages, None, None, bucket, None))
        df = spark.createDataFrame(out, LOG)
        for name in extra:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("clash"))
        return df

    return make
