import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from eventlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    return local_session(8, **{"spark.checkpoint.dir": shared})


@pytest.fixture()
def events(spark):
    """Build events from (data JSON, metadata JSON) pairs, ids by position."""
    from pyspark.sql import functions as F

    def build(*rows):
        texts = [(str(i), *(r if isinstance(r, tuple) else (r, "{}"))) for i, r in enumerate(rows)]
        return spark.createDataFrame(texts, "event_id string, d string, m string").select(
            "event_id",
            F.parse_json("d").alias("data"),
            F.parse_json("m").cast("map<string,variant>").alias("metadata"),
        )

    return build
