import os
import sys
import tempfile
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    ckpt = tempfile.mkdtemp(prefix="ss-test-ckpt-")
    s = (SparkSession.builder.master("local[4]").appName("support_signals-tests")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true").config("spark.checkpoint.dir", ckpt)
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


TICKET_DDL = ("ticket_no bigint, id string, created_at timestamp_ntz, category string, account_id bigint, "
              "priority string, status string, assignee string, subject string, body string, tags string, "
              "topic_id int, is_emerging_trend boolean, embedding array<float>")


def ts(s: str) -> datetime:
    return datetime.fromisoformat(s)


@pytest.fixture()
def make_tickets(spark):
    def build(rows):
        out = []
        for i, r in enumerate(rows):
            r = dict(r)
            out.append((r.get("ticket_no", i), r["id"], ts(r["created_at"]), r.get("category", "api"),
                        r.get("account_id", i), r.get("priority", "low"), r.get("status", "open"), r.get("assignee"),
                        r.get("subject", f"subject of {r['id']}"), r.get("body", "body"),
                        r.get("tags", "[]"), r.get("topic_id", 0), r.get("is_emerging_trend", False),
                        [float(x) for x in r["embedding"]]))
        return spark.createDataFrame(out, TICKET_DDL)
    return build
