"""Small inputs written by hand."""

import json
from datetime import datetime


def bodies(spark, *messages):
    """Response bodies: objects become JSON, text stays as it is."""
    rows = [(i, m if isinstance(m, str) else json.dumps(m)) for i, m in enumerate(messages)]
    return spark.createDataFrame(rows, "n int, value string")


def raw(spark, *payloads):
    rows = [(p if isinstance(p, str) else json.dumps(p),) for p in payloads]
    return spark.createDataFrame(rows, "raw_payload string")


def ts(text):
    return datetime.fromisoformat(text)


def rows(df, *order):
    picked = df.orderBy(*order) if order else df
    return [tuple(r) for r in picked.collect()]
