"""Schemas of the stored tables.  UUIDs are canonical lower-case strings, whose order is that of their bytes."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

LINK = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("url", T.StringType(), False), T.StructField("retrieved_at", T.TimestampType(), False)])
EDGE = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("src", T.StringType(), False), T.StructField("dst", T.StringType(), False), T.StructField("updated_at", T.TimestampType(), False)])
DOCUMENT = T.StructType(
    [
        T.StructField("link_id", T.StringType(), False),
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("indexed_at", T.TimestampType()),
        T.StructField("pagerank", T.DoubleType()),
    ]
)
POSTING = T.StructType([T.StructField("term", T.StringType()), T.StructField("link_id", T.StringType()), T.StructField("tf", T.LongType())])

NIL_ID = "00000000-0000-0000-0000-000000000000"
LAST_ID = "ffffffff-ffff-ffff-ffff-ffffffffffff"
#: seconds of 0001-01-03 00:00:00 UTC, the time of a link that was never fetched; earlier than every other.
#: Two days into year 1, as Python's datetime cannot read the first in every time zone.
NEVER = -62135424000


def never():
    return F.timestamp_seconds(F.lit(NEVER))
