"""Row types of the three activity streams and of the published results."""

from __future__ import annotations

import json

from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType, TimestampType

HOURS = tuple(range(24))
COUNTERS = tuple(f"count_h{h:02d}" for h in HOURS)
TOP = 10


def _struct(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t) for n, t in fields])


FRIENDSHIP = _struct(("ts", TimestampType()), ("user_id1", LongType()), ("user_id2", LongType()))
COMMENT = _struct(("ts", TimestampType()), ("comment_id", LongType()), ("user_id", LongType()), ("content", StringType()), ("user_name", StringType()), ("is_post_comment", BooleanType()), ("parent_id", LongType()))
POST = _struct(("ts", TimestampType()), ("post_id", LongType()), ("user_id", LongType()), ("content", StringType()), ("user_name", StringType()))

HOUR_STATISTICS = _struct(("ts", LongType()), *((c, LongType()) for c in COUNTERS))


def wide_ranking(id_name: str, score_name: str, k: int = TOP) -> StructType:
    """ts, then id and score for each rank."""
    return _struct(("ts", LongType()), *((f"{n}_{i}", LongType()) for i in range(1, k + 1) for n in (id_name, score_name)))


#: Result topic -> row type. Twelve-hour names follow the window: one hour, a day, a week, everything.
RESULTS = {
    **{f"friendships_{w}": HOUR_STATISTICS for w in ("day", "week", "all")},
    **{f"posts_{w}": wide_ranking("post_id", "num_comments") for w in ("hour", "day", "week")},
    **{f"users_{w}": wide_ranking("user", "rating") for w in ("hour", "day", "week")},
}
INPUTS = {"friendships": FRIENDSHIP, "comments": COMMENT, "posts": POST}

_AVRO = {"bigint": "long", "string": "string", "boolean": "boolean", "timestamp": {"type": "long", "logicalType": "timestamp-millis"}}


def avro(name: str) -> str:
    """The Avro schema of an input stream or result, derived from its row type."""
    fields = [{"name": f.name, "type": _AVRO[f.dataType.simpleString()]} for f in (INPUTS | RESULTS)[name].fields]
    return json.dumps({"type": "record", "name": f"{name}_record", "fields": fields})
