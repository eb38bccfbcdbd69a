"""Unchecked fields are read from the line of every event."""

from collections import Counter

from tidemill.plans import registry
from tidemill.sources import tables

SF = "/root/testdata/sf0.001"


def test_every_event_is_read(spark):
    found = Counter(map(tuple, registry.queries()["parse_unchecked"](spark, SF).collect()))
    events = tables.events(spark, SF).selectExpr("date_trunc('millisecond', ts)::timestamp_ntz AS ts", "user_id").collect()
    assert found == Counter(map(tuple, events))
