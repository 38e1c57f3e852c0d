"""Literal events with fixed times."""

from pyspark.sql import functions as F

from clickweave.sources.events import with_event_time
from clickweave.sources.schema import EVENT

T0 = 1704067200000


def row(event_id, user, session, kind, page, offset=0, **more):
    base = {"eventId": event_id, "userId": user, "sessionId": session, "eventType": kind, "pageUrl": page, "timestamp": T0 + offset, "targetElement": None, "referrerUrl": None, "userAgent": None, "schemaVersion": "1.0", "metadata": None}
    return base | more


def frame(spark, rows):
    return with_event_time(spark.createDataFrame([tuple(r[c] for c in EVENT.fieldNames()) for r in rows], EVENT))


def views(spark, *pages, user="u1", session="s1"):
    return frame(spark, [row(f"evt{k}", user, session, kind, page, at) for k, (kind, page, at) in enumerate(pages)])


def ms(column):
    return F.unix_millis(column)
