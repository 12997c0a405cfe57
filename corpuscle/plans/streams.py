"""Event stream queries, as batches of the same operators."""

from pyspark.sql import functions as F

from corpuscle.plans.base import query, table
from corpuscle.streaming import events


def _frames(spark, d):
    """Conversations as frames: one token event a turn, and a done event for the last turn's place."""
    c = table(spark, d, "conversations")
    data = F.to_json(F.struct(F.col("text")))
    token = c.select(F.concat(F.lit("id: c"), "conv_id", F.lit(":"), "turn", F.lit("\nevent: token\n: note\ndata: "), data).alias("frame"))
    done = c.groupBy("conv_id").agg(F.max("turn").alias("m")).select(F.concat(F.lit("event: done\ndata: {\"finish\":\ndata: \"complete\"}\nid: c"), "conv_id", F.lit(":"), (F.col("m") + 1).cast("string")).alias("frame"))
    return token.unionByName(done)


@query("SELECT 'c' || conv_id AS message_id, turn AS seq, 'token' AS kind, text FROM conversations UNION ALL SELECT 'c' || conv_id, max(turn) + 1, 'done', '' FROM conversations GROUP BY conv_id")
def st1_st2_decode(spark, d):
    return events.decode_events(events.parse_frames(_frames(spark, d))).select("message_id", "seq", "kind", "text")


@query("SELECT 'c' || conv_id AS message_id, string_agg(text, '' ORDER BY turn) AS content, 'complete' AS status, max(turn) + 1 AS last_seq FROM (SELECT DISTINCT ON (conv_id, turn) * FROM conversations) GROUP BY conv_id")
def st3_message_states(spark, d):
    return events.message_states(events.decode_events(events.parse_frames(_frames(spark, d)))).select("message_id", "content", "status", "last_seq")


@query("SELECT 'c' || conv_id AS message_id, 'token' AS kind, min(turn) AS first_seq, max(turn) AS last_seq, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id UNION ALL SELECT 'c' || conv_id, 'done', max(turn) + 1, max(turn) + 1, '' FROM conversations GROUP BY conv_id")
def st4_coalesced(spark, d):
    return events.coalesced(events.decode_events(events.parse_frames(_frames(spark, d))))


@query("SELECT user_id AS conversation, max(event_id) AS proposal FROM events WHERE event_type = 'click' GROUP BY 1")
def st6_newest_pending(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("conversation"), F.col("event_id").alias("proposal"), F.col("event_id").alias("at"), F.when(F.col("event_type") == "click", "pending").otherwise("done").alias("decision"))
    return events.newest_pending(rows)


@query("""SELECT user_id, '1 day' AS length, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS requests, count(*) - 3 AS over FROM events GROUP BY 1, 3 HAVING count(*) > 3
UNION ALL SELECT user_id, '1 hour', time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01'), count(*), count(*) - 1 FROM events GROUP BY 1, 3 HAVING count(*) > 1""")
def st8_rate_limit(spark, d):
    return events.rate_limited(table(spark, d, "events"), "user_id", "ts", {"1 day": 3, "1 hour": 1})
