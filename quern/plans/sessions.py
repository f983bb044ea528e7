"""Queries of research sessions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.plans.registry import query
from quern.session import table
from quern.streaming import sessions

#: Conversations as sessions. A user's row asks under a command, an assistant's attaches its row as evidence to that of the row
#: before; every fifth question is sent again, every seventh again with another hash; the seventh row closes the session.
_REQUESTS = r"""r AS (SELECT conv_id, turn, role, CASE WHEN turn = 6 THEN 'session_closed' WHEN role = 'user' THEN 'question_asked' ELSE 'evidence_attached' END AS kind, sha256(coalesce(text, '')) AS h FROM conversations),
a AS (SELECT conv_id, turn * 10 AS place, kind, CASE WHEN kind = 'question_asked' THEN h END AS text, CASE WHEN kind = 'evidence_attached' THEN 'r' || turn % 3 END AS ref, CASE kind WHEN 'question_asked' THEN 'c' || turn WHEN 'evidence_attached' THEN 'c' || (turn - 1) END AS command, 'h' AS hash FROM r
  UNION ALL SELECT conv_id, turn * 10 + 1, kind, h, NULL, 'c' || turn, 'h' FROM r WHERE kind = 'question_asked' AND turn % 5 = 0
  UNION ALL SELECT conv_id, turn * 10 + 2, kind, h, NULL, 'c' || turn, 'other' FROM r WHERE kind = 'question_asked' AND turn % 7 = 2)"""


@query(rf"""WITH RECURSIVE {_REQUESTS},
z AS (SELECT conv_id, min(place) AS ends FROM a WHERE kind = 'session_closed' GROUP BY conv_id),
o AS (SELECT a.*, CASE WHEN kind = 'question_asked' AND place % 10 <> 0 THEN CASE WHEN EXISTS (FROM a b WHERE b.conv_id = a.conv_id AND b.command = a.command AND b.place = a.place - a.place % 10 AND (z.ends IS NULL OR b.place < z.ends)) THEN CASE hash WHEN 'h' THEN 'repeated' ELSE 'conflict' END ELSE CASE WHEN a.place > z.ends THEN 'closed' ELSE 'accepted' END END
  WHEN kind = 'evidence_attached' AND NOT EXISTS (FROM a b WHERE b.conv_id = a.conv_id AND b.command = a.command AND b.kind = 'question_asked' AND b.place < a.place AND (z.ends IS NULL OR b.place < z.ends)) THEN 'not_started'
  WHEN a.place > z.ends THEN 'closed' ELSE 'accepted' END AS outcome FROM a LEFT JOIN z USING (conv_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS seq FROM o WHERE outcome = 'accepted'),
c AS (SELECT conv_id, place, seq, sha256('["' || conv_id || '",' || seq || ',"' || kind || '","' || coalesce(text, '') || '",[' || coalesce('"' || ref || '"', '') || '],"' || repeat('0', 64) || '"]') AS hash_ FROM n WHERE seq = 1
  UNION ALL SELECT n.conv_id, n.place, n.seq, sha256('["' || n.conv_id || '",' || n.seq || ',"' || n.kind || '","' || coalesce(n.text, '') || '",[' || coalesce('"' || n.ref || '"', '') || '],"' || c.hash_ || '"]') FROM c JOIN n ON n.conv_id = c.conv_id AND n.seq = c.seq + 1)
SELECT o.conv_id AS session_id, o.place, o.outcome, c.seq AS sequence, c.hash_ AS event_hash FROM o LEFT JOIN c USING (conv_id, place)""")
def session_answers(spark, sf_dir):
    """Conversations replayed as sessions with commands, of which some are sent again, some with another hash, and some after closing."""
    t = F.col("turn")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", F.when(t == 6, "session_closed").when(F.col("role") == "user", "question_asked").otherwise("evidence_attached").alias("kind"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    asks, shows = F.col("kind") == "question_asked", F.col("kind") == "evidence_attached"
    name = lambda turn: F.concat(F.lit("c"), turn.cast("string"))
    first = rows.select("session_id", (t * 10).alias("place"), "kind", F.when(asks, F.col("h")).alias("text"), F.when(shows, F.array(F.concat(F.lit("r"), (t % 3).cast("string")))).alias("refs"), F.when(asks, name(t)).when(shows, name(t - 1)).alias("command_id"), F.lit("h").alias("command_hash"))
    again = lambda add, every, rest, digest: rows.filter(asks & (t % every == rest)).select("session_id", (t * 10 + add).alias("place"), "kind", F.col("h").alias("text"), F.lit(None).cast("array<string>").alias("refs"), name(t).alias("command_id"), F.lit(digest).alias("command_hash"))
    found = sessions.answered(first.unionByName(again(1, 5, 0, "h")).unionByName(again(2, 7, 2, "other")))
    return found.select("session_id", "place", "outcome", "sequence", "event_hash")
