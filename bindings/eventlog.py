"""Action-log bindings: a session is a user, an operation an event type, order is time."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.tables import table
from tidemark.operators import eventlog as ev
from tidemark.operators.ordering import ordered_positions

STEPS = ["signup", "view", "click", "purchase"]
LONG_WALK = STEPS + ["view", "click", "error", "view", "purchase"]
ORDER = ["ts", "event_id"]
FLOOR = 12


def log(spark, sf):
    return table(spark, sf, "events").withColumn("accepted", F.col("value") >= FLOOR)


LOG_SQL = f"log AS (SELECT *, value >= {FLOOR} AS accepted FROM events)"


def funnel(spark, sf):
    accepted = log(spark, sf).filter("accepted")
    return ev.funnel_progress(accepted, STEPS, "user_id", "event_type", ORDER)


def _funnel_sql(steps):
    """One CTE per step: the earliest matching event after the previous one."""
    parts = [f"""s1 AS (SELECT user_id, min(row(ts, event_id)) AS at FROM chosen
               WHERE event_type = '{steps[0]}' GROUP BY 1)"""]
    for i, step in enumerate(steps[1:], start=2):
        parts.append(
            f"""s{i} AS (SELECT c.user_id, min(row(ts, event_id)) AS at FROM chosen c JOIN s{i - 1} p
            ON c.user_id = p.user_id WHERE event_type = '{step}' AND row(ts, event_id) > p.at GROUP BY 1)"""
        )
    reached = " + ".join(f"CASE WHEN s{i}.user_id IS NULL THEN 0 ELSE 1 END" for i in range(1, len(steps) + 1))
    joins = " ".join(f"LEFT JOIN s{i} ON s{i}.user_id = u.user_id" for i in range(1, len(steps) + 1))
    return f"""{", ".join(parts)}
SELECT u.user_id, CAST({reached} AS INTEGER) AS steps_reached, {reached} = {len(steps)} AS complete
FROM (SELECT DISTINCT user_id FROM chosen) u {joins}"""


FUNNEL = f"WITH {LOG_SQL}, chosen AS (SELECT * FROM log WHERE accepted), {_funnel_sql(STEPS)}"


def long_funnel(spark, sf):
    rows = log(spark, sf).withColumn("user_id", F.col("user_id") * 10 + F.dayofmonth("ts") % 10)
    return ev.funnel_progress(rows, LONG_WALK, "user_id", "event_type", ORDER)


LONG_FUNNEL = f"""WITH chosen AS (
  SELECT ts, event_id, event_type, user_id * 10 + day(ts) % 10 AS user_id FROM events),
{_funnel_sql(LONG_WALK)}"""


def recovery_chain(spark, sf):
    """A refused error, then an accepted view, then an accepted purchase above a floor."""
    chain = {
        "fired": ~F.col("accepted") & (F.col("event_type") == "error"),
        "diagnosed": F.col("accepted") & (F.col("event_type") == "view"),
        "cleared": F.col("accepted") & (F.col("event_type") == "purchase") & (F.col("value") > 20),
    }
    out = ev.event_after(log(spark, sf), "user_id", ORDER, chain)
    return out.select("user_id", *[F.col(f"{c}.event_id").alias(c) for c in chain])


RECOVERY_CHAIN = f"""WITH {LOG_SQL},
a AS (SELECT user_id, min(row(ts, event_id)) AS at FROM log WHERE NOT accepted AND event_type = 'error' GROUP BY 1),
b AS (SELECT l.user_id, min(row(ts, event_id)) AS at FROM log l JOIN a USING (user_id)
      WHERE accepted AND event_type = 'view' AND row(ts, event_id) >= a.at GROUP BY 1),
c AS (SELECT l.user_id, min(row(ts, event_id)) AS at FROM log l JOIN b USING (user_id)
      WHERE accepted AND event_type = 'purchase' AND value > 20 AND row(ts, event_id) >= b.at GROUP BY 1)
SELECT u.user_id, a.at[2] AS fired, b.at[2] AS diagnosed, c.at[2] AS cleared
FROM (SELECT DISTINCT user_id FROM log) u LEFT JOIN a USING (user_id) LEFT JOIN b USING (user_id) LEFT JOIN c USING (user_id)"""


def session_flags(spark, sf):
    kind = F.col("event_type")
    return ev.flags(
        log(spark, sf),
        "user_id",
        {
            "dirty": (kind == "error") & (F.col("value") > 30),
            "diagnosed": (kind == "view") & F.col("accepted"),
            "recovered": (kind == "purchase") & (F.col("value") > 60),
        },
    )


SESSION_FLAGS = f"""WITH {LOG_SQL}
SELECT user_id, bool_or(event_type = 'error' AND value > 30) AS dirty,
  bool_or(event_type = 'view' AND accepted) AS diagnosed,
  bool_or(event_type = 'purchase' AND value > 60) AS recovered FROM log GROUP BY 1"""


def depth_floors(spark, sf):
    return ev.depth_floors(
        log(spark, sf), "user_id", F.col("accepted"), F.col("event_type").isin("view", "click"),
        F.get_json_object("props", "$.k"), 25, 10, 10,
    )


DEPTH_FLOORS = f"""WITH {LOG_SQL}, d AS (
  SELECT user_id, count(*) FILTER (accepted) AS accepted,
    count(*) FILTER (accepted AND event_type IN ('view', 'click')) AS observations,
    count(DISTINCT CASE WHEN accepted AND event_type IN ('view', 'click') THEN props ->> '$.k' END) AS observation_kinds
  FROM log GROUP BY 1)
SELECT *, accepted >= 25 AND observations >= 10 AND observation_kinds >= 10 AS deep_enough FROM d"""


def prefix_sequence(spark, sf):
    by_day = log(spark, sf).withColumn("session", F.concat_ws("-", "user_id", F.dayofmonth("ts").cast("string")))
    return ev.prefix_sequence(by_day, "session", "event_type", ORDER, ["view", "click"])


PREFIX_SEQUENCE = """SELECT session, coalesce(list(event_type ORDER BY n) = ['view', 'click'], false) AS matches FROM (
  SELECT user_id || '-' || day(ts) AS session, event_type,
    row_number() OVER (PARTITION BY user_id, day(ts) ORDER BY ts, event_id) AS n FROM events)
WHERE n <= 2 GROUP BY 1"""


def sequence_continuity(spark, sf):
    """Positions of a session; every seventh session has lost one row."""
    placed = ordered_positions(log(spark, sf), ["user_id"], [F.col(c) for c in ORDER], "seq")
    kept = placed.filter(~((F.col("user_id") % 7 == 0) & (F.col("seq") == 3)))
    return ev.sequence_continuity(kept, "user_id", "seq")


SEQUENCE_CONTINUITY = """SELECT user_id, count(*) AS n, count(*) = max(seq) AS continuous FROM (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)
WHERE NOT (user_id % 7 = 0 AND seq = 3) GROUP BY 1"""


def running_budget(spark, sf):
    out = ev.running_budget(log(spark, sf), "user_id", ORDER, F.col("event_type") == "click", 6)
    return out.select("event_id", "user_id", "attempts", "remaining", "over_limit")


RUNNING_BUDGET = """SELECT event_id, user_id, attempts, greatest(6 - attempts, 0) AS remaining,
  event_type = 'click' AND attempts > 6 AS over_limit FROM (
  SELECT *, count(*) FILTER (event_type = 'click') OVER (PARTITION BY user_id ORDER BY ts, event_id
    ROWS UNBOUNDED PRECEDING) AS attempts FROM events)"""


def best_so_far(spark, sf):
    rows = log(spark, sf).withColumn("bars", F.floor("value").cast("long"))
    return ev.best_so_far(rows, "user_id", ["accepted", "bars"], ["event_id"])


BEST_SO_FAR = f"""WITH {LOG_SQL}
SELECT user_id, accepted, bars, event_id FROM (
  SELECT user_id, accepted, CAST(floor(value) AS BIGINT) AS bars, event_id,
    row_number() OVER (PARTITION BY user_id ORDER BY accepted DESC, floor(value) DESC, event_id) AS n FROM log) WHERE n = 1"""


def latest_state(spark, sf):
    return ev.latest_state(log(spark, sf), ["user_id", "event_type"], ["value", "accepted"], ORDER)


LATEST_STATE = f"""WITH {LOG_SQL}
SELECT user_id, event_type, value, accepted FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM log) WHERE n = 1"""


def partial_scores(spark, sf):
    flags = session_flags(spark, sf)
    score = ev.partial_score(
        [(F.col("dirty"), 0.25), (F.col("diagnosed"), 0.5), (F.col("recovered"), 0.5)], cap=1.0
    )
    return flags.select("user_id", score.alias("score"))


PARTIAL_SCORES = f"""SELECT user_id, least(1.0::DOUBLE, CASE WHEN dirty THEN 0.25 ELSE 0 END
  + CASE WHEN diagnosed THEN 0.5 ELSE 0 END + CASE WHEN recovered THEN 0.5 ELSE 0 END)::DOUBLE AS score
FROM ({SESSION_FLAGS})"""

BOUND = {
    "funnel_progress": (funnel, FUNNEL),
    "long_funnel": (long_funnel, LONG_FUNNEL),
    "recovery_chain": (recovery_chain, RECOVERY_CHAIN),
    "session_flags": (session_flags, SESSION_FLAGS),
    "depth_floors": (depth_floors, DEPTH_FLOORS),
    "prefix_sequence": (prefix_sequence, PREFIX_SEQUENCE),
    "sequence_continuity": (sequence_continuity, SEQUENCE_CONTINUITY),
    "running_budget": (running_budget, RUNNING_BUDGET),
    "best_so_far": (best_so_far, BEST_SO_FAR),
    "latest_state": (latest_state, LATEST_STATE),
    "partial_scores": (partial_scores, PARTIAL_SCORES),
}
