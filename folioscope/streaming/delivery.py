"""Delivery of events: rules per row, the same on tables and on streams, and stateful operators for streams."""

from __future__ import annotations

import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupStateTimeout

from folioscope.plans.catalog import query, table

# Seconds a delivery may be old or early, bytes a body may have, silence allowed before giving up.
TOLERANCE, BODY = 300, 262144


def replay_state(received: Column, sent: Column) -> Column:
    """By the row's own two times, edge allowed; no watermark, which would drop rows unreported."""
    age = F.unix_timestamp(received) - F.unix_timestamp(sent)
    return F.when(age > TOLERANCE, "too old").when(age < -TOLERANCE, "from the future").otherwise("in time")


def verified(body: Column, sent: Column, header: Column, secret: str) -> Column:
    """Is any `v1=` of the header the HMAC-SHA256 of "sent.body"? Arrow batches; the secret stays in the closure."""

    @F.pandas_udf("boolean")
    def of(bodies: pd.Series, times: pd.Series, headers: pd.Series) -> pd.Series:
        def one(b, t, h):
            want = hmac.new(secret.encode(), f"{t}.{b or ''}".encode(), "sha256").hexdigest()
            given = [p[3:].strip() for p in (h or "").split(",") if p.strip().startswith("v1=") for p in [p.strip()]]
            return any(hmac.compare_digest(want, g) for g in given)

        return pd.Series([one(*x) for x in zip(bodies, times, headers)], dtype=bool)

    return of(body, sent, header)


def routed(rows: DataFrame) -> DataFrame:
    """rows(header, age, size, signed, seen) with the first rule that speaks against each, or `accept`."""
    status = (
        F.when(F.col("header").isNull(), "no header").when(~F.col("header").contains("v1="), "malformed")
        .when(F.abs("age") > TOLERANCE, "out of tolerance").when(F.col("size") > BODY, "too large")
        .when(~F.col("signed"), "mismatch").when(F.col("seen"), "duplicate").otherwise("accept")
    )
    return rows.withColumn("status", status)


def deduplicated(stream: DataFrame, delay: str = "60 days") -> DataFrame:
    """J3 on a stream(event_id, ts): one row per id. State is bounded by the delay, which must cover late deliveries."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def profile(stream: DataFrame) -> DataFrame:
    """Counts by type, for update or complete mode."""
    return stream.groupBy("event_type").agg(F.count("*").alias("n"))


def silences(stream: DataFrame, budget: Column, delay: str = "1 hour") -> DataFrame:
    """J6 on a stream(request_id, ts): sessions that end once nothing came for the row's own budget."""
    return stream.withWatermark("ts", delay).groupBy(F.session_window("ts", budget), "request_id").agg(F.count("*").alias("signs"))


def deadlines(stream: DataFrame, delay: str = "1 hour", memory_s: int = 86400) -> DataFrame:
    """J6 live, on a stream(request_id, ts, kind, budget_s): `answered` or `silent` per request, with the time.

    Any row but an `answer` is a sign of life and restarts the clock of its own budget. What comes after a request is
    settled is ignored; it is remembered as settled for ``memory_s``. A null budget counts as none: silent at once.
    """

    def settle(key, frames, state):
        until, settled = state.get if state.exists else (0, False)
        if state.hasTimedOut:
            if settled:
                state.remove()
                return
            done = ("silent", until)
        else:
            done, first = None, not state.exists
            signs = pd.concat(list(frames)).sort_values("ts", kind="stable")
            for ts, kind, budget in zip(signs["ts"], signs["kind"], signs["budget_s"].fillna(0)):
                now = ts.value // 1_000_000
                if settled or done:
                    break
                if not first and now > until:
                    done = ("silent", until)
                elif kind == "answer":
                    done = ("answered", now)
                else:
                    until, first = now + int(budget * 1000), False
        if done:
            settled, until = True, done[1]
        state.update((until, settled))
        wake = until + 1 + (memory_s * 1000 if settled else 0)
        state.setTimeoutTimestamp(max(wake, state.getCurrentWatermarkMs() + 1))
        if done:
            yield pd.DataFrame({"request_id": [key[0]], "outcome": [done[0]], "at_ms": [done[1]]})

    kind = stream.schema["request_id"].dataType.simpleString()
    rows = stream.select("request_id", "ts", "kind", F.col("budget_s").cast("double").alias("budget_s")).filter("request_id is not null and ts is not null")
    return rows.withWatermark("ts", delay).groupBy("request_id").applyInPandasWithState(
        settle, f"request_id {kind}, outcome string, at_ms long", "until long, settled boolean", "append", GroupStateTimeout.EventTimeTimeout
    )


def counted(results: DataFrame) -> DataFrame:
    """results(outcome, attention) observed as `progress`: done, and each in one of attention, skipped, converted."""
    odd, skipped = F.coalesce("attention", F.lit(False)), F.coalesce(F.col("outcome") == "skipped", F.lit(False))
    return results.observe(
        "progress", F.count("*").alias("done"), F.count_if(odd).alias("attention"),
        F.count_if(~odd & skipped).alias("skipped"), F.count_if(~odd & ~skipped).alias("converted"),
    )


class Progress(StreamingQueryListener):
    """Running totals of `counted` streams; ``beat`` gets them whenever another 25 are done."""

    def __init__(self, beat, every: int = 25):
        self.totals, self.beat, self.every = dict.fromkeys(("done", "attention", "skipped", "converted"), 0), beat, every

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get("progress")
        if row is not None:
            before = self.totals["done"] // self.every
            self.totals = {k: n + (row[k] or 0) for k, n in self.totals.items()}
            if self.totals["done"] // self.every > before:
                self.beat(dict(self.totals))

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


_SENT = "event_id % 700 - 350"


@query(f"""SELECT event_id, CASE WHEN {_SENT} > 300 THEN 'too old' WHEN {_SENT} < -300 THEN 'from the future' ELSE 'in time' END AS state FROM events""")
def j1_replay_window(spark, sf_dir):
    """J1 on events delivered some seconds after they were sent."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("sent"), F.expr(_SENT).alias("age"))
    received = F.timestamp_seconds(F.unix_timestamp("sent") + F.col("age"))
    return rows.select("event_id", replay_state(received, F.col("sent")).alias("state"))


@query("SELECT event_id, event_id % 3 <> 0 AS signed FROM events")
def j2_signatures(spark, sf_dir):
    """Headers with two signatures, one of them right, on two rows in three."""
    body, sent = F.col("props"), F.col("event_id").cast("string")

    @F.pandas_udf("string")
    def signed(bodies: pd.Series, times: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series(["v1=00, v1=" + hmac.new(k.encode(), f"{t}.{b or ''}".encode(), "sha256").hexdigest() for b, t, k in zip(bodies, times, keys)])

    key = F.when(F.col("event_id") % 3 == 0, "other").otherwise("secret")
    rows = table(spark, sf_dir, "events").select("event_id", "props", signed(body, sent, key).alias("header"))
    return rows.select("event_id", verified(body, sent, F.col("header"), "secret").alias("signed"))


@query("SELECT event_id // 3 AS id, min(event_id) AS first, count(*) AS deliveries FROM events GROUP BY ALL")
def j3_first_deliveries(spark, sf_dir):
    """J3, the batch form: an id delivered several times counts once."""
    return table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 3).alias("id")).agg(F.min("event_id").alias("first"), F.count("*").alias("deliveries"))


_ROUTE = """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 't=1' ELSE 't=1,v1=ab' END AS header, event_id % 800 - 400 AS age,
event_id % 300000 * 7 AS size, event_id % 17 <> 0 AS signed, event_id % 19 = 0 AS seen FROM events"""


@query(f"""SELECT event_id, CASE WHEN header IS NULL THEN 'no header' WHEN NOT contains(header, 'v1=') THEN 'malformed' WHEN abs(age) > 300 THEN 'out of tolerance' WHEN size > 262144 THEN 'too large'
WHEN NOT signed THEN 'mismatch' WHEN seen THEN 'duplicate' ELSE 'accept' END AS status FROM ({_ROUTE})""")
def j4_reject_order(spark, sf_dir):
    """J4 on deliveries made of events."""
    k = F.col("event_id")
    header = F.when(k % 11 == 0, None).when(k % 13 == 0, "t=1").otherwise("t=1,v1=ab")
    rows = table(spark, sf_dir, "events").select(
        "event_id", header.alias("header"), (k % 800 - 400).alias("age"), (k % 300000 * 7).alias("size"), (k % 17 != 0).alias("signed"), (k % 19 == 0).alias("seen")
    )
    return routed(rows).select("event_id", "status")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, count(*) AS signs, count(DISTINCT session) AS silences FROM s GROUP BY user_id""")
def j6_silences(spark, sf_dir):
    """J6, the batch form: signs of life of a user and how often 12 hours passed without one."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    sessions = rows.groupBy("user_id", F.session_window("ts", "12 hours")).agg(F.count("*").alias("n"))
    return sessions.groupBy("user_id").agg(F.sum("n").alias("signs"), F.count("*").alias("silences"))


@query("""SELECT o_orderkey // 1000 AS batch, count(*) AS done, count(*) FILTER (WHERE o_orderstatus = 'F') AS converted, count(*) // 25 AS heartbeats FROM orders GROUP BY ALL""")
def j8_progress(spark, sf_dir):
    """Done and converted per batch, with a heartbeat for each 25."""
    return table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 1000).alias("batch")).agg(
        F.count("*").alias("done"), F.count_if(F.col("o_orderstatus") == "F").alias("converted"), F.floor(F.count("*") / 25).alias("heartbeats")
    )


@query("SELECT doc_id, doc_id % 50 = 7 AS failed FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality = 1)")
def j11_retry(spark, sf_dir):
    """What a dead worker left undone, with the file itself (every fiftieth) marked failed."""
    done = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id").join(done, "doc_id", "left_anti")
    return rows.select("doc_id", (F.col("doc_id") % 50 == 7).alias("failed"))
