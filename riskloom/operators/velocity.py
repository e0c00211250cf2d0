"""Transaction velocity features (V1-V5), batch form.

V1 trailing-window counts / sums are heads, whole slices and tails of time slices, added up. V5
sessions use *halo buckets*: time is cut into buckets; every event is placed in its own
bucket and copied once into the next one, so an (account, bucket) group holds everything
that a session reaching into that bucket can see. Either way a busy account is split
across many tasks instead of one partition holding its whole history.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.exprs import nan_to_null

US = 1_000_000
SLICE_S = 3_600
WINDOWS = {"24h": 86_400, "7d": 7 * 86_400, "30d": 30 * 86_400}


def _micros(ts: str):
    """Microseconds since the epoch of a TIMESTAMP_NTZ, independent of the session time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")


def trailing_windows(df: DataFrame, key: str, ts: str, value: str, windows: dict[str, int],
                     id_col: str = "transaction_id", slice_s: int = SLICE_S) -> DataFrame:
    """Per event: count and sum of the same account's events with ts in [t - width, t], for every width.

    Nothing is ever subtracted, so a NaN (read as NULL), an infinity or an amount of 1e17 touches no window that it is not in.
    Time is cut into slices that divide every width. What [t - width, t] holds is the head of the slice of t up to t, the whole
    slices before it, and the tail of the slice of t - width. Each event puts, for each width, a copy into the slice of t + width: there
    the tails are running sums in falling order of time, as the heads are in rising order, and both are in one (account, slice)
    group. Whole slices are summed over a table with one row for each active slice of an account. The work is linear in the
    events, and a busy account is spread over its slices. Events without a time see each other, as in SQL.
    """
    step = gcd(slice_s, *windows.values()) * US
    us, amount = _micros(ts), nan_to_null(F.col(value).cast("double"))
    own = F.struct(us.alias("__us"), F.lit("").alias("__name"))
    copies = [F.struct((us + w * US).alias("__us"), F.lit(name).alias("__name")) for name, w in windows.items()]
    rows = df.select(key, id_col, ts, amount.alias(value), F.explode(F.when(us.isNull(), F.array(own)).otherwise(F.array(own, *copies))).alias("r"))
    rows = rows.select(key, id_col, ts, value, "r.*").withColumn("__slice", F.floor(F.col("__us") / step))
    parts = {"n": F.lit(1).cast("long"), "known": F.col(value).isNotNull().cast("long"), "amt": F.coalesce(value, F.lit(0.0))}
    group = Window.partitionBy(key, "__slice")
    # in both orders, all events of the same instant are in
    heads = group.orderBy("__us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tails = group.orderBy(F.desc("__us")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    of = lambda name, c: F.sum(F.when(F.col("__name") == name, c))
    ends = [of(name, e).over(heads if not name else tails).alias(f"__{c}_{name}") for c, e in parts.items() for name in ("", *windows)]
    rows = rows.select(key, id_col, ts, value, "__name", "__slice", *ends).where(F.col("__name") == "").drop("__name")
    slices = df.select(F.col(key).alias("__key"), F.floor(us / step).alias("__at"), amount.alias(value)).where(F.col("__at").isNotNull())
    slices = slices.groupBy("__key", "__at").agg(*[F.sum(e).alias(c) for c, e in parts.items()])
    between = {name: Window.partitionBy("__key").orderBy("__at").rangeBetween(1 - w * US // step, -1) for name, w in windows.items()}
    slices = slices.select("__key", "__at", *[F.sum(c).over(between[name]).alias(f"__m_{c}_{name}") for c in parts for name in windows if windows[name] * US > step])
    rows = rows.join(slices, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__slice") == F.col("__at")), "left")
    out = []
    for name, w in windows.items():
        middle = [f"__m_{{}}_{name}"] if w * US > step else []
        total = lambda c: sum((F.coalesce(F.col(p.format(c)), F.lit(0)) for p in (*middle, f"__{{}}_{name}")), F.col(f"__{c}_"))  # noqa: B023, E731
        out += [total("n").alias(f"cnt_{name}"), F.when(total("known") > 0, total("amt")).alias(f"sum_{name}")]
    return rows.select(key, id_col, ts, value, *out)


def velocity_features(tx: DataFrame, key: str = "account_id", ts: str = "ts", value: str = "amount",
                      windows: dict[str, int] = WINDOWS) -> DataFrame:
    """V1: trailing 24h / 7d / 30d counts and sums per transaction."""
    return trailing_windows(tx, key, ts, value, windows)


def in_out_ratio(tx: DataFrame, key: str = "account_id", ts: str = "ts", unit: str = "day") -> DataFrame:
    """V2: per account and window, inflow (purchases), outflow (other events), out/in ratio."""
    inflow = F.sum(F.when(F.col("type") == "purchase", F.col("amount")).otherwise(0.0))
    outflow = F.sum(F.when(F.col("type") != "purchase", F.col("amount")).otherwise(0.0))
    return (tx.groupBy(key, F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias("window_start"))
            .agg(inflow.alias("inflow"), outflow.alias("outflow"))
            .withColumn("out_in_ratio", F.try_divide(F.col("outflow"), F.col("inflow"))))


def first_activity_delay(accounts: DataFrame, tx: DataFrame, key: str = "account_id",
                         created: str = "first_order", ts: str = "ts") -> DataFrame:
    """V3: days from account creation to its first transaction (accounts with activity)."""
    first = tx.groupBy(key).agg(F.min(ts).alias("first_tx"))
    return (accounts.select(key, created).join(first, key)
            .select(key, created, "first_tx",
                    F.datediff(F.to_date("first_tx"), F.to_date(created)).alias("delay_days")))


def tumbling_counts(tx: DataFrame, ts: str = "ts", unit: str = "day") -> DataFrame:
    """V4 batch twin: event counts and value per (day, type)."""
    return (tx.groupBy(F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz").alias("window_start"), "type")
            .agg(F.count(F.lit(1)).alias("n_events"), F.sum("amount").alias("total_amount")))


def sessions(tx: DataFrame, key: str = "account_id", ts: str = "ts", gap_s: int = 1800,
             bucket_s: int = 86_400, id_col: str = "transaction_id") -> DataFrame:
    """V5: activity sessions (an event starts a new session when the account's previous
    event is >= gap earlier); end = last event + gap, as Spark's session windows.

    Skew-safe: whether an event has a predecessor within the gap only needs the
    same or the previous time bucket (bucket >= gap), so events are copied into the
    next bucket (halo) and the check runs per (account, bucket). Session numbers are
    running counts of session starts: per (account, bucket) counts give offsets
    over a table with one row per active bucket, then a running count inside each
    bucket. The final grouping by (account, session) uses partial aggregation."""
    us = _micros(ts)
    g_us, b_us = gap_s * US, bucket_s * US
    x = tx.select(key, id_col, ts, "amount", us.alias("__us")).withColumn("__b", F.floor(F.col("__us") / b_us))
    halo = F.explode(F.array(F.struct(F.col("__b").alias("b"), F.lit(0).alias("role")),
                             F.struct((F.col("__b") + 1).alias("b"), F.lit(1).alias("role"))))
    y = x.select("*", halo.alias("__h")).select(key, id_col, ts, "amount", "__us", "__h.b", "__h.role")
    # previous event (home or halo copy) strictly before this one in (time, id) order
    w_prev = Window.partitionBy(key, "b").orderBy("__us", id_col)
    y = y.withColumn("__prev", F.lag("__us").over(w_prev)).filter(F.col("role") == 0)
    y = y.withColumn("__start", (F.col("__prev").isNull() | (F.col("__us") - F.col("__prev") >= g_us)).cast("int"))
    per_b = y.groupBy(key, "b").agg(F.sum("__start").alias("__n"))
    w_off = Window.partitionBy(key).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # one row per active bucket
    offs = per_b.select(key, "b", F.coalesce(F.sum("__n").over(w_off), F.lit(0)).alias("__off"))
    w_run = Window.partitionBy(key, "b").orderBy("__us", id_col).rowsBetween(Window.unboundedPreceding, 0)
    y = (y.join(offs, [key, "b"]).withColumn("__sid", F.col("__off") + F.sum("__start").over(w_run)))
    s = y.groupBy(key, "__sid").agg(F.min(ts).alias("session_start"), F.max(ts).alias("__last"),
                                    F.count(F.lit(1)).alias("n_events"), F.sum("amount").alias("total_amount"))
    return s.select(key, "session_start",
                    (F.col("__last") + F.expr(f"INTERVAL {gap_s} SECONDS")).alias("session_end"),
                    "n_events", "total_amount")


def sessions_window(tx: DataFrame, key: str = "account_id", ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    """V5 with Spark's session windows (the streaming operator; clusters by account)."""
    s = tx.groupBy(key, F.session_window(F.col(ts), gap).alias("sw")).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum("amount").alias("total_amount"))
    return s.select(key, F.col("sw.start").alias("session_start"), F.col("sw.end").alias("session_end"),
                    "n_events", "total_amount")
