"""State over time: repeats within their time to live, cooling hosts, retention, resuming.

Each has a batch form and, where it makes sense, a stream form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from vouch.session import staged


#: Rows of a key that are folded in one row; the times of a key with more are followed by pointers. Slices of a time to live.
LIGHT, SLICES = 4096, 64


def fresh_requests(rows: DataFrame, hours: int, light: int = LIGHT) -> DataFrame:
    """rows (key, ts) that had to be answered anew: a kept row serves its key for some hours, then the next one is kept.

    A null key is a key like others; rows without ts are left out, repeats count
    once. A key of few rows is folded in its own row; one of many is work for
    many tasks. Both give the same rows.
    """
    rows = rows.select("key", "ts").where(F.col("ts").isNotNull())
    hot = staged(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > light).select(F.col("key").alias("_hot")), "hot_keys")
    folded = rows if hot.isEmpty() else rows.join(hot, F.col("key").eqNullSafe(F.col("_hot")), "left_anti")
    times = folded.groupBy("key").agg(F.sort_array(F.collect_set("ts")).alias("ts"))
    start = F.array().cast("array<timestamp>")
    expires = F.expr(f"INTERVAL {int(hours)} HOURS")
    kept = F.aggregate("ts", start, lambda held, t: F.when((F.size(held) == 0) | (t >= F.try_element_at(held, F.lit(-1)) + expires), F.concat(held, F.array(t))).otherwise(held))
    out = times.select("key", F.explode(kept).alias("ts"))
    if folded is rows:
        return out
    heavy = rows.join(hot, F.col("key").eqNullSafe(F.col("_hot")), "left_semi").distinct()
    return out.unionByName(kept_by_pointers(heavy, hours))


def next_kept(times: DataFrame, hours: int) -> DataFrame:
    """times (key, ts) with the time `next` that is kept after a row, were it kept: its key's first at or past the end of its time to live.

    Each end is looked for in its slice of time, else it is the first time of a
    later slice, so what meets in one task is a slice's rows, or a row a slice.
    """
    expires, width = F.expr(f"INTERVAL {int(hours)} HOURS"), int(hours) * 3_600_000_000 // SLICES
    ends = times.select("key", "ts", (F.col("ts") + expires).alias("_at"), F.lit(None).cast("timestamp").alias("_real"))
    points = times.select("key", "ts", F.col("ts").alias("_at"), F.col("ts").alias("_real")).unionByName(ends)
    points = points.withColumn("_slice", F.expr(f"unix_micros(_at) div {width}"))
    after = Window.partitionBy("key").orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = points.groupBy("key", "_slice").agg(F.min("_real").alias("_first"))
    later = firsts.select(F.col("key").alias("_key"), F.col("_slice").alias("_s"), F.last("_first", ignorenulls=True).over(after).alias("_later"))
    # Latest first; of equal moments the time itself comes before an end, which it still serves.
    within = Window.partitionBy("key", "_slice").orderBy(F.desc("_at"), F.desc_nulls_last("_real")).rowsBetween(Window.unboundedPreceding, 0)
    found = points.withColumn("_own", F.last("_real", ignorenulls=True).over(within)).where("_real is null")
    found = found.join(later, F.col("key").eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_s")))
    return found.select("key", "ts", F.coalesce("_own", "_later").alias("next")).where("next is not null")


def kept_by_pointers(times: DataFrame, hours: int) -> DataFrame:
    """The kept of some distinct times (key, ts): pointers of twice the length each round, so n kept times of a key take log2(n) rounds.

    Rows are joined by key and time together, which no two rows share: a key
    with a third of all rows is spread like any other.
    """
    ahead = staged(next_kept(staged(times, "times"), hours), "next_kept")
    last = staged(times.groupBy("key").agg(F.min("ts").alias("ts")), "first_kept")
    out = last
    while True:
        a, b = ahead.alias("a"), ahead.select(F.col("key").alias("_key"), F.col("ts").alias("_ts"), F.col("next").alias("_next"))
        reached = out.join(b, F.col("key").eqNullSafe(F.col("_key")) & (F.col("ts") == F.col("_ts")))
        last = staged(reached.select("key", F.col("_next").alias("ts")), "kept")
        if last.isEmpty():
            return out
        out = out.unionByName(last)
        ahead = staged(a.join(b, F.col("a.key").eqNullSafe(F.col("_key")) & (F.col("a.next") == F.col("_ts"))).select("a.key", "a.ts", F.col("_next").alias("next")), "twice_ahead")


def fresh_stream(stream: DataFrame, hours: int, late: str = "1 hour") -> DataFrame:
    """The stream form: one state value a key, the time of its last kept row; a kept row starts the time to live anew.

    Rows of a key within one batch are taken in order of ts, a row later than
    `late` behind the newest is dropped, and a key's state goes when the
    watermark is past its time to live. On a log in order it keeps the rows that
    fresh_requests does. Rows without key or ts are dropped. Needs the RocksDB
    state store.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    span = int(hours) * 3_600_000  # milliseconds

    class Fresh(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle, self.last = handle, handle.getValueState("last", "micros long")

        def handleInputRows(self, key, rows, timerValues):
            held = self.last.get()[0] if self.last.exists() else None
            before, kept = held, []
            for t in sorted({int(t) for frame in rows for t in frame["micros"]}):
                if held is None or t >= held + 1000 * span:
                    kept.append(t)
                    held = t
            if held != before:
                if before is not None:
                    self.handle.deleteTimer(before // 1000 + span + 1)
                self.last.update((held,))
                self.handle.registerTimer(held // 1000 + span + 1)
            yield pd.DataFrame({"key": [key[0]] * len(kept), "micros": pd.Series(kept, dtype="int64")})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.last.clear()
            yield pd.DataFrame({"key": pd.Series([], dtype="object"), "micros": pd.Series([], dtype="int64")})

        def close(self) -> None:
            pass

    rows = stream.select("key", "ts").where("key is not null and ts is not null").withWatermark("ts", late).withColumn("micros", F.unix_micros("ts"))
    kind = stream.schema["key"].dataType.simpleString()
    kept = rows.groupBy("key").transformWithStateInPandas(Fresh(), f"key {kind}, micros long", "Append", "EventTime")
    return kept.select("key", F.timestamp_micros("micros").alias("ts"))


def cooldown_seconds(retry_after: Column, ts: Column, default: int = 900, least: int = 60, most: int = 21_600) -> Column:
    """Seconds that a host asks to be left alone: a number, or an HTTP date, within bounds."""
    text = F.trim(F.coalesce(retry_after, F.lit("")))
    number = F.when(text.rlike(r"^\d+$"), text.try_cast("double"))
    date = F.try_to_timestamp(F.substring(text, 6, 20), F.lit("dd MMM yyyy HH:mm:ss"))
    ahead = F.unix_timestamp(date) - F.unix_timestamp(ts)
    return F.least(F.greatest(F.coalesce(number, ahead, F.lit(float(default))), F.lit(float(least))), F.lit(float(most)))


#: The slices of time of a host's log.
SLICE = "hour"


def host_cooldown(log: DataFrame) -> DataFrame:
    """log (host, ts, status, retry_after) with cooling_until before each fetch and whether the fetch falls in it.

    A later 429 or 503 sets the end anew, even to an earlier time. A host's log
    is cut into slices of time, so a host that holds a third of all fetches is
    work for many tasks; only a row a slice meets in one. A fetch without a host
    is never blocked.
    """
    until = F.when(F.col("status").isin(429, 503), F.timestamp_seconds(F.unix_timestamp("ts") + cooldown_seconds(F.col("retry_after"), F.col("ts"))))
    order = ["ts", *[c for c in ("event_id",) if c in log.columns]]
    rows = log.withColumns({"_until": until, "_slice": F.date_trunc(SLICE, "ts")})
    # Within a slice of time the last end is found there; a slice's own last end goes on to later slices of its host.
    ends = rows.where("_until is not null").groupBy("host", "_slice").agg(F.max_by("_until", F.struct(*order)).alias("_last"))
    slices = rows.select("host", "_slice").distinct().join(ends, ["host", "_slice"], "left")
    earlier = Window.partitionBy("host").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select(F.col("host").alias("_host"), F.col("_slice").alias("_s"), F.last("_last", ignorenulls=True).over(earlier).alias("_carried")).where("_carried is not null")
    within = Window.partitionBy("host", "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_own", F.when(F.col("host").isNotNull(), F.last("_until", ignorenulls=True).over(within)))
    rows = rows.join(carried, (F.col("host") == F.col("_host")) & (F.col("_slice") == F.col("_s")), "left")
    rows = rows.withColumn("cooling_until", F.coalesce("_own", "_carried"))
    return rows.withColumn("blocked", F.coalesce(F.col("cooling_until") > F.col("ts"), F.lit(False))).select(*log.columns, "cooling_until", "blocked")


def cooldown_stream(stream: DataFrame) -> DataFrame:
    """The stream form of host_cooldown: one state value a host, gone when the watermark is past its end.

    Rows of a host within one batch are taken in order of ts; a row later than
    the watermark is dropped. Needs the RocksDB state store.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Cooling(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle, self.until = handle, handle.getValueState("until", "seconds double")

        def handleInputRows(self, key, rows, timerValues):
            before = until = self.until.get()[0] if self.until.exists() else None
            frames = [frame[["ts", "status", "wait"]] for frame in rows]  # of one host and micro-batch, without texts
            out = []
            for ts, status, wait in pd.concat(frames).sort_values("ts", kind="stable").itertuples(index=False):
                now = ts.timestamp()
                out.append((key[0], ts, int(status), until is not None and until > now))
                if status in (429, 503):
                    until = now + wait
            if until != before:
                if before is not None:
                    self.handle.deleteTimer(int(before * 1000) + 1)
                self.until.update((until,))
                self.handle.registerTimer(int(until * 1000) + 1)
            yield pd.DataFrame(out, columns=["host", "ts", "status", "blocked"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.until.clear()
            yield pd.DataFrame({"host": pd.Series([], dtype="object"), "ts": pd.Series([], dtype="datetime64[ns]"), "status": pd.Series([], dtype="int32"), "blocked": pd.Series([], dtype="bool")})

        def close(self) -> None:
            pass

    rows = stream.withColumn("wait", cooldown_seconds(F.col("retry_after"), F.col("ts"))).withWatermark("ts", "6 hours")
    return rows.groupBy("host").transformWithStateInPandas(Cooling(), "host string, ts timestamp, status int, blocked boolean", "Append", "EventTime")


def purged(rows: DataFrame, now: Column, days: int = 30, column: str = "created_at") -> DataFrame:
    """Rows not older than some days; with a column of dates as partitions this drops whole ones."""
    return rows.where(F.col(column) >= now - F.expr(f"INTERVAL {int(days)} DAYS"))


def live(cache: DataFrame, now: Column) -> DataFrame:
    """Cache rows that haven't expired."""
    return cache.where(F.col("expires_at") > now)


def fingerprint(rows: DataFrame, start: int | None = None, end: int | None = None) -> str:
    """What identifies an input and its range, whatever the order of its rows; only one row reaches the driver."""
    each = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in rows.columns]), 256)
    parts = [F.sum(F.conv(F.substring(each, i, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in (1, 9, 17, 25)]
    sums = rows.agg(F.count("*").alias("n"), *parts).select(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("n", "p1", "p9", "p17", "p25")], F.lit(str(start)), F.lit(str(end))), 256))
    return sums.first()[0]


def remaining(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Rows whose record_id has no result yet."""
    return rows.join(results.select("record_id").distinct(), "record_id", "left_anti")


def resume(rows: DataFrame, folder: str, work, start: int | None = None, end: int | None = None) -> DataFrame:
    """Run work on the rows without a result and append; a folder of another input or range is refused.

    Returns all results. A run that ends half way has appended nothing and is
    simply run again.
    """
    spark, own = rows.sparkSession, fingerprint(rows, start, end)
    try:
        known = spark.read.parquet(f"{folder}/input").first()[0]
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        spark.createDataFrame([(own,)], "fingerprint string").write.parquet(f"{folder}/input")
        known = own
    if known != own:
        raise ValueError("these results belong to another input or range; choose another folder")
    add_results(rows, folder, work)
    return spark.read.parquet(f"{folder}/results")


def add_results(rows: DataFrame, folder: str, work) -> None:
    """Append what work gives for the rows that have no result in the folder yet."""
    try:
        left = remaining(rows, rows.sparkSession.read.parquet(f"{folder}/results"))
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        left = rows
    if not left.isEmpty():
        work(left).write.mode("append").parquet(f"{folder}/results")


def resume_stream(rows: DataFrame, folder: str, work) -> DataStreamWriter:
    """Stream form of resume: every micro-batch runs work on its rows without a result; set a checkpoint and start it.

    A batch that is repeated after a loss finds the results it wrote and adds
    nothing twice. A record_id stands once in a batch, as in a CSV batch.
    """
    return rows.writeStream.foreachBatch(lambda batch, _: add_results(batch, folder, work))
