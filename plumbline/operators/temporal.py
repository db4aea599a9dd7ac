"""Per-user temporal features and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.scan import carried_rows, in_stretches, lagged, with_carried

DAY = 86400.0


def temporal_features(posts: DataFrame, *, user: str = "user_id", ts: str = "ts", order: str = "post_id", engagement: str = "score", recent: tuple[int, ...] = (7, 14, 30)) -> DataFrame:
    """Features of each user's posts in order of time.

    ``posts`` has ``sentiment``, ``toxicity`` and ``engagement``, whose nulls count as 0; slope and R² are those of engagement over
    the place. "Recent" means the last so many rows. Users with fewer than three posts get the defaults. Posts are scanned in
    stretches (``scan``) and aggregates are combined before they are shuffled, so a user may have any share of the posts.
    """
    columns, by = ["s", "sec", "toxicity"], ["sec", order]
    own = posts.select(
        user, F.col(order).alias(order), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("sec"),
        *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for n, c in (("s", "sentiment"), ("e", engagement), ("toxicity", "toxicity"))),
    )
    rows = in_stretches(own, user, by)
    rows = with_carried(rows, carried_rows(rows, user, by, columns, 2), user)
    back = {(c, n): lagged(c, user, by, n) for c, n in (("s", 1), ("s", 2), ("sec", 1), ("toxicity", 1))}
    place = F.coalesce("__base", F.lit(0)) + F.col("__local")
    total = F.coalesce("__total", F.count("*").over(Window.partitionBy("__range", user)))
    rows = rows.select(
        user, "s", "e", "toxicity", "sec",
        (place - 1).cast("double").alias("i"),
        (total - place + 1).alias("from_end"),
        (F.col("s") - back["s", 1]).alias("d1"),
        (F.col("s") - 2 * back["s", 1] + back["s", 2]).alias("d2"),
        (F.col("sec") - back["sec", 1]).alias("gap"),
        (F.col("toxicity") - back["toxicity", 1]).alias("dt"),
    )
    late = [x for n in recent for own in [F.when(F.col("from_end") <= n, F.col("s"))] for x in (F.avg(own).alias(f"mean_{n}"), F.stddev_pop(own).alias(f"std_{n}"))]
    out = rows.groupBy(user).agg(
        F.count("*").alias("n"),
        F.avg("d1").alias("velocity"),
        F.avg("d2").alias("acceleration"),
        F.regr_slope("e", "i").alias("slope"),
        F.when(F.stddev_pop("e") > 0, F.regr_r2("e", "i")).otherwise(1.0).alias("r2"),
        *late,
        F.avg("gap").alias("gap_mean"),
        F.stddev_samp("gap").alias("gap_std"),
        (-F.regr_slope("gap", "i")).alias("posting_acceleration"),
        F.avg("dt").alias("toxicity_trend"),
        F.max(F.when(F.col("from_end") <= 7, F.col("toxicity"))).alias("toxicity_peak"),
    )
    few = F.col("n") < 3
    default = {"gap_mean": DAY}
    names = [c for c in out.columns if c not in (user, "n")]
    return out.select(user, "n", *(F.when(few, F.lit(default.get(c, 0.0))).otherwise(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in names))


def smoothed(series: Column, alpha: float = 0.3) -> Column:
    """The last value of exponential smoothing over an array."""
    return F.aggregate(F.slice(series, 2, F.size(series)), F.get(series, F.lit(0)), lambda a, x: a * (1 - alpha) + x * alpha)


def forecast(series: DataFrame, *, key: str, value: str = "score", order: str = "i", steps: int = 7, threshold: float = 80.0) -> DataFrame:
    """A blend of smoothing and linear trend, ``steps`` ahead, clipped to 0 .. 100, with its trend, peak and confidence.

    Fewer than three values are too few: the last one is repeated, the trend is ``insufficient_data`` and the confidence 0. Where
    no forecast exceeds the last value there is no peak. A key's series is collected in order: give series of bounded length,
    such as one value per day.
    """
    rows = series.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).cast("double").alias("i"), F.col(value).cast("double").alias("v")))).alias("own"),
        F.regr_slope(value, order).alias("slope"),
        F.regr_intercept(value, order).alias("intercept"),
        F.stddev_pop(value).alias("std"),
        F.count("*").alias("n"),
        F.max(order).alias("last_i"),
    )
    level = smoothed(F.transform("own", lambda x: x["v"]))
    rows = rows.withColumns({"level": level, "last": F.element_at("own", -1)["v"], "slope": F.coalesce("slope", F.lit(0.0))})
    ahead = F.transform(
        F.sequence(F.lit(1), F.lit(steps)),
        lambda h: F.least(
            F.greatest(0.6 * (F.col("level") + F.col("slope") * h) + 0.4 * (F.coalesce("intercept", "level") + F.col("slope") * (F.col("last_i") + h)), F.lit(0.0)), F.lit(100.0)
        ),
    )
    few, slope = F.col("n") < 3, F.col("slope")
    rows = rows.withColumn("forecast", F.when(few, F.array_repeat("last", steps)).otherwise(ahead))
    trend = F.when(few, "insufficient_data").when(slope > 2, "accelerating").when(slope > 0.5, "increasing").when(slope < -2, "decelerating").when(slope < -0.5, "decreasing").otherwise("stable")
    peak = F.when(~few & (F.array_max("forecast") > F.col("last")), F.array_position("forecast", F.array_max("forecast")))
    sure = F.when(few, 0.0).otherwise(F.least(F.greatest(F.least(F.col("n") / 30, F.lit(1.0)) * (1 - F.col("std") / 50), F.lit(0.0)), F.lit(1.0)))
    crossing = F.array_position(F.transform("forecast", lambda x: x >= threshold), F.lit(True))
    return rows.select(key, "forecast", trend.alias("trend"), peak.cast("int").alias("peak_day"), sure.alias("confidence"), crossing.cast("int").alias("crossing"))
