"""Behavioural login baseline per source address, judged before each login updates it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seclog.config import DAY_US, HOUR_US, SECOND_US, BaselineLimits, checked
from seclog.operators.scan import CHUNK, chunk_of


def logins(events: DataFrame) -> DataFrame:
    """Successful logins with the hour and the day (UTC) they fall in."""
    ok = (
        (F.col("kind") == "SSH_SUCCESS") & F.col("src_ip").isNotNull() & (F.col("user") != "")
    )
    us = F.col("us")
    return events.filter(ok).select(
        "event_id",
        "src_ip",
        "user",
        "us",
        (F.floor(us / HOUR_US) % 24).cast("int").alias("hour"),
        F.floor(us / DAY_US).alias("day"),
    )


def login_history(
    events: DataFrame, limits: BaselineLimits = BaselineLimits(), known: DataFrame | None = None
) -> DataFrame:
    """Every login with what was known about its address before it.

    ``known`` is what ``login_state`` holds of logins in earlier hours.

    Time is cut into clock hours, so all logins of a chunk share hour and day:
    what an address brings into a chunk (``_carried``) is one row, and only
    what is known of a user is one row per user. Everything else is counted
    inside the chunk. ``usual_mask`` has bit h set once hour h was seen twice.
    """
    checked(limits)
    rows = logins(events).withColumn(CHUNK, chunk_of(F.col("us"), HOUR_US))
    users = _with_user_before(_per_user(rows, known))
    here = Window.partitionBy("src_ip", CHUNK).orderBy("us", "event_id")
    same_user = Window.partitionBy("src_ip", CHUNK, "user").orderBy("us", "event_id")
    counted = (
        rows.join(users.select("src_ip", "user", CHUNK, "user_before"), ["src_ip", "user", CHUNK])
        .select(
            "*",
            (F.row_number().over(here) - 1).cast("long").alias("n_here"),
            (F.col("user_before") + F.row_number().over(same_user) - 1).alias("user_prior"),
            F.lag("us").over(here).alias("us_here"),
        )
        .withColumn(
            "users_here",
            F.coalesce(
                F.sum(F.when(F.col("user_prior") == 0, 1)).over(
                    here.rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
    )
    n_here, hour_prior = F.col("n_here"), F.col("hour_before") + F.col("n_here")
    turned = (F.col("hour_before") < 2) & (hour_prior >= 2)

    def of_previous(own: Column, carried: str) -> Column:
        return F.when(n_here > 0, own).otherwise(F.coalesce(f"previous.{carried}", F.lit(0)))

    return counted.join(_carried(users, limits), ["src_ip", CHUNK]).select(
        "event_id",
        "src_ip",
        "user",
        "us",
        "hour",
        (F.col("prior_before") + n_here).alias("prior"),
        hour_prior.alias("hour_prior"),
        "user_prior",
        F.when(turned, F.col("mask_before").bitwiseOR(_bit(F.col("hour"))))
        .otherwise(F.col("mask_before"))
        .alias("usual_mask"),
        (F.col("users_before") + F.col("users_here")).alias("known_users"),
        F.coalesce("us_here", "previous.us").alias("previous_us"),
        of_previous(F.col("day_before") + n_here, "n").alias("today_count"),
        of_previous(F.col("earlier_days"), "earlier_days").alias("earlier_days"),
        of_previous(F.col("earlier_logins"), "earlier_logins").alias("earlier_logins"),
    )


def _bit(hour: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), hour)


def _sum_before(value: Column, *keys: str) -> Column:
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(before), F.lit(0))


STATE = ("src_ip", "user", CHUNK, "n", "first_us", "last_us")
#: Stands for all days before the last active ones.
_LONG_AGO = -1_000_000


def _per_user(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Logins per (address, user, chunk)."""
    us = F.col("us")
    counted = rows.groupBy("src_ip", "user", CHUNK).agg(
        F.count(F.lit(1)).alias("n"), F.min(us).alias("first_us"), F.max(us).alias("last_us")
    )
    return counted if known is None else _merged(counted.unionByName(known.select(*STATE)))


def _merged(states: DataFrame) -> DataFrame:
    return states.groupBy("src_ip", "user", CHUNK).agg(
        F.sum("n").alias("n"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us")
    )


def _with_user_before(users: DataFrame) -> DataFrame:
    """With the user's logins in earlier chunks."""
    return users.withColumn("user_before", _sum_before(F.col("n"), "src_ip", "user"))


def login_state(
    events: DataFrame, limits: BaselineLimits = BaselineLimits(), known: DataFrame | None = None
) -> DataFrame:
    """What later logins are judged by, mergeable: logins per (address, user, hour of a day).

    Days before the last ``active_days`` with logins of an address only count by their hour, so they are folded
    into one: an address has at most 24 * (active_days + 1) rows a user, whatever its history.
    """
    rows = logins(events).withColumn(CHUNK, chunk_of(F.col("us"), HOUR_US))
    users = _per_user(rows, known)
    day = F.floor(F.col(CHUNK) / 24)
    days = users.select("src_ip", day.alias("__day")).distinct()
    recent = Window.partitionBy("src_ip").orderBy(F.desc("__day"))
    first = days.withColumn("__no", F.row_number().over(recent)).filter(F.col("__no") <= limits.active_days)
    kept = users.join(first.groupBy("src_ip").agg(F.min("__day").alias("__from")), "src_ip")
    folded = F.lit(24 * _LONG_AGO).cast("long") + F.pmod(F.col(CHUNK), F.lit(24))
    chunk = F.when(day >= F.col("__from"), F.col(CHUNK)).otherwise(folded)
    return _merged(kept.withColumn(CHUNK, chunk).drop("__from")).select(*STATE)


def profiles_of_state(state: DataFrame) -> DataFrame:
    """The profiles of ``login_profiles`` (without anomalies) from the state of a stream."""
    hour = F.pmod(F.col(CHUNK), F.lit(24)).cast("int")
    hourly = state.groupBy("src_ip", hour.alias("hour")).agg(
        F.sum("n").alias("n"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us")
    )
    users = state.groupBy("src_ip", "user").agg(F.lit(1).alias("one")).groupBy("src_ip").agg(F.count("*").alias("known_users"))
    return _profile(hourly).join(users, "src_ip")


def _carried(users: DataFrame, limits: BaselineLimits) -> DataFrame:
    """What an address brings into each of its chunks, one row per hour with logins."""
    hours = (
        users.groupBy("src_ip", CHUNK)
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("user_before") == 0, 1).otherwise(0)).alias("new_users"),
            F.max("last_us").alias("last_us"),
        )
        .withColumn("__hour", F.pmod(F.col(CHUNK), F.lit(24)).cast("int"))
        .withColumn("__day", F.floor(F.col(CHUNK) / 24))
        .withColumn("hour_before", _sum_before(F.col("n"), "src_ip", "__hour"))
        .withColumn("day_before", _sum_before(F.col("n"), "src_ip", "__day"))
        .withColumn("day_no", F.dense_rank().over(Window.partitionBy("src_ip").orderBy("__day")))
    )
    turns_usual = F.when(
        (F.col("hour_before") < 2) & (F.col("hour_before") + F.col("n") >= 2), _bit(F.col("__hour"))
    ).otherwise(F.lit(0).cast("long"))
    # Days are numbered as they occur: the frame holds the active days before this one.
    earlier = (
        Window.partitionBy("src_ip").orderBy("day_no").rangeBetween(-(limits.active_days - 1), -1)
    )
    known = hours.select(
        "*",
        F.least(F.col("day_no") - 1, F.lit(limits.active_days - 1)).cast("long").alias("earlier_days"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier_logins"),
    )
    last = F.struct(
        F.col("last_us").alias("us"),
        (F.col("day_before") + F.col("n")).alias("n"),
        "earlier_days",
        "earlier_logins",
    )
    return known.select(
        "src_ip",
        CHUNK,
        "hour_before",
        "day_before",
        "earlier_days",
        "earlier_logins",
        _sum_before(F.col("n"), "src_ip").alias("prior_before"),
        _sum_before(F.col("new_users"), "src_ip").alias("users_before"),
        _sum_before(turns_usual, "src_ip").alias("mask_before"),
        F.lag(last).over(Window.partitionBy("src_ip").orderBy(CHUNK)).alias("previous"),
    )


def _usual_hours() -> Column:
    is_set = lambda h: F.shiftright(F.col("usual_mask"), h).bitwiseAND(F.lit(1)) == 1
    return F.array_compact(F.array(*[F.when(is_set(h), str(h)) for h in range(24)]))


def unusual_hour() -> Column:
    return (F.col("usual_mask") != 0) & (F.col("hour_prior") < 2)


def new_user() -> Column:
    return (F.col("known_users") > 0) & (F.col("user_prior") == 0)


def after_absence(limits: BaselineLimits) -> Column:
    return F.coalesce(
        F.col("us") - F.col("previous_us") > limits.absence_sec * SECOND_US, F.lit(False)
    )


def frequency_spike(limits: BaselineLimits) -> Column:
    # today > factor * average, without dividing
    above = F.col("today_count") * F.col("earlier_days") > F.lit(limits.spike_factor) * F.col(
        "earlier_logins"
    )
    return (
        (F.col("earlier_days") + 1 >= limits.spike_min_days)
        & (F.col("today_count") >= limits.spike_min_count)
        & above
    )


def reasons(limits: BaselineLimits) -> Column:
    days = F.floor((F.col("us") - F.col("previous_us")) / DAY_US)
    # ties round to even
    average = F.format_string("%.1f", F.bround(F.col("earlier_logins") / F.col("earlier_days"), 1))
    return F.array_compact(
        F.array(
            F.when(
                unusual_hour(),
                F.concat(
                    F.lit("login at unusual hour "),
                    F.lpad(F.col("hour").cast("string"), 2, "0"),
                    F.lit(":xx (normal hours: ["),
                    F.array_join(_usual_hours(), ", "),
                    F.lit("])"),
                ),
            ),
            F.when(
                new_user(),
                F.concat(
                    F.lit("new username '"), F.col("user"), F.lit("' for IP with "),
                    F.col("known_users"), F.lit(" known users"),
                ),
            ),
            F.when(
                after_absence(limits), F.concat(F.lit("login after "), days, F.lit("-day absence"))
            ),
            F.when(
                frequency_spike(limits),
                F.concat(
                    F.lit("login frequency spike: "), F.col("today_count"),
                    F.lit(" today vs avg "), average, F.lit("/day"),
                ),
            ),
        )
    )


def login_anomalies(
    events: DataFrame, limits: BaselineLimits = BaselineLimits(), known: DataFrame | None = None
) -> DataFrame:
    """Logins that deviate from an established profile, with the reasons as one text."""
    return (
        login_history(events, limits, known)
        .filter(F.col("prior") >= limits.min_observations)
        .withColumn("reasons", reasons(limits))
        .filter(F.size("reasons") > 0)
        .select("event_id", "src_ip", "user", "us", F.array_join("reasons", "; ").alias("anomaly"))
    )


def _profile(hourly: DataFrame) -> DataFrame:
    entry = F.struct(F.col("hour"), F.col("n"))
    return hourly.groupBy("src_ip").agg(
        F.sum("n").alias("total_logins"),
        F.min("first_us").alias("first_seen_us"),
        F.max("last_us").alias("last_seen_us"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("login_hours"),
    )


def login_profiles(
    events: DataFrame, anomalies: DataFrame | None = None
) -> DataFrame:
    """One row per address; logins per hour as a map of at most 24 entries.

    The users themselves are in ``login_profile_users``: their number per
    address has no bound, so they are rows, not an array.
    """
    rows = logins(events)
    hourly = rows.groupBy("src_ip", "hour").agg(
        F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us")
    )
    users = login_profile_users(events).groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("known_users")
    )
    out = _profile(hourly).join(users, "src_ip")
    if anomalies is None:
        return out
    odd = anomalies.groupBy("src_ip").agg(F.count(F.lit(1)).alias("anomaly_count"))
    return out.join(odd, "src_ip", "left").withColumn(
        "anomaly_count", F.coalesce("anomaly_count", F.lit(0))
    )


def login_profile_users(events: DataFrame) -> DataFrame:
    return logins(events).groupBy("src_ip", "user").agg(
        F.count(F.lit(1)).alias("logins"), F.min("us").alias("first_seen_us")
    )
