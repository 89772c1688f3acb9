"""Rules over activity: sliding limits, breakers, error patterns, points, levels and badges."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.operators.activity import sliding_counts


@dataclass(frozen=True)
class Rule:
    """At least threshold events of the kinds (all, if none) of one user within seconds; of `amount`, their sum."""

    name: str
    kinds: tuple[str, ...]
    threshold: float
    seconds: int
    amount: str | None = None


# fixed values: the rules on access denials, queries, requests, documents, failed logins, rate limits and volume
RULES = (
    Rule("denials", ("denied",), 5, 300), Rule("queries", ("query",), 100, 60), Rule("requests", (), 50, 10), Rule("documents", ("document",), 20, 60),
    Rule("auth_failures", ("auth_failure",), 10, 300), Rule("rate_violations", ("rate_violation",), 3, 300), Rule("volume", (), 50_000_000, 600, "bytes"),
)
# fixed values: levels and the points from which they hold
LEVELS = (("Novice", 0), ("Explorer", 100), ("Analyst", 500), ("Expert", 1500), ("Knowledge Master", 5000))
# fixed values: badges by counter and threshold
BADGES = (("uploads_count", 1), ("uploads_count", 5), ("uploads_count", 25), ("reviews_count", 1), ("reviews_count", 10), ("reviews_count", 50), ("streak_days", 7), ("streak_days", 30), ("total_points", 1000), ("total_points", 5000))
# fixed values: points for a first or following day of a streak, and for every seventh
DAILY_BONUS, WEEKLY_BONUS = 5, 25
# fixed values: what an action counts as
ACTIVITY = {"upload": "upload", "approval": "review", "verify": "verify", "review_approve": "review", "review_reject": "review", "review_edit": "review"}
# fixed values: how many times the base rate a role may ask
ROLE_MULTIPLIERS = {"admin": 3.0, "reviewer": 2.0, "contributor": 1.5, "default": 1.0}


def broken(events: DataFrame, rules: tuple[Rule, ...], user: str, kind: str, ts: str) -> DataFrame:
    """(user, rule, most, alerts): of each rule that a user comes under, the most within its window and how often the threshold was reached.

    Every rule is a range frame over the user's events, so a task holds a window, not a user's history.
    """
    found = []
    for rule in rules:
        own = events.where(F.col(kind).isin(list(rule.kinds))) if rule.kinds else events
        if rule.amount is None:
            seen = sliding_counts(own.select(user, ts), [user], ts, rule.seconds)
        else:
            frame = Window.partitionBy(user).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-rule.seconds * 1_000_000 + 1, 0)
            # added as decimals, so that a sum that is just the threshold reaches it in any order; doubles for what no decimal holds
            exact = F.col(rule.amount).try_cast("decimal(28,10)")
            loose = F.count_if(F.col(rule.amount).isNotNull() & exact.isNull()).over(frame) > 0
            seen = own.withColumn("in_window", F.when(loose, F.sum(rule.amount).over(frame)).otherwise(F.sum(exact).over(frame).cast("double")))
        found.append(seen.groupBy(user).agg(F.max(F.col("in_window").cast("double")).alias("most"), F.count_if(F.col("in_window") >= rule.threshold).alias("alerts")).withColumn("rule", F.lit(rule.name)))
    return reduce(DataFrame.unionByName, found).select(user, "rule", "most", "alerts")


def repeat_offenders(events: DataFrame, user: str, ts: str, hours: int, least: int = 10) -> DataFrame:
    """(user, denials, severity) of users with at least least events in the hours before the last one."""
    last = events.agg(F.max(ts).alias("_last"))
    recent = events.join(F.broadcast(last)).where(F.col(ts) >= F.col("_last") - F.expr(f"INTERVAL {hours} HOURS"))
    counts = recent.groupBy(user).agg(F.count("*").alias("denials")).where(F.col("denials") >= least)
    return counts.withColumn("severity", F.when(F.col("denials") >= 25, "critical").when(F.col("denials") >= 15, "high").otherwise("medium"))


def breaker(calls: DataFrame, name: str, ts: str, failed: Column, seconds: int, volume: int = 5, rate: float = 0.5) -> DataFrame:
    """(name, opened, calls, failures): windows of seconds in which a breaker opens, for enough calls and too many of them failed."""
    windows = calls.groupBy(name, F.window(ts, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("calls"), F.count_if(failed).alias("failures"))
    return windows.where((F.col("calls") >= volume) & (F.col("failures") >= rate * F.col("calls"))).select(name, F.col("w.start").alias("opened"), "calls", "failures")


def health(errors: Column, total: Column) -> Column:
    """healthy, degraded from a twentieth of errors on, unhealthy from a fifth on."""
    share = F.when(total > 0, errors / total).otherwise(0.0)
    return F.when(share >= 0.2, "unhealthy").when(share >= 0.05, "degraded").otherwise("healthy")


def points(events: DataFrame, user: str, ts: str, worth: Column) -> DataFrame:
    """(user, day, base, streak, awarded): points of each active day, with the bonus for a day of a streak and for every seventh."""
    days = events.groupBy(user, F.to_date(ts).alias("day")).agg(F.sum(worth).alias("base"))
    w = Window.partitionBy(user).orderBy("day")
    days = days.withColumn("_island", F.date_sub("day", F.row_number().over(w)))
    days = days.withColumn("streak", F.row_number().over(Window.partitionBy(user, "_island").orderBy("day")))
    first = F.row_number().over(w) == 1
    bonus = F.when(first | (F.col("streak") > 1), DAILY_BONUS).otherwise(0) + F.when(F.col("streak") % 7 == 0, WEEKLY_BONUS).otherwise(0)
    return days.withColumn("awarded", F.col("base") + bonus).drop("_island")


def level(xp: Column) -> Column:
    """struct(name, progress): the level that xp reaches, and how far it is on the way to the next in per cent."""
    made = None
    for (name, low), (_, high) in reversed(list(zip(LEVELS, [*LEVELS[1:], ("", 0)], strict=True))):
        progress = F.least(F.lit(100.0), (xp - low) * 100.0 / (high - low)) if high else F.lit(100.0)
        own = F.struct(F.lit(name).alias("name"), progress.alias("progress"))
        made = own if made is None else F.when(xp >= high, made).otherwise(own)
    return made


def badges(counters: DataFrame, user: str) -> DataFrame:
    """(user, counter, threshold, progress, earned) of every badge for each user's counters."""
    each = F.array(*[F.struct(F.lit(c).alias("counter"), F.lit(t).alias("threshold"), F.least(F.lit(100.0), F.col(c) * 100.0 / t).alias("progress")) for c, t in BADGES])
    return counters.select(user, F.explode(each).alias("b")).select(user, "b.*", (F.col("b.progress") >= 100).alias("earned"))


def activity_type(action: Column) -> Column:
    return F.coalesce(*[F.when(action == a, F.lit(t)) for a, t in ACTIVITY.items()], F.lit("activity"))


def effective_limit(base: Column, roles: Column) -> Column:
    """floor(base times the multiplier of the highest of the roles)."""
    best = F.greatest(*[F.when(F.array_contains(roles, r), F.lit(m)).otherwise(F.lit(ROLE_MULTIPLIERS["default"])) for r, m in ROLE_MULTIPLIERS.items()])
    return F.floor(base * best)


def sparkline(values: Column, width: int = 30) -> Column:
    """Values as characters of eight heights, at most width of them, taken evenly; equal values stand in the middle."""
    marks = F.array(*[F.lit(c) for c in "▁▂▃▄▅▆▇█"])
    n = F.size(values)
    taken = F.when(n <= width, values).otherwise(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get(values, F.floor(i * n / width).cast("int"))))
    low, high = F.array_min(taken), F.array_max(taken)
    at = lambda v: F.when(high == low, F.lit(3)).otherwise(F.least(F.lit(7), F.floor((v - low) / (high - low) * 8).cast("int")))
    return F.array_join(F.transform(taken, lambda v: F.get(marks, at(v))), "")


def hash31(text: Column) -> Column:
    """The 32-bit hash h = 31 h + code of a text's characters, as a signed long."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != F.lit("")), lambda c: F.ascii(c).cast("long"))
    wrap = lambda x: F.pmod(x + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c))


def variant(key: Column, shares: dict[str, int]) -> Column:
    """The variant that a key always falls to, shares being per cent of the keys in order."""
    bucket, chosen, at = F.abs(hash31(key)) % 100, None, 0
    for name, share in shares.items():
        at += share
        chosen = F.when(bucket < at, name) if chosen is None else chosen.when(bucket < at, name)
    return chosen


def deletions(events: DataFrame, key: str, ts: str, mark: Column, recover: Column, grace: int) -> DataFrame:
    """(key, state, since): active, pending (and since when), or deleted (and when), after all events.

    A mark makes an active row pending, a recovery a pending one active; one that stays pending for grace seconds, up to
    the last event of all, is deleted for good. Marks of pending rows change nothing.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = events.where(mark | recover).select(key, at.alias("t"), mark.alias("mark"))
    last = events.agg(F.max(at).alias("last"))
    w = Window.partitionBy(key).orderBy("t", "mark")
    rows = rows.withColumn("start", F.col("mark") & ~F.coalesce(F.lag("mark").over(w), F.lit(False)))
    ahead = F.min(F.when(~F.col("mark"), F.col("t"))).over(w.rowsBetween(1, Window.unboundedFollowing))
    starts = rows.withColumn("back", ahead).where("start")
    due = F.col("t") + grace * 1_000_000
    starts = starts.join(F.broadcast(last)).withColumn("gone", F.when((F.col("back").isNull() | (F.col("back") > due)) & (due <= F.col("last")), due))
    each = starts.groupBy(key).agg(F.min("gone").alias("gone"), F.max(F.when(F.col("back").isNull(), F.col("t"))).alias("open"))
    state = F.when(F.col("gone").isNotNull(), "deleted").when(F.col("open").isNotNull(), "pending").otherwise("active")
    every = events.select(key).distinct().join(each, key, "left")
    return every.select(key, state.alias("state"), F.timestamp_micros(F.coalesce("gone", "open")).alias("since"))
