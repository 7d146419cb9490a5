"""Cron expressions of five fields (DAT-07): the next tick after an instant, all fields having to fit, on instants and on columns."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.sources import shared

SEARCHED_MINUTES = 525_600
_RANGES = [("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 6)]


def parse(expression: str) -> list[list[int]]:
    """The allowed numbers of each field: *, lists, ranges, steps, and a/n, which runs from a to the field's end."""
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError(f"five fields are needed: {expression!r}")
    return [_field(f, *r) for f, r in zip(fields, _RANGES)]


def _field(text: str, name: str, low: int, high: int) -> list[int]:
    out: set[int] = set()
    for part in text.split(","):
        span, slash, step = part.partition("/")
        if slash and (not step.isdigit() or int(step) < 1):
            raise ValueError(f"{name}: step {part!r}")
        a, dash, b = span.partition("-")
        if span == "*":
            first, last = low, high
        elif a.isdigit() and (b.isdigit() if dash else True):
            first, last = int(a), int(b) if dash else high if slash else int(a)
        else:
            raise ValueError(f"{name}: {part!r}")
        if not low <= first <= last <= high:
            raise ValueError(f"{name}: {part!r} is out of range")
        out.update(range(first, last + 1, int(step) if slash else 1))
    return sorted(out)


def next_tick(expression: str, after: datetime) -> datetime:
    minutes, hours, days, months, weekdays = map(set, parse(expression))
    at, end = after.replace(second=0, microsecond=0) + timedelta(minutes=1), after + timedelta(minutes=SEARCHED_MINUTES)
    while at <= end:
        if at.month in months and at.day in days and at.isoweekday() % 7 in weekdays:
            if at.hour in hours:
                if at.minute in minutes:
                    return at
                at += timedelta(minutes=1)
            else:
                at = at.replace(minute=0) + timedelta(hours=1)
        else:
            at = at.replace(hour=0, minute=0) + timedelta(days=1)
    raise ValueError(f"no tick of {expression!r} within a year")


def next_tick_of(ts: Column, expression: str) -> Column:
    """The next tick after each instant, all five fields counting; null if there is none within a year."""
    minutes, hours, days, months, weekdays = parse(expression)
    of_day = sorted(60 * h + m for h in hours for m in minutes)
    one_of = lambda c, values, whole: F.lit(True) if len(values) == whole else c.isin(values)
    fits = lambda d: one_of(F.month(d), months, 12) & one_of(F.dayofmonth(d), days, 31) & one_of(F.dayofweek(d) - 1, weekdays, 7)
    today = F.to_date(ts)
    now = F.hour(ts) * 60 + F.minute(ts)
    later = F.array_min(F.filter(F.lit(of_day), lambda m: m > now))
    day = F.array_min(F.filter(F.sequence(F.date_add(today, 1), F.date_add(today, 366)), fits))
    at = lambda d, m: F.timestamp_seconds(F.unix_timestamp(d.cast("timestamp")) + m * 60)
    found = F.when(fits(today) & later.isNotNull(), at(today, later)).otherwise(at(day, F.lit(of_day[0])))
    return F.when(found <= ts + F.expr(f"interval {SEARCHED_MINUTES} minutes"), found)


_PART = r"^(\*|[0-9]{1,9}(?:-[0-9]{1,9})?)(?:/([0-9]{1,9}))?$"


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def _has(mask: Column, n: Column) -> Column:
    return mask.bitwiseAND(_bit(n)) != 0


def _lowest(mask: Column, least: Column) -> Column:
    """The lowest number of a mask that is at least so large; null if there is none."""
    above = mask.bitwiseAND(F.bitwise_not(_bit(least) - 1))
    return F.when(above != 0, F.bit_count(above.bitwiseAND(-above) - 1))


def mask(field: Column, low: int, high: int) -> Column:
    """A bit for each number that a cron field allows; null if it isn't a field of that range."""

    def part(p):
        number = lambda c: c.try_cast("int")
        span, step = F.regexp_extract(p, _PART, 1), number(F.regexp_extract(p, _PART, 2))
        a, b = number(F.split_part(span, F.lit("-"), F.lit(1))), number(F.split_part(span, F.lit("-"), F.lit(2)))
        first = F.when(span == "*", low).otherwise(a)
        last = F.when(span == "*", high).when(span.contains("-"), b).when(step.isNotNull(), high).otherwise(a)
        fine = p.rlike(_PART) & (first >= low) & (last <= high) & (first <= last) & (F.coalesce(step, F.lit(1)) >= 1)
        return F.when(fine, F.aggregate(F.sequence(first, last, F.coalesce(step, F.lit(1))), F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(_bit(i))))

    parts = F.transform(F.split(field, ",", -1), part)
    return F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def masks(expression: Column) -> Column:
    """struct(minute, hour, day, month, weekday) of masks of a cron text; null if it isn't one."""
    fields = F.split(F.btrim(expression, F.lit(" \t\n\x0b\x0c\r")), r"[ \t\n\x0B\f\r]+", -1)
    each = [mask(F.get(fields, i), low, high).alias(name) for i, (name, low, high) in enumerate(_RANGES)]
    whole = F.struct(*each)
    return F.when((F.size(fields) == 5) & F.forall(F.array(*(whole[name] for name, _, _ in _RANGES)), lambda m: m.isNotNull()), whole)


def _fits(m: Column, d: Column) -> Column:
    return _has(m["month"], F.month(d)) & _has(m["day"], F.dayofmonth(d)) & _has(m["weekday"], F.dayofweek(d) - 1)


def _later(m: Column, today: Column) -> Column:
    """The first day of a year after today that the masks allow."""
    days = lambda a, z: F.array_min(F.filter(F.sequence(F.date_add(today, a), F.date_add(today, z)), lambda d: _fits(m, d)))
    return F.coalesce(days(1, 8), days(9, 366))


def _tick(m: Column, at: Column, fits: Column, later: Column) -> Column:
    """The next tick after an instant by its masks, given whether its day fits and the next day that does."""
    hour, minute = F.hour(at), F.minute(at)
    first = _lowest(m["minute"], F.lit(0))
    this_hour = F.when(_has(m["hour"], hour), _lowest(m["minute"], minute + 1))
    of_day = F.coalesce(hour * 60 + this_hour, _lowest(m["hour"], hour + 1) * 60 + first)
    instant = lambda d, minutes: F.timestamp_seconds(F.unix_timestamp(d.cast("timestamp")) + minutes * 60)
    return F.when(fits & of_day.isNotNull(), instant(F.to_date(at), of_day)).otherwise(instant(later, _lowest(m["hour"], F.lit(0)) * 60 + first))


def next_tick_by(ts: Column, expression: Column) -> Column:
    """The next tick after each instant by each row's own expression; null if it isn't one, or ticks at no minute within a year.

    A text becomes five masks, and the next minute, hour and day are the lowest bits above the instant's own; days are looked through by the
    week, then by the year.
    """

    def tick(m, at):
        today = F.to_date(at)
        return _tick(m, at, _fits(m, today), _later(m, today))

    found = F.get(F.transform(F.array(F.struct(masks(expression).alias("m"), ts.cast("timestamp").alias("at"))), lambda x: F.when(x["m"].isNotNull(), tick(x["m"], x["at"]))), F.lit(0))
    return F.when(found <= ts + F.expr(f"interval {SEARCHED_MINUTES} minutes"), found)


DAYS = 1_000_000  # pairs of an expression and a day that are broadcast; beyond it rows are shuffled by both


def next_ticks(rows: DataFrame, ts: str, expression: str, name: str) -> DataFrame:
    """Rows with next_tick_by() of two of their columns as a further one. Each expression is read once and each of its days looked up once, however
    many rows have them; a row then costs a few bit operations."""
    held = rows.select(F.col(expression).alias("_cron"), F.to_date(F.col(ts).cast("timestamp")).alias("_day")).where("_cron is not null and _day is not null").distinct()
    held = shared.written(held, "days")
    read = shared.written(held.select("_cron").distinct().select("_cron", masks(F.col("_cron")).alias("_m")).where("_m is not null"), "crons")
    small = lambda df: F.broadcast(df) if df.count() <= DAYS else df
    days = held.join(small(read), "_cron").select("_cron", "_day", "_m", _fits(F.col("_m"), F.col("_day")).alias("_fits"), _later(F.col("_m"), F.col("_day")).alias("_later"))
    days = shared.written(days, "ticks")
    at = F.col(ts).cast("timestamp")
    met = rows.join(small(days), (F.col(expression) == F.col("_cron")) & (F.to_date(at) == F.col("_day")), "left")
    found = F.when(F.col("_m").isNotNull(), _tick(F.col("_m"), at, F.col("_fits"), F.col("_later")))
    found = F.when(found <= F.col(ts) + F.expr(f"interval {SEARCHED_MINUTES} minutes"), found)
    return met.withColumn(name, found).drop("_cron", "_day", "_m", "_fits", "_later")


def next_minute_tick(ts: Column, minutes: list[int]) -> Column:
    """The next tick of an expression that restricts minutes alone."""
    return next_tick_of(ts, f"{','.join(map(str, minutes))} * * * *")


def run_on_schedule(expression: str | None, run, max_runs: int | None = None, now=datetime.now, sleep=time.sleep, escalation: type[Exception] | None = None) -> list:
    """Run at once, then at each tick, one run after the other, until max_runs; without an expression, once.

    An escalation is a run's result and raised in the end; any other error stops the loop.
    """
    results, raised = [], None
    left = max_runs or (None if expression else 1)
    if expression:
        parse(expression)
    while left is None or left > 0:
        try:
            results.append(run())
        except Exception as e:
            if escalation is None or not isinstance(e, escalation) or not expression:
                raise
            results.append({"status": "escalated", "notes": [str(e)]})
            raised = e
        left = None if left is None else left - 1
        if not expression or left == 0:
            break
        at = now()
        sleep(max(0.0, (next_tick(expression, at) - at).total_seconds()))
    if raised:
        raise raised
    return results
