"""Rights, embargo, retention, territories and life cycles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
# fixed values: years by retention class, and the moves of the asset life cycle
RETENTION_YEARS = {"Temporary": 1, "Standard": 5, "LongTerm": 10}
LIFECYCLE = {
    "Ingest": ("QcPending",),
    "QcPending": ("QcPassed", "QcFailed"),
    "QcPassed": ("Active",),
    "QcFailed": ("QcPending", "Deleted"),
    "Active": ("Archived", "Deleted"),
    "Archived": ("Active", "Deleted"),
    "Deleted": (),
}


def country_allowed(country: Column, allowed: list[str], blocked: list[str]) -> Column:
    """A blocked country never is; an empty list of allowed ones allows all others."""
    c = F.upper(country)
    out = ~c.isin(*[x.upper() for x in blocked]) if blocked else F.lit(True)
    return out & c.isin(*[x.upper() for x in allowed]) if allowed else out


def territory_multiplier(territory: Column, overrides: dict[str, float], default: Column) -> Column:
    if not overrides:
        return default
    known = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair])
    return F.coalesce(F.try_element_at(known, territory), default)


def zone_countries(countries: Column, regions: Column) -> Column:
    """Sorted distinct countries of a zone and of its regions (array of arrays)."""
    return F.array_sort(F.array_distinct(F.concat(countries, F.flatten(regions))))


def common_countries(restrictions: Column) -> Column:
    """Countries that all restrictions (array of arrays) share, sorted; of none, none."""
    rest = F.slice(restrictions, 2, F.greatest(F.size(restrictions) - 1, F.lit(0)))
    both = F.aggregate(rest, F.array_distinct(F.get(restrictions, F.lit(0))), lambda acc, x: F.array_intersect(acc, x))
    return F.array_sort(F.coalesce(both, F.array().cast("array<string>")))


def embargo_days(lift: Column, now: Column) -> Column:
    """Whole days until the lift, cut towards zero; negative once it is past."""
    return ((lift - now) / DAY).cast("long")


def eligible_for_deletion(kind: Column, ingested: Column, expires: Column, hold: Column, now: Column) -> Column:
    """Times in seconds. Never under a legal hold or for permanent assets; an own expiry comes before the class's years."""
    years = F.create_map(*[F.lit(x) for pair in RETENTION_YEARS.items() for x in pair])
    own = F.coalesce(F.try_element_at(years, kind) * (365 * DAY) + ingested <= now, F.lit(False))
    return ~hold & (kind != "Permanent") & F.when(expires.isNotNull(), now >= expires).otherwise(own)


def stage_for_age(age_days: Column, active_days: int, delete_after_days: int) -> Column:
    return F.when(age_days >= delete_after_days, "Deleted").when(age_days >= active_days, "Archived").otherwise("Active")


def may_move(stage: Column, following: Column) -> Column:
    known = F.create_map(*[x for s, to in LIFECYCLE.items() for x in (F.lit(s), F.array(*map(F.lit, to)).cast("array<string>"))])
    return F.coalesce(F.array_contains(F.try_element_at(known, stage), following), F.lit(False))


def next_occurrence(after: Column, start: Column, kind: str, interval: int = 1, days: tuple[int, ...] = (), day: int = 1, month: int = 1, end: Column | None = None) -> Column:
    """The next time of a recurrence behind the later of `after` and `start`; null at or behind `end`.

    daily adds `interval` days. weekly takes the first of the next seven days that is one of `days` (0 Monday to
    6 Sunday) in a week whose distance to the start `interval` divides, the seventh day if there is none. monthly
    adds `interval` months and takes `day`, yearly takes `month` and `day` of the next year; where that date does
    not exist, the time stays as it is.
    """
    base = F.greatest(after, start)
    clock = F.unix_timestamp(base) - F.unix_timestamp(base.cast("date").cast("timestamp"))
    if kind == "daily":
        out = F.timestamp_seconds(F.unix_timestamp(base) + max(interval, 1) * DAY)
    elif kind == "weekly":
        if not days:
            return F.lit(None).cast("timestamp")
        seconds, origin = F.unix_timestamp(base), F.unix_timestamp(start)
        fits = F.filter(F.sequence(F.lit(1), F.lit(7)), lambda i: F.weekday(F.timestamp_seconds(seconds + i * DAY)).isin(*days) & (((seconds + i * DAY - origin) / (7 * DAY)).cast("long") % interval == 0))
        out = F.timestamp_seconds(seconds + F.coalesce(F.get(fits, F.lit(0)), F.lit(7)) * DAY)
    elif kind in ("monthly", "yearly"):
        months = F.month(base) + interval - 1 if kind == "monthly" else F.lit(month - 1)
        year = F.year(base) + (F.floor(months / 12) if kind == "monthly" else 1)
        first = F.make_date(year.cast("int"), (months % 12 + 1).cast("int"), F.lit(1))
        out = F.when(F.day(F.last_day(first)) >= day, F.timestamp_seconds(F.unix_timestamp(F.date_add(first, day - 1).cast("timestamp")) + clock)).otherwise(base)
    else:
        raise ValueError(f"unknown recurrence {kind!r}")
    if end is not None:
        out = F.when((after < end) & (out < end), out)
    return out


def daily_occurrences(start: Column, low: Column, high: Column, interval: int, most: int) -> Column:
    """Array of the times from the later of `low` and `start` on, `interval` days apart, before `high`, `most` at most."""
    base = F.unix_timestamp(F.greatest(low, start))
    step = max(interval, 1) * DAY
    count = F.least(F.ceil((F.unix_timestamp(high) - base) / step), F.lit(most))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.timestamp_seconds(base + i * step))).otherwise(F.array().cast("array<timestamp>"))
