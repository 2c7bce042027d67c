"""Decay, ranking, pricing and quality expressions. Every function takes and returns columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def exponential_decay(age: Column, half_life: float) -> Column:
    """exp(-ln(h) / h * age): the constant is ln(h), not ln(2)."""
    return F.exp(-math.log(half_life) / half_life * age)


def linear_decay(age: Column, max_age: float) -> Column:
    return F.greatest(1 - age / max_age, F.lit(0.0))


def logarithmic_decay(age: Column) -> Column:
    """1 / ln(1 + age); null at age 0, where it has no bound."""
    return F.try_divide(F.lit(1.0), F.log(1 + age))


def polynomial_decay(age: Column, degree: int) -> Column:
    return 1 / F.pow(1 + age, F.lit(float(degree)))


def gaussian_decay(age: Column, sigma: float) -> Column:
    return F.exp(-(age * age) / (2 * sigma * sigma))


def step_decay(age: Column, steps: list[tuple[float, float]], otherwise: float = 0.0) -> Column:
    out = F.lit(otherwise)
    for limit, value in reversed(steps):
        out = F.when(age < limit, value).otherwise(out)
    return out


def half_life_weight(age: Column, half_life: float) -> Column:
    return F.exp(-math.log(2) * age / half_life) if half_life else F.lit(1.0)


def hackernews_score(points: Column, age_hours: Column, gravity: float = 1.8) -> Column:
    return points / F.pow(age_hours + 2, F.lit(gravity))


# fixed value: seconds from which hot scores count
HOT_EPOCH = 1_114_293_600


def reddit_hot_score(up: Column, down: Column, seconds: Column) -> Column:
    """sign * max(log10 |up - down|, 1) + seconds since HOT_EPOCH, not below 0, / 45,000."""
    score = up - down
    order = F.greatest(F.log10(F.abs(score).cast("double")), F.lit(1.0))
    return F.signum(score.cast("double")) * order + F.greatest(seconds - HOT_EPOCH, F.lit(0)) / 45000.0


def trending_composite(age_hours: Column, views_per_hour: Column, engagement: Column) -> Column:
    """0.3 recency + 0.4 velocity + 0.3 engagement; velocity is ln / 10 up to 1, and 0 below one view an hour."""
    velocity = F.when(views_per_hour < 1, 0.0).otherwise(F.least(F.log(views_per_hour) / 10, F.lit(1.0)))
    return 0.3 * F.exp(-0.1 * age_hours) + 0.4 * velocity + 0.3 * engagement


def novelty(unseen: Column, popularity: Column) -> Column:
    """0.6 if unseen, and 0.4 * (1 - min(popularity, 1))."""
    return F.when(unseen, 0.6).otherwise(0.0) + 0.4 * (1 - F.least(popularity, F.lit(1.0)))


def serendipity(unexpectedness: Column, relevance: Column) -> Column:
    return unexpectedness * relevance


def weighted_normalise(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of scores within 0 to 1; 0 without weight."""
    total = sum(w for _, w in parts)
    if total < 2.220446049250313e-16:
        return F.lit(0.0)
    return F.greatest(F.least(sum((c * w for c, w in parts), F.lit(0.0)) / total, F.lit(1.0)), F.lit(0.0))


def view_multiplier(views: Column, base: float = 10.0, most: float = 2.0, threshold: int = 100, weight: float = 0.2) -> Column:
    """1 below the threshold, else 1 + weight * log_base(views) / base, `most` at most."""
    return F.when(views < threshold, 1.0).otherwise(F.least(1 + weight * (F.log(views.cast("double")) / math.log(base)) / base, F.lit(most)))


def freshness_decay(age_days: Column, half_life: float, kind: str) -> Column:
    """exponential, linear (0 at twice the half-life), step or logarithmic; 0 for a negative age or half-life."""
    if half_life <= 0:
        return F.lit(0.0)
    value = {
        "exponential": lambda: F.exp(-math.log(2) / half_life * age_days),
        "linear": lambda: F.greatest(1 - age_days / (2 * half_life), F.lit(0.0)),
        "step": lambda: F.when(age_days <= half_life, 1.0).otherwise(0.0),
        "logarithmic": lambda: 1 / (1 + F.log2(1 + age_days / half_life)),
    }[kind]()
    return F.when(age_days < 0, 0.0).otherwise(value)


def freshness(published: Column, updated: Column, velocity: Column, kind: str, half_life: float = 7.0, most: float = 1000.0, weight: float = 0.2) -> Column:
    """Decay of the lesser age and a boost for velocity, 1 at most."""
    boost = F.least(F.greatest(velocity, F.lit(0.0)) / most, F.lit(1.0)) * weight
    return F.least(freshness_decay(F.least(published, updated), half_life, kind) + boost, F.lit(1.0))


def boost_factor(age_days: Column, schedule: list[tuple[int, float]]) -> Column:
    """The factor of the first offset that the age does not pass; 1 beyond all."""
    out = F.lit(1.0)
    for offset, factor in sorted(schedule, key=lambda x: x[0], reverse=True):
        out = F.when(age_days <= offset, factor).otherwise(out)
    return out


# fixed values: boosts of matched fields, base ratings and weights of implicit signals
FIELD_BOOSTS = {"title": 2.0, "description": 1.5, "keywords": 1.3, "transcript": 1.0}
SIGNAL_RATINGS = {"view": 2.0, "completion": 4.0, "repeat_view": 4.5, "skip": 1.0, "fast_forward": 1.5, "rewind": 3.0, "pause": 2.5, "share": 5.0, "bookmark": 4.5}


def field_boost(matched: Column, boosts: dict[str, float] | None = None) -> Column:
    """Product of the boosts of the matched fields; unknown fields count 1."""
    known = F.create_map(*[F.lit(x) for pair in (boosts or FIELD_BOOSTS).items() for x in pair])
    return F.aggregate(matched, F.lit(1.0), lambda acc, f: acc * F.coalesce(F.try_element_at(known, f), F.lit(1.0)))


def signal_rating(kind: Column, strength: Column) -> Column:
    """Base rating of the signal times its strength (0 to 1), 5 at most."""
    known = F.create_map(*[F.lit(x) for pair in SIGNAL_RATINGS.items() for x in pair])
    return F.least(F.try_element_at(known, kind) * F.greatest(F.least(strength, F.lit(1.0)), F.lit(0.0)), F.lit(5.0))


def watch_rating(watch_ms: Column, completed: Column) -> Column:
    """4 if completed, else 3, and half a point an hour up to one; 5 at most."""
    return F.least(F.when(completed, 4.0).otherwise(3.0) + F.least(watch_ms / 3_600_000.0 * 0.5, F.lit(1.0)), F.lit(5.0))


def blended_rating(explicit: Column, implicit: Column) -> Column:
    return F.coalesce(explicit * 0.7 + implicit * 0.3, explicit, implicit)


def network_health(loss_rate: Column, jitter_us: Column) -> Column:
    return (F.greatest(1 - loss_rate, F.lit(0.0)) + F.greatest(1 - jitter_us / 50000.0, F.lit(0.0))) / 2


def speedup(baseline: Column, current: Column, threshold: float) -> Column:
    """struct(speedup, change_percent, is_improvement, is_regression); 1 without a current time."""
    s = F.when(current > 0, baseline / current).otherwise(1.0)
    return F.struct(s.alias("speedup"), ((s - 1) * 100).alias("change_percent"), (s > 1 + threshold / 100).alias("is_improvement"), (s < 1 - threshold / 100).alias("is_regression"))


def resource_cost(rate: float, seconds: Column, weight: Column) -> Column:
    return max(rate, 0.0) * seconds * weight


def ucb(mean: Column, total: Column, own: Column, c: float = math.sqrt(2)) -> Column:
    return F.when(own == 0, float("inf")).otherwise(mean + c * F.sqrt(F.log(total.cast("double")) / own))


def thompson_mean(success: Column, failure: Column) -> Column:
    return (1 + success) / (2 + success + failure)


def epsilon_decay(eps: Column, rate: float) -> Column:
    return F.greatest(eps * (1 - rate), F.lit(0.01))


def z_score(x: Column, mean: Column, std: Column) -> Column:
    return F.when(std < 1e-9, 0.0).otherwise((x - mean) / std)


def min_max(x: Column, low: Column, high: Column) -> Column:
    return F.when(high - low < 1e-9, 0.0).otherwise((x - low) / (high - low))


def royalty(revenue: Column, rate: float, minimum: float) -> Column:
    return F.greatest(revenue * rate / 100, F.lit(minimum))


def overall_quality(vmaf: Column, ssim: Column, psnr: Column) -> Column:
    """Weights .5, .3 and .2; PSNR of 20 to 50 dB maps to 0 to 100."""
    level = F.least(F.greatest((psnr - 20) / 30 * 100, F.lit(0.0)), F.lit(100.0))
    return 0.5 * vmaf + 0.3 * ssim * 100 + 0.2 * level


def frequency_error_ppm(measured: Column, nominal: Column) -> Column:
    return F.when(F.abs(nominal) < 1e-12, 0.0).otherwise((measured - nominal) / nominal * 1e6)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(a))
