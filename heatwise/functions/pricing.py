"""Probabilities, prices and stakes as column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def implied_prob(odds: Column) -> Column:
    return F.when(odds > 0, 1 / odds)


def layoff_fitness(days: Column, threshold: int = 30, half_life: float = 60.0) -> Column:
    """1 up to the threshold, then an exponential decay; unknown is 0.6 and a negative gap counts as none."""
    d = F.greatest(days, F.lit(0))
    return F.when(days.isNull(), 0.6).when(d <= threshold, 1.0).otherwise(F.exp(-(math.log(2) / half_life) * (d - threshold)))


def validate_ranges(rules: dict[str, Column]) -> Column:
    """Names of the rules that do not hold; a rule that is NULL holds."""
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))


def fraction_ratios(q1: Column, q2: Column, final: Column) -> tuple[Column, Column]:
    return F.try_divide(q1, q2), F.try_divide(q2 - q1, final)


def early_speed(beaten_q1: Column) -> Column:
    return -beaten_q1


def late_kick(beaten_q2: Column, beaten_final: Column) -> Column:
    return beaten_q2 - beaten_final


def expected_value(p: Column, odds: Column) -> Column:
    return p * odds - 1


def kelly_fraction(p: Column, odds: Column, k: float = 0.25, basis: str = "edge") -> Column:
    """k times max(0, (x * odds - (1 - x)) / odds), x the edge; with basis "prob" the textbook rule, x the chance and net odds."""
    if basis == "edge":
        return F.greatest(F.lit(0.0), (p * odds - (1 - p)) / odds) * k
    return F.greatest(F.lit(0.0), (p * (odds - 1) - (1 - p)) / (odds - 1)) * k


def bet_cap(f: Column, cap: float = 0.03) -> Column:
    return F.least(f, F.lit(cap))


def inferred_pool_share(odds: Column, pool: Column, takeout: Column | float) -> Column:
    return (1 - takeout) * pool / odds


# Usual shares of a pool that the operator of the bets keeps.
TAKEOUT = {"win": 0.17, "place": 0.17, "show": 0.17, "exacta": 0.21, "trifecta": 0.25, "superfecta": 0.25, "pick3": 0.25, "pick4": 0.25, "pick6": 0.25}


def takeout_of(bet_type: Column, own: dict[str, float] | None = None, default: float = 0.17) -> Column:
    """The share kept from the pool of a kind of bet; a track's own shares come first, an unknown kind has the default."""
    shares = TAKEOUT | (own or {})
    return F.coalesce(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])[F.lower(bet_type)], F.lit(default))


def post_bet_odds(odds: Column, stake: Column, pool: Column, takeout: Column | float) -> Column:
    """Odds after our stake has gone into the pool; without a pool or a stake they stay."""
    moved = (1 - takeout) * (pool + stake) / (inferred_pool_share(odds, pool, takeout) + stake)
    return F.when(pool.isNull() | (F.coalesce(stake, F.lit(0.0)) <= 0), odds).otherwise(moved)


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def clip_logit(p: Column, eps: float = 1e-9) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def log_loss_term(p: Column, y: Column, eps: float = 1e-7) -> Column:
    q = clip(p, eps, 1 - eps)
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def bernoulli_z(p: Column, y: Column, eps: float = 1e-4, most: float = 5.0) -> Column:
    """Residual over its deviation, clipped; the variance is at least eps."""
    return clip((y - p) / F.sqrt(F.greatest(p * (1 - p), F.lit(eps))), -most, most)


def pnl_z(expected: Column, pnl: Column, stake: Column, p: Column, odds: Column, eps: float = 1e-4, most: float = 5.0) -> Column:
    """Profit less expectation over its deviation. expected is a value per unit staked."""
    sd = F.abs(stake) * F.when(p.isNotNull() & odds.isNotNull(), F.sqrt(F.greatest(p * (1 - p), F.lit(eps))) * odds).otherwise(1.0)
    return clip((pnl - expected * stake) / F.greatest(sd, F.lit(eps)), -most, most)


def is_sprint(furlongs: Column) -> Column:
    return furlongs <= 6.5


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier)
