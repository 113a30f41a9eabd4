"""Prices, budgets and tiers of model calls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of one call, and the share of tokens a compression must save.
MAX_INPUT_TOKENS, MAX_OUTPUT_TOKENS, MAX_COST = 32_000, 8_000, 1.0
MIN_SAVINGS = 0.10

# Tier, lowest and highest score, input and output token caps.
TIERS = [
    ("solar", 0, 15, 0, 0),
    ("daylight", 16, 30, 4000, 1200),
    ("horizon", 31, 45, 8000, 2400),
    ("twilight", 46, 60, 16000, 4800),
    ("starlight", 61, 80, 32000, 8000),
    ("aurora", 81, 100, 64000, 12000),
]


def call_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """US dollars of one call; prices are per million tokens."""
    return F.round(tokens_in / F.lit(1e6) * F.lit(price_in) + tokens_out / F.lit(1e6) * F.lit(price_out), 8)


def worst_case_cost(tokens_in: Column, tier: Column, price_in: Column, price_out: Column) -> Column:
    """US dollars a call can cost at most, known before it is made: all its input and the tier's whole output cap.

    Without prices a dollar for a million input tokens is assumed. NULL for an unknown tier.
    """
    priced = tokens_in / F.lit(1e6) * price_in + tier_cap(tier) / F.lit(1e6) * price_out
    unpriced = price_in.isNull() & price_out.isNull()
    return F.when(tier_cap(tier).isNotNull(), F.round(F.when(unpriced, tokens_in / F.lit(1e6)).otherwise(priced), 8))


def refusal(tokens_in: Column, tier: Column, worst_case: Column, left: Column) -> Column:
    """Why a call must not be made, or NULL when it may: fails closed where the tier or the cost is unknown."""
    return (
        F.when(tier_cap(tier).isNull(), "unknown tier")
        .when(tokens_in > tier_cap(tier, "input"), "input token cap exceeded")
        .when(worst_case.isNull(), "unknown cost")
        .when(left.isNull() | (worst_case > left), "worst case exceeds the budget"))


def budget_violations(tokens_in: Column, tokens_out: Column, cost: Column) -> Column:
    """The exceeded limits joined by ``; ``, or NULL when the call is within all of them."""
    found = F.concat_ws(
        "; ",
        F.when(tokens_in > MAX_INPUT_TOKENS, "input token budget exceeded"),
        F.when(tokens_out > MAX_OUTPUT_TOKENS, "output token budget exceeded"),
        F.when(cost > MAX_COST, "cost budget exceeded"),
    )
    return F.nullif(found, F.lit(""))


def compression_pays(before: Column, after: Column) -> Column:
    possible = (before > 0) & (after >= 0) & (after <= before)
    return F.coalesce(F.when(possible, (before - after) / before >= MIN_SAVINGS), F.lit(False))


def complexity_score(columns: Column, alerts: Column) -> Column:
    return F.least(F.lit(100), F.lit(36) + columns * 2 + alerts * 4).cast("double")


def tier_for_score(score: Column) -> Column:
    """The tier whose range holds the score; NULL outside every range, also between 15 and 16."""
    tier = F.lit(None).cast("string")
    for name, low, high, _, _ in TIERS:
        tier = F.when(score.between(low, high), name).otherwise(tier)
    return tier


def tier_cap(tier: Column, which: str = "output") -> Column:
    """A tier's token cap; NULL for an unknown tier, which callers must refuse."""
    cap = F.lit(None).cast("int")
    for name, _, _, cap_in, cap_out in TIERS:
        cap = F.when(tier == name, cap_out if which == "output" else cap_in).otherwise(cap)
    return cap
