"""Score expressions: recency, saturation, weights, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _days(at: Column, as_of: str) -> Column:
    return (F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(at)) / 86400.0


def recency_boost(last_at: Column | str, created_at: Column | str, as_of: str) -> Column:
    """1 / (1 + days / 100) since the last reinforcement or, without one, the creation; 1 without either."""
    days = F.greatest(F.lit(0.0), _days(F.coalesce(_c(last_at), _c(created_at)), as_of))
    return F.coalesce(1.0 / (1.0 + days * 0.01), F.lit(1.0))


def recency_decay(updated_at: Column | str, as_of: str, scale_days: float = 90.0) -> Column:
    """exp(-whole days / scale); 1 for a missing or future time."""
    return F.exp(-F.coalesce(F.greatest(F.lit(0), F.floor(_days(_c(updated_at), as_of))), F.lit(0)) / scale_days)


def access_saturation(count: Column | str) -> Column:
    """ln(1 + n) / ln 50 within 0..1."""
    return F.least(F.lit(1.0), F.log1p(F.greatest(F.lit(0), _c(count)).cast("double")) / F.log(F.lit(50.0)))


def context_score(rel: Column, importance: Column, trust: Column, recency: Column, access: Column, trust_weight: float = 0.0) -> Column:
    """0.35 relevance + 0.25 importance + weighted trust + 0.1 recency + 0.1 access."""
    return 0.35 * rel + 0.25 * importance + trust_weight * trust + 0.1 * recency + 0.1 * access


def seed_weight(n_nodes: Column | int, in_degree: Column | str, trust: Column | str) -> Column:
    """max(0.5, ln(1 + n / (1 + in-degree))) times (0.1 + 0.9 trust)."""
    n = F.lit(n_nodes) if isinstance(n_nodes, int) else n_nodes
    idf = F.greatest(F.lit(0.5), F.log(1.0 + F.greatest(F.lit(1), n) / (1.0 + _c(in_degree))))
    return F.greatest(F.lit(1e-6), idf * (0.1 + 0.9 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), _c(trust)))))


def usage_edge_weight(w0: Column, in_degree: Column, access: Column, is_code: Column, age_days: Column, trust: Column, decay_per_day: float = 0.015) -> Column:
    """Edge weight by use: less for hubs, more for much used targets, less for old and untrusted ones.

    Targets with fewer than 4 uses are in grace: smaller slope, no decay.
    """
    base = F.when((w0 > 0) & ~F.isnan(w0), w0).otherwise(0.5) / F.greatest(F.lit(1.0), F.log(1.0 + in_degree))
    grace = access < 4
    bonus = F.least(F.lit(3.0), 1.0 + F.log1p(access.cast("double")) * F.when(grace, 0.25).otherwise(0.5))
    decay = F.exp(-F.when(is_code | grace, 0.0).otherwise(decay_per_day) * F.greatest(F.lit(0.0), age_days))
    return F.greatest(F.lit(1e-9), base * bonus * decay * (0.1 + 0.9 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), trust))))


# Weights of link kinds in rankings.
KIND_WEIGHTS = {"manual": 1.0, "contradicts": 0.8, "causes": 0.8, "category": 0.5, "same_project": 0.3}
UNKNOWN_KIND = 0.5


def kind_weight(kind: Column | str, weights: dict[str, float] | None = None) -> Column:
    """The weight of a link kind, in any case; a middle one for unknown kinds."""
    k = F.lower(_c(kind))
    out = F.lit(UNKNOWN_KIND)
    for name, w in (weights or KIND_WEIGHTS).items():
        out = F.when(k == name, F.lit(w)).otherwise(out)
    return out


def kind_weights_of(json: str | None) -> dict[str, float]:
    """Weights from a JSON object {kind: weight}; pairs that aren't positive numbers are left out, nothing usable gives the defaults."""
    import json as j
    import math

    try:
        pairs = j.loads(json or "")
    except ValueError:
        pairs = {}
    pairs = pairs if isinstance(pairs, dict) else {}
    good = {str(k).lower(): float(v) for k, v in pairs.items() if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) and v > 0}
    return good or dict(KIND_WEIGHTS)


def working_set_boost(weight: Column | str, is_dirty: Column, boost: float = 1.2) -> Column:
    """A seed's weight, raised where its file is being worked on."""
    return F.when(is_dirty, _c(weight) * boost).otherwise(_c(weight)) if boost > 1 else _c(weight)


def round3(c: Column | str) -> Column:
    """Rounded to 3 digits by way of thousandths."""
    return F.round(_c(c) * 1000) / 1000


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """2 TP / (2 TP + FP + FN); 1 where there is nothing to find and nothing found."""
    whole = 2 * tp + fp + fn
    return F.when(whole == 0, 1.0).otherwise(2.0 * tp / whole)


def weighted_confidence(score: Column, trust: Column) -> Column:
    """Mean trust weighted by score (an aggregate)."""
    return F.sum(score * trust) / F.sum(score)
