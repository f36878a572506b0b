"""Statistics of a true token under a vocabulary-wide logit list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MINUS_INF = float("-inf")


def _shifted_sum(logits: Column, top: Column, term) -> Column:
    return F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + term(x.cast("double") - top))


def _top(logits: Column) -> Column:
    return F.array_max(logits).cast("double")


def log_sum_exp(logits: Column) -> Column:
    """Max-shifted log of the sum of exponentials."""
    top = _top(logits)
    return top + F.ln(_shifted_sum(logits, top, F.exp))


def _logit_of(logits: Column, target: Column) -> Column:
    """The target's logit; NULL without target or logits, an error for a target outside the list."""
    inside = (target >= 0) & (target < F.size(logits))
    message = F.concat(F.lit("target outside the vocabulary: "), target.cast("string"))
    return F.when(target.isNull() | logits.isNull() | (F.size(logits) < 1), None).when(inside, F.get(logits, target)).otherwise(F.raise_error(message))


def surprisal_of(logits: Column, target: Column) -> Column:
    """-log p(target); `target` is a 0-based vocabulary position. NULL without target or logits."""
    return log_sum_exp(logits) - _logit_of(logits, target).cast("double")


def target_rank(logits: Column, target: Column) -> Column:
    """Vocabulary entries with strictly larger logit than the target's (0 = top); NULL without either."""
    chosen = _logit_of(logits, target)
    return F.when(chosen.isNotNull(), F.size(F.filter(logits, lambda x: x > chosen)))


def entropy_of(logits: Column) -> Column:
    """Entropy in nats; an entry at minus infinity contributes nothing."""
    top = _top(logits)
    mass = _shifted_sum(logits, top, F.exp)
    weighted = _shifted_sum(
        logits, top, lambda d: F.when(d == F.lit(_MINUS_INF), 0.0).otherwise(d * F.exp(d))
    )
    return F.ln(mass) - weighted / mass
