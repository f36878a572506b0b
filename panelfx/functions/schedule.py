"""Learning-rate schedule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Peak rate, floor as a share of the peak, warm-up share of the run.
MAX_LR = 0.001
FLOOR_SHARE = 0.1
WARMUP_SHARE = 0.01


def warmup_cosine(
    step: Column, total: Column, max_lr: float = MAX_LR, base_lr: float | None = None
) -> Column:
    """Linear from `base_lr` to `max_lr` over the warm-up, then a half cosine back to `base_lr`."""
    base = FLOOR_SHARE * max_lr if base_lr is None else base_lr
    span = max_lr - base
    total = total.cast("double")
    warmup = F.ceil(total * WARMUP_SHARE).cast("double")
    decay = F.try_divide(step - warmup, total - warmup)
    return F.when(step <= warmup, base + F.try_divide(span * step, warmup)).otherwise(
        base + 0.5 * span * (1 + F.cos(F.pi() * decay))
    )
