"""Panel effects on Spark: token statistics, staggered-adoption effects and their profiles."""

import sys

from pyspark import cloudpickle

from panelfx.operators.effects import EffectOptions, compute_effects
from panelfx.operators.panel import PanelSpec
from panelfx.session import build_session

# Functions of this package travel to the executors by value, which need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["EffectOptions", "PanelSpec", "build_session", "compute_effects"]
