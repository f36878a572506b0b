"""Column functions: everything here returns a native Spark column."""

from panelfx.functions.arrays import inputs_of, labels_of, list_mean, non_null_size, share_equal
from panelfx.functions.ids import batch_of, cohort_of, hash_key, none_if_nan
from panelfx.functions.logits import entropy_of, log_sum_exp, surprisal_of, target_rank
from panelfx.functions.paths import size_from_effect_file, step_from_path
from panelfx.functions.schedule import warmup_cosine

__all__ = [
    "batch_of",
    "cohort_of",
    "entropy_of",
    "hash_key",
    "inputs_of",
    "labels_of",
    "list_mean",
    "log_sum_exp",
    "non_null_size",
    "none_if_nan",
    "share_equal",
    "size_from_effect_file",
    "step_from_path",
    "surprisal_of",
    "target_rank",
    "warmup_cosine",
]
