"""Fixed schemas of the tables that cross a file boundary."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


_long, _int, _double, _string = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()

CORPUS = _struct(doc_id=_long, text=_string)
TOKENIZED = _struct(doc_id=_long, input_ids=T.ArrayType(_int))
SEQUENCES = _struct(seq_idx=_long, input_ids=T.ArrayType(_int))
SAMPLE = _struct(cohort=_long, batch_idx=_long, seq_idx=_long)
TOKEN_FREQ = _struct(token=_int, count=_long)

STATS_NESTED = _struct(
    sup=T.ArrayType(T.ArrayType(_double)),
    rank=T.ArrayType(T.ArrayType(_int)),
    entropy=T.ArrayType(T.ArrayType(_double)),
    seq_idx=T.ArrayType(_long),
)
STATS = _struct(
    seq_idx=_long,
    sup=T.ArrayType(_double),
    rank=T.ArrayType(_int),
    entropy=T.ArrayType(_double),
)
STATS_SHORT = _struct(seq_idx=_long, sup_seq=_double)
PANEL = _struct(
    seq_idx=_long, step=_int, sup_seq=_double, entr_seq=_double, acc_seq=_double, avg_rank=_double
)

_measures = dict(ATT=_double, std_error=_double, lower=_double, upper=_double, zero_not_in_cband=_string)
EFFECTS_ALL = _struct(cohort=_long, base_period=_long, time=_long, **_measures)
EFFECTS_COHORT = _struct(cohort=_long, **_measures)
EFFECTS_TIME = _struct(time=_long, **_measures)
EFFECTS_EVENT = _struct(relative_period=_long, **_measures)
