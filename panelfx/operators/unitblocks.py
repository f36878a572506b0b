"""Sums over units that Spark's aggregates cannot express: contrast variances and bootstrap sums.

A panel is folded once into one row per unit. Tasks stream through these rows in Arrow batches and turn
each group of them into a small dense matrix. For a balanced panel that is all: a group's matrix of squared
deviations is joined with the contrasts of the views asked for. With gaps, contrasts are brought to the tasks in
parts of a bounded number of entries; each further part is one more pass over the folded units, so neither
the driver nor a task ever holds more than one part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelfx.functions import none_if_nan
from panelfx.operators.panel import PanelSpec
from panelfx.session import freeze

ROWS_PER_SALT = 500_000
# Entries of contrasts, and numbers of bootstrap sums, that a pass over the units works on.
PART_ENTRIES = 500_000
PART_NUMBERS = 4_000_000
# Entries multiplied out together with a block of units.
ENTRIES_TOGETHER = 1_024
# Neighbouring sums that travel in one row.
SEGMENT = 4_096
_OPEN_BYTES = 256 << 20
_BLOCK_UNITS = 2_048


def times_of(cells: DataFrame) -> list[int]:
    """The distinct times of the panel."""
    return sorted(r["time"] for r in cells.select("time").distinct().collect())


def fold_units(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row per unit: by..., cohort, unit (as text), times and ys (lists in order of time).

    Missing outcomes (NULL, NaN) are left out, and units without any. Several rows of one unit at one
    time raise, and so does a unit with several cohorts. Rows are shuffled once; a unit's repeated rows are
    counted before they are listed, so a list is never longer than there are times.
    """
    spec.check(panel)
    unit = [*spec.by, "unit"]
    y = panel.select(
        *spec.by,
        F.col(spec.cohort).cast("bigint").alias("cohort"),
        F.col(spec.unit).alias("unit"),
        F.col(spec.time).cast("bigint").alias("time"),
        none_if_nan(F.col(spec.target)).alias("y"),
    ).where(F.col("y").isNotNull())
    name = F.coalesce(F.col("unit").cast("string"), F.lit("NULL"))
    repeated = F.concat(
        F.lit("unbalanced panel: several rows for one unit and time, unit "), name, F.lit("; unbalanced_units lists them")
    )
    moving = F.concat(F.lit("several cohorts for unit "), name)
    # The two groupings are already satisfied by this one exchange.
    once = y.repartition(*unit).groupBy(*unit, "time").agg(
        F.when(F.count("*") == 1, F.max("y")).otherwise(F.raise_error(repeated)).alias("y"),
        F.max("cohort").alias("cohort"),
    )
    steady = (F.count("cohort") == 0) | ((F.count("cohort") == F.count("*")) & (F.min("cohort") == F.max("cohort")))
    return (
        once.groupBy(*unit)
        .agg(
            F.when(steady, F.max("cohort")).otherwise(F.raise_error(moving)).alias("cohort"),
            F.sort_array(F.collect_list(F.struct("time", "y"))).alias("obs"),
        )
        .select(*spec.by, "cohort", F.col("unit").cast("string").alias("unit"), F.col("obs.time").alias("times"), F.col("obs.y").alias("ys"))
    )


def unit_observations(units: DataFrame, spec: PanelSpec) -> DataFrame:
    """by..., cohort, unit, time, y: the rows that folded units were made of."""
    rows = F.inline(F.arrays_zip(F.col("times").alias("time"), F.col("ys").alias("y")))
    return units.select(*spec.by, "cohort", "unit", rows)


def salted_units(units: DataFrame, cells: DataFrame, spec: PanelSpec) -> DataFrame:
    """Folded units dealt to (group, salt), so that few groups meet in a task and a large one is many tasks.

    The number of salts follows the group's rows. Groups of more than one salt are written down, so the
    join knows their size in bytes.
    """
    keys = [*spec.by, "cohort"]
    large = freeze(
        cells.groupBy(*keys)
        .agg(F.sum("n").alias("_rows"))
        .where(F.col("_rows") > ROWS_PER_SALT)
        .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.ceil(F.col("_rows") / ROWS_PER_SALT).cast("bigint").alias("_salts")),
        "salts",
    )
    on = [units[k].eqNullSafe(large[f"_k_{k}"]) for k in keys]
    salt = F.pmod(F.xxhash64("unit"), F.coalesce("_salts", F.lit(1)))
    return units.join(large, on, "left").select(*units.columns, salt.alias("salt")).repartition(*keys, "salt")


def _codes(batch: pa.RecordBatch, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's key values, and the first row of every number."""
    codes = np.zeros(batch.num_rows, dtype=np.int64)
    for key in keys:
        encoded = batch.column(key).dictionary_encode(null_encoding="encode")
        codes = codes * len(encoded.dictionary) + encoded.indices.to_numpy()
        # numbers stay below the number of rows, whatever the number of keys
        _, first, codes = np.unique(codes, return_index=True, return_inverse=True)
    return codes, first


def _group_codes(batch: pa.RecordBatch, keys: list[str]) -> tuple[np.ndarray, list[tuple]]:
    """Group number per row, and the key values of every group number."""
    inverse, first = _codes(batch, keys)
    values = [tuple(batch.column(k)[int(i)].as_py() for k in keys) for i in first]
    return inverse, values


def _dense_blocks(
    batch: pa.RecordBatch, keys: list[str], times: np.ndarray
) -> Iterator[tuple[tuple, list[str], np.ndarray]]:
    """(group values, unit ids, units x times matrix with NaN where unobserved)."""
    lists = batch.column("times")
    lengths = np.diff(lists.offsets.to_numpy())
    row_of = np.repeat(np.arange(batch.num_rows), lengths)
    col_of = np.searchsorted(times, lists.flatten().to_numpy())
    dense = np.full((batch.num_rows, len(times)), np.nan)
    dense[row_of, col_of] = batch.column("ys").flatten().to_numpy()
    units = batch.column("unit")
    codes, values = _group_codes(batch, keys)
    for code, group in enumerate(values):
        members = np.flatnonzero(codes == code)
        for at in range(0, len(members), _BLOCK_UNITS):
            part = members[at : at + _BLOCK_UNITS]
            yield group, units.take(pa.array(part)).to_pylist(), dense[part]


def _summed(
    units: DataFrame,
    keys: list[str],
    times: list[int],
    sums_of: Callable[[tuple, list[str], np.ndarray], list[np.ndarray]],
    rows_of: Callable[[tuple, np.ndarray, list[np.ndarray]], dict[str, np.ndarray | list]],
    fields: list[T.StructField],
) -> DataFrame:
    """Add up `sums_of` over the blocks of a group within a task; `rows_of` lays the sums out."""
    key_fields = [units.schema[k] for k in keys]
    schema = T.StructType([*key_fields, *fields])
    grid = np.asarray(times, dtype=np.int64)
    names = schema.names

    def emit(open_groups: dict[tuple, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for group, sums in open_groups.items():
            out = rows_of(group, grid, sums)
            length = len(next(iter(out.values())))
            arrays = [
                pa.array([value] * length, type=arrow_types[k]) for k, value in zip(keys, group)
            ] + [pa.array(out[f.name], type=arrow_types[f.name]) for f in fields]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_groups: dict[tuple, list[np.ndarray]] = {}
        held_bytes = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for group, ids, block in _dense_blocks(batch, keys, grid):
                new = sums_of(group, ids, block)
                held = open_groups.get(group)
                if held is not None:
                    open_groups[group] = [a + b for a, b in zip(held, new)]
                    continue
                open_groups[group] = new
                held_bytes += sum(a.nbytes for a in new)
                if held_bytes > _OPEN_BYTES:
                    yield from emit(open_groups)
                    open_groups, held_bytes = {}, 0
        yield from emit(open_groups)

    arrow_types = {f.name: _arrow_type(f.dataType) for f in schema.fields}
    return units.mapInArrow(run, schema)


def _arrow_type(dtype: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(dtype)


@dataclass(frozen=True)
class Contrasts:
    """One part of a table of contrasts, as tasks use it.

    `groups` has, for each group of units, arrays over its entries: places of time t and of time s in
    `grid`, weight, mean difference, and key, in order of the key.
    """

    grid: np.ndarray
    n_keys: int
    groups: dict[tuple, tuple[np.ndarray, ...]]

    def chunks(self, group: tuple) -> Iterator[tuple[np.ndarray, ...]]:
        """Entries of a group, some at a time; those of one key together."""
        entries = self.groups.get(group)
        if entries is None:
            return
        key = entries[-1]
        heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        at = 0
        while at < len(key):
            later = heads[np.searchsorted(heads, at + ENTRIES_TOGETHER, "right") - 1] if at + ENTRIES_TOGETHER < len(key) else len(key)
            if later <= at:
                later = heads[heads > at][0] if (heads > at).any() else len(key)
            yield tuple(c[at:later] for c in entries)
            at = later


def _contrast_parts(
    entries: DataFrame, by: list[str], key: list[str], times: list[int], most: int
) -> Iterator[tuple[Contrasts, DataFrame]]:
    """Parts of at most about `most` entries, and the keys of each (by..., key..., `_k`: their number there).

    `entries` has by..., cohort, key..., t, s, w and mean; a key is in one part as a whole.
    """
    spark = entries.sparkSession
    written = freeze(entries, "contrasts")
    parts = max(-(-written.count() // most), 1)
    grid = np.asarray(times, dtype=np.int64)
    for part in range(parts):
        some = written.where(F.pmod(F.xxhash64(*by, *key), F.lit(parts)) == part).toArrow().combine_chunks()
        if not some.num_rows:
            continue
        batch = some.to_batches()[0]
        codes, first = _codes(batch, [*by, *key])
        names = batch.take(pa.array(first)).select([*by, *key])
        numbered = pa.Table.from_batches([names]).append_column("_k", pa.array(np.arange(len(first))))
        order = np.argsort(codes, kind="stable")
        members, groups = _group_codes(batch, [*by, "cohort"])
        columns = [np.searchsorted(grid, batch.column(c).to_numpy(zero_copy_only=False)) for c in ("t", "s")]
        columns += [batch.column(c).to_numpy(zero_copy_only=False) for c in ("w", "mean")] + [codes]
        table = {}
        for code, group in enumerate(groups):
            rows = order[members[order] == code]
            table[group] = tuple(c[rows] for c in columns)
        yield Contrasts(grid, len(first), table), spark.createDataFrame(numbered)


def _per_key(
    units: DataFrame,
    entries: DataFrame,
    by: list[str],
    key: list[str],
    times: list[int],
    names: list[str],
    add: Callable[[list[np.ndarray], np.ndarray, np.ndarray], None],
) -> DataFrame:
    """by..., key..., and the sums `names` over all units, as `add` makes them from a block of units.

    `add` gets the sums so far, the keys of some entries and weight * (y(t) - y(s) - mean) of these entries
    (rows) and units (columns), NaN where a unit lacks one of the times. Each task holds one number per key and
    name, and sends them on in segments; nothing is made per unit and key outside of a block.
    """
    out: DataFrame | None = None
    groups = [*by, "cohort"]
    for contrasts, keys in _contrast_parts(entries, by, key, times, PART_ENTRIES):
        shared = units.sparkSession.sparkContext.broadcast((contrasts.grid, contrasts.n_keys, contrasts.groups))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            part = Contrasts(*shared.value)
            # whole segments, as rows that are folded together hold equally long lists
            padded = -(-part.n_keys // SEGMENT) * SEGMENT
            sums = [np.zeros(padded) for _ in names]
            met = np.zeros(padded, bool)
            for batch in batches:
                if not batch.num_rows:
                    continue
                for group, _, block in _dense_blocks(batch, groups, part.grid):
                    turned = np.ascontiguousarray(block.T)
                    for t, s, w, mean, k in part.chunks(group):
                        add(sums, k, (turned[t] - turned[s] - mean[:, None]) * w[:, None])
                        met[k] = True
            for at in range(0, padded, SEGMENT):
                if met[at : at + SEGMENT].any():
                    columns = [pa.array([at // SEGMENT], pa.int64())] + [pa.array([a[at : at + SEGMENT]]) for a in sums]
                    yield pa.RecordBatch.from_arrays(columns, ["seg", *names])

        schema = "seg bigint, " + ", ".join(f"`{n}` array<double>" for n in names)
        partial = units.select(*groups, "unit", "times", "ys").mapInArrow(run, schema)
        zipped = F.arrays_zip(F.sequence(F.lit(0), F.size(names[0]) - 1).alias("i"), *names)
        rows = fold_lists(partial, ["seg"], names).select("seg", F.inline(zipped))
        found = keys.join(rows.withColumn("_k", F.col("seg") * SEGMENT + F.col("i")), "_k").drop("_k", "seg", "i")
        out = found if out is None else out.unionByName(found)
    if out is None:
        empty = entries.select(*by, *key).limit(0)
        return empty.withColumns({n: F.lit(0.0) for n in names})
    return out


def pair_sums(units: DataFrame, pairs: DataFrame, spec: PanelSpec, times: list[int]) -> DataFrame:
    """by..., cohort, t, s, n, mean: units of the group seen at both times, and their mean of y(t) - y(s).

    Only the pairs asked for are added up. A pair that no unit was seen at is left out.
    """

    def add(sums: list[np.ndarray], keys: np.ndarray, block: np.ndarray) -> None:
        sums[0][keys] += np.count_nonzero(~np.isnan(block), axis=1)
        sums[1][keys] += np.nansum(block, axis=1)

    entries = pairs.select(
        *spec.by, "cohort", F.col("cohort").alias("_g"), F.col("t").alias("_t"), F.col("s").alias("_s"), "t", "s",
        F.lit(1.0).alias("w"), F.lit(0.0).alias("mean"),
    )
    found = _per_key(units, entries, list(spec.by), ["_g", "_t", "_s"], times, ["_n", "_sum"], add)
    return found.where("_n > 0").select(
        *spec.by,
        F.col("_g").alias("cohort"),
        F.col("_t").alias("t"),
        F.col("_s").alias("s"),
        F.col("_n").cast("bigint").alias("n"),
        (F.col("_sum") / F.col("_n")).alias("mean"),
    )


def influence_squares(units: DataFrame, entries: DataFrame, by: list[str], key: list[str], times: list[int]) -> DataFrame:
    """by..., key..., var: the sum over units of their squared influence on the key's estimate.

    An entry (by..., cohort, key..., t, s, w, mean) adds w * (y(t) - y(s) - mean) to the influence of each unit of its
    group that is seen at both times, so every unit's influence follows its own pattern of times.
    """

    def add(sums: list[np.ndarray], keys: np.ndarray, block: np.ndarray) -> None:
        heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        influence = np.add.reduceat(np.nan_to_num(block, copy=False), heads, axis=0)
        sums[0][keys[heads]] += np.einsum("ij,ij->i", influence, influence)

    return _per_key(units, entries, by, key, times, ["var"], add)


def gram_matrices(units: DataFrame, cells: DataFrame, spec: PanelSpec, times: list[int]) -> DataFrame:
    """by..., cohort, gram: sums over a balanced group's units of products of deviations at two times.

    Deviations are from the group's means in `cells`; the list has a row of `times` for each of `times`. One
    pass over the units, however many groups there are.
    """
    keys = [*spec.by, "cohort"]
    in_order = F.sort_array(F.collect_list(F.struct("time", "mean")))
    means = freeze(
        cells.groupBy(*[F.col(k).alias(f"_m_{k}") for k in keys]).agg(F.transform(in_order, lambda c: c["mean"]).alias("_means")), "means"
    )
    same = [F.col(k).eqNullSafe(F.col(f"_m_{k}")) for k in keys]
    deviations = F.zip_with("ys", "_means", lambda y, mean: y - mean)
    centred = units.join(means, same).select(*keys, "unit", "times", deviations.alias("ys"))

    def sums_of(_group: tuple, _ids: list[str], block: np.ndarray) -> list[np.ndarray]:
        seen = np.nan_to_num(block, copy=False)
        return [(seen.T @ seen).ravel()]

    def rows_of(_group: tuple, _grid: np.ndarray, sums: list[np.ndarray]) -> dict[str, np.ndarray | list]:
        return {"gram": [sums[0]]}

    fields = [T.StructField("gram", T.ArrayType(T.DoubleType()))]
    partial = _summed(salted_units(centred, cells, spec), keys, times, sums_of, rows_of, fields)
    return fold_lists(partial, keys, ["gram"])


def contrast_squares(
    units: DataFrame, cells: DataFrame, entries: DataFrame, spec: PanelSpec, key: list[str], times: list[int]
) -> DataFrame:
    """`influence_squares` of a balanced panel, whose cost grows with units and entries but not with their product.

    Every unit of a group is seen at the same times, so its influence on a key is a sum of its deviations with
    weights that the group shares, and the sum of squares is the quadratic form of the weights in the group's
    matrix. A cohort has at most a few keys a time; the controls have all keys but few matrices, so that these
    are a join of their own.
    """
    by = list(spec.by)
    groups = [*by, "cohort"]
    grid = F.array(*[F.lit(t) for t in times]).cast("array<bigint>")

    def weight_at(time: str, weight: Column) -> Column:
        return F.struct((F.array_position(grid, F.col(time).cast("bigint")) - 1).cast("int").alias("i"), weight.alias("w"))

    both = F.inline(F.array(weight_at("t", F.col("w")), weight_at("s", -F.col("w"))))
    weights = freeze(
        # the two groupings are already satisfied by this one exchange
        entries.select(*groups, *key, both)
        .repartition(*groups, *key)
        .groupBy(*groups, *key, "i")
        .agg(F.sum("w").alias("w"))
        .groupBy(*groups, *key)
        .agg(F.collect_list(F.struct("i", "w")).alias("_weights")),
        "weights",
    )
    grams = freeze(gram_matrices(units, cells, spec, times), "grams")

    def row(x: Column) -> Column:
        return F.aggregate(
            "_weights", F.lit(0.0), lambda total, y: total + y["w"] * F.get("gram", x["i"] * len(times) + y["i"])
        )

    form = F.aggregate("_weights", F.lit(0.0), lambda total, x: total + x["w"] * row(x)).alias("_square")
    treated = F.col("cohort").isNotNull()
    found = weights.where(treated).join(grams.where(treated), groups).select(*by, *key, form)
    # written down, so that few matrices are broadcast
    control = freeze(grams.where(~treated).drop("cohort"), "control")
    never = weights.where(~treated)
    never = never.join(control, by) if by else never.crossJoin(control)
    return (
        found.unionByName(never.select(*by, *key, form))
        .groupBy(*by, *key)
        .agg(F.greatest(F.sum("_square"), F.lit(0.0)).alias("var"))
    )


def unit_signs(ids: list[str], seed: int, draws: int) -> np.ndarray:
    """units x draws matrix of -1/+1 read from the bits of md5(seed:unit:block)."""
    blocks = -(-draws // 128)
    digests = b"".join(
        hashlib.md5(f"{seed}:{u}:{k}".encode()).digest() for u in ids for k in range(blocks)
    )
    bits = np.unpackbits(np.frombuffer(digests, dtype=np.uint8)).reshape(len(ids), blocks * 128)
    return 1.0 - 2.0 * bits[:, :draws]


def unit_mammen(ids: list[str], seed: int, draws: int) -> np.ndarray:
    """units x draws matrix of Mammen's two-point weights (mean 0, variance 1)."""
    blocks = -(-draws // 4)
    digests = b"".join(
        hashlib.md5(f"{seed}:{u}:{k}".encode()).digest() for u in ids for k in range(blocks)
    )
    uniform = np.frombuffer(digests, dtype=">u4").reshape(len(ids), blocks * 4)[:, :draws] / 2**32
    root = np.sqrt(5.0)
    return np.where(uniform < (root + 1) / (2 * root), (1 - root) / 2, (1 + root) / 2)


def bootstrap_sums(
    units: DataFrame,
    cells: DataFrame,
    spec: PanelSpec,
    draws: int,
    seed: int,
    multiplier: str,
) -> DataFrame:
    """Per group and time, over the group's units: `s[b] = sum V_b y(t)` and `w[b] = sum V_b`.

    Weights depend on (seed, unit, b) only, so neither partitioning nor retries change them.
    """
    keys = [*spec.by, "cohort"]
    times = times_of(cells)
    weights = {"rademacher": unit_signs, "mammen": unit_mammen}[multiplier]

    def sums_of(_group: tuple, ids: list[str], block: np.ndarray) -> list[np.ndarray]:
        v = weights(ids, seed, draws)
        # Unit constants cancel in every difference over time, so centred outcomes will do.
        y = block - np.nanmean(block, axis=1, keepdims=True)
        return [np.nan_to_num(y).T @ v, v.sum(axis=0), np.nan_to_num(y).sum(axis=0)]

    def rows_of(_group: tuple, grid: np.ndarray, sums: list[np.ndarray]) -> dict[str, np.ndarray | list]:
        return {
            "time": grid,
            "s": list(sums[0]),
            "w": [sums[1]] * len(grid),
            "total": sums[2],
        }

    fields = [
        T.StructField("time", T.LongType()),
        T.StructField("s", T.ArrayType(T.DoubleType())),
        T.StructField("w", T.ArrayType(T.DoubleType())),
        T.StructField("total", T.DoubleType()),
    ]
    partial = _summed(salted_units(units, cells, spec), keys, times, sums_of, rows_of, fields)
    return fold_lists(partial, [*keys, "time"], ["s", "w"], ["total"])


def bootstrap_pairs(
    units: DataFrame, cells: DataFrame, stats: DataFrame, spec: PanelSpec, draws: int, seed: int, multiplier: str
) -> tuple[DataFrame, DataFrame]:
    """Bootstrap sums of a panel with gaps.

    Returns by..., cohort, t, s, z with `z[b] = sum V_b (y(t) - y(s) - mean) / n` over the units seen at both times (the
    pairs, sizes and means are those of `stats`), and by..., cohort, w with `w[b] = sum V_b` over all
    units of the group. Pairs are worked on in parts whose sums fit into a task.
    """
    by = list(spec.by)
    groups = [*by, "cohort"]
    times = times_of(cells)
    weights = {"rademacher": unit_signs, "mammen": unit_mammen}[multiplier]
    dealt = freeze(salted_units(units, cells, spec), "dealt")
    entries = stats.select(
        *by, "cohort", F.col("cohort").alias("_g"), F.col("t").alias("_t"), F.col("s").alias("_s"), "t", "s",
        (F.lit(1.0) / F.col("n")).alias("w"), "mean",
    )
    out: DataFrame | None = None
    for contrasts, keys in _contrast_parts(entries, by, ["_g", "_t", "_s"], times, max(PART_NUMBERS // draws, 1)):
        shared = units.sparkSession.sparkContext.broadcast((contrasts.grid, contrasts.n_keys, contrasts.groups))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            part = Contrasts(*shared.value)
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                for group, ids, block in _dense_blocks(batch, groups, part.grid):
                    v, turned = None, np.ascontiguousarray(block.T)
                    for t, s, w, mean, k in part.chunks(group):
                        v = weights(ids, seed, draws) if v is None else v
                        new = np.nan_to_num((turned[t] - turned[s] - mean[:, None]) * w[:, None]) @ v
                        for key, row in zip(k.tolist(), new, strict=True):
                            sums[key] = sums[key] + row if key in sums else row.copy()
            some = list(sums)
            for at in range(0, len(some), 256):
                rows = some[at : at + 256]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([sums[k] for k in rows])], ["_k", "z"])

        partial = dealt.select(*groups, "unit", "times", "ys").mapInArrow(run, "_k bigint, z array<double>")
        found = keys.join(fold_lists(partial, ["_k"], ["z"]), "_k").drop("_k")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = entries.select(*by, "_g", "_t", "_s").limit(0).withColumn("z", F.array(F.lit(0.0)))

    def sums_of(_group: tuple, ids: list[str], _block: np.ndarray) -> list[np.ndarray]:
        return [weights(ids, seed, draws).sum(axis=0)]

    def rows_of(_group: tuple, _grid: np.ndarray, sums: list[np.ndarray]) -> dict[str, np.ndarray | list]:
        return {"w": [sums[0]]}

    whole = _summed(dealt, groups, times, sums_of, rows_of, [T.StructField("w", T.ArrayType(T.DoubleType()))])
    renamed = out.select(*by, F.col("_g").alias("cohort"), F.col("_t").alias("t"), F.col("_s").alias("s"), "z")
    return renamed, fold_lists(whole, groups, ["w"])


def largest_draws(estimates: DataFrame, by: list[str]) -> DataFrame:
    """by..., largest: over all rows, the largest |draw| / std_error of each draw, as one list.

    Each task keeps one list a group; maxima merge like sums do. Rows without an error don't take part.
    """
    rows = estimates.where("std_error > 0").select(
        *by, F.transform("draws", lambda d: F.abs(d)).alias("draws"), "std_error"
    )
    schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("largest", T.ArrayType(T.DoubleType()))])
    types = {f.name: _arrow_type(f.dataType) for f in schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, groups = _group_codes(batch, by) if by else (np.zeros(batch.num_rows, np.int64), [()])
            values = batch.column("draws").flatten().to_numpy().reshape(batch.num_rows, -1)
            values = values / batch.column("std_error").to_numpy()[:, None]
            for code, group in enumerate(groups):
                top = values[codes == code].max(axis=0)
                held[group] = np.maximum(held[group], top) if group in held else top
        for group, top in held.items():
            arrays = [pa.array([v], types[c]) for c, v in zip(by, group, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([top], types["largest"])], schema.names)

    partial = rows.mapInArrow(run, schema)
    if by:
        return fold_lists(partial, by, ["largest"], how=np.maximum)
    whole = partial.withColumn("_all", F.lit(0))
    return fold_lists(whole, ["_all"], ["largest"], how=np.maximum).drop("_all")


def fold_lists(
    df: DataFrame, keys: list[str], lists: list[str], numbers: list[str] | None = None, how: np.ufunc = np.add
) -> DataFrame:
    """Element-wise sums (or another fold) of equally long list columns and of number columns per key.

    Rows meet sorted by key, so a task folds them as they stream by and holds one result; a key with
    very many rows is never gathered. Exploding the lists would shuffle a row per element instead.
    """
    numbers = numbers or []
    columns = [*keys, *lists, *numbers]
    narrow = df.select(*columns)
    schema = narrow.schema
    arrow_types = {f.name: _arrow_type(f.dataType) for f in schema.fields}

    def emit(runs: list[tuple[tuple, list[np.ndarray]]]) -> pa.RecordBatch:
        arrays = [
            pa.array([key[i] for key, _ in runs], type=arrow_types[k]) for i, k in enumerate(keys)
        ]
        for i, name in enumerate(lists):
            arrays.append(pa.array([sums[i] for _, sums in runs], type=arrow_types[name]))
        for i, name in enumerate(numbers):
            values = [float(sums[len(lists) + i][0]) for _, sums in runs]
            arrays.append(pa.array(values, type=arrow_types[name]))
        return pa.RecordBatch.from_arrays(arrays, names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[tuple, list[np.ndarray]] | None = None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            row_keys = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            starts = [0] + [i for i in range(1, n) if row_keys[i] != row_keys[i - 1]]
            values = [batch.column(c).flatten().to_numpy().reshape(n, -1) for c in lists]
            values += [batch.column(c).to_numpy().reshape(n, 1) for c in numbers]
            sums = [how.reduceat(v, starts, axis=0) for v in values]
            runs = [(row_keys[at], [s[j] for s in sums]) for j, at in enumerate(starts)]
            if held is not None and held[0] == runs[0][0]:
                runs[0] = (held[0], [how(a, b) for a, b in zip(held[1], runs[0][1])])
            elif held is not None:
                runs.insert(0, held)
            held = runs.pop()
            if runs:
                yield emit(runs)
        if held is not None:
            yield emit([held])

    return narrow.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
