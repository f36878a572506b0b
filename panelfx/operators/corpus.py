"""Token corpora: words, vocabulary, ids, counts, fixed-length packing, next-token pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelfx.functions import inputs_of, labels_of
from panelfx.operators.ordering import range_index, running_total
from panelfx.session import freeze

PACKED_LENGTH = 2049  # fixed value: 2048 predicted positions and the first token
# Fewest tokens of a part that is packed in one go.
PART_TOKENS = 1_000_000
FIRST_PACKED_ID = -100  # fixed value: packed rows are numbered -100, -101, ...
# Bounds of the broadcast part of a vocabulary, some tens of megabytes at the very most.
HEAD_WORDS = 1_000_000
HEAD_WORD_CHARS = 32


def words_of(text: Column) -> Column:
    """Whitespace-separated words; an empty list for blank text."""
    return F.array_remove(F.split(text, r"\s+"), "")


def token_frequency(tokens: DataFrame, column: str = "input_ids") -> DataFrame:
    """Count per distinct token. Every task counts its own rows before the shuffle."""
    return (
        tokens.select(F.explode(column).alias("token")).groupBy("token").agg(F.count("*").alias("count"))
    )


def vocabulary(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, token_id, count): ids count from 0 by falling frequency, then by token."""
    counts = token_frequency(docs.select(words_of(F.col(text)).alias("words")), "words")
    falling = counts.withColumn("_falling", -F.col("count"))
    ranked = running_total(falling, ["_falling", "token"], F.lit(1), "token_id")
    return ranked.select("token", F.col("token_id").cast("int").alias("token_id"), "count")


def _look_up_head(words: DataFrame, head: pa.Table, doc_id: str) -> DataFrame:
    """(doc_id, ids, pos, token): ids NULL where a word is not in `head`; these words in the lists.

    A hash lookup of whole Arrow batches against the broadcast head; a document's words stay
    together, so nothing is exploded and nothing is shuffled.
    """
    shared = words.sparkSession.sparkContext.broadcast(
        (head["token"].combine_chunks(), head["token_id"].combine_chunks())
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_ids = shared.value
        for batch in batches:
            lists = batch.column("words")
            offsets = lists.offsets.to_numpy()
            ends = pa.array(offsets - offsets[0])
            flat = lists.flatten()
            ids = known_ids.take(pc.index_in(flat, value_set=known))
            missed = np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False))
            missed_ends = np.searchsorted(missed, offsets - offsets[0]).astype(np.int32)
            own_start = np.repeat(offsets[:-1] - offsets[0], np.diff(missed_ends))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(doc_id),
                    pa.ListArray.from_arrays(ends, ids),
                    pa.ListArray.from_arrays(
                        pa.array(missed_ends), pa.array((missed - own_start).astype(np.int32))
                    ),
                    pa.ListArray.from_arrays(pa.array(missed_ends), flat.take(pa.array(missed))),
                ],
                names=[doc_id, "ids", "pos", "token"],
            )

    schema = T.StructType(
        [
            words.schema[doc_id],
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("pos", T.ArrayType(T.IntegerType())),
            T.StructField("token", T.ArrayType(T.StringType())),
        ]
    )
    return words.mapInArrow(run, schema)


def tokenize(
    docs: DataFrame,
    vocab: DataFrame | None = None,
    tokenizer: Callable[[Iterator[pd.Series]], Iterator[pd.Series]] | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    unknown_id: int | None = None,
) -> DataFrame:
    """(doc_id, input_ids) from text.

    With `tokenizer`, a function over batches of texts, or with a vocabulary of at most `HEAD_WORDS`
    short words, nothing is shuffled. Of a larger vocabulary that many of the lowest ids, which are
    the most frequent words, are broadcast; only words that are not among them are shuffled, to be
    joined with the rest. A word outside the vocabulary, or without an id in it, becomes `unknown_id`,
    or an error where that is not given. Every row of `docs` gives one row, whatever its id.
    """
    if tokenizer is not None:

        def batched(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            yield from tokenizer(texts)

        as_ids = F.pandas_udf(batched, "array<int>")
        return docs.select(doc_id, as_ids(text).alias("input_ids"))
    if vocab is None:
        raise ValueError("give a vocabulary or a tokenizer")
    # written down once: the broadcast part, the rest and the join read it
    ids = freeze(vocab.select("token", F.col("token_id").cast("int").alias("token_id")).where("token_id IS NOT NULL"), "vocabulary")
    in_head = (F.col("token_id") < HEAD_WORDS) & (F.length("token") <= HEAD_WORD_CHARS)
    head, tail = ids.where(in_head).toArrow(), ids.where(~in_head)
    words = docs.select(doc_id, F.coalesce(words_of(F.col(text)), F.array()).alias("words"))
    coded = _look_up_head(words, head, doc_id)
    if tail.isEmpty():
        fallback = (
            F.lit(unknown_id).cast("int")
            if unknown_id is not None
            else F.raise_error(
                F.concat(F.lit("word outside the vocabulary: "), F.col("token")[0])
            ).cast("int")
        )
        filled = F.transform("ids", lambda i: F.coalesce(i, fallback))
        complete = F.when(F.size("pos") == 0, F.col("ids")).otherwise(filled)
        return coded.select(doc_id, complete.alias("input_ids"))
    # rows meet their rare words again by a number, written down with them: ids may repeat or be NULL
    coded = freeze(coded.withColumn("_row", F.monotonically_increasing_id()), "coded")
    rare = coded.select("_row", F.inline(F.arrays_zip("pos", "token"))).join(tail, "token", "left")
    outside = (
        F.lit(unknown_id).cast("int")
        if unknown_id is not None
        else F.raise_error(F.concat(F.lit("word outside the vocabulary: "), F.col("token")))
    )
    found = rare.groupBy("_row").agg(
        F.collect_list(F.struct("pos", F.coalesce("token_id", outside).alias("id"))).alias("found")
    )
    placed = F.transform("ids", lambda i, at: F.struct(at.alias("pos"), i.alias("id")))
    common = F.filter(placed, lambda p: p["id"].isNotNull())
    merged = F.sort_array(F.concat(common, "found"))
    return (
        coded.select(doc_id, "_row", "ids")
        .join(found, "_row", "left")
        .select(
            doc_id,
            F.when(F.col("found").isNull(), F.col("ids"))
            .otherwise(F.transform(merged, lambda p: p["id"]))
            .alias("input_ids"),
        )
    )


def pack_sequences(
    tokenized: DataFrame, length: int = PACKED_LENGTH, doc_id: str = "doc_id"
) -> DataFrame:
    """Join all token lists in document order and cut them into rows of `length`.

    Ids must be there and unique, or this raises. Nothing is put between documents; the incomplete
    last row is left out. A distributed running total over (doc_id, number of tokens) gives parts of
    about equally many tokens and the place at which each begins. Tokens are then shuffled once, to
    their parts in order; a task cuts whole rows out of its stream of lists as they come, and only the two
    pieces at a part's borders travel again. A NULL list counts as empty.
    """
    spark = tokenized.sparkSession
    known = F.when(F.col(doc_id).isNotNull(), F.coalesce(F.size("input_ids"), F.lit(0))).otherwise(
        F.raise_error(F.lit("NULL or repeated id: NULL"))
    )
    sizes = tokenized.select(doc_id, F.greatest(known, F.lit(0)).alias("_n"))
    starts = running_total(sizes, [doc_id], F.col("_n"), "_start")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    total = starts.agg(F.max(F.col("_start") + F.col("_n"))).first()[0] or 0
    # more parts than tasks, as parts are dealt by hash
    width = max(total // (4 * tasks), PART_TOKENS)
    begins = (
        starts.groupBy(F.floor(F.col("_start") / width).alias("_part"))
        .agg(F.min(doc_id).alias("id"), F.min("_start").alias("start"))
        .orderBy("start", "id")
        .collect()
    )
    ids, offsets = [r["id"] for r in begins], [r["start"] for r in begins]
    placed = (
        tokenized.select(doc_id, F.coalesce("input_ids", F.array()).alias("input_ids"))
        .withColumn("_part", range_index(F.col(doc_id), ids[1:]))
        .repartition(min(max(len(ids), 1), tasks), "_part")
        .sortWithinPartitions("_part", doc_id)
    )
    tokens = tokenized.schema["input_ids"]
    schema = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("begin", T.LongType()), T.StructField("input_ids", tokens.dataType),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last_id, at, held = None, None, 0, None

        def rows(begin: int, values: pa.Array, ends: np.ndarray) -> pa.RecordBatch:
            begins = begin + ends[:-1]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            return pa.RecordBatch.from_arrays([pa.array(begins // length), pa.array(begins), lists], schema.names)

        def whole(values: pa.Array, begin: int, close: bool) -> tuple[pa.RecordBatch | None, pa.Array, int]:
            """Rows and pieces that end within `values`, and what is left; everything at the end of a part."""
            first = min(-begin % length, len(values))
            ends = np.arange(first, len(values) + 1, length, dtype=np.int64)
            if not close and first < -begin % length:
                return None, values, begin
            ends = np.unique(np.concatenate([[0], ends, [len(values)] if close else []]).astype(np.int64))
            if len(ends) < 2:
                return None, values, begin
            done = int(ends[-1])
            return rows(begin, values.slice(0, done), ends), values.slice(done), begin + done

        for batch in batches:
            if not batch.num_rows:
                continue
            parts, names = batch.column("_part").to_numpy(), batch.column(doc_id).to_pylist()
            for before, after in zip([last_id, *names], names, strict=False):
                if before == after:
                    raise ValueError(f"NULL or repeated id: {after}")
            last_id = names[-1]
            cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if parts[a] != part:
                    if held is not None and len(held):
                        yield whole(held, at, True)[0]
                    part, at, held = int(parts[a]), offsets[int(parts[a])], None
                new = batch.column("input_ids").slice(a, b - a).flatten()
                held = new if held is None or not len(held) else pa.concat_arrays([held, new])
                out, held, at = whole(held, at, False)
                if out is not None:
                    yield out
        if held is not None and len(held):
            yield whole(held, at, True)[0]

    # written down: rows are read twice, and a lost executor costs no part again
    pieces = freeze(placed.mapInArrow(cut, schema), "pieces")
    complete = F.size("input_ids") == length
    joined = (
        pieces.where(~complete)
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("begin", "input_ids"))).alias("p"))
        .select("row", F.flatten("p.input_ids").alias("input_ids"))
    )
    return (
        pieces.select("row", "input_ids")
        .unionByName(joined)
        .where(complete)
        .select((F.lit(FIRST_PACKED_ID) - F.col("row")).cast("bigint").alias("seq_idx"), "input_ids")
    )


def next_token_pairs(sequences: DataFrame, unit: str = "seq_idx", column: str = "input_ids") -> DataFrame:
    """(unit, pos, token, label): the token at pos and the one it predicts. No shuffle."""
    both = F.arrays_zip(
        inputs_of(F.col(column)).alias("token"), labels_of(F.col(column)).alias("label")
    )
    return sequences.select(unit, F.posexplode(both).alias("pos", "pair")).select(
        unit, "pos", "pair.token", "pair.label"
    )


def sequence_lookup(
    sequences: DataFrame, wanted: DataFrame, unit: str = "seq_idx"
) -> DataFrame:
    """Rows of `wanted` with their token lists, sorted by id within partitions."""
    # written down, so that its size in bytes decides whether the token lists have to move
    return sequences.join(freeze(wanted, "wanted"), unit).sortWithinPartitions(unit)


def union_splits(**splits: DataFrame) -> DataFrame:
    """All splits as one table with a `split` column."""
    frames = [df.withColumn("split", F.lit(name)) for name, df in splits.items()]
    if not frames:
        raise ValueError("no splits given")
    whole = frames[0]
    for other in frames[1:]:
        whole = whole.unionByName(other)
    return whole
