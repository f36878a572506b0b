"""Secret scans by patterns and by character Markov models, with DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelfx.llm.texts import unused

# The three base patterns. Matches are leftmost and do not overlap within a kind.
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
# A run that is too short fails as a whole, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")

SYMBOLS = "A-Za-z0-9+/_=-"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SPAN = "array<struct<start:int,kind:int,end:int>>"
# Elements of a running total that are added up one by one, and characters of a text cut out together.
TOGETHER = 256
BLOCK = 4096


@dataclass(frozen=True)
class MarkovOptions:
    """When a string without a pattern counts as a secret.

    Candidates are runs of `least` or more of the alphabet's characters. A run is reported when its
    log-likelihood ratio reaches `total` and its mean per character `mean`. `flat` and `sharp` are the
    pseudo-counts of each transition in the model of random strings and of ordinary identifiers;
    max_samples bounds the labelled strings of each label used in training, max_docs the texts that
    give ordinary identifiers.
    """

    least: int = 20
    total: float = 15.0
    mean: float = 0.5
    flat: float = 20.0
    sharp: float = 0.5
    max_samples: int = 20_000
    max_docs: int = 2_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also where `body` looks at it for each element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Fold of all elements of a bigint array up to each one, from 0 on.

    Appending to an array copies it, so elements are folded in blocks first and then the blocks' results: of n
    elements about n * TOGETHER / 2 are copied, not n * n / 2.
    """
    empty = F.array().cast("array<bigint>")
    zero = F.lit(0).cast("bigint")

    def fold(items: Column) -> Column:
        start = F.struct(zero.alias("at"), empty.alias("all"))

        def add(state: Column, item: Column) -> Column:
            return let(
                step(state["at"], item),
                lambda now: F.struct(now.alias("at"), F.concat(state["all"], F.array(now)).alias("all")),
            )

        return F.aggregate(items, start, add)

    def by_blocks(items: Column) -> Column:
        begins = F.sequence(F.lit(1), F.size(items), F.lit(TOGETHER))
        blocks = F.transform(begins, lambda i: fold(F.slice(items, i, F.lit(TOGETHER))))

        def joined(done: Column) -> Column:
            ends = fold(F.transform(done, lambda d: d["at"]))["all"]
            before = F.slice(F.concat(F.array(zero), ends), F.lit(1), F.size(done))
            return F.flatten(F.zip_with(done, before, lambda d, b: F.transform(d["all"], lambda x: step(b, x))))

        return let(blocks, joined)

    return let(values, lambda items: F.when(F.size(items) > 0, by_blocks(items)).otherwise(empty))


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern: array of (start, end, hit, judged), in code points; judged is the group's text.

    Places are running totals of the lengths of matches and of the gaps between them.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.array().cast("array<string>")
    found = F.struct(F.split(text, pattern, -1).alias("gaps"), hits.alias("hits"), judged.alias("judged"))

    def placed(f: Column) -> Column:
        steps = F.zip_with(
            F.slice(f["gaps"], F.lit(1), F.size(f["hits"])), f["hits"], lambda g, h: (F.length(g) + F.length(h)).cast("bigint")
        )
        ends = running(steps, lambda a, b: a + b)
        rows = F.arrays_zip(ends.alias("end"), f["hits"].alias("hit"), (f["judged"] if group else f["hits"]).alias("judged"))
        return F.transform(
            rows,
            lambda r: F.struct(
                (r["end"] - F.length(r["hit"])).cast("int").alias("start"), r["end"].cast("int").alias("end"), r["hit"], r["judged"]
            ),
        )

    return let(found, placed)


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of the matches whose judged text is long enough."""
    long_enough = F.filter(_matches(text, pattern, group), lambda m: F.length(m["judged"]) >= F.lit(max(least, 1)))
    return F.transform(long_enough, lambda m: F.struct(m["start"], F.lit(kind).alias("kind"), m["end"]))


def no_spans() -> Column:
    return F.array().cast(SPAN)


def base_spans(text: Column) -> Column:
    """All base spans of a text, sorted by start, then kind; a null text has none."""
    lowered = F.lower(text)
    named = F.contains(lowered, F.lit(KEYWORDS[0]))
    for word in KEYWORDS[1:]:
        named = named | F.contains(lowered, F.lit(word))
    assign = F.when(named, _spans(text, ASSIGN, 1, 2, ASSIGN_LEAST)).otherwise(no_spans())
    access = F.when(F.contains(text, F.lit("AKIA")), _spans(text, ACCESS, 2)).otherwise(no_spans())
    hexes = F.when(text.rlike(HEX), _spans(text, HEX, 3)).otherwise(no_spans())
    return F.array_sort(F.concat(assign, access, hexes))


def _values(text: Column) -> Column:
    """What the base patterns' matches hold: the value of an assignment, or the match itself."""
    named = F.filter(_matches(text, ASSIGN, 2), lambda m: F.length(m["judged"]) >= F.lit(ASSIGN_LEAST))
    others = [F.transform(_matches(text, p), lambda m: m["hit"]) for p in (ACCESS, HEX)]
    return F.concat(F.transform(named, lambda m: F.rtrim(F.lit(".="), m["judged"])), *others)


def _identifiers(text: Column) -> Column:
    """Words of three or more letters, and three neighbouring words at a time written as an identifier.

    Identifiers are what programs, paths and links have instead of prose: words joined by `_`, `-` or `/`, or by
    their capitals, in capitals, or with a number; which of these, the words' hash decides.
    """
    found = F.regexp_extract_all(text, F.lit("[A-Za-z]{3,}"), F.lit(0))

    def written(words: Column) -> Column:
        triples = F.transform(
            F.sequence(F.lit(1), F.size(words) - 2, F.lit(3)), lambda i: F.slice(words, i, F.lit(3))
        )

        def style(t: Column) -> Column:
            def joined(sep: str, each: Callable[[Column], Column]) -> Column:
                return F.array_join(F.transform(t, each), sep)

            number = F.pmod(F.crc32(F.concat_ws(" ", t).cast("binary")), F.lit(1000))
            low, high, camel = F.lower, F.upper, F.initcap
            forms = [
                joined("_", low), joined("-", low), joined("/", low), joined("", camel),
                F.concat(F.lower(t[0]), joined("", camel)), joined("_", high), joined("-", camel),
                F.concat(joined("_", low), F.lit("_"), number.cast("string")), F.concat(joined("", camel), number.cast("string")),
                F.concat(joined("/", camel), F.lit("/"), number.cast("string")),
            ]
            return F.element_at(F.array(*forms), (F.pmod(F.hash(F.concat_ws(" ", t)), F.lit(len(forms))) + 1).cast("int"))

        return F.when(F.size(words) >= 3, F.concat(words, F.transform(triples, style))).otherwise(words)

    return let(found, written)


def labelled_strings(docs: DataFrame, options: MarkovOptions) -> DataFrame:
    """(string, label) to train on: the values of base matches are 1, words and identifiers made of them 0.

    `docs` has columns text and base. Matches come from all documents, words from max_docs different
    texts chosen by hash; each label is bounded to max_samples different strings, chosen by hash.
    """
    matched = docs.where(F.size("base") > 0).select(F.explode(_values(F.col("text"))).alias("string"))
    text_key = F.xxhash64(F.lit(2), "text")
    chosen = docs.where("text <> ''").select(text_key.alias("_key")).distinct().orderBy("_key").limit(options.max_docs)
    few = docs.select("text", text_key.alias("_key")).join(F.broadcast(chosen), "_key").dropDuplicates(["_key"])
    ordinary = few.select(F.explode(_identifiers(F.col("text"))).alias("string"))

    def bounded(strings: DataFrame, label: int) -> DataFrame:
        key = F.xxhash64(F.lit(label), "string")
        kept = strings.where("string <> ''").distinct().orderBy(key, "string").limit(options.max_samples)
        return kept.select("string", F.lit(label).alias("label"))

    return bounded(matched, 1).unionByName(bounded(ordinary, 0))


def train_markov(samples: DataFrame, options: MarkovOptions = MarkovOptions()) -> list[float]:
    """Log-likelihood ratio of every transition, row by row of the alphabet (and 0 for other characters).

    `samples` has columns string and label (1 random, 0 ordinary; others and nulls are left out).
    Transition counts are aggregated by Spark; at most two tables of alphabet size squared reach the
    driver. Without samples of a label its model is uniform.
    """

    def neighbours(chars: Column) -> Column:
        most = F.size(chars) - 1
        return F.zip_with(F.slice(chars, F.lit(1), most), F.slice(chars, F.lit(2), most), lambda a, b: F.concat(a, b))

    pairs = (
        samples.where("label IN (0, 1) AND length(string) > 1")
        .select("label", F.explode(let(F.split("string", ""), neighbours)).alias("pair"))
        .where(F.col("pair").rlike(f"^[{SYMBOLS}]{{2}}$"))
        .groupBy("label", "pair")
        .count()
        .collect()
    )
    size = len(ALPHABET)
    counts = [[[0.0] * size for _ in range(size)] for _ in range(2)]
    place = {c: i for i, c in enumerate(ALPHABET)}
    for row in pairs:
        if row["pair"][0] in place and row["pair"][1] in place:
            counts[row["label"]][place[row["pair"][0]]][place[row["pair"][1]]] += row["count"]
    ratios = []
    for plain, wild in zip(*counts, strict=True):
        a, b = sum(wild) + options.flat * size, sum(plain) + options.sharp * size
        ratios += [
            round(math.log((w + options.flat) / a) - math.log((p + options.sharp) / b), 6)
            for p, w in zip(plain, wild, strict=True)
        ]
    return ratios


def markov_score(run: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of a run of the alphabet's characters, summed over its transitions."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    places = [max(ALPHABET.find(chr(c)), 0) for c in range(128)]
    code = F.split(F.lit(",".join(map(str, places))), ",").cast("array<int>")

    def summed(codes: Column) -> Column:
        most = F.size(codes) - 1
        steps = F.zip_with(
            F.slice(codes, F.lit(1), most),
            F.slice(codes, F.lit(2), most),
            lambda a, b: F.element_at(table, a * len(ALPHABET) + b + 1),
        )
        return F.aggregate(steps, F.lit(0.0), lambda total, x: total + x)

    return let(F.transform(F.split(run, ""), lambda c: F.element_at(code, F.ascii(c) + 1)), summed)


def _free_of(base: Column, candidates: Column) -> Column:
    """The candidates that touch no base span: of the base spans that begin before a candidate's end (found by
    bisection), none ends after its start."""
    starts = F.transform(base, lambda b: b["start"])
    reach = running(F.transform(base, lambda b: b["end"].cast("bigint")), lambda a, b: F.greatest(a, b))
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])

    def free(s: Column) -> Column:
        def untouched(c: Column) -> Column:
            def narrowed(found: Column, step: Column) -> Column:
                later = found + step
                below = (later <= F.size(s["starts"])) & (F.get(s["starts"], later - 1) < c["end"])
                return F.when(below, later).otherwise(found)

            before = F.aggregate(steps, F.lit(0), narrowed)
            return F.coalesce(F.get(s["reach"], before - 1) <= c["start"], F.lit(True))

        return F.filter(s["candidates"], untouched)

    return let(F.struct(starts.alias("starts"), reach.alias("reach"), candidates.alias("candidates")), free)


def markov_spans(text: Column, base: Column, ratios: list[float], options: MarkovOptions) -> Column:
    """Candidate runs that look random under the two models and touch no base span."""
    pattern = f"(?<![{SYMBOLS}])[{SYMBOLS}]{{{options.least},}}"

    def wild(m: Column) -> Column:
        n = m["end"] - m["start"]
        return let(markov_score(m["hit"], ratios), lambda v: (v >= options.total) & (v >= options.mean * n))

    found = F.filter(_free_of(base, _matches(text, pattern)), wild)
    spans = F.transform(found, lambda m: F.struct(m["start"], F.lit(4).alias("kind"), m["end"]))
    return F.when(text.rlike(pattern), spans).otherwise(no_spans())


def spelled(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"], s["end"])), ","
    )


def secret_spans(docs: DataFrame, options: MarkovOptions = MarkovOptions(), samples: DataFrame | None = None) -> DataFrame:
    """`docs` with columns base and spans: arrays of (start, kind, end), ends exclusive, in code points.

    Base spans follow the patterns; the Markov models add runs that no pattern covers, and spans has
    both, by start, then kind. The models are trained on `samples` (string, label), or on strings
    that the base patterns label in the documents. A null or empty text has no spans. All rows are
    kept, columns named base or spans are replaced; the scan itself is one pass without a shuffle.
    """
    read = docs.drop("base", "spans")
    text = F.coalesce(F.col("text"), F.lit(""))
    with_base = read.withColumn("base", base_spans(text))
    if samples is None:
        samples = labelled_strings(with_base, options)
    ratios = train_markov(samples, options)
    return with_base.withColumn(
        "spans", F.array_sort(F.concat("base", markov_spans(text, F.col("base"), ratios, options)))
    )


def _without(text: Column, spans: Column, mark: str) -> Column:
    """The text with a mark for every span, or for several that overlap.

    Its blocks are cut once; what lies between spans is taken from the blocks it is in, so a text with many
    spans is not read from its start for each of them.
    """
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    reach = running(F.transform(spans, lambda s: s["end"].cast("bigint")), lambda a, b: F.greatest(a, b))
    state = F.struct(blocks.alias("blocks"), reach.alias("reach"), spans.alias("spans"), F.length(text).cast("bigint").alias("n"))

    def replaced(s: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            first, last = (F.floor(x / BLOCK).cast("int") for x in (a, b - 1))
            head, tail = F.pmod(a, F.lit(BLOCK)).cast("int"), F.pmod(b - 1, F.lit(BLOCK)).cast("int")
            one = F.substring(F.get(s["blocks"], first), head + 1, (b - a).cast("int"))
            middle = F.array_join(F.slice(s["blocks"], first + 2, last - first - 1), "")
            many = F.concat(F.substring(F.get(s["blocks"], first), head + 1, F.lit(BLOCK)), middle, F.substring(F.get(s["blocks"], last), F.lit(1), tail + 1))
            return F.when(b <= a, F.lit("")).when(first == last, one).otherwise(many)

        before = F.concat(F.array(F.lit(0).cast("bigint")), s["reach"])
        rows = F.arrays_zip(s["spans"].alias("span"), F.slice(before, F.lit(1), F.size(s["spans"])).alias("from"))
        apart = F.filter(rows, lambda r: r["span"]["start"] >= r["from"])
        pieces = F.transform(apart, lambda r: F.concat(between(r["from"], r["span"]["start"].cast("bigint")), F.lit(mark)))
        return F.concat(F.array_join(pieces, ""), between(F.element_at(s["reach"], -1), s["n"]))

    return let(state, replaced)


def redact(docs: DataFrame, mark: str = "[secret]", options: MarkovOptions = MarkovOptions()) -> DataFrame:
    """`docs` with every span of its text replaced by `mark`, overlapping ones by one.

    n_chars, if there, becomes the new length of a changed text. Rows without spans do not change.
    """
    names = docs.columns
    # columns of the operator's own names are put aside
    aside = {c: unused(f"{c}_aside", names) for c in names if c.lower() in ("base", "spans")}
    flag = unused("changed", names)
    found = secret_spans(docs.withColumnsRenamed(aside), options)
    changed = F.size("spans") > 0
    columns = {"text": F.when(changed, _without(F.col("text"), F.col("spans"), mark)).otherwise(F.col("text"))}
    cleaned = found.select(*[columns.get(c, F.col(aside.get(c, c))).alias(c) for c in names], changed.alias(flag))
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        cleaned = cleaned.withColumn("n_chars", F.when(F.col(flag), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cleaned.select(*names)
