import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from panelfx.llm.fill_middle import ERROR, FimOptions, RankIndex, boundaries, fill_in_middle, restored
from panelfx.llm.queries import FIM_SQL, fill_middle

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = ["", None, " ", "a", "a ", " a  b\n", "é \x85 ü\t\t", "x" * 5000 + " y", "a <P> b", "<S>", "< M>", "<M", "\x00 \x00"]


def plain_row(doc_id, text, options=FimOptions()):
    text = text or ""
    units = TOKENS.findall(text)
    digest = hashlib.sha256(f"{options.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= options.rate:
        return (doc_id, len(units), "plain", None, None, text)
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < options.spm:
        return (doc_id, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}")
    return (doc_id, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é😀\n\t\x1c", max_size=60), min_size=1, max_size=8))
def test_boundaries_are_those_of_the_pattern(texts):
    _, _, values, heads = boundaries(pa.array(texts))
    for i, text in enumerate(texts):
        ends = np.cumsum([0, *(len(t.encode()) for t in TOKENS.findall(text))])
        assert values[heads[i] : heads[i + 1]].tolist() == ends.tolist()


def test_the_index_is_exact_and_its_error_bounded():
    rng = np.random.default_rng(2)
    shapes = [rng.integers(1, 9, 30_000), rng.integers(1, 9, 10), np.array([1, 10**6, 1, 1]), rng.pareto(0.7, 5000).astype(int) + 1, np.zeros(0, int)]
    texts = [np.concatenate([[0], np.cumsum(s)]) for s in shapes]
    heads = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    values = np.concatenate(texts)
    index = RankIndex(values, heads)
    assert (index.offsets(np.arange(len(values))) == values).all()
    assert np.isin(heads[:-1], index.first).all()
    assert len(index.first) < len(values) / 2
    piece = np.searchsorted(index.first, np.arange(len(values)), "right") - 1
    predicted = index.line(index.base[piece], index.slope[piece], np.arange(len(values)) - index.first[piece])
    assert np.abs(predicted - values).max() <= ERROR
    # evenly long tokens need one piece only
    assert len(RankIndex(np.arange(100_000) * 7, np.array([0, 100_000])).first) == 1


def test_rows_are_those_of_the_definition(spark):
    rng = np.random.default_rng(4)
    texts = TEXTS + ["".join(rng.choice(list("abé <PSM>\n"), 40)) for _ in range(300)]
    rows = [(i - 3, t) for i, t in enumerate(texts)] + [(None, "no id at all"), (5, "twice is twice"), (5, "twice is twice")]
    # ids of all forms
    rows += [(i, "one two  three\nfour five ") for i in range(1000, 1200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS n", "2 AS form", "3 AS output")
    found = fill_in_middle(docs)
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(repr(plain_row(*r)) for r in rows)
    assert {r.form for r in found.collect()} == {"plain", "psm", "spm"}
    back = sorted(r[0] for r in found.select(restored("output", "form")).collect())
    assert back == sorted(t or "" for _, t in rows)


def test_options_and_other_kinds_of_ids(spark):
    options = FimOptions(seed=7, rate=100, spm=0)
    docs = spark.createDataFrame([("x1", "a b c"), ("", "d e"), (None, "f g")], "doc_id string, text string")
    found = {r.doc_id: tuple(r) for r in fill_in_middle(docs, options).collect()}
    assert found == {d: plain_row(d, t, options) for d, t in [("x1", "a b c"), ("", "d e"), (None, "f g")]}


def test_a_long_text_and_an_empty_table(spark):
    long = "wort und " * 400_000
    docs = spark.createDataFrame([(i, long) for i in range(6)], "doc_id bigint, text string")
    rows = fill_in_middle(docs).select("doc_id", "n", "form", restored("output", "form").alias("t")).collect()
    assert all(r.n == 800_001 and r.t == long for r in rows)
    assert fill_in_middle(docs.limit(0)).count() == 0


def test_the_query_matches_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
    expected = con.sql(FIM_SQL).select(*names).fetchall()
    assert sorted(map(repr, expected)) == sorted(repr(tuple(r)) for r in fill_middle(spark, folder).select(*names).collect())
