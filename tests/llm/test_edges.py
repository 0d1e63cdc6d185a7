"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables and clashing extra columns."""

from __future__ import annotations

import pytest

from tickloom.llm import ann, licenses, mixing, neardup, packing, suffixdedup, tokencount, toxicity, vecdedup, webtext
from tickloom.llm.queries import tokenizer_file

DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, sequence_id string, g string, hash string, rep string, weight string, topic string"
LONG = "word " * 60_000


def model(docs):
    return toxicity.fit(docs, docs.sparkSession.createDataFrame([(0, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int"))


OPERATORS = {
    "near": neardup.near_duplicates,
    "keep_one": neardup.keep_one,
    "count": lambda d: tokencount.token_counts(d, tokenizer_file("piece_bpe_32k.model")),
    "prefix": lambda d: tokencount.prefix_table(d, tokenizer_file("piece_bpe_32k.model")),
    "mix": mixing.mix,
    "sample": mixing.sample,
    "score": lambda d: toxicity.score(d, model(d)),
    "reject": lambda d: toxicity.reject(d, model(d)),
    "digest": suffixdedup.digest,
    "remove": suffixdedup.remove,
    "pack": lambda d: packing.pack(d, tokenizer_file("word_bpe_49k.json")),
    "license": licenses.scan,
}
FEWER = {"keep_one", "sample", "reject", "pack"}


def rows():
    x = ("x",) * 8
    some = [(0, "a tie of words that is the same", "en", "s", 1, *x), (0, "a tie of words that is the same", "en", "s", 1, *x), (None, "no id", None, None, None, *(None,) * 8), (2, None, "de", "s", None, *x), (3, "", "", "", 0, *x)]
    return [*some, (4, LONG, "en", "t", 5, *x), (5, "a tie of words that is the same", "en", "t", 1, *x), (6, "\u0000퟿ é 😀", "en", "t", 1, *x)]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_documents(spark, name):
    docs = spark.createDataFrame(rows(), DOC).repartition(3)
    out = OPERATORS[name](docs).collect()
    assert out
    if name not in FEWER:
        assert len(out) == len(rows())
    empty = spark.createDataFrame([], DOC)
    assert OPERATORS[name](empty).collect() == []


def test_one_of_repeated_rows_stays(spark):
    kept = neardup.keep_one(spark.createDataFrame(rows(), DOC)).collect()
    ids = [r["doc_id"] for r in kept]
    assert sorted(i for i in ids if i is not None) == [0, 2, 4, 6]  # 3 is empty as 2 is
    assert ids.count(None) == 1


def test_pages(spark):
    schema = "page_id long, url string, html string, host string, root string, fixed string, text string"
    data = [(None, None, None, None, None, None, None), (1, "http://h/", "<p>" * 3000 + "deep", "h", "r", "f", "t"), (1, "http://h/", "<p>" * 3000 + "deep", "h", "r", "f", "t"), (2, "::", "<<>><a b='", "", "", "", "")]
    got = webtext.extract(spark.createDataFrame(data, schema)).collect()
    assert len(got) == 4 and [r["text"] for r in got if r["page_id"] == 1] == ["deep", "deep"]
    assert webtext.extract(spark.createDataFrame([], schema)).collect() == []


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int, id string, weight string, codes string, norm string"
    data = [(0, [1.0, 0.0], 0, *"abcd"), (0, [1.0, 0.0], 0, *"abcd"), (None, [1.0, 0.0], 0, *"abcd"), (100, [1.0, None], 0, *"abcd"), (3, [0.0, 1.0], None, *(None,) * 4), (4, [1.0, 0.0, 0.0], 0, *"abcd"), (5, [], 0, *"abcd")]
    df = spark.createDataFrame(data, schema)
    dup = vecdedup.duplicates(df).collect()
    assert len(dup) == 7 and sorted(r["n_links"] for r in dup) == [0, 0, 0, 0, 0, 1, 1]
    near = ann.nearest(df).collect()
    assert [(r["query_id"], r["vec_id"], r["rank"]) for r in near] == [(0, 3, 1)]
    empty = spark.createDataFrame([], schema)
    assert vecdedup.duplicates(empty).collect() == [] and ann.nearest(empty).collect() == []
