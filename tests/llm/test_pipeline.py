"""Each stage of the pipeline against a brute-force version of it, on its own input."""

from __future__ import annotations

import os

import pyarrow as pa
import pytest

import corpus_pipeline
from tickloom.llm import mixing, packing, toxicity
from tickloom.llm.queries import tokenizer_file

from .test_operators import brute_classes, brute_removed

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        seen.append((docs.orderBy("doc_id").toPandas(), out.orderBy("doc_id").toPandas(), docs))
        docs = out
    assert all(o.columns.tolist() == columns for _, o, _ in seen[:-1])

    before, after, df = seen[0]
    model = toxicity.fit(df, spark.read.parquet(f"{SF}/labels.parquet"))
    assert after.doc_id.tolist() == sorted(r["doc_id"] for r in toxicity.score(df, model).where("predicted = 0").collect())

    before, after, _ = seen[1]
    classes = brute_classes(before.text.tolist())
    assert after.doc_id.tolist() == [d for i, d in enumerate(before.doc_id) if classes[i] == i]

    before, after, _ = seen[2]
    raw = [t.encode() for t in before.text]
    left = [bytes(c for c, x in zip(b, m, strict=True) if not x).decode(errors="ignore") for b, m in zip(raw, brute_removed(raw, 200), strict=True)]
    assert after.text.tolist() == left and after.n_chars.tolist() == [len(t) for t in left]

    before, after, df = seen[3]
    assert after.doc_id.tolist() == sorted(r["doc_id"] for r in mixing.mix(df, keep=0.5).where("sampled").collect())
    assert 0 < len(after) < len(before)

    before, after, _ = seen[4]
    e = packing.WordIds(tokenizer_file("word_bpe_49k.json"))
    size = {d: len(ids) for d, ids in zip(before.doc_id, e.encode(pa.array(before.text.tolist())), strict=True)}
    assert after.groupby("doc_id").length.sum().to_dict() == size
    assert after.groupby("sequence_id").length.sum().max() <= 2048
