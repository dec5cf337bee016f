from __future__ import annotations

import hashlib

import corpus_pipeline
import pytest
import tokenizers
from test_set_ops import classes, fingerprint, hits
from test_text_ops import PATH

import __spark_entry__ as entry
from dqspark.llm import langid, pii, queries

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in table.collect()}
    judge = langid.classifier(langid.train(queries.training_rows(table)[0]))
    keys = sorted(rows)
    rejected = judge([rows[k].text for k in keys])[3]
    left = [k for k, gone in zip(keys, rejected, strict=True) if not gone]
    assert len(left) >= 0.95 * len(keys)
    groups = classes([fingerprint(rows[k].text) for k in left])
    left = [k for i, k in enumerate(left) if groups[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [k for k in left if not hits(rows[k].text, items)[1]]
    coder = tokenizers.Tokenizer.from_file(PATH)
    clean = {r.doc_id: r.text for r in pii.redact(table.where(table.doc_id.isin(left))).collect()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(got) == left
    for k in left:
        ids = coder.encode(clean[k], add_special_tokens=False).ids
        assert got[k].n_tokens == len(ids)
        assert got[k].decoded_sha256 == hashlib.sha256(coder.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_and_take_awkward_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(0, None, "en", "s", None, 1), (1, "", None, None, 0, 2), (2, "x", "en", "s", 1, 3), (2, "x", "en", "s", 1, 3), (None, "the and of the house with the", "en", "s", 9, 4), (5, "the words " * 50_000, "en", "s", 500_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint long")
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    assert 5 in {r.doc_id for r in out.collect()} or name == "language_id"
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_registered(spark):
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
