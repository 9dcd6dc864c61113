"""The pipeline's stages, each against plain Python on what the stage before it kept."""

import base64

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.test_operators import HARD, hard, python_components, python_overlap, python_quality_score
from wanderframe.llm import quality_classifier, secret_scan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.orderBy("doc_id").collect()]


def test_stages_do_what_plain_python_does(spark, outputs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality_classifier.fitted(table, spark.read.parquet(f"{SF}/labels.parquet"))
    good, distinct, clean, redacted, tokens = outputs
    assert texts(good) == [(i, t) for i, t in texts(table) if python_quality_score(model, t) >= 0.5]
    assert {i for i, _ in texts(distinct)} == {d for d, _, c in python_components(texts(good)) if d == c}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert texts(clean) == [(i, t) for i, t in texts(distinct) if not python_overlap(t, items)[3]]
    scanner = secret_scan.Scanner()
    assert texts(redacted) == [(i, secret_scan.redact(t, s)) for i, t in texts(clean) for s in scanner.scan([t])]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(corpus_pipeline.TOKENIZER), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r["doc_id"]: r["ids"] for r in tokens.collect()} == {i: library.encode_ordinary(t) for i, t in texts(redacted)}


def test_the_first_stage_keeps_what_labels_call_good(spark, outputs):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {i for i, _ in texts(outputs[0])}
    assert sum((i in kept) == bool(q) for i, q in labels.items()) >= 0.98 * len(labels)


def test_columns_stay(spark, outputs):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(df.columns == columns for df in outputs[:-1])


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_hard_rows_and_none(spark, stage):
    assert stage(spark, hard(spark), SF).count() <= len(HARD)
    assert stage(spark, hard(spark).filter("false"), SF).count() == 0
