"""The pipeline against its stages on rows that each of them has to act on."""

import os

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tablewise.llm import bpe
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_near_dup import brute as groups

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    out = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], FOLDER).cache())
        out[-1].count()
    return out


def test_stages_keep_columns_and_rows_of_their_input(steps):
    for before, after in zip(steps[:-2], steps[1:-1]):
        assert after.columns == before.columns
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}


def test_near_duplicates_against_brute_force(steps):
    before = [(r.doc_id, r.text) for r in steps[1].collect()]
    want = {i for i, (_, c) in groups(before, 5, 80).items() if i == c}
    assert {r.doc_id for r in steps[2].collect()} == want and len(want) < len(before)


def test_decontamination_against_brute_force(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    before = [(r.doc_id, r.text) for r in steps[2].collect()]
    hit = {d for d, _ in leaks(before, items)}
    assert hit and {r.doc_id for r in steps[3].collect()} == {d for d, _ in before} - hit


def test_secrets_go_and_tokens_read_back(steps):
    before = {r.doc_id: r.text for r in steps[3].collect()}
    after = {r.doc_id: r for r in steps[4].collect()}
    changed = [i for i, t in before.items() if after[i].text != t]
    assert changed and len(changed) < 0.1 * len(before)
    assert all("[SECRET]" in after[i].text and after[i].n_chars == len(after[i].text) for i in changed)
    library = Tokenizer.from_file(bpe.default_path())
    for r in steps[5].collect():
        assert np.frombuffer(r.ids, dtype="<u4").tolist() == library.encode(after[r.doc_id].text).ids


def test_toxic_documents_go(spark, steps):
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    left = {r.doc_id for r in steps[1].collect()}
    toxic = [i for i, t in marks.items() if t]
    clean = [i for i, t in marks.items() if not t]
    assert sum(i in left for i in toxic) <= 0.2 * len(toxic)
    assert sum(i in left for i in clean) >= 0.97 * len(clean)


def test_run_gives_the_last_stage(spark, steps):
    rows = entry.queries()["pipeline"](spark, FOLDER)
    want = {(r.doc_id, r.ids_sha256) for r in steps[5].collect()}
    assert {(r.doc_id, r.ids_sha256) for r in rows.collect()} == want


def test_empty_and_odd_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (5_000_001, None, "en", "s", None), (5_000_002, "", "en", "s", 0)], docs.schema)
    for table in ("labels", "benchmark"):
        os.symlink(f"{FOLDER}/{table}.parquet", tmp_path / f"{table}.parquet")
    for part, rows in ((docs.limit(0), 0), (odd, 3)):
        for _, stage in corpus_pipeline.STAGES:
            part = stage(spark, part, str(tmp_path))
        assert part.count() == rows
