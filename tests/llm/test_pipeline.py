"""The pipeline's stages against what each operator decides, and its last stage as a round trip."""

from __future__ import annotations

import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from fewshot_spark.llm import tokens
from fewshot_spark.llm.queries import vocabulary
from fewshot_spark.session import read_table
from test_operators import brute_leaks, brute_near

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = read_table(spark, SF001, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF001).checkpoint()
        out.append(docs)
    return out


def test_columns_and_order(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "leaks", "packing"]
    columns = read_table(spark, SF001, "documents").columns
    assert all(s.columns == columns for s in stages[:-1])


def test_near_copies_leave_one_of_each_group(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = {i for i, _, c in brute_near(rows, 5, 80) if i == c}
    assert {str(r.doc_id) for r in stages[2].collect()} == want


def test_no_leak_stays(spark, stages):
    items = [(r.item_id, r.text) for r in read_table(spark, SF001, "benchmark").collect()]
    before, after = ([(r.doc_id, r.text) for r in s.collect()] for s in stages[2:4])
    bad = {d for d, *_ in brute_leaks(before, items)}
    assert sorted(after) == sorted(r for r in before if r[0] not in bad)


def test_run_packs_every_id_once(spark, stages):
    rows = corpus_pipeline.run(spark, SF001).collect()
    enc = tokens.encoder(vocabulary())
    ids = {r.doc_id: [*tokens.ids_of(enc, r.text or "").tolist(), 0] for r in stages[3].collect()}
    assert {r.doc_id for r in rows} == set(ids)
    for d, want in ids.items():
        end = 0
        for r in sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start):
            assert r.start == end and r.ids_crc32 == zlib.crc32(np.array(want[end : end + r.length], "<u4").tobytes())
            end += r.length
        assert end == len(want)


def test_last_stage_delivers_the_training_sequences(stages):
    enc = tokens.encoder(vocabulary())
    want = {r.doc_id: [*tokens.ids_of(enc, r.text or "").tolist(), 0] for r in stages[3].collect()}
    got = {}
    for r in sorted(stages[4].collect(), key=lambda r: r.start):
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == want


def test_entry_works_without_the_subpackage():
    root = Path(__file__).resolve().parents[2]
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('corpus_pipeline', 'fewshot_spark.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(k.startswith('op1_') or k == 'pipeline' for k in e.queries())\n"
    ) % str(root)
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)


def test_near_copies_go_by_id_and_text(spark):
    copy, own = "one two three four five six seven eight", "nine ten eleven twelve other words of its own here"
    rows = [(1, copy), (2, copy), (2, own), (3, own + " x"), (4, copy), (4, copy), (5, "alone and unlike the other rows of this"), (5, "alone and unlike the other rows of this")]
    rows += [(None, copy), (None, "last words that no other row of the table has"), (7, None), (7, None), (8, "")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, near_id string").repartition(3)
    got = corpus_pipeline.drop_near_copies(spark, docs, SF001)
    assert got.columns == docs.columns
    want = [rows[0], rows[2], rows[6], rows[9], (7, None), (7, None), (8, "")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))


def test_stages_take_clashing_columns(spark):
    docs = read_table(spark, SF001, "documents").selectExpr("*", "1 as quality_score", "2 as cut_units").drop("n_chars")
    for _, stage in corpus_pipeline.STAGES[:2]:
        done = stage(spark, docs, SF001)
        assert done.columns == docs.columns and done.count() > 0
