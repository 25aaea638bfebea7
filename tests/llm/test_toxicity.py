"""Toxicity: the machines against direct rules, learning, held-out accuracy, odd inputs."""

from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as E
from fewshot_spark.llm import toxicity, transducer
from fewshot_spark.session import read_table

SF01 = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, toxicity double, row string, label int"


def direct(symbols):
    """What a clause's words become, by plain rules."""
    out = []
    targets = [k for k, s in enumerate(symbols) if s == "y"]
    for k, s in enumerate(symbols):
        if s not in "it":
            out.append("o")
            continue
        denied = any(symbols[j] == "n" for j in range(max(0, k - toxicity.NEAR_NEGATION), k))
        said = "q" in symbols[:k]
        near = any(abs(j - k) <= toxicity.NEAR_TARGET for j in targets)
        out.append("d" if denied else "r" if said else ("I" if near else "i") if s == "i" else ("T" if near else "o"))
    return out


@pytest.mark.parametrize("weights", [(0.6, 1.0, 0.2, 0.3, 1.0), (5.0, 1.0, 3.0, 0.0, 0.0)])
def test_grammar_equals_direct_rules(weights):
    machine = toxicity.grammar(dict(zip(toxicity.KINDS, weights, strict=True)))
    rng = random.Random(2)
    clauses = [list(c) for n in range(4) for c in itertools.product("oitynq", repeat=n)]
    clauses += [rng.choices("oooooitynq", k=rng.randrange(4, 16)) for _ in range(3000)]
    for c in clauses:
        found = machine.best(c, [1.0] * len(c))
        assert found is not None and found[1] == direct(c), c


def test_composition_equals_one_after_the_other():
    rng = random.Random(3)

    def machine():
        m = transducer.Transducer()
        for _ in range(3):
            m.state(rng.random() < 0.7)
        m.final.add(0)
        for _ in range(14):
            m.arc(rng.randrange(3), rng.choice("ab"), rng.choice("ab"), rng.randrange(3), rng.randrange(9))
        return m

    def runs(m, word):
        found = [(0, 0.0, "")]
        for s in word:
            found = [(to, w + v, out + o) for at, w, out in found for o, v, to in m.arcs[at].get(s, ())]
        return [(w, out) for at, w, out in found if at in m.final]

    for _ in range(60):
        a, b = machine(), machine()
        word = rng.choices("ab", k=4)
        both = [w + v for w, middle in runs(a, word) for v, _ in runs(b, middle)]
        got = a.then(b).best(word, [1.0] * 4)
        assert (got and got[0]) == (max(both) if both else None)


@pytest.fixture(scope="module")
def learned(spark):
    rng = random.Random(5)
    plain = [f"w{i}" for i in range(400)]
    rows, marks = [], []
    for i in range(1200):
        words = rng.choices(plain, k=40)
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(40), rng.choice(["blorf", "zindle"]) if i % 12 else "grumpf" + "".join(rng.choices("aeiou", k=3)))
        rows.append((i, " ".join(words) + "."))
        marks.append((i, int(toxic)))
    copied = " ".join(f"only{k}" for k in range(30)) + " blorf."
    rows += [(5000 + i, copied) for i in range(40)]
    marks += [(5000 + i, 1) for i in range(40)]
    return toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int"))


def test_learns_words_and_stems_but_not_copied_text(learned):
    assert set(learned.words) >= {"blorf", "zindle"} and not [w for w in learned.words if w.startswith("only")]
    assert "grumpf" in learned.stems and not [s for s in learned.stems if s.startswith("only")]
    scorer = toxicity.Scorer(learned)
    assert scorer.score("w1 w2 grumpfxyzzy w3 blorf") > 0.5 > scorer.score("w1 w2 w3. only3 only4")
    far, near = scorer.features("blorf w1 w2 w3 w4 w5 w6 you"), scorer.features("you w1 blorf")
    assert far[0] > 0 == far[1] and near[0] == near[1] > 0
    assert scorer.features("not a blorf")[2] > 0 and scorer.features("he said w1 w2 w3 w4 w5 blorf")[3] > 0
    assert scorer.features("I will kill you")[4] > 0 and not scorer.features("kill the process").any()


def test_query_on_held_out_rows(spark):
    rows = E.queries()["op12_toxicity"](spark, SF01).collect()
    marks = {r.doc_id: r.toxic for r in read_table(spark, SF01, "labels").collect()}
    assert len(rows) == read_table(spark, SF01, "documents").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(r.score, marks[r.doc_id]) for r in rows if r.held_out and r.doc_id in marks]
    assert np.mean([(s >= 0.5) == (y == 1) for s, y in held]) > 0.95


def test_slices_do_not_change_a_text(learned, monkeypatch):
    scorer = toxicity.Scorer(learned)
    rng = random.Random(7)
    text = " ".join(rng.choice(["w1", "blorf", "you", "not", "zindle.", "w2\n", "said", "grumpfaei"]) for _ in range(3000))
    want = scorer.features(text)
    assert "".join(toxicity.slices(text, 400)) == text
    monkeypatch.setattr(toxicity, "slices", lambda t: iter([t[: t.index(".", 2000) + 1], t[t.index(".", 2000) + 1 :]]))
    assert np.allclose(scorer.features(text), want)


def test_odd_rows(spark, learned):
    rows = [(1, None), (2, ""), (3, "..."), (4, "blorf zindle blorf you"), (4, "blorf zindle blorf you"), (None, "x" * 3_000_000), (6, "w1 " * 700_000 + "blorf blorf zindle")]
    docs = spark.createDataFrame([(*r, 0.5, "r", 1) for r in rows], SCHEMA).repartition(3)
    got = toxicity.score(docs, learned)
    assert got.columns == [*docs.columns, "toxicity_"]
    by = {(r.doc_id, (r.text or "")[:3]): r.toxicity_ for r in got.collect()}
    assert got.count() == 7 and len(by) == 6
    assert by[1, ""] == by[2, ""] == by[3, "..."] == by[None, "xxx"] < 0.5 < by[4, "blo"] and by[6, "w1 "] > 0.5
    assert toxicity.score(docs.limit(0), learned).count() == 0
    found = toxicity.matches(docs, learned).collect()
    assert sorted((r.doc_id, r.kinds) for r in found if r.doc_id == 4) == [(4, ["insult at a target"] * 3)] * 2
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs, none).constant == 0.5
    one = spark.createDataFrame([(i, 1) for i in range(30)] + [(None, 0), (2, None), (3, 7)], "doc_id long, toxic int")
    assert 0 < toxicity.fit(docs, one).constant < 1
