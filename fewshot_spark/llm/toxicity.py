"""Toxicity by a weighted finite-state grammar of clauses.

Words become symbols: insult and threat words (core), words that name a target, negate or report
speech, and all others. Three machines are composed: negation marks a core word shortly behind a
negation, reported speech marks those behind a verb of saying, and the target machine tells
core words near a target from others (a target may still follow: the machine guesses whether, and
a guess that fails ends the path). A last machine weighs what they write. A clause counts by its best path, so
the same word weighs differently when it is thrown at somebody, denied, quoted or stands alone.

Insult words and stems are learned from labelled texts: words, and beginnings that several such
words share, that are far more common in toxic documents than in others (lower bound of the log
odds), and in several surroundings, so that the words of a text with many near copies are not
taken for insults. How much each kind of
match counts is learned too. Threats, targets, negations and verbs of saying are closed classes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import free_name
from .transducer import Transducer

MAX_LABELLED, MAX_TERMS, SLICE = 20_000, 50_000, 1 << 20
STEM, LONGEST = range(3, 9), 40
LEAST_DOCS, LEAST_ODDS, LEAST_STEM_ODDS, FAMILY, THREAT_STRENGTH = 5, 2.3, 3.5, 4, 3.0
NEAR_NEGATION, NEAR_TARGET = 3, 4
# Closed classes in English, German, French and Spanish.
THREATS = """kill hurt destroy stab shoot punch strangle murder beat
töten umbringen vernichten erschießen erwürgen verprügeln tuer frapper détruire étrangler matar golpear destruir disparar estrangular""".split()
TARGETS = """you your yours yourself he him she her they them their these those du dich dir dein euch ihr sie er
tu toi te vous votre il elle ils elles tú ti usted ustedes él ella ellos ellas""".split()
NEGATIONS = "not no never nobody neither don isn aren wasn doesn didn nicht kein keine keinen nie niemals pas jamais aucun nunca jamás ningún".split()
REPORTS = """said says say saying called calls quoted quote wrote writes claims reported sagt sagte sagen nannte schrieb zitat
dit disait appelle appelait écrit selon dijo dice llamó escribió según""".split()
KINDS = ("insult", "insult at a target", "denied", "reported", "threat at a target")
# Evidence and its weight before learning: any insult or threat that is neither denied nor
# reported; more where there is a target; denied; reported; more where it is a threat.
PRIOR = (0.6, 0.4, 0.2, 0.3, 0.0)
_TOKEN = re.compile(r"[^\W_]+|[.!?;\n]")
_OTHER, _INSULT, _THREAT, _TARGET, _NOT, _SAID, _STOP = range(7)
_NAMES = "oitynq"


def _total(machine: Transducer, state: int, symbols: str, to: int) -> None:
    for s in symbols:
        machine.arc(state, s, s, to)


def negation(reach: int = NEAR_NEGATION) -> Transducer:
    """Core words at most ``reach`` words behind a negation become ``d`` (denied)."""
    m = Transducer()
    states = [m.state() for _ in range(reach + 1)]  # words that the last negation still reaches
    for left, s in enumerate(states):
        m.arc(s, "n", "o", states[reach])
        _total(m, s, "oyq", states[max(0, left - 1)])
        for core in "it":
            m.arc(s, core, "d" if left else core, states[max(0, left - 1)])
    return m


def reported() -> Transducer:
    """Core words behind a verb of saying become ``r``."""
    m = Transducer()
    plain, said = m.state(), m.state()
    for s in (plain, said):
        m.arc(s, "q", "o", said)
        _total(m, s, "oyd", s)
        for core in "it":
            m.arc(s, core, "r" if s == said else core, s)
    return m


def targeted(reach: int = NEAR_TARGET) -> Transducer:
    """Insults within ``reach`` words of a target become ``I``, threats ``T``; a threat without a
    target is no match. A state holds how many words the last target still reaches, how many may
    not be a target (a core word was guessed to have none) and within how many one has to come."""
    m, number, todo = Transducer(), {}, []

    def place(left: int, barred: int, owed: int) -> int:
        key = (left, barred, owed)
        if key not in number:
            number[key] = m.state(final=not owed)
            todo.append(key)
        return number[key]

    place(0, 0, 0)
    while todo:
        left, barred, owed = todo.pop()
        at = number[left, barred, owed]
        if not barred:
            m.arc(at, "y", "o", place(reach, 0, 0))
        if owed == 1:
            continue
        after = (max(0, left - 1), max(0, barred - 1), max(0, owed - 1))
        _total(m, at, "odr", place(*after))
        for core, hit, miss in (("i", "I", "i"), ("t", "T", "o")):
            if left:
                m.arc(at, core, hit, place(*after))
            else:
                m.arc(at, core, hit, place(0, after[1], after[2] or reach))
                m.arc(at, core, miss, place(0, reach, after[2]))
    return m


def weighing(weights: dict[str, float]) -> Transducer:
    m = Transducer()
    s = m.state()
    for symbol, kind in zip("iIdrT", KINDS, strict=True):
        m.arc(s, symbol, symbol, s, weights[kind])
    m.arc(s, "o", "o", s)
    return m


def grammar(weights: dict[str, float]) -> Transducer:
    return negation().then(reported()).then(targeted()).then(weighing(weights))


class _Classes(dict):
    """Class of a word; seen words are kept, up to a bound."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        super().__init__()
        self.words, self.stems, self.strength = words, stems, {}
        self.closed = {w: c for c, ws in ((_SAID, REPORTS), (_TARGET, TARGETS), (_NOT, NEGATIONS), (_THREAT, THREATS)) for w in ws}
        self.closed |= dict.fromkeys(".!?;\n", _STOP)

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
            self.strength.clear()
        got, weight = self.closed.get(word, _OTHER), 1.0
        if got in (_OTHER, _THREAT):
            known = self.words.get(word) or max((self.stems.get(word[:n], 0.0) for n in STEM if n < len(word)), default=0.0)
            if known:
                got, weight = _INSULT, known
        if got == _THREAT:
            weight = THREAT_STRENGTH
        self[word], self.strength[word] = got, weight
        return got


@dataclass
class Model:
    """``words`` and ``stems``: strength (lower bound of the log odds) of what is learned;
    ``weights`` of the evidence, none below 0, so a target never makes an insult weigh less."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = PRIOR
    bias: float = -2.0
    constant: float | None = None

    def by_kind(self) -> dict[str, float]:
        own, aimed, denied, said, threat = self.weights
        return dict(zip(KINDS, (own, own + aimed, denied, said, own + aimed + threat), strict=True))


def slices(text: str, size: int = SLICE):
    """A text in slices of about ``size`` characters, cut behind the end of a clause (a word where
    none ends)."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(c, at, at + size) for c in ".!?;\n")
        cut = cut if cut > at else max(text.rfind(" ", at, at + size), at + size // 2)
        yield text[at : cut + 1]
        at = cut + 1
    yield text[at:]


class Scorer:
    def __init__(self, model: Model):
        self.model, self.classes, self.machine = model, _Classes(model.words, model.stems), grammar(model.by_kind())

    def clauses(self, text: str):
        """Best paths of the clauses with a core word: ``(words, written, strength)``."""
        for part in slices(text):
            words = _TOKEN.findall(part.lower())
            codes = bytes(map(self.classes.__getitem__, words))
            if not (_INSULT in codes or _THREAT in codes):
                continue
            at = 0
            for clause in codes.split(bytes([_STOP])):
                if _INSULT in clause or _THREAT in clause:
                    own = words[at : at + len(clause)]
                    strength = [self.classes.strength.get(w, 1.0) for w in own]
                    found = self.machine.best([_NAMES[c] for c in clause], strength)
                    if found:
                        yield own, found[1], strength
                at += len(clause) + 1

    def features(self, text: str | None) -> np.ndarray:
        """Evidence (as in ``PRIOR``) of all clauses of the whole text: log(1 + strength matched)."""
        sums = dict.fromkeys("iIdrT", 0.0)
        for _, written, strength in self.clauses(text or ""):
            for kind, s in zip(written, strength, strict=True):
                if kind != "o":
                    sums[kind] += s
        aimed = sums["I"] + sums["T"]
        return np.log1p(np.array([sums["i"] + aimed, aimed, sums["d"], sums["r"], sums["T"]]))

    def score(self, text: str | None) -> float:
        m = self.model
        if m.constant is not None:
            return m.constant
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, m.bias + float(self.features(text) @ np.array(m.weights))))))


def _counts(batches):
    """Labelled documents by term: ``(term, whole word, clean, toxic)``. Null term: all of them."""
    held: Counter = Counter()

    def rows():
        keys = list({(t, w) for t, w, _ in held})
        done = pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in keys], pa.string()), pa.array([w for _, w in keys], pa.bool_())]
            + [pa.array([held[t, w, y] for t, w in keys], pa.int64()) for y in (0, 1)],
            ["term", "whole", "clean", "toxic"],
        )
        held.clear()
        return done

    for b in batches:
        for text, label in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            seen: set = set()
            for part in slices(text.as_py() or ""):
                seen.update(w for w in _TOKEN.findall(part.lower()) if 2 < len(w) <= LONGEST)
            stems = {w[:n] for w in seen for n in STEM if n < len(w)}
            held.update((w, True, label) for w in seen)
            held.update((s, False, label) for s in stems)
            held[None, None, label] += 1
            if len(held) > 1_000_000:
                yield rows()
    yield rows()


def _contexts(known: frozenset):
    """Surroundings (hash of the words on either side) of known words in a task's texts."""

    def run(batches):
        for b in batches:
            words, sides = [], []
            for text in b.column(0):
                for part in slices(text.as_py() or ""):
                    own = ["", *(w for w in _TOKEN.findall(part.lower()) if w not in ".!?;\n"), ""]
                    for k, w in enumerate(own):
                        if w in known:
                            words.append(w)
                            sides.append(f"{own[k - 1]} {own[k + 1]}")
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(sides, pa.string())], ["word", "sides"])

    return run


def lexicon(rows: list[tuple[str, bool, float]], sides: dict[str, int]) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems from ``(term, whole, log odds)`` of terms that are sure enough; ``sides``: surroundings by toxic word. A stem needs ``FAMILY`` such words; of stems
    with the same words the longest stands."""
    words = {t: odds for t, whole, odds in rows if whole and sides.get(t, 0) >= LEAST_DOCS}
    family: dict[str, set] = {}
    for t in sides:
        for n in STEM:
            if n < len(t):
                family.setdefault(t[:n], set()).add(t)
    stems: dict[str, float] = {}
    for t, whole, odds in sorted(rows, key=lambda r: (-len(r[0]), r[0])):
        own = family.get(t, ())
        if not whole and len(own) >= FAMILY and sum(sides[w] for w in own) >= LEAST_DOCS:
            if not any(s.startswith(t) and len(family[s]) == len(own) for s in stems):
                stems[t] = odds
    return words, stems


def _fit_weights(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Logistic regression of rows that stand for ``n`` texts each, towards ``PRIOR``, no weight
    below 0, by Newton steps."""
    prior = np.array([*PRIOR, -2.0])
    z = np.column_stack([x, np.ones(len(x))])
    pull = np.array([1.0] * x.shape[1] + [1e-3])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (n * (p - y)) + pull * (w - prior)
        hess = (z * (n * p * (1 - p))[:, None]).T @ z + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -1, 1)
        w[:-1] = np.maximum(w[:-1], 0)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w[:-1].tolist()), float(w[-1])


def _sample_features(model: Model):
    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            f = [scorer.features(t.as_py()).tolist() for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64())), b.column(1)], ["f", "label"])

    return run


def fit(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """Words, stems and weights from at most ``max_rows`` labelled rows (those with the smallest
    hash of their id; the bound keeps what the driver gets fixed), of their whole texts. At most
    ``MAX_TERMS`` terms, those of the most toxic documents, come to the driver.

    Labels other than 0 and 1, null ids, and ids with both labels are not learned from. With
    fewer than 10 labelled rows or one class only, the score is a constant (smoothed share)."""
    good = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("label")).where("l_id is not null and label in (0, 1)")
    good = good.groupBy("l_id").agg(F.min("label").alias("label"), F.max("label").alias("top")).where("label = top")
    some = good.withColumn("h", F.xxhash64("l_id")).orderBy("h", "l_id").limit(max_rows).select("l_id", "label")
    rows = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("text")).join(F.broadcast(some), F.col("d_id") == F.col("l_id"))
    rows = rows.select("text", "label")
    terms = rows.mapInArrow(_counts, "term string, whole boolean, clean long, toxic long")
    terms = terms.groupBy("term", "whole").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).checkpoint()
    total = terms.where("term is null").first()
    clean, toxic = (total["clean"], total["toxic"]) if total else (0, 0)
    if clean + toxic < 10 or not clean or not toxic:
        return Model(constant=float((toxic + 1) / (clean + toxic + 2)))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    error = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    top = terms.where("term is not null and toxic >= 2").withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    least = F.when(F.col("whole"), LEAST_ODDS).otherwise(LEAST_STEM_ODDS)
    top = top.withColumn("odds", F.col("odds") - 1.64 * error).withColumn("sure", (F.col("toxic") >= LEAST_DOCS) & (F.col("odds") >= least))
    top = top.orderBy(F.col("toxic").desc(), "term", "whole").limit(MAX_TERMS).collect()
    known = frozenset(r["term"] for r in top if r["whole"])
    around = rows.where("label = 1").select("text").mapInArrow(_contexts(known), "word string, sides string").distinct()
    sides = {r["word"]: r["count"] for r in around.groupBy("word").count().collect()}
    words, stems = lexicon([(r["term"], r["whole"], r["odds"]) for r in top if r["sure"]], sides)
    model = Model(words, stems)
    got = rows.mapInArrow(_sample_features(model), "f array<double>, label int").groupBy("f", "label").count().toArrow()
    got = sorted(got.to_pylist(), key=lambda r: (r["f"], r["label"]))  # texts of equal evidence are one row
    model.weights, model.bias = _fit_weights(*(np.array([r[c] for r in got], float) for c in ("f", "label", "count")))
    return model


def _score(model: Model):
    def run(batches):
        scorer = Scorer(model)
        for b in batches:
            s = [scorer.score(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(s, pa.float64())], ["row", "toxicity"])

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) of every row of ``docs`` and ``toxicity`` (0 to 1),
    from the whole text and nothing else, in the scan stage. Null and empty texts, and texts
    without a match, get the score of no evidence; repeated rows get equal scores; no rows give no
    rows. Where the kept columns hold ``toxicity``, the new last column is ``toxicity_``."""
    row = F.struct(*(docs.columns if keep is None else keep)).alias("row")
    src = docs.select(F.col(text_col).alias("text"), row)
    done = src.mapInArrow(_score(model), f"row {src.schema['row'].dataType.simpleString()}, toxicity double")
    return done.select("row.*", F.col("toxicity").alias(free_name(src.schema["row"].dataType.names, "toxicity")))


def _matches(model: Model):
    def run(batches):
        scorer, kinds = Scorer(model), dict(zip("iIdrT", KINDS, strict=True))
        for b in batches:
            for i, text in enumerate(b.column(1)):
                found = [(" ".join(words), [kinds[k] for k in written if k != "o"]) for words, written, _ in scorer.clauses(text.as_py() or "")]
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    own = b.column(0).take(pa.array([i] * len(part), pa.int64()))
                    yield pa.RecordBatch.from_arrays([own, pa.array([c for c, _ in part], pa.string()), pa.array([k for _, k in part], pa.list_(pa.string()))], ["doc_id", "clause", "kinds"])

    return run


def matches(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, clause, kinds`` of every clause with a core word: its words and what they match."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(_matches(model), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, clause string, kinds array<string>")
