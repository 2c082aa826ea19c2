"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer maps words to symbols (insult, threat, target, object, negation, report).  Small transducers read
them, each for a pattern of its own: an insult near its target, under a negation, or reported; a threat whose target
follows, or whose object goes before it.  Their composition marks each insult and emits each threat, so only words that
match a pattern score.  The lexicon, its weights, and what every mark is worth are learned from labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import checkpointed, long_column, string_column

#: Fixed word lists of the grammar, in four languages; threats are stems.  Objects are targets that a verb may follow.
TARGETS = frozenset("you your yours yourself they them their he him she her du dich dir dein ihr ihn euch sie vous toi te votre vos tu usted ustedes tú ellos".split())
OBJECTS = frozenset("dich dir ihn euch te toi".split())
NEGATIONS = frozenset("not no never neither nor cannot nicht kein keine nie niemals pas jamais ni aucun nunca ninguno tampoco".split())
REPORTS = frozenset("said says called calls claimed wrote quoted according sagte nannte behauptete laut dit disait selon écrit dijo llamó según escribió".split())
THREATS = tuple("kill murder hurt destroy beat burn stab shoot töt schlag vernicht umbring tuer frapp détrui matar golpe destru".split())
SAMPLE_ROWS = 20_000
#: A term is learned from so many toxic documents at least, or so large a share of them, if its log-odds reach this.
LEAST_DOCS, LEAST_SHARE, LEAST_WEIGHT = 3, 1 / 400, 2.5
STEMS = (4, 5, 6)
#: How many words an insult may come after its target, and a negation reach; how far a threat's target may follow, and its object go before.
TARGET_REACH, NEGATION_REACH, THREAT_REACH, OBJECT_REACH = 6, 3, 4, 3
#: What a document's features are, and what each is worth before anything is learned.
FEATURES = ("largest", "all", "clauses", "targeted", "negated", "reported", "threats")
PRIOR = (0.0, 0.0, 0.0, 0.25, -0.5, -0.25, 1.5)
_WORD = re.compile(r"[^\W\d_]+")
_END = re.compile(r"[.!?;\n]")
_THREAT = re.compile("|".join(THREATS))


@dataclass(frozen=True)
class Transducer:
    """States 0.., a table (state, symbol) -> (state, marks); symbols that the table lacks lead to ``otherwise``."""

    arcs: dict[tuple[int, str], tuple[int, tuple[str, ...]]]
    otherwise: tuple[int, ...]

    def step(self, state: int, symbol: str) -> tuple[int, tuple[str, ...]]:
        return self.arcs.get((state, symbol), (self.otherwise[state], ()))

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same symbols; states pair up and marks go together."""
        n = len(other.otherwise)
        symbols = {s for _, s in self.arcs} | {s for _, s in other.arcs}
        arcs = {}
        for a in range(len(self.otherwise)):
            for b in range(n):
                for s in symbols:
                    (x, f), (y, g) = self.step(a, s), other.step(b, s)
                    arcs[a * n + b, s] = (x * n + y, f + g)
        return Transducer(arcs, tuple(self.otherwise[a] * n + other.otherwise[b] for a in range(len(self.otherwise)) for b in range(n)))


def within(symbols: tuple[str, ...], reach: int, mark: str) -> Transducer:
    """Insults at most ``reach`` words after one of ``symbols`` get a mark."""
    arcs: dict = {(s, symbol): (reach, ()) for s in range(reach + 1) for symbol in symbols}
    for s in range(1, reach + 1):
        arcs[s, "insult"] = (s - 1, (mark,))
    return Transducer(arcs, tuple(max(0, s - 1) for s in range(reach + 1)))


def ever(symbol: str, mark: str) -> Transducer:
    """Insults after ``symbol`` in the clause get a mark."""
    return Transducer({(0, symbol): (1, ()), (1, "insult"): (1, (mark,))}, (0, 1))


def pursuit(after: int, before: int, negation: int) -> Transducer:
    """Emits a threat where a target comes at most ``after`` words behind a threat word, or a threat word at most ``before`` behind an object.

    A threat word at most ``negation`` words behind a negation is none, and a negation drops an object.
    """
    # 0: nothing; then words left to wait for a target; then words since an object; then words under a negation.
    waits, seen, denied = range(1, after + 1), range(after + 1, after + before + 1), range(after + before + 1, after + before + negation + 1)
    arcs: dict = {}
    for s in (0, *waits, *seen, *denied):
        arcs[s, "negation"] = (denied[-1], ())
        arcs[s, "threat"] = (0, ("threat",)) if s in seen else (0, ()) if s in denied else (waits[-1], ())
        arcs[s, "object"] = (0, ("threat",)) if s in waits else (s - 1 if s in denied and s > denied[0] else seen[-1] if s not in denied else 0, ())
        if s in waits:
            arcs[s, "target"] = (0, ("threat",))
    less = [0, *(s - 1 for s in waits), *(s - 1 if s > seen[0] else 0 for s in seen), *(s - 1 if s > denied[0] else 0 for s in denied)]
    return Transducer(arcs, tuple(less))


GRAMMAR = within(("target", "object"), TARGET_REACH, "targeted").compose(within(("negation",), NEGATION_REACH, "negated")).compose(ever("report", "reported")).compose(pursuit(THREAT_REACH, OBJECT_REACH, NEGATION_REACH))


def symbols(words: Iterable[str], terms: dict[str, float]) -> list[tuple[str, float]]:
    """The lexical transducer: (symbol, weight) of each word; ``terms`` has whole words and stems marked by a final *."""
    out = []
    for w in words:
        weight = max((terms[t] for t in (w, *(f"{w[:k]}*" for k in STEMS if len(w) >= k)) if t in terms), default=0.0)
        if weight > 0:
            out.append(("insult", weight))
        elif _THREAT.match(w):
            out.append(("threat", 0.0))
        else:
            out.append(("object" if w in OBJECTS else "target" if w in TARGETS else "negation" if w in NEGATIONS else "report" if w in REPORTS else "other", 0.0))
    return out


@dataclass
class Found:
    """What the grammar finds in a clause: weight of its insults, of those with each mark, and how many threats."""

    weight: float = 0.0
    marked: dict[str, float] = field(default_factory=lambda: {"targeted": 0.0, "negated": 0.0, "reported": 0.0})
    threats: int = 0


def read_clause(clause: str, terms: dict[str, float]) -> Found:
    state, out = 0, Found()
    for symbol, weight in symbols(_WORD.findall(clause), terms):
        state, marks = GRAMMAR.step(state, symbol)
        out.weight += weight
        for m in marks:
            if m == "threat":
                out.threats += 1
            else:
                out.marked[m] += weight
    return out


def features(found: list[Found]) -> tuple[float, ...]:
    """FEATURES of the clauses that score: the largest weight, the log of 1 + all of it, how many score, and logs of 1 + what has each mark."""
    own = [f for f in found if f.weight > 0 or f.threats]
    sums = (sum(f.marked[m] for f in own) for m in ("targeted", "negated", "reported"))
    return (max((f.weight for f in own), default=0.0), math.log1p(sum(f.weight for f in own)), float(len(own)), *map(math.log1p, sums), math.log1p(sum(f.threats for f in own)))


class Matcher:
    """Finds the clauses that hold a term or a threat word, with one automaton over the text."""

    def __init__(self, terms: dict[str, float]):
        self.terms, self.auto = terms, ahocorasick.Automaton()
        # A stem finds all that the equal whole word does, so of both the stem stays.
        for k in dict.fromkeys((*sorted(THREATS), *(t.rstrip("*") for t in terms))):
            self.auto.add_word(k, (len(k), f"{k}*" in terms or k in THREATS))
        self.auto.make_automaton()

    def clauses(self, text: str) -> list[str]:
        low = text.lower()
        out, upto = [], -1
        for at, (size, stem) in self.auto.iter(low):
            first = at - size + 1
            if first <= upto or (first and low[first - 1].isalpha()) or (not stem and at + 1 < len(low) and low[at + 1].isalpha()):
                continue
            begin = max(low.rfind(c, 0, first) for c in ".!?;\n") + 1
            end = _END.search(low, at)
            upto = end.start() if end else len(low)
            out.append(low[begin:upto])
        return out

    def found(self, text: str | None) -> list[tuple[str, Found]]:
        """The clauses that score."""
        every = ((c, read_clause(c, self.terms)) for c in self.clauses(text or ""))
        return [(c, f) for c, f in every if f.weight > 0 or f.threats]

    def features(self, text: str | None) -> tuple[float, ...]:
        return features([f for _, f in self.found(text)])


@dataclass(frozen=True)
class Model:
    terms: dict[str, float]
    bias: float
    weights: tuple[float, ...] = PRIOR

    def worth(self, values: tuple[float, ...]) -> float:
        return sum(w * x for w, x in zip(self.weights, values, strict=True))

    def score(self, values: tuple[float, ...]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.worth(values)))))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, rows: int, label: str = "toxic") -> DataFrame:
    """(text, y) of labelled rows that are not held out; of more than ``rows``, those of a range of id hashes."""
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and __id is not null")
    known = known.groupBy("__id").agg(F.max("y").alias("y")).where(~held_out("__id"))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < int((1 << 20) * rows / n))
    # The sample's ids are as many as ``rows`` says, whatever the input, so they go to the texts and not the texts to them.
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return checkpointed(text.join(F.broadcast(known), F.col("doc_id") == F.col("__id")).select("text", "y"))


def _terms(batches):
    """Documents that have each word or stem, by label; one row for each in a batch."""
    for batch in batches:
        counts: Counter = Counter()
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(_WORD.findall((text or "").lower()))
            words |= {f"{w[:k]}*" for w in words for k in STEMS if len(w) >= k}
            counts.update((w, y) for w in words)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in counts]), pa.array([y for _, y in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["term", "y", "n"])


def learn(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, terms: int | None = None, least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE, least_weight: float = LEAST_WEIGHT) -> Model:
    """Lexicon and weights from at most about ``sample_rows`` labelled rows, chosen by a hash of their id.

    A word, or a stem of STEMS letters, becomes a term when at least ``least_docs`` and ``least_share`` of the sampled
    toxic documents have it and its smoothed log-odds are at least ``least_weight``; only if ``terms`` is given, of more
    than so many those stay that have most toxic documents times weight.  What each of FEATURES is worth is learned by
    logistic regression that draws towards PRIOR, so a pattern that the sample lacks keeps its prior worth.  Only the
    sample limits what is learned, never what is scored.
    """
    train = training_rows(docs, labels, sample_rows)
    totals = {r.y: r.n for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return Model({}, 30.0 if pos else -30.0)
    found = train.mapInArrow(_terms, "term string, y int, n long").groupBy("term").agg(F.sum(F.when(F.col("y") == 1, F.col("n"))).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n"))).alias("b"))
    found = found.select("term", F.col("a").alias("a"), F.coalesce("b", F.lit(0)).alias("b")).where(F.col("a") >= max(least_docs, int(pos * least_share)))
    weight = F.log((F.col("a") + 0.5) / (pos + 1)) - F.log((F.col("b") + 1) / (neg + 2))
    best = found.select("term", (weight * F.lit(1.0)).alias("w"), (F.col("a") * weight).alias("gain")).where(F.col("w") >= least_weight).orderBy(F.desc("gain"), "term")
    # Each term is in `least_docs` documents of the sample at least, so the sample bounds them.
    lexicon = {r.term: r.w for r in (best if terms is None else best.limit(terms)).collect()}
    x, y = [], []
    for r in train.mapInArrow(_featured(docs.sparkSession.sparkContext.broadcast(Model(lexicon, 0.0))), "y int, x array<double>").toLocalIterator():
        x.append((1.0, *r.x))
        y.append(r.y)
    w = logistic(np.array(x), np.array(y, float), np.array((0.0, *PRIOR)))
    return Model(lexicon, float(w[0]), tuple(map(float, w[1:])))


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, drawn towards ``prior``; the first column is the constant and is not."""
    w = prior.copy()
    shrink = np.full(x.shape[1], ridge)
    shrink[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * (w - prior))
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _featured(model):
    def run(batches):
        m = Matcher(model.value.terms)
        for batch in batches:
            f = [m.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(f, pa.list_(pa.float64()))], names=["y", "x"])

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("clauses", pa.list_(pa.struct([("text", pa.string()), ("score", pa.float64())])))])


def _scored(model):
    def run(batches):
        m = Matcher(model.value.terms)
        for batch in batches:
            texts, (ids, nulls) = string_column(batch, "text"), long_column(batch, "doc_id")
            for a in range(0, len(texts), 1000):
                scores, clauses = [], []
                for t in texts.slice(a, 1000).to_pylist():
                    own = m.found(t)
                    scores.append(model.value.score(features([f for _, f in own])))
                    clauses.append([{"text": c, "score": model.value.worth(features([f]))} for c, f in own])
                yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 1000], mask=nulls[a : a + 1000]), pa.array(scores), pa.array(clauses, _OUT.field(2).type)], schema=_OUT)

    return run


def toxicity(docs: DataFrame, labels: DataFrame, *, model: Model | None = None, sample_rows: int = SAMPLE_ROWS, terms: int | None = None, least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE, least_weight: float = LEAST_WEIGHT) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5), clauses (text, and what it alone is worth in log-odds, of each match).

    The model is learned (see `learn` for the limits of the lexicon) from rows of ``labels`` (doc_id, toxic 0/1) whose
    crc32(doc_id as text) mod 5 is not 0, at most about ``sample_rows`` of them, chosen by a hash of the id; labels that
    contradict each other count as toxic, others than 0 and 1 are ignored.  Only the text enters a score.  Without
    labels of both kinds, all documents get the score of the only kind, and 0 without any.

    A clause matches if it has a learned term, or a word of a stem of THREATS with its target at most THREAT_REACH words
    behind it or its object at most OBJECT_REACH before it, and not under a negation.

    Null and empty texts have no clauses and get the score of such texts.  A null doc_id is held out or not as the
    empty string is.  Repeated ids and repeated rows are scored each.  A text of any length is scored whole, in one
    task.  Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    model = model or learn(docs, labels, sample_rows=sample_rows, terms=terms, least_docs=least_docs, least_share=least_share, least_weight=least_weight)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, score double, clauses array<struct<text:string,score:double>>")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses")


def without_toxic(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that ``toxicity`` predicts 0 for.

    Each row is judged by its own text, so null and repeated ids do not matter; other columns pass through whatever
    their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, sample_rows=sample_rows))

    def run(batches):
        m = Matcher(shared.value.terms)
        for batch in batches:
            texts = string_column(batch, "text").to_pylist()
            yield batch.filter(pa.array([shared.value.score(m.features(t)) < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
