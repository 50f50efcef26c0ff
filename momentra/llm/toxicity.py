"""Toxicity: a weighted finite-state pattern grammar over clauses.

Words become symbols: an insult of one of three strengths (a stem learned from labels), THREAT,
TARGET, NEGATION, REPORT, BREAK (a comma or "but"), STOP (the end of a clause) or OTHER. Five
transducers, each a table of arcs, read and write symbols:

* threat: a threat counts only where a target follows within two words;
* negation: weakens a match within three words after a negation, up to a break;
* reported speech: weakens matches from a reporting verb to the next break or stop;
* target: an insult after a target weighs more, a target after an insult adds a match of its own;
* insult: accepts insults, threats and late targets as matches, stacked insults for more.

They are composed into one deterministic table, weights multiplied along the cascade, which walks the
symbols of a clause; a clause is matched if the table emits anything in it. The document's score is a
logistic function of its matched clauses' weights, fitted on the same labelled rows as the stems.

Stems are word beginnings (and whole words) whose rate among the words of toxic documents is many
times that of others. They are counted by Spark over at most ``sample`` labelled rows, those with the
smallest digests of their ids; the driver gets at most ``most`` stems a half and four numbers a row.

Defined cases: null and empty texts match nothing and get the lowest score; labels that are null take
no part; of repeated labels the largest counts; without a label of either class every score is the
same prior; repeated rows are scored each; a null ``doc_id`` counts as the empty id; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n|,]")
# Closed word classes of the grammar.
THREATS = frozenset("kill hurt destroy murder shoot stab burn strangle tuer tuez frapper töten umbringen schlagen matar golpear".split())
TARGETS = frozenset("you your yourself he she they them him her his their tu toi vous ton te du dich dir dein sie ihr tú usted ellos ti".split())
NEGATIONS = frozenset("not never no neither nor isn aren wasn pas jamais nicht kein keine nie nunca jamás".split())
REPORTS = frozenset("said says wrote writes called quoted reported claimed dit écrit sagte schrieb dijo escribió".split())
BREAKS = frozenset(", but mais aber pero".split())
STOPS = frozenset(".!?;:\n|")
_LONGEST, _SHORTEST = 12, 4

#: Input symbols: insults by strength, threat, target, negation, report, break, stop, other.
SYMBOLS = "abchtnrk.o"
#: Log rate ratios up to which a stem is of strength a, b; what a match of each strength weighs.
_STRENGTHS, _WEIGHTS = (2.75, 4.25), {"a": 2.2, "b": 3.5, "c": 5.0}


@dataclass(frozen=True)
class Transducer:
    """Deterministic arcs ``(state, symbol) -> (output, weight, next state)`` from state 0; no arc: a copy that stays."""

    arcs: dict

    def arc(self, state, symbol: str) -> tuple:
        return self.arcs.get((state, symbol), (symbol, 1.0, state))

    def run(self, symbols: Iterable[str]) -> list[tuple[str, float]]:
        state, out = 0, []
        for s in symbols:
            o, w, state = self.arc(state, s)
            out.append((o, w))
        return out


def _arcs(*rows: tuple) -> Transducer:
    """Rows ``(states, symbols, output or None for a copy, weight, next)``."""
    return Transducer({(q, s): (s if out is None else out, weight, to) for states, symbols, out, weight, to in rows for q in states for s in symbols})


#: States 2 and 1: words in which a threat may still find its target, which then becomes T.
THREAT = _arcs(((0, 1, 2), "h", "o", 1.0, 2), ((2,), "abcnro", None, 1.0, 1), ((1,), "abcnro", None, 1.0, 0), ((1, 2), "t", "T", 1.0, 0), ((1, 2), "k.", None, 1.0, 0))
#: States 3 to 1: words that a negation still reaches.
NEGATION = _arcs(*[((q,), "tro", None, 1.0, q - 1) for q in (1, 2, 3)], *[((q,), "abcT", None, 0.4, q - 1) for q in (1, 2, 3)], (range(4), "n", "o", 1.0, 3), ((1, 2, 3), "k.", None, 1.0, 0))
#: State 1: inside reported speech.
REPORT = _arcs(((1,), "abcT", None, 0.5, 1), ((0, 1), "r", "o", 1.0, 1), ((1,), "k.", None, 1.0, 0))
#: State 1: a target was named; state 2: an insult waits for one. J is a target that joins an insult.
TARGET = _arcs(((0, 1, 2), "T", None, 1.0, 1), ((0, 1), "t", "o", 1.0, 1), ((2,), "t", "J", 1.0, 1), ((0, 2), "abc", None, 1.0, 2), ((1,), "abc", None, 1.25, 1), ((0, 1, 2), ".", None, 1.0, 0))
#: Writes + for a match, - for anything else; state 1: the clause has a match already.
INSULT = _arcs(((0,), "ok", "-", 1.0, 0), ((1,), "ok", "-", 1.0, 1), *[((q,), s, "+", w * (1.0, 1.1)[q], 1) for q in (0, 1) for s, w in _WEIGHTS.items()], ((0, 1), "T", "+", 3.0, 1), ((0, 1), "J", "+", 0.5, 1), ((0, 1), ".", "-", 1.0, 0))
CASCADE = (THREAT, NEGATION, REPORT, TARGET, INSULT)


def compose(first: Transducer, second: Transducer, symbols: str = SYMBOLS) -> Transducer:
    """The transducer that writes what ``second`` writes for what ``first`` writes; weights multiply."""
    number, queue, arcs = {(0, 0): 0}, deque([(0, 0)]), {}
    while queue:
        at = queue.popleft()
        for s in symbols:
            middle, w, p = first.arc(at[0], s)
            out, v, q = second.arc(at[1], middle)
            if (p, q) not in number:
                number[p, q] = len(number)
                queue.append((p, q))
            arcs[number[at], s] = (out, w * v, number[p, q])
    return Transducer(arcs)


def _table() -> tuple[list[dict[str, int]], list[dict[str, float]]]:
    """Next states and emitted weights (0 without a match) of the composed grammar."""
    whole = reduce(compose, CASCADE)
    n = 1 + max(q for q, _ in whole.arcs)
    step, emit = [{} for _ in range(n)], [{} for _ in range(n)]
    for (q, s), (out, w, to) in whole.arcs.items():
        step[q][s], emit[q][s] = to, w if out == "+" else 0.0
    return step, emit


STEP, EMIT = _table()
_LIVE = re.compile("[abch]")


class _Symbols(dict):
    """Symbols of words, filled as they occur."""

    def __init__(self, stems: dict[str, float]):
        self.stems = stems

    def __missing__(self, word: str) -> str:
        if len(self) > 200_000:
            self.clear()
        self[word] = s = self.symbol(word)
        return s

    def symbol(self, word: str) -> str:
        for words, s in ((STOPS, "."), (BREAKS, "k"), (THREATS, "h"), (TARGETS, "t"), (NEGATIONS, "n"), (REPORTS, "r")):
            if word in words:
                return s
        # the longest stem that the word begins with ('$' ends a whole word)
        for stem in (word + "$", *(word[:k] for k in range(min(len(word), _LONGEST), _SHORTEST - 1, -1))):
            if stem in self.stems:
                return "abc"[sum(self.stems[stem] > x for x in _STRENGTHS)]
        return "o"


class Grammar:
    """The composed table over the words of a text; ``emit`` gives the features of a text."""

    def __init__(self, stems: dict[str, float]):
        self.stems, self._symbols = stems, _Symbols(stems)

    def clauses(self, symbols: str) -> Iterator[float]:
        """The weight of each matched clause."""
        for clause in symbols.split("."):
            if _LIVE.search(clause):  # no other symbol can lead to a match
                state = total = 0
                for s in clause:
                    total += EMIT[state][s]
                    state = STEP[state][s]
                if total:
                    yield total

    def emit(self, text: str | None) -> tuple[float, float, float, float]:
        """Sum, largest clause, sum for 100 words, and log length."""
        tokens = _TOKEN.findall((text or "").lower())
        got = list(self.clauses("".join(map(self._symbols.__getitem__, tokens))))
        total = sum(got)
        return math.log1p(total), math.log1p(max(got, default=0.0)), math.log1p(100 * total / (len(tokens) + 20)), math.log1p(len(tokens)) / 10


def _stem_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``stem, toxic, half, n, docs`` of some rows; the stem '' counts all words."""
    names = ["stem", "toxic", "half"]
    n, docs = Counter(), Counter()

    def out() -> pd.DataFrame:
        frame = pd.DataFrame([*n], columns=names)
        return frame.assign(n=[*n.values()], docs=[docs[k] for k in n])

    for b in batches:
        for text, y, half in zip(b["text"], b["toxic"], b["half"], strict=True):
            own = Counter()
            for w, c in Counter(w for w in _TOKEN.findall((text or "").lower()) if w[0].isalpha()).items():
                own["", y, half] += c
                for k in range(_SHORTEST, min(len(w), _LONGEST) + 1):
                    own[w[:k], y, half] += c
                own[w + "$", y, half] += c
            n.update(own)
            docs.update(own.keys())
            if len(n) > 300_000:
                yield out()
                n.clear()
                docs.clear()
    if n:
        yield out()


def learn_stems(counts: DataFrame, halves: tuple[int, ...], most: int = 600, least_docs: int = 3, least_ratio: float = 6.0) -> dict[str, float]:
    """At most ``most`` stems over-represented in toxic rows of ``halves``, with log rate ratios as weights."""
    own = counts.where(F.col("half").isin(*halves))
    words = {r["toxic"]: r["n"] for r in own.where("stem = ''").groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    told = own.where("stem <> ''").groupBy("stem").agg(*[F.coalesce(F.sum(F.when(F.col("toxic") == y, F.col("n"))), F.lit(0)).alias(f"n{y}") for y in (0, 1)], F.sum(F.when(F.col("toxic") == 1, F.col("docs"))).alias("docs"))
    ratio = ((F.col("n1") + 0.1) / max(words.get(1, 0), 1)) / ((F.col("n0") + 0.5) / max(words.get(0, 0), 1))
    told = told.withColumn("ratio", ratio).where((F.col("docs") >= least_docs) & (F.col("ratio") >= least_ratio))
    best = told.orderBy(F.desc(F.col("docs") * F.log("ratio")), F.desc(F.length("stem")), "stem").limit(most)
    return {r["stem"]: r["w"] for r in best.select("stem", F.log("ratio").alias("w")).collect()}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps on the ridge-penalised logistic loss; the first coefficient is the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


@shared.tidied
def _chosen(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``text, toxic, half`` of at most ``sample`` labelled ids outside the held-out fold, written."""
    folds = labels.where(F.col("toxic").isin(0, 1) & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = folds.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample)  # a few dozen bytes a row
    half = F.pmod(F.crc32(F.concat(F.lit("half:"), F.col("doc_id").cast("string")).cast("binary")), F.lit(2)).cast("int")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    return shared.written(rows.select("text", "toxic", half.alias("half")), "labelled")


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> tuple[Grammar, np.ndarray]:
    """Grammar and coefficients from at most ``sample`` labelled ids outside the held-out fold."""
    rows = _chosen(docs, labels, sample)
    counted = rows.mapInPandas(_stem_counts, "stem string, toxic int, half int, n long, docs long")
    counts = shared.written(counted.groupBy("stem", "toxic", "half").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "stems")
    # stems from one half, coefficients from the other, and both ways: weights are not fitted to their own rows
    by_half = [learn_stems(counts, (1,)), learn_stems(counts, (0,))]

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammars = [Grammar(s) for s in by_half]
        for b in batches:
            if len(b):
                x = np.array([grammars[h].emit(t) for t, h in zip(b["text"], b["half"], strict=True)])
                yield pd.DataFrame(x, columns=["x0", "x1", "x2", "x3"]).assign(toxic=b["toxic"].to_numpy())

    got = np.array(sorted(map(tuple, rows.mapInPandas(features, "x0 double, x1 double, x2 double, x3 double, toxic int").collect())))
    stems = learn_stems(counts, (0, 1))
    for table in (rows, counts):
        shared.forget(table)
    if not len(got) or len(set(got[:, 4])) < 2:
        return Grammar({}), np.array([-2.0, 0, 0, 0, 0])
    return Grammar(stems), fit_logistic(got[:, :4], got[:, 4])


def fold(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def score(docs: DataFrame, grammar: Grammar, coefficients: np.ndarray) -> DataFrame:
    """``doc_id, score`` for every row; only texts are read."""
    stems, b = grammar.stems, [float(v) for v in coefficients]

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = Grammar(stems)
        for batch in batches:
            if len(batch):
                x = np.array([g.emit(t) for t in batch["text"]])
                yield pd.DataFrame({"key": batch["key"], "score": 1 / (1 + np.exp(-np.clip(b[0] + x @ np.array(b[1:]), -30, 30)))})

    scored = docs.select(F.col("doc_id").cast("string").alias("key"), F.col("text").cast("string").alias("text")).mapInPandas(stream, "key string, score double")
    return scored.select(F.col("key").cast("long").alias("doc_id"), "score")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    out = score(docs, *fit(docs, shared.table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
