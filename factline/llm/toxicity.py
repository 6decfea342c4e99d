"""Toxicity by a weighted finite-state grammar over clauses.

Transducers for insult, threat, target, negation and reported speech read a clause from left to
right; their composition turns matched clauses into weighted events, never isolated words into a
verdict by themselves. Insult words and insult stems (a stem followed by any ending) come from a
short fixed list and from labelled documents; the weights of the events are fitted on the same
bounded sample of labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm import common as K
from factline.sources import scratch

# The seed grammar.
INSULTS = ("idiot", "stupid", "moron", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile")
THREATS = ("kill", "hurt", "destroy", "burn", "beat", "stab", "shoot", "hang")
INTENTS = ("will", "gonna", "should", "shall", "going", "must")
TARGETS = ("you", "your", "youre", "he", "she", "they", "them", "him", "her", "this", "that", "these", "those")
NEGATIONS = ("not", "never", "isnt", "arent", "wasnt", "hardly", "without")
REPORTS = ("said", "says", "wrote", "quoted", "quote", "called", "reported", "claimed", "according")

SEED_WEIGHT = 4.0
STEMS = (4, 5, 6)
NEAR = 3
EVENTS = ("plain", "negated", "reported", "targeted", "threat", "clauses")
WORD = re.compile(r"[^\W_]+")
CLAUSE = re.compile(r"[^.!?;:\n]+")


@dataclass(frozen=True)
class Grammar:
    """`words` and `stems` map to log-odds; `weights` has one weight an event and the bias last."""

    words: dict[str, float]
    stems: dict[str, float]
    weights: tuple[float, ...] = (1.0, 0.4, 0.4, 0.5, 2.0, 0.3, -3.0)


SEED = Grammar({w: SEED_WEIGHT for w in INSULTS}, {})


class Lexer(dict):
    """Weight of a word as an insult: its own, or that of its longest known stem. Remembered."""

    def __init__(self, g: Grammar):
        super().__init__()
        self.g = g

    def __missing__(self, w: str) -> float:
        if len(self) >= K.CACHED_WORDS:
            self.clear()
        v = self.g.words.get(w, 0.0)
        if not v:
            v = next((self.g.stems[w[:n]] for n in reversed(STEMS) if len(w) >= n and w[:n] in self.g.stems), 0.0)
        if len(w) <= 64:
            self[w] = v
        return v


def clause_events(words: list[str], lexer: Lexer) -> list[float] | None:
    """One run of the composed transducers over a clause: events in the order of EVENTS, or None.

    States carried from word to word: how long ago a negation, an intent and a target stood, and
    whether the clause reports someone's speech.
    """
    out = [0.0] * 6
    negated = intent = target = -99
    reported = hit = False
    for i, w in enumerate(words):
        if w in NEGATIONS:
            negated = i
        elif w in REPORTS:
            reported = True
        elif w in INTENTS:
            intent = i
        elif w in TARGETS:
            target = i
        if w in THREATS and (i - intent <= NEAR or (i + 1 < len(words) and words[i + 1] in TARGETS)):
            out[4] += 0.3 if reported or i - negated <= NEAR else 1.0
            hit = True
        v = lexer[w]
        if v:
            hit = True
            out[1 if i - negated <= NEAR else 2 if reported else 0] += v
            if i - target <= NEAR:
                out[3] += 1.0
    if not hit:
        return None
    out[5] = 1.0
    return out


def events(text: str | None, lexer: Lexer) -> tuple[list[float], int]:
    """Summed events of a whole text, and how many of its clauses matched."""
    total = [0.0] * 6
    if not text:
        return total, 0
    low = text.lower()
    seen = set(WORD.findall(low))
    if not any(map(lexer.__getitem__, seen)) and seen.isdisjoint(THREATS):
        return total, 0
    n = 0
    for clause in CLAUSE.findall(low):
        got = clause_events(WORD.findall(clause), lexer)
        if got:
            n += 1
            total = [a + b for a, b in zip(total, got)]
    return total, n


def squashed(x: np.ndarray) -> np.ndarray:
    """Event sums as the scorer sees them: growing, but ever more slowly."""
    return np.log1p(np.asarray(x, float))


def labelled(docs: DataFrame, labels: DataFrame, max_train: int, usable) -> DataFrame:
    """Distinct texts with a label, at most `max_train` of the labelled ids, chosen by a hash of the id.

    `usable` is a Column over doc_id of rows that may be learned from. The ids are at most
    `max_train`, so they are broadcast; texts don't move until they are chosen.
    """
    ids = labels.where("doc_id is not null and toxic is not null").where(usable).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(ids), "doc_id").select("text", "y")
    return rows.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, usable=None, max_train: int = 20_000, min_docs: int = 5, min_weight: float = 3.0, max_lexicon: int = 5_000) -> Grammar:
    """Learn insult words, stems and event weights from at most `max_train` labelled documents.

    A word or stem enters the lexicon if at least `min_docs` distinct toxic texts hold it and its
    log-odds reach `min_weight`. Without toxic or without other texts the seed grammar is returned.
    """
    usable = F.lit(True) if usable is None else usable
    sample = scratch.written(labelled(docs, labels, max_train, usable), "toxic-sample")
    sizes = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        return SEED

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flushed(c):
            return pd.DataFrame([(f, *v) for f, v in c.items()], columns=["f", "pos", "neg"])

        seen: dict[str, list[int]] = {}
        for pdf in batches:
            for text, y in zip(pdf["text"], pdf["y"]):
                words = set(WORD.findall(text.lower()))
                found = set(words)
                found.update(f"{w[:n]}*" for w in words for n in STEMS if len(w) >= n)
                for f in found:
                    seen.setdefault(f, [0, 0])[0 if y == 1 else 1] += 1
                if len(seen) > 1_000_000:
                    yield flushed(seen)
                    seen = {}
        yield flushed(seen)

    counts = sample.select("text", "y").mapInPandas(count, "f string, pos long, neg long")
    counts = counts.groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where(F.col("pos") >= min_docs)
    odds = F.log((F.col("pos") + 0.5) / (n_pos + 1.0)) - F.log((F.col("neg") + 0.5) / (n_neg + 1.0))
    # Of the unbounded vocabulary only the strongest max_lexicon come to the driver: the size of the model.
    rows = counts.withColumn("w", odds).where(F.col("w") >= min_weight).orderBy(F.desc("w"), "f").limit(max_lexicon).collect()
    words = {w: SEED_WEIGHT for w in INSULTS} | {r.f: r.w for r in rows if not r.f.endswith("*")}
    stems = {r.f[:-1]: r.w for r in rows if r.f.endswith("*")}
    grammar = Grammar(words, stems)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexer = Lexer(grammar)
        for pdf in batches:
            yield pd.DataFrame({"x": [events(t, lexer)[0] for t in pdf["text"]], "y": pdf["y"]})

    # As many rows as the sample has, seven numbers each; equal rows are counted, not repeated.
    got = sample.select("text", "y").mapInPandas(look, "x array<double>, y int").groupBy("x", "y").count().limit(2 * max_train).collect()
    x = np.array([r.x for r in got])
    return Grammar(words, stems, logistic(squashed(x), np.array([r.y for r in got], float), np.array([r["count"] for r in got], float)))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 200) -> tuple[float, ...]:
    """Weights that are never below zero, so that a further match never lowers a score; bias last."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (n * (p - y)) + penalty * w
        curve = (a * (n * (p * (1 - p) + 1e-4))[:, None]).T @ a + np.diag(penalty)
        new = w - np.linalg.solve(curve, grad)
        new[:-1] = np.maximum(new[:-1], 0)
        done = np.abs(new - w).max() < 1e-6
        w = new
        if done:
            break
    return tuple(float(v) for v in w)


def score(docs: DataFrame, grammar: Grammar, text: str = "text", into: str = "toxicity") -> DataFrame:
    """Every row of `docs` with a struct column `into`: score (0 to 1) and matched clauses.

    Null and empty texts have no clause and get the grammar's base score. Rows, repeated ones too,
    are kept as they are; a column of that name is replaced. No shuffle.
    """

    @F.pandas_udf("score double, clauses long")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lexer = Lexer(grammar)
        w = np.array(grammar.weights)
        for s in batches:
            got = [events(t, lexer) for t in s]
            z = squashed(np.array([e for e, _ in got]).reshape(-1, 6)) @ w[:-1] + w[-1]
            yield pd.DataFrame({"score": 1 / (1 + np.exp(-np.clip(z, -30, 30))), "clauses": [n for _, n in got]})

    return docs.withColumn(into, scored(F.col(text)))


def held_out(doc_id) -> F.Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 5, is 0. Null ids: false."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted and clauses for every row of `docs`."""
    grammar = fit(docs, labels, ~held_out("doc_id"), max_train)
    out = score(docs.select("doc_id", "text"), grammar, into="_t")
    s = F.col("_t.score")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), s.alias("score"), F.when(s >= 0.5, 1).otherwise(0).alias("predicted"), F.col("_t.clauses").alias("clauses"))
