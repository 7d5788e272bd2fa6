"""Toxicity by a weighted finite-state grammar over clauses, with a lexicon learned from labels."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm import labelled, words

SAMPLE = 30_000  # labelled rows used for fitting, at most
LEXICON = 20_000  # learned entries, at most
STEMS = (4, 5, 6)  # lengths of the word beginnings that may be entries
EVIDENCE = 14.0  # log-likelihood ratio an entry needs

# Function words of the grammar in English, French, German and Spanish, and threat verbs.
TARGETS = "you your yours he she they him her them tu toi vous te vos ton ta il elle ils elles du dich dir ihr euch sie er tú vosotros usted ustedes ellos ellas él ella".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says called reported quoted wrote claimed sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split()
THREATS = "kill hurt destroy burn beat smash shoot stab töten umbringen schlagen tuer frapper brûler détruire matar golpear quemar destruir".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
_FIXED = {w: c for c, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in ws}
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_ENDS = re.compile(rb"[.!?;:|,\"]$")


def bare(word: bytes) -> str:
    return _EDGE.sub("", word.decode("utf-8", "replace").lower())


def entries_of(word: str) -> list[str]:
    """The lexicon entries that a word can match: itself, or a stem it goes on from (marked `*`)."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


@dataclass(frozen=True)
class Transducer:
    """Weighted finite-state transducer over token classes: state and class to next state and factor; others keep the state at factor 1."""

    steps: dict[tuple[int, int], tuple[int, float]]

    def step(self, state: int, kind: int) -> tuple[int, float]:
        return self.steps.get((state, kind), (state, 1.0))


# What each part of the grammar does to the weight of an insult or a threat that follows it in the clause.
INSULTS = Transducer({(0, THREAT): (0, 1.0), (0, INSULT): (0, 1.0)})
THREATENING = Transducer({(0, THREAT): (0, 0.2), (0, TARGET): (1, 1.0), (1, THREAT): (1, 1.0), (1, TARGET): (1, 1.0)})
AIMED = Transducer({(0, TARGET): (1, 1.0), (1, INSULT): (1, 1.5)})
NEGATED = Transducer({(0, NEGATION): (1, 1.0), (1, INSULT): (0, 0.4), (1, THREAT): (0, 0.4)})
REPORTED = Transducer({(0, REPORT): (1, 1.0), (1, INSULT): (1, 0.5), (1, THREAT): (1, 0.4)})


def compose(parts: tuple[Transducer, ...]) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], float]]:
    """One transducer that does what all parts do side by side: next state and factor per reachable state and class.

    A state stands for the tuple of the parts' states, a factor is the product of theirs.
    """
    numbers, follow, factor = {(0,) * len(parts): 0}, {}, {}
    open_ = list(numbers)
    while open_:
        at = open_.pop()
        for kind in range(6):
            moved = [p.step(s, kind) for p, s in zip(parts, at)]
            to = tuple(m[0] for m in moved)
            if to not in numbers:
                numbers[to] = len(numbers)
                open_.append(to)
            follow[numbers[at], kind] = numbers[to]
            factor[numbers[at], kind] = math.prod(m[1] for m in moved)
    return follow, factor


_NEXT, _FACTOR = compose((INSULTS, THREATENING, AIMED, NEGATED, REPORTED))


def clause_score(classes: list[int], weights: list[float]) -> float:
    """Weight of a clause's path through the composed grammar (it is deterministic): insults and threats emit, summed."""
    state, total = 0, 0.0
    for c, w in zip(classes, weights):
        if c in (INSULT, THREAT):
            total += w * _FACTOR[state, c]
        state = _NEXT[state, c]
    return total


def _seen_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct entries of each text, counted per batch: entry, texts of label 1, texts of label 0."""
    for batch in batches:
        for part in words.pieces(batch):
            found, counts = words.split(part.column(1))
            distinct, codes = words.coded(found)
            if not len(codes):
                continue
            names: dict[str, int] = {}
            owner, number = [], []
            own = words.owners(counts)
            for w, e in enumerate(map(bare, distinct)):
                if e:
                    for x in entries_of(e):
                        owner.append(w)
                        number.append(names.setdefault(x, len(names)))
            # entries of distinct words, then of each text's distinct words
            starts = np.searchsorted(owner, np.arange(len(distinct) + 1))
            pair = np.unique(own.astype(np.int64) * len(distinct) + codes)
            text, word = pair // len(distinct), pair % len(distinct)
            per = (starts[1:] - starts[:-1])[word]
            at = np.repeat(starts[:-1][word] - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(per.sum())
            entry = np.asarray(number, np.int64)[at] if len(number) else np.empty(0, np.int64)
            once = np.unique(np.repeat(text, per) * max(1, len(names)) + entry)
            text, entry = once // max(1, len(names)), once % max(1, len(names))
            y = part.column(2).to_numpy(zero_copy_only=False)[text]
            pos = np.bincount(entry, y == 1, len(names)).astype(np.int64)
            neg = np.bincount(entry, y != 1, len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.string()), pa.array(pos), pa.array(neg)], ["entry", "pos", "neg"])


def learn_lexicon(examples: DataFrame) -> dict[str, float]:
    """Insult entries with their weights, from a bounded sample: id, text, y.

    Texts holding an entry are counted per label in Spark; an entry stays if its log-likelihood
    ratio shows it to belong to label 1. At most LEXICON entries reach the driver, the strongest ones.
    Its weight is the smoothed log-odds against the base rate. A sample with one label only gives no entry.
    """
    totals = examples.agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n")).first()
    pos_n, neg_n = float(totals.p or 0), float((totals.n or 0) - (totals.p or 0))
    if not pos_n or not neg_n:
        return {}
    seen = examples.mapInArrow(_seen_entries, "entry string, pos long, neg long")
    c = seen.groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).filter("pos >= 3")
    rate = pos_n / (pos_n + neg_n)
    p, n = F.col("pos"), F.col("neg")
    both = p + n
    gain = 2 * (p * F.log(p / (both * rate)) + F.when(n > 0, n * F.log(n / (both * (1 - rate)))).otherwise(0.0))
    odds = F.log((p + 0.5) / (pos_n + 1)) - F.log((n + 0.5) / (neg_n + 1))
    strong = c.withColumn("gain", gain).withColumn("w", odds).filter((F.col("gain") >= EVIDENCE) & (F.col("w") > 1.5))
    got = strong.orderBy(F.desc("gain"), "entry").limit(LEXICON).select("entry", "w").collect()
    return {r.entry: float(r.w) for r in got}


class Grammar:
    """Lexical transducer (word to class and weight) composed with the clause grammar."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known = lexicon, {}

    def token(self, word: bytes) -> tuple[int, float]:
        w = bare(word)
        if w in _FIXED:
            return _FIXED[w], 2.0
        best = max((self.lexicon.get(e, 0.0) for e in entries_of(w)), default=0.0) if w else 0.0
        return (INSULT, best) if best > 0 else (OTHER, 0.0)

    def texts(self, texts: pa.Array) -> np.ndarray:
        """Per text: sum and maximum of its clauses' scores, and matched clauses per 100 words."""
        found, counts = words.split(texts)
        out = np.zeros((len(counts), 3))
        distinct, codes = words.coded(found)
        if not len(codes):
            return out
        pairs = [self.token(w) for w in distinct]
        kind = np.fromiter((k for k, _ in pairs), np.int8, len(pairs))[codes]
        weight = np.fromiter((w for _, w in pairs), float, len(pairs))[codes]
        ends = np.fromiter((bool(_ENDS.search(w)) for w in distinct), bool, len(distinct))[codes]
        own = words.owners(counts)
        opens = np.zeros(len(codes), bool)
        opens[1:] = ends[:-1] | (own[1:] != own[:-1])
        clause = np.cumsum(opens)
        # other words leave the grammar's state as it is, so only the rest of a clause is walked, whatever its length
        said = np.flatnonzero(kind != OTHER)
        cuts = np.flatnonzero(np.diff(clause[said])) + 1
        for part in np.split(said, cuts) if len(said) else ():
            s = clause_score(kind[part].tolist(), weight[part].tolist())
            if s > 0:
                row = out[own[part[0]]]
                row[0] += s
                row[1] = max(row[1], s)
                row[2] += 1
        out[:, 2] *= 100.0 / np.maximum(counts, 1)
        return out


def _design(f: np.ndarray) -> np.ndarray:
    return np.column_stack([np.log1p(f[:, 0]), f[:, 1], np.log1p(f[:, 2]), f[:, 0] > 0])


def calibrate(examples: DataFrame, lexicon: dict[str, float]) -> np.ndarray:
    """Logistic weights (bias last) of the clause features, from at most SAMPLE rows of six numbers each."""
    rows = clause_features(examples, lexicon, "id", "text", "y").toPandas()
    if rows.empty or rows["y"].nunique() < 2:
        return np.array([0.0, 0.0, 0.0, 2.0, -2.0])
    x = np.column_stack([_design(rows[["total", "top", "density"]].to_numpy(float)), np.ones(len(rows))])
    y, w = rows["y"].to_numpy(float), np.zeros(5)
    for _ in range(50):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(5)
        w = w + np.linalg.solve(h, x.T @ (y - p) - 0.5 * w)
    return w


def clause_features(docs: DataFrame, lexicon: dict[str, float], id_col: str, text_col: str, *carried: str) -> DataFrame:
    rows = docs.select(F.col(id_col), F.col(text_col), *carried)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    names = [id_col, *carried, "total", "top", "density"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names[:-3])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(shared.value)
        for batch in batches:
            for part in words.pieces(batch):
                f = grammar.texts(part.column(1))
                kept = [part.column(0), *(part.column(2 + i) for i in range(len(carried)))]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(f[:, i]) for i in range(3))], names)

    return rows.mapInArrow(run, f"{schema}, total double, top double, density double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, sample: int = SAMPLE,
             threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1), predicted.

    The insult lexicon and the calibration are learned from at most `sample` labelled rows outside the
    held-out fold; every text is then cut in clauses at marks, its words become token classes with weights, and the
    composed grammar scores each clause that holds an insult or a threat: more with a target before it, less
    when negated or reported.

    Null and empty texts match no clause and get the score of that. Repeated rows are scored each, null ids
    pass through, an empty table gives an empty table; without labels nothing is learned and only
    threats count.
    """
    examples = labelled.sample(docs, labels, "toxic", folds, held_out, sample, id_col, text_col).persist()
    lexicon = learn_lexicon(examples)
    w = calibrate(examples, lexicon)
    examples.unpersist()
    f = clause_features(docs, lexicon, id_col, text_col)
    total = F.log1p("total") * w[0] + F.col("top") * w[1] + F.log1p("density") * w[2] + (F.col("total") > 0).cast("int") * w[3] + w[4]
    return f.select(
        id_col, (labelled.remainder(F.col(id_col), folds) == held_out).alias("held_out"),
        (1 / (1 + F.exp(-total))).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
