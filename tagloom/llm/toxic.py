"""Toxic sentences by a gapped-subsequence string kernel, Nystroem landmarks and a support vector machine.

Units.  A text is read as units: its words in lower case, also without characters that are no letters, and
single letters that follow each other (spelt-out words) put together.  A sentence is as toxic as its worst unit, a text as its worst sentence.

Kernel.  The features of a unit are its subsequences of ORDER letters (a start and an end mark
included) within SPAN places, weighted DECAY^(places covered); other characters take a place but are
never part of a feature, so inserted characters and gaps only lower the weights, and the kernel is
normalised by the unit's own length in feature space.

Machine.  LANDMARKS training units span the Nystroem space; a linear squared-hinge machine is trained in it.  As
the kernel's features are explicit, the trained machine is folded back into one weight per
subsequence: scoring a unit is a weighted sum of table entries, equal to evaluating all landmarks.

Training.  Labels belong to texts, so sentences of labelled texts are learnt by multiple instances: in
a toxic text at least one unit is toxic, in others none is.  Units that many toxic texts share and
others do not are found by greedy cover and are positive; after each fit the other toxic texts add their
highest unit where its margin is above SURE, and the highest units of the other texts become further
negatives.  Training reads at most about MAX_TOXIC toxic and
MAX_CLEAN other labelled texts, chosen by a digest of the id.  A logistic curve maps the worst unit of
a text to a score.

A null or empty text, or one without letters, has the score of a text without any evidence.  Without
positive training texts every score is 0.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

#: labelled texts read for training
MAX_TOXIC = 1000
MAX_CLEAN = 2500
LANDMARKS = 256
DECAY = 0.7
SPAN = 7
ROUNDS = 3
SURE = 0.5
#: a toxic text weighs as much as this many clean ones; a unit stands for at most MOST_TEXTS clean texts
TOXIC_WEIGHT = 10
MOST_TEXTS = 30
#: units longer than this are read in overlapping stretches
LONGEST = 40
KEPT_UNITS = 250_000
#: stretches whose features are held at a time, in tasks and in training, which runs on the driver beside the session
HELD = 8_000
HELD_IN_TRAINING = 1_000
_SYMBOLS = 40
#: letters in one subsequence
ORDER = 4
_TABLE = _SYMBOLS ** ORDER
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SPELT = re.compile(r"(?<!\S)(?:\S[ \t]+){2,}\S(?!\S)")


def symbol(letter: str) -> int:
    """0 for what is no letter, 1 and 2 are the marks, then a-z, then a place for each other letter."""
    if "a" <= letter <= "z":
        return ord(letter) - ord("a") + 3
    return 29 + ord(letter) % 11 if letter.isalpha() else 0


_of: dict[str, int] = {}


def units_of(text: str) -> set[str]:
    """Distinct units of a text."""
    lowered = text.lower()
    found = {w.strip(_EDGES) for w in set(lowered.split())}
    for m in _SPELT.finditer(lowered):
        letters = m.group().split()
        found.add("".join(letters).strip(_EDGES))
        if letters[0] in ("a", "i"):  # a word of its own before the spelt one
            found.add("".join(letters[1:]).strip(_EDGES))
    # a unit with characters put between its letters is also read without them
    found |= {"".join(filter(str.isalpha, w)) for w in found if not w.isalpha()}
    found.discard("")
    return found


def _codes(unit: str) -> list[int]:
    out = [1]
    for letter in unit:
        code = _of.get(letter)
        if code is None:
            code = _of[letter] = symbol(letter)
            if len(_of) > 100_000:
                _of.clear()
        out.append(code)
    while len(out) > 1 and not out[-1]:
        out.pop()  # punctuation at the end is no gap
    at = 1
    while at < len(out) and not out[at]:
        at += 1
    return [1, *out[at:], 2]


def _stretches(codes: list[int]) -> list[list[int]]:
    if len(codes) <= LONGEST:
        return [codes]
    step = LONGEST - 2 * SPAN
    return [codes[at:at + LONGEST] for at in range(0, len(codes) - 2 * SPAN, step)]


class Features:
    """Weighted subsequences of stretches: row, feature, weight; rows have unit length."""

    def __init__(self, stretches: list[list[int]]) -> None:
        rows, keys, weights = [], [], []
        order: dict[int, list[int]] = {}
        for i, s in enumerate(stretches):
            order.setdefault(len(s), []).append(i)
        for size, members in order.items():
            grid = np.array([stretches[i] for i in members], np.int64)
            row = np.array(members)
            for last in range(ORDER - 1, min(SPAN, size)):
                for inner in itertools.combinations(range(1, last), ORDER - 2):
                    key, ok = 0, True
                    for at in (0, *inner, last):
                        letter = grid[:, at:size - last + at]
                        key, ok = key * _SYMBOLS + letter, ok & (letter > 0)
                    rows.append(np.broadcast_to(row[:, None], key.shape)[ok])
                    keys.append(key[ok])
                    weights.append(np.full(int(ok.sum()), DECAY ** (last + 1)))
        n = len(stretches)
        row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        pair = row * _TABLE + (np.concatenate(keys) if keys else row)
        pair, inverse = np.unique(pair, return_inverse=True)
        weight = np.bincount(inverse, np.concatenate(weights) if weights else None, len(pair)).astype(float)
        self.row, self.key = (pair // _TABLE).astype(np.int32), (pair % _TABLE).astype(np.int32)
        norm = np.sqrt(np.bincount(self.row, weight * weight, n))
        self.weight = (weight / np.maximum(norm[self.row], 1e-12)).astype(np.float32)
        self.n = n

    def dot(self, table: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.weight * table[self.key], self.n)

    def against(self, landmarks: Features) -> np.ndarray:
        """Kernel values of every row with every landmark."""
        out = np.empty((self.n, landmarks.n))
        edges = np.searchsorted(landmarks.row, np.arange(landmarks.n + 1))
        table = np.zeros(_TABLE, np.float32)
        for j in range(landmarks.n):
            some = slice(edges[j], edges[j + 1])
            table[landmarks.key[some]] = landmarks.weight[some]
            out[:, j] = self.dot(table)
            table[landmarks.key[some]] = 0
        return out


@dataclass
class Model:
    table: np.ndarray  # one weight per subsequence
    bias: float
    slope: float
    shift: float


def unit_margins(units: list[str], model: Model, held: int = HELD) -> np.ndarray:
    """Distance of each unit from the machine's border; the worst stretch of a long unit counts."""
    stretches, owner = [], []
    for i, u in enumerate(units):
        parts = _stretches(_codes(u))
        stretches += parts
        owner += [i] * len(parts)
    out = np.full(len(units), -np.inf)
    for at in range(0, len(stretches), held):
        value = Features(stretches[at:at + held]).dot(model.table) + model.bias
        np.maximum.at(out, owner[at:at + held], value)
    return out


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1e-4, steps: int = 400) -> np.ndarray:
    """Linear squared-hinge machine by accelerated gradient steps; the last column of x is constant."""
    w = np.zeros(x.shape[1])
    ahead, before, t = w.copy(), w.copy(), 1.0
    scaled = x * np.sqrt(weight)[:, None]
    curve = 2 * np.linalg.norm(scaled.T @ scaled, 2) + cost
    del scaled
    for _ in range(steps):
        gap = np.maximum(0, 1 - y * (x @ ahead))
        w = ahead - (cost * ahead - 2 * x.T @ (weight * y * gap)) / curve
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, before = w + (old - 1) / t * (w - before), w
    return w


def _in_parts(stretches: list[list[int]]) -> Iterator[Features]:
    """Features of a bounded number of stretches at a time, in order."""
    for at in range(0, len(stretches), HELD_IN_TRAINING):
        yield Features(stretches[at:at + HELD_IN_TRAINING])


def _fit_units(toxic: dict[str, float], clean: dict[str, float], seed: int) -> Model:
    """Machine over units that weigh by the number of texts they stand for."""
    rng = np.random.Generator(np.random.PCG64(seed))
    names = sorted(toxic) + sorted(clean)
    first = [_stretches(_codes(u))[0] for u in names]
    y = np.array([1.0] * len(toxic) + [-1.0] * len(clean))
    weight = np.array([toxic[u] for u in sorted(toxic)] + [clean[u] for u in sorted(clean)])
    half = LANDMARKS // 2
    centre = np.zeros(_TABLE)
    for part in _in_parts(first[:len(toxic)]):
        np.add.at(centre, part.key, part.weight)
    likeness = np.concatenate([part.dot(centre) for part in _in_parts(first[len(toxic):])])
    alike = np.argsort(-likeness, kind="stable")[:half // 2]  # clean units most like toxic ones
    chosen = [*rng.permutation(len(toxic))[:half].tolist(), *(len(toxic) + alike).tolist(),
              *(len(toxic) + rng.permutation(len(clean))[:half // 2]).tolist()]
    landmarks = Features([first[i] for i in chosen])
    values, vectors = np.linalg.eigh(landmarks.against(landmarks))
    good = values > 1e-6
    project = vectors[:, good] / np.sqrt(values[good])
    x, at = np.ones((len(first), project.shape[1] + 1)), 0
    for part in _in_parts(first):
        x[at:at + part.n, :-1] = part.against(landmarks) @ project
        at += part.n
    w = _machine(x, y, weight)
    alpha = project @ w[:-1]
    table = np.bincount(landmarks.key, landmarks.weight * alpha[landmarks.row], _TABLE)
    return Model(table.astype(np.float32), float(w[-1]), 1.0, 0.0)


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve."""
    a, b, weight = 2.0, 0.0, np.full(len(m), 1 / max(1, len(m)))
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = weight * (p - (y > 0))
        a, b = a - 2 * (g @ m + 1e-3 * (a - 4)), b - 2 * g.sum()
    return float(max(a, 1e-3)), float(b)


def cover(bags: list[list[str]], common: Counter, least: int) -> list[str]:
    """Units that toxic texts share: those of one text in 25, then greedily the one that most texts without
    a chosen one have.

    A unit of other texts must be 50 times rarer there; a greedy choice must add ``least`` texts.
    """
    ratio = max(1.0, sum(common.values()) / max(1, sum(map(len, bags))))
    holders: dict[str, list[int]] = {}
    for i, b in enumerate(bags):
        for u in b:
            holders.setdefault(u, []).append(i)
    open_ = {u: h for u, h in holders.items() if len(h) >= least and len(h) * ratio > 50 * common[u]}
    free = np.ones(len(bags), bool)
    chosen = sorted(u for u, h in open_.items() if 25 * len(h) >= len(bags) and len(h) >= 2 * least)
    for u in chosen:
        free[open_.pop(u)] = False
    while open_:
        gain = {u: int(free[h].sum()) for u, h in open_.items()}
        open_ = {u: h for u, h in open_.items() if gain[u] >= least}
        if not open_:
            break
        best = max(open_, key=lambda u: (gain[u], u))
        chosen.append(best)
        free[open_.pop(best)] = False
    return chosen


def _margins(units: list[str], model: Model) -> dict[str, float]:
    return dict(zip(units, unit_margins(units, model, HELD_IN_TRAINING).tolist(), strict=True))


def fit(toxic_texts: list[str], clean_texts: list[str], seed: int = 5) -> Model | None:
    """Multiple-instance training from whole labelled texts; None without toxic texts."""
    one: dict[str, str] = {}  # a unit of many texts is held once
    bags, clean_bags = ([[one.setdefault(u, u) for u in sorted(units_of(t))] for t in texts] for texts in (toxic_texts, clean_texts))
    if not any(bags):
        return None
    there = Counter(u for b in clean_bags for u in b)
    rng = np.random.Generator(np.random.PCG64(seed))
    start = cover(bags, there, 5 if len(bags) > 200 else 3 if len(bags) > 12 else 1)
    known = set(start)
    unexplained = [b for b in bags if b and not known.intersection(b)]
    everyday = sorted(there, key=lambda u: (-there[u], u))
    clean = set(everyday[:2000]) | {everyday[i] for i in rng.permutation(len(everyday))[:6000].tolist()}
    toxic = dict.fromkeys(start, 0.0)
    for b in bags:
        shared = known.intersection(b)
        for u in shared:
            toxic[u] += 1 / len(shared)
    if not toxic:
        toxic = {u: 1.0 for b in unexplained for u in b if not there[u]} or {unexplained[0][0]: 1.0}
    explained = dict(toxic)
    inside = sorted({u for b in unexplained for u in b})

    def machine(turn: int) -> Model:
        ordinary = {u: min(there[u], MOST_TEXTS) / len(bags) / TOXIC_WEIGHT for u in clean if u not in toxic} or {"-": 1.0}
        return _fit_units({u: n / len(bags) for u, n in toxic.items()}, ordinary, seed + turn)

    model = machine(0)
    for turn in range(1, ROUNDS + 1):
        value = _margins(everyday, model)
        hard = sorted(everyday, key=lambda u: (-value[u], u))[:3000]
        clean |= {u for u in hard if value[u] > -0.9}
        value = _margins(inside, model)
        # a toxic text without a shared unit is explained by its highest one, if that is much like the shared
        # ones; else its label counts as an error
        best = Counter(max(b, key=lambda u: (value[u], u)) for b in unexplained)
        toxic = explained | {u: n for u, n in best.items() if not there[u] and value[u] > SURE}
        model = machine(turn)
    value = _margins(sorted(set(everyday).union(*bags)), model)
    worst = [max(map(value.__getitem__, b), default=-3.0) for b in bags + clean_bags]
    y = np.array([1] * len(bags) + [-1] * len(clean_bags))
    model.slope, model.shift = _logistic(np.maximum(np.array(worst), -3), y)
    return model


class Scorer:
    """Scores texts, and keeps the margins of units met lately (two bounded generations)."""

    def __init__(self, model: Model) -> None:
        self.model, self.young, self.old = model, {}, {}

    def scores(self, texts: list[str]) -> np.ndarray:
        bags = [units_of(t) for t in texts]
        fresh = []
        for u in set().union(*bags) if bags else ():
            if u not in self.young:
                if u in self.old:
                    self.young[u] = self.old[u]
                else:
                    fresh.append(u)
        self.young.update(zip(fresh, unit_margins(fresh, self.model).tolist(), strict=True))
        worst = np.array([max(map(self.young.__getitem__, b), default=-3.0) for b in bags])
        if len(self.young) > KEPT_UNITS // 2:
            self.old, self.young = self.young, {}
        m = np.maximum(worst, -3)
        return 1 / (1 + np.exp(-np.clip(self.model.slope * m + self.model.shift, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Train on ``docs`` (``doc_id, text``) that ``labels`` (``doc_id, toxic``) covers, see the bounds above.

    Null labels are no labels; a document labelled twice counts with its highest label.
    """
    marked = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = (F.when(F.col("toxic") == 1, F.lit(min(1.0, MAX_TOXIC / max(1, sizes.get(1, 0)))))
             .otherwise(F.lit(min(1.0, MAX_CLEAN / max(1, sum(n for k, n in sizes.items() if k != 1))))))
    # the chosen ids are about MAX_TOXIC + MAX_CLEAN numbers, so no text has to be shuffled to meet its label
    chosen = (docs.where(F.col("text").isNotNull()).select("doc_id", "text")
              .join(F.broadcast(marked.where(draw < share)), "doc_id").select("doc_id", "toxic", "text").toArrow())
    order = sorted(zip(chosen["doc_id"].to_pylist(), chosen["toxic"].to_pylist(), chosen["text"].to_pylist(), strict=True))
    return fit([t for _, y, t in order if y == 1], [t for _, y, t in order if y != 1])


_scorers: dict[int, Scorer] = {}


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with a column ``_toxic_score`` (0 to 1)."""
    if model is None:
        return docs.withColumn("_toxic_score", F.lit(0.0))
    # the model is one table of a fixed size
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(column: pa.Array) -> pa.Array:
        key = id(spread)
        scorer = _scorers.get(key)
        if scorer is None:
            _scorers.clear()
            scorer = _scorers[key] = Scorer(spread.value)
        out, held, size = [], [], 0
        for text in column:
            held.append(text.as_py() or "")
            size += len(held[-1])
            if size > 1_000_000:
                out.append(scorer.scores(held))
                held, size = [], 0
        out.append(scorer.scores(held))
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    return docs.withColumn("_toxic_score", arrow_udf(run, DoubleType())(F.col("text")))


def keep_clean(docs: DataFrame, model: Model | None, border: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``border``."""
    held = scored(docs.select(F.struct("*").alias("row"), "text"), model)
    return held.where(F.col("_toxic_score") < border).select("row.*")
