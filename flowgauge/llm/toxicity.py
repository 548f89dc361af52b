"""Toxicity by a counterfactually regularised linear classifier.

Features are the words of a text and their beginnings, as present or absent. The classifier is a
logistic regression. Beside the loss on labelled texts it is penalised for every labelled text that
names a group of people: with the name swapped for that of another group of the same kind, the
score should not change. So a neutral mention of a group adds nothing of its own.

It is fitted on a bounded sample: at most ``most`` labelled rows of each class, by the smallest
hash of doc_id, weighted to the classes' shares among all labelled rows. Features are chosen by
counts over that sample. Every text is scored, whole.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import in_slices, written
from flowgauge.llm.tokens import texts_of

WORDS = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)
#: Labelled rows of each class, features kept, texts that a feature must be in, and the least
#: logarithm of how much oftener one class holds it and fewest standard errors of that difference,
#: so that words of every text and chance finds stay out.
MOST, FEATURES, SUPPORT, LIFT, CLEAR = 5000, 4000, 8, 1.4, 6.0
RIDGE, FAIRNESS, ROUNDS = 0.005, 10.0, 800
REMEMBERED = 800_000
#: Names of groups that may take each other's place, by kind and language.
GROUPS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "jew", "hindu", "buddhist", "atheist"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("african", "asian", "european", "american", "arab", "mexican"), ("immigrants", "refugees", "foreigners", "locals"),
    ("immigrant", "refugee", "foreigner", "local"), ("black", "white"), ("blacks", "whites"),
    ("africans", "asians", "europeans", "americans", "arabs", "mexicans"),
    ("blind", "deaf", "disabled"), ("frauen", "männer"), ("christen", "muslime", "juden"), ("femmes", "hommes"),
    ("chrétiens", "musulmans", "juifs"), ("mujeres", "hombres"),
    ("frau", "mann"), ("femme", "homme"), ("mujer", "hombre"), ("einwanderer", "flüchtlinge", "ausländer"),
    ("immigrés", "réfugiés", "étrangers"), ("inmigrantes", "refugiados", "extranjeros"),
    ("cristianos", "musulmanes", "judíos"),
)
SWAP = {term: group[(i + 1) % len(group)] for group in GROUPS for i, term in enumerate(group)}


def word_features(word: str) -> list[str]:
    """The word itself, marked as whole, and its beginnings."""
    return [word + "$", *(word[:n] for n in BEGINNINGS if len(word) > n)]


def features(words: set[str]) -> set[str]:
    return {f for w in words for f in word_features(w)}


def words_of(text: str) -> set[str]:
    return set(WORDS.findall(text.lower()))


def _sample(labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, float]]:
    """At most ``most`` rows of each class as (doc_id, label), and the weight of a row by class."""
    usable = labels.where("doc_id is not null and toxic in (0, 1)").select(
        F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("label"))
    held = {r[0]: r[1] for r in usable.groupBy("label").count().collect()}
    order = [F.crc32(F.concat(F.lit("sample-"), F.col("doc_id").cast("string")).cast("binary")), "doc_id"]
    parts = [usable.where(F.col("label") == c).orderBy(*order).limit(most) for c in (0, 1)]
    return written(parts[0].unionByName(parts[1]), "toxic-sample"), {c: n / min(n, most) for c, n in held.items()}


def _counted(batches):
    """How many texts of each class hold a feature, in parts of bounded size."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())

    def out():
        names = sorted(set(seen[0]) | set(seen[1]))
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in seen)], ["feature", "n0", "n1"])

    for batch in batches:
        for part in in_slices(batch, "text"):
            for label, text in zip(part.column("label").to_pylist(), texts_of(part.column("text"))):
                seen[label].update(features(words_of(text)))
            if len(seen[0]) + len(seen[1]) > 300_000:
                yield out()
                seen[0].clear()
                seen[1].clear()
    yield out()


def _rows(index: dict[str, int]):
    """Feature numbers of a text, and of its counterfactual if it names a group."""

    def run(batches):
        for batch in batches:
            for part in in_slices(batch, "text"):
                own, other = [], []
                for text in texts_of(part.column("text")):
                    words = words_of(text)
                    swapped = {SWAP.get(w, w) for w in words}
                    own.append(sorted(index[f] for f in features(words) if f in index))
                    other.append(sorted(index[f] for f in features(swapped) if f in index) if swapped != words else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("label").cast(pa.int32()), *(pa.array(c, pa.list_(pa.int32())) for c in (own, other))],
                    ["label", "own", "other"])

    return run


class _Sparse:
    """Rows of present features as a matrix of zeros and ones."""

    def __init__(self, lists: list, size: int):
        self.n, self.size = len(lists), size
        self.row = np.repeat(np.arange(self.n), [len(x) for x in lists])
        self.col = np.fromiter((i for x in lists for i in x), np.int64, len(self.row))

    def __matmul__(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.col], self.n)

    def back(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, values[self.row], self.size)


def fit_weights(label: np.ndarray, own: list, other: list, share: np.ndarray, size: int) -> np.ndarray:
    """Weights of ``size`` features and, last, the intercept, by accelerated descent."""
    x = _Sparse([[*row, size] for row in own], size + 1)
    pairs = [i for i, row in enumerate(other) if row is not None]
    gone, come = ([sorted(set(a[i]) - set(b[i])) for i in pairs] for a, b in ((own, other), (other, own)))
    here, there = _Sparse(gone, size + 1), _Sparse(come, size + 1)
    share = share / share.sum()
    pull = FAIRNESS / max(1, len(pairs))
    ridge = np.append(np.full(size, RIDGE / max(1, size)), 0.0)
    scale = 1 / np.sqrt(0.25 * x.back(share) + 2 * pull * (here.back(np.ones(len(pairs))) + there.back(np.ones(len(pairs)))) + ridge + 1e-9)

    def apart(w):
        gap = (here @ w) - (there @ w)
        return 2 * pull * (here.back(gap) - there.back(gap)) + ridge * w

    v = np.random.default_rng(3).normal(size=size + 1)  # at right angles to no direction
    for _ in range(30):  # the largest curvature sets the step
        w = scale * v / np.linalg.norm(v)
        v = scale * (0.25 * x.back(share * (x @ w)) + apart(w))
    step = 1 / (1.1 * np.linalg.norm(v))
    now, ahead = np.zeros(size + 1), np.zeros(size + 1)
    for turn in range(ROUNDS):
        w = scale * ahead
        error = share * (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - label)
        new = ahead - step * scale * (x.back(error) + apart(w))
        ahead = new + turn / (turn + 3) * (new - now)
        now = new
    return scale * now


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST) -> tuple[dict[str, float], float]:
    """Fitted on at most ``most`` rows of each class, rows that repeat a doc_id included. Weights by feature, and the intercept. Without labelled texts of both classes there are no
    features, and the intercept follows the share of toxic labels, one added to each class."""
    sample, weight = _sample(labels, most)
    known = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample), "doc_id")
    known = written(known.select("label", "text", F.monotonically_increasing_id().alias("row")), "toxic-texts")
    for c, n in [tuple(r) for r in known.groupBy("label").count().collect()]:
        if n > most:  # rows that repeat a doc_id of the sample all came along
            chosen = known.where(F.col("label") == c).select(F.xxhash64("text").alias("h"), "row").orderBy("h", "row").limit(most)
            left = known.join(F.broadcast(chosen.select("row")), "row", "left_semi")
            known = written(known.where(F.col("label") != c).unionByName(left.select(*known.columns)), "toxic-texts")
            weight[c] = weight.get(c, 0) * n / most
    known = known.drop("row")
    seen = known.mapInArrow(_counted, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    size = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    a, b = size.get(0, 0), size.get(1, 0)
    if not a or not b:
        toxic, clean = (weight.get(c, 0) * size.get(c, 0) for c in (1, 0))
        return {}, float(np.log((toxic + 1) / (clean + 1)))
    p0, p1 = (F.col("n0") + 0.5) / (a + 1), (F.col("n1") + 0.5) / (b + 1)
    both = (F.col("n0") + F.col("n1")) / (a + b)
    z = (p1 - p0) / F.sqrt(both * (1 - both) * (1 / a + 1 / b) + 1e-9)
    chosen = (seen.where(F.col("n0") + F.col("n1") >= SUPPORT).where(F.abs(F.log(p1 / p0)) >= LIFT)
              .select("feature", F.abs(z).alias("z")).where(F.col("z") >= CLEAR)
              .orderBy(F.desc("z"), "feature").limit(FEATURES))
    names = [r[0] for r in chosen.collect()]
    index = {name: i for i, name in enumerate(names)}
    rows = known.mapInArrow(_rows(index), "label int, own array<int>, other array<int>").collect()
    rows.sort(key=lambda r: (r.label, r.own, r.other or []))
    label = np.array([r.label for r in rows], float)
    share = np.array([weight[r.label] for r in rows], float)
    weights = fit_weights(label, [r.own for r in rows], [r.other for r in rows], share, len(names))
    return {name: float(weights[i]) for name, i in index.items()}, float(weights[-1])


class Scorer:
    """Scores of whole texts; what a piece of text adds is remembered."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def found(self, piece: str) -> frozenset | None:
        """The features with a weight in a piece of text without blanks, None if there are none."""
        hits = frozenset(f for w in WORDS.findall(piece.lower()) for f in word_features(w) if f in self.weights)
        return hits or None

    def scores(self, texts: list[str]) -> list[float]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out = []
        known = self.known
        for text in texts:
            pieces = set(text.split(" "))
            for piece in pieces.difference(known):
                known[piece] = self.found(piece)
            hits = {h for h in map(known.__getitem__, pieces) if h is not None}
            total = self.bias + sum(sorted(self.weights[f] for f in frozenset().union(*hits)))
            out.append(float(1 / (1 + np.exp(-np.clip(total, -500, 500)))))
        return out


def score(docs: DataFrame, weights: dict[str, float], bias: float, text: str = "text", keep: bool = False,
          name: str = "score") -> DataFrame:
    """``docs`` with a score of each text, and without the text unless it is to be kept. A column of
    ``docs`` that is named like the score is replaced."""
    kept = [f for f in docs.schema if f.name != name and (keep or f.name != text)]

    def run(batches):
        scorer = Scorer(weights, bias)
        for batch in batches:
            for part in in_slices(batch, text):
                values = pa.array(scorer.scores(texts_of(part.column(text))), pa.float64())
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), values], [*(f.name for f in kept), name])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + f"`{name}` double"
    return docs.select(*(f.name for f in kept), *([] if keep else [text])).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that the classifier never learns from: the crc32 of doc_id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classified(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text, ...).

    A null text is empty and gets the intercept's score. Rows with the same doc_id are scored each by
    their own text; a null doc_id is not held out. Labels other than 0 and 1 teach nothing, and a
    doc_id with several labels teaches each. Other columns play no part.
    """
    learn = labels.where(~held_out(F.col("doc_id")))
    weights, bias = fit(docs, learn, most)
    scored = score(docs.select(F.col("doc_id").cast("long"), "text"), weights, bias)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
