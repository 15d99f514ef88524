"""Toxicity by a classifier chain of linear models.

The label table has one toxicity flag, so the chain's categories are graded from it: `insult` (flagged, with a word that
the sample ties to the flag), `repeated_insult` (two such words or more) and `toxic` (flagged), in this order. Each model
is a logistic regression over the words and word stems of a text and the probabilities of the categories before it; a stem
is the first four or five letters of a longer word, so inflected forms share a feature. Those probabilities are out-of-fold
predictions in training, and the earlier models' own predictions afterwards.

The models are fitted on a bounded sample of labelled rows (SAMPLE rows, half of each label as far as there are enough,
first by a hash of the id). No model has seen what it is judged by: whatever leaves folds out chooses its vocabulary and the
words tied to the flag without their labels, too. For the threshold, whole chains are fitted without each fold in turn, and
their predictions of that fold are weighted to the true shares of the labels.

Defined cases: null text is the empty text; texts without known words get the base rate; where the sample lacks one of
the two labels nothing is toxic; a document labelled twice is toxic if any label says so, null labels don't count;
repeated rows each give a row; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.arrow import SLICE, map_rows
from quillstone.llm.common import Workspace, spread

CATEGORIES = ("insult", "repeated_insult", "toxic")
#: Bounds of the fit: labelled rows, words of the vocabulary, and documents a word must be in.
SAMPLE, WORDS, LEAST_DOCS = 6000, 4096, 4
FOLDS, L2 = 4, 1.0
#: Below 1, the threshold weighs precision above recall: clean documents are to stay.
BETA = 0.5
_WORD = re.compile(r"\w+")


#: Lengths of stems; a stem ends in STEM, which is in no word.
STEMS, STEM = (4, 5), "-"


def words(text: str | None) -> set[str]:
    """Distinct words and stems of the whole text."""
    whole = set(_WORD.findall((text or "").lower()))
    return whole.union(*({w[:n] + STEM for w in whole if len(w) > n} for n in STEMS))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Rows:
    """Sparse binary features: the word numbers of row k are columns[starts[k] : starts[k + 1]]."""

    starts: np.ndarray
    columns: np.ndarray
    width: int

    @classmethod
    def of(cls, lists: list[list[int]], width: int) -> Rows:
        return cls(np.cumsum([0, *map(len, lists)]), np.fromiter((x for own in lists for x in own), np.int64), width)

    def __post_init__(self) -> None:
        self.row = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def some(self, rows: np.ndarray, words: list[int]) -> Rows:
        """Some rows, over some words, which are numbered anew."""
        local = np.full(self.width, -1)
        local[words] = np.arange(len(words))
        sizes = np.diff(self.starts)[rows]
        at = np.repeat(self.starts[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        columns, row = local[self.columns[at]], np.repeat(np.arange(len(rows)), sizes)
        known = columns >= 0
        return Rows(np.cumsum([0, *np.bincount(row[known], minlength=len(rows))]), columns[known], len(words))

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.columns], len(self.starts) - 1)

    def summed(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, r[self.row], self.width)


def fit_linear(x: Rows, extra: np.ndarray, y: np.ndarray, steps: int = 40) -> np.ndarray:
    """Weights of the words, then of the columns of `extra`, then the intercept: L2-regularised logistic loss by L-BFGS."""
    d, e = x.width, extra.shape[1]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.times(w[:d]) + extra @ w[d : d + e] + w[-1]
        p = sigmoid(z)
        value = float(np.logaddexp(0, z).sum() - y @ z + L2 / 2 * (w[:-1] @ w[:-1]))
        r = p - y
        return value, np.concatenate([x.summed(r) + L2 * w[:d], extra.T @ r + L2 * w[d : d + e], [r.sum()]])

    w = np.zeros(d + e + 1)
    value, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, used = g.copy(), []
        for s, t, rho in reversed(past):
            a = rho * (s @ q)
            used.append(a)
            q -= a * t
        if past:
            s, t, _ = past[-1]
            q *= (s @ t) / (t @ t)
        else:
            q /= max(1.0, np.abs(g).max())
        for (s, t, rho), a in zip(past, reversed(used)):
            q += (a - rho * (t @ q)) * s
        size, slope = 1.0, g @ q
        while True:
            new = w - size * q
            new_value, new_g = loss(new)
            if new_value <= value - 1e-4 * size * slope or size < 1e-6:
                break
            size /= 2
        s, t = new - w, new_g - g
        if s @ t > 1e-12:
            past = [*past[-9:], (s, t, 1 / (s @ t))]
        done = value - new_value < 1e-5 * max(1.0, abs(value))
        w, value, g = new, new_value, new_g
        if done:
            break
    return w


@dataclass
class Chain:
    """weights[k]: of category k, in the order of fit_linear; threshold: of the last category's probability."""

    vocabulary: dict[str, int]
    weights: list[np.ndarray] = field(default_factory=list)
    threshold: float = 2.0

    def __post_init__(self) -> None:
        self.of_word = {w: [float(own[k]) for own in self.weights] for w, k in self.vocabulary.items()}

    def predict(self, text: str | None) -> list[float]:
        if not self.weights:
            return [0.0] * len(CATEGORIES)
        get, sums = self.of_word.get, [0.0] * len(self.weights)
        for word in sorted(words(text) & self.of_word.keys()):
            for k, v in enumerate(get(word)):
                sums[k] += v
        out: list[float] = []
        d = len(self.vocabulary)
        for total, own in zip(sums, self.weights):
            z = total + float(own[-1]) + sum(p * float(w) for p, w in zip(out, own[d:-1]))
            out.append(float(sigmoid(z)))
        return out


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The border with the best weighted F measure: the middle of the gap below the last probability that it accepts."""
    order = np.argsort(-p, kind="stable")
    hit, miss = np.cumsum((weight * y)[order]), np.cumsum((weight * (1 - y))[order])
    f = (1 + BETA**2) * hit / (BETA**2 * hit[-1] + hit + miss)
    last = np.append(p[order][:-1] > p[order][1:], True)
    at = int(np.where(last, f, -1).argmax())
    below = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float((p[order][at] + below) / 2)


@dataclass
class Choice:
    """What rows without some folds tell: numbers of the vocabulary's words, and of those tied to the flag."""

    words: list[int]
    tied: set[int]


Choices = dict[frozenset[int], Choice]


def fit_chain(choices: Choices, held: Rows, y: np.ndarray, fold: np.ndarray, without: frozenset[int] = frozenset()) -> list[np.ndarray]:
    """Weights of each category's model over choices[without], fitted on the rows outside the folds `without`."""
    rows = np.flatnonzero(~np.isin(fold, list(without)))
    parts = [(choices[without | {k}], rows[fold[rows] != k], rows[fold[rows] == k]) for k in sorted(set(fold[rows].tolist()))]
    cut = [(choice, train, held.some(train, choice.words), test, held.some(test, choice.words)) for choice, train, test in parts]
    whole = held.some(rows, choices[without].words)
    weights, probabilities = [], np.zeros((len(y), 0))
    for category in range(len(CATEGORIES)):
        out = np.zeros(len(y))
        for choice, train, x, test, x_test in cut:
            if len(train):
                w = fit_linear(x, probabilities[train], target(category, choice, held, y, train))
                out[test] = predict(w, x_test, probabilities[test])
        weights.append(fit_linear(whole, probabilities[rows], target(category, choices[without], held, y, rows)))
        probabilities = np.column_stack([probabilities, out])
    return weights


def target(category: int, choice: Choice, held: Rows, y: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which rows are of a category: flagged, with as many tied words as it asks for."""
    least = (1, 2, 0)[category]
    tied = held.some(rows, sorted(choice.tied))
    return y[rows] * (np.diff(tied.starts) >= least)


def predict(w: np.ndarray, x: Rows, probabilities: np.ndarray) -> np.ndarray:
    return sigmoid(x.times(w[: x.width]) + probabilities @ w[x.width : -1] + w[-1])


def held_out(choices: Choices, held: Rows, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """The last category's probability of each row, by a chain fitted without its fold."""
    p = np.zeros(len(y))
    for k in sorted(set(fold.tolist())):
        without, rows = frozenset({k}), np.flatnonzero(fold == k)
        if len(rows) == len(y):
            continue
        x, own = held.some(rows, choices[without].words), np.zeros((len(rows), 0))
        for w in fit_chain(choices, held, y, fold, without):
            own = np.column_stack([own, predict(w, x, own)])
        p[rows] = own[:, -1]
    return p


def choose(counts: DataFrame, sizes: dict[tuple[int, int], int]) -> dict[frozenset[int], tuple[list[str], set[str]]]:
    """Vocabulary and tied words without each fold, without each two, and of all rows. Each is WORDS words at most.

    counts: word, n0.. (documents of each fold that hold it) and t0.. (those with the flag); sizes: documents by (fold, flag).
    """
    out = {}
    sets = [frozenset(), *(frozenset({k}) for k in range(FOLDS)), *(frozenset({j, k}) for k in range(FOLDS) for j in range(k))]
    for without in sets:
        own = [k for k in range(FOLDS) if k not in without]
        with_, n = (sum((F.col(f"{c}{k}") for k in own), F.lit(0)) for c in ("t", "n"))
        toxic, clean = (sum(sizes.get((k, flag), 0) for k in own) for flag in (1, 0))
        rate_with, rate_without = (with_ + 0.5) / (toxic + 1.0), (n - with_ + 0.5) / (clean + 1.0)
        scored = counts.where(n >= LEAST_DOCS).select("word", with_.alias("with"), F.log(rate_with / rate_without).alias("tie"), (F.abs(rate_with - rate_without) * F.abs(F.log(rate_with / rate_without))).alias("gain"))
        chosen = scored.orderBy(F.desc("gain"), "word").limit(WORDS).collect()
        out[without] = [r["word"] for r in chosen], {r["word"] for r in chosen if r["tie"] > np.log(20) and r["with"] >= max(LEAST_DOCS, 0.02 * toxic)}
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """Fits the chain on labelled rows of docs(doc_id, text); labels(doc_id, toxic)."""
    spark = docs.sparkSession
    flags = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    shares = {r["toxic"]: r["n"] for r in flags.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not shares.get(0) or not shares.get(1):
        return Chain({})
    first = [flags.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for t in (0, 1)]
    picked = first[0].unionByName(first[1])  # SAMPLE rows at most, so the broadcast below is bounded
    space = Workspace(spark, "toxicity")
    rows = space.keep(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"]), "sample").select("doc_id", "toxic", "text")
    # copies of a text are in one fold
    listed = map_rows(rows.select(F.struct("doc_id", "toxic", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(FOLDS)).cast("int").alias("fold")).alias("row"), "text"), ["row", "text"], [pa.field("words", pa.list_(pa.string()))], lambda: lambda text: (sorted(words(text)),))
    listed = space.keep(listed.select("row.*", "words"), "words")
    sizes = {(r["fold"], r["toxic"]): r["n"] for r in listed.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}
    if not all(sum(n for (_, flag), n in sizes.items() if flag == t) for t in (0, 1)):
        return Chain({})
    by_fold = [F.count_if(F.col("fold") == k).alias(f"n{k}") for k in range(FOLDS)] + [F.count_if((F.col("fold") == k) & (F.col("toxic") == 1)).alias(f"t{k}") for k in range(FOLDS)]
    counts = listed.select("fold", "toxic", F.explode("words").alias("word")).groupBy("word").agg(*by_fold).where(sum((F.col(f"n{k}") for k in range(FOLDS)), F.lit(0)) >= LEAST_DOCS)
    chosen = choose(space.keep(counts, "counts"), sizes)
    number = {w: k for k, w in enumerate(sorted({w for own, _ in chosen.values() for w in own}))}

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(number[w] for w in x if w in number) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.list_(pa.int32()))], names=["doc_id", "toxic", "fold", "columns"])

    kinds = {f.name: f.dataType.simpleString() for f in listed.schema}
    data = listed.select("doc_id", "toxic", "fold", "words").mapInArrow(numbers, f"doc_id {kinds['doc_id']}, toxic int, fold int, columns array<int>").orderBy("doc_id").collect()
    space.drop("sample", "words", "counts")
    held, y, fold = Rows.of([r["columns"] for r in data], len(number)), np.array([float(r["toxic"]) for r in data]), np.array([r["fold"] for r in data])
    choices = {without: Choice([number[w] for w in own], {number[w] for w in tied}) for without, (own, tied) in chosen.items()}
    weights = fit_chain(choices, held, y, fold)
    weight = np.where(y > 0, shares[1] / y.sum(), shares[0] / (len(y) - y.sum()))
    return Chain({w: k for k, w in enumerate(chosen[frozenset()][0])}, weights, best_threshold(held_out(choices, held, y, fold), y, weight))


def keep_clean(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """The rows of docs that the chain doesn't call toxic, with all their columns, whatever their names. One pass, no shuffle."""
    shared, at = docs.sparkSession.sparkContext.broadcast(chain), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                yield part.filter(pa.array([own.predict(text)[-1] < own.threshold for text in part.column(at).to_pylist()], pa.bool_()))

    numbered = spread(docs).toDF(*(f"c{k}" for k in range(len(docs.columns))))  # Arrow wants plain names
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)


SCORES = [*(pa.field(f"p_{c}", pa.float64()) for c in CATEGORIES), pa.field("toxic", pa.bool_())]


def score(docs: DataFrame, chain: Chain, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, the probability of each category, and `toxic`. One pass, no shuffle; the model has WORDS words at most."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def make():
        own = shared.value

        def row(text: str | None) -> tuple:
            p = own.predict(text)
            return *p, p[-1] >= own.threshold

        return row

    return map_rows(docs, [key, text_col], SCORES, make)
