"""Toxicity by cumulative-link ordinal regression (operator 3).

Severity has grades 0 to 3. Features are whole words and word beginnings of 3, 5, 7 and 9 letters; each has two
values, c / (c + 1) of its count c and r / (r + 1) of its rate r in per cent of the words. One weight vector serves all ordered
thresholds: P(grade >= k) = sigmoid(w x - t_k). Expected severity is the sum of these three
probabilities, and a document is toxic if the first is at least one half.

* The sample of labelled documents that is learned from has ``PER_CLASS`` rows of a class at most, those that come first by a
  hash. It is stored; workers count its features, and what reaches the driver is hashes and counts.
* Weights are signed, and sparse by an L1 penalty: features are chosen by the fit alone. It begins
  with those that the gradient at zero weights favours; those of the others that break the optimality conditions join until none does.
* ``labels.toxic`` tells two grades apart. Toxic documents get grade 1, 2 or 3 by how widespread toxicity is in them:
  the share of their segments of ``SEGMENT`` words that a model of two grades marks which was fitted to the
  other half of the sample, in thirds of the sample.
* The first threshold is then moved to where it divides the sample with the fewest errors, below the second.

Null and empty texts have no features and get the score of none. Rows without a label, id or text
are not learned from; without toxic examples nothing is toxic (severity 0). Repeated rows are
repeated; an empty table gives an empty result. Only doc_id and text, and of labels doc_id and
toxic, are read.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm import byte_bpe, common

#: Labelled documents that are learned from, toxic and clean ones, at most.
PER_CLASS = {1: 2000, 0: 3000}
GRADES = 3
SEGMENT = 10
#: The L1 penalty as a share of the least one at which all weights are zero; features in fewer documents have none.
PENALTY, LEAST_DOCUMENTS = 0.03, 5
#: The share of that penalty under which the features that it chose are fitted again (a relaxed lasso).
RELAXED = 0.3
_STARTS = (3, 5, 7, 9)


def features_of(word: str) -> list[str]:
    """A lower-case word without outer punctuation, and its beginnings (marked as such)."""
    w = word.strip(string.punctuation)
    return [w, *(w[:n] + "~" for n in _STARTS if len(w) > n)] if w else []


def hash_of(feature: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(feature.encode("utf-8", "replace")) >> 1


def _hashes():
    return byte_bpe.Words(lambda w: tuple(map(hash_of, features_of(w))), 200_000)


@dataclass
class Model:
    index: dict[int, int]  # by the hash of a feature
    weights: list[float]  # of counts, then of rates
    thresholds: list[float]

    def __post_init__(self):
        self._words = None

    def __getstate__(self):
        return self.__dict__ | {"_words": None}

    def etas(self, words: list[str]) -> float:
        if self._words is None:
            index = self.index
            self._words = byte_bpe.Words(lambda w: tuple(index[h] for f in features_of(w) if (h := hash_of(f)) in index))
        found = Counter(f for x in map(self._words.__getitem__, words) for f in x)
        half, n = len(self.index), len(words)
        return sum(self.weights[f] * c / (c + 1) + self.weights[half + f] * c / (c + 0.01 * n) for f, c in found.items())

    def eta(self, text: str | None) -> float:
        return self.etas(common.text_of(text).lower().split())

    def at_least(self, text: str | None) -> list[float]:
        """P(grade >= 1), P(grade >= 2), P(grade >= 3)."""
        e = self.eta(text)
        return [1 / (1 + math.exp(min(50.0, max(-50.0, t - e)))) for t in self.thresholds]

    def spread(self, text: str | None) -> float:
        """The share of segments that are likelier than not of grade 1 or more."""
        words = common.text_of(text).lower().split()
        parts = [words[i : i + SEGMENT] for i in range(0, len(words), SEGMENT)]
        return sum(self.etas(p) >= self.thresholds[0] for p in parts) / max(1, len(parts))


def _sigmoid(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def loss_and_gradients(x, y, params, grades: int):
    """Mean negative log-likelihood of grades y. params: weights, the first threshold, logarithms of the steps to the next."""
    import numpy as np

    k = x.shape[1]
    steps = np.exp(params[k + 1 :])
    edges = np.concatenate([[-1e9], params[k] + np.concatenate([[0.0], np.cumsum(steps)]), [1e9]])
    eta = x @ params[:k]
    a, b = _sigmoid(edges[y + 1] - eta), _sigmoid(edges[y] - eta)
    p, n = np.maximum(a - b, 1e-12), len(y)
    d_t = np.zeros(grades + 2)
    np.add.at(d_t, y + 1, -a * (1 - a) / p / n)
    np.add.at(d_t, y, b * (1 - b) / p / n)
    d_t = d_t[1:-1]
    later = np.cumsum(d_t[::-1])[::-1]  # what moves with each threshold
    d_eta = (1 - a - b) / n
    return float(-np.log(p).mean()), np.concatenate([x.T @ d_eta, [later[0]], later[1:] * steps]), d_eta


def fit_dense(x, y, grades: int, l1: float, rounds: int = 400, tolerance: float = 2e-3):
    """Proximal accelerated gradient descent with restarts; params as in ``loss_and_gradients``, and d_eta at the end."""
    import numpy as np

    k = x.shape[1]
    share = np.clip([(y >= g).mean() for g in range(1, grades + 1)], 1e-3, 1 - 1e-3)
    t = -np.log(share / (1 - share))
    now = np.concatenate([np.zeros(k), t[:1], np.log(np.maximum(np.diff(t), 0.05))])
    ahead, momentum, step = now.copy(), 1.0, 1.0
    loss, grad, d_eta = loss_and_gradients(x, y, ahead, grades)
    for _ in range(rounds):
        while True:
            new = ahead - step * grad
            new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - step * l1, 0)
            moved = new - ahead
            new_loss, new_grad, new_eta = loss_and_gradients(x, y, new, grades)
            if new_loss <= loss + grad @ moved + moved @ moved / (2 * step) + 1e-12 or step < 1e-8:
                break
            step /= 2
        if (ahead - new) @ (new - now) > 0:
            momentum = 1.0
        later = (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        ahead, now, momentum, d_eta = new + (momentum - 1) / later * (new - now), new, later, new_eta
        if np.abs(moved).max() < tolerance:
            break
        loss, grad, _ = loss_and_gradients(x, y, ahead, grades)
        step *= 1.1
    return now, d_eta


@dataclass
class Sample:
    """Documents as rows of a sparse matrix: ``doc``, ``feature`` (a hash) and ``count`` of each entry, ``n`` words and ``toxic`` of each document."""

    doc: object
    feature: object
    count: object
    n: object
    toxic: object

    def part(self, chosen) -> Sample:
        import numpy as np

        inside = chosen[self.doc]
        return Sample((np.cumsum(chosen) - 1)[self.doc[inside]], self.feature[inside], self.count[inside], self.n[chosen], self.toxic[chosen])


def counted(texts: list[str]) -> tuple[list, list, list]:
    """Words, hashes of features and counts of each text."""
    words = _hashes()
    n, features, counts = [], [], []
    for t in texts:
        own = t.lower().split()
        found = Counter(f for x in map(words.__getitem__, own) for f in x)
        n.append(len(own))
        features.append(list(found.keys()))
        counts.append(list(found.values()))
    return n, features, counts


def sample_of(n, features, counts, toxic) -> Sample:
    import numpy as np

    sizes = [len(f) for f in features]
    flat = lambda lists, kind: np.concatenate([np.asarray(x, kind) for x in lists]) if lists else np.zeros(0, kind)
    return Sample(np.repeat(np.arange(len(sizes)), sizes), flat(features, np.int64), flat(counts, np.float64), np.asarray(n, np.float64), np.asarray(toxic, np.int64))


def fit(sample: Sample, grade, grades: int = GRADES, penalty: float = PENALTY) -> Model:
    """The penalised maximum-likelihood model."""
    import numpy as np

    y = np.asarray(grade)
    known, place, documents = np.unique(sample.feature, return_inverse=True, return_counts=True)
    counts, rates = sample.count / (sample.count + 1), sample.count / (sample.count + 0.01 * sample.n[sample.doc])

    def correlated(d_eta):
        both = (np.bincount(place, v * d_eta[sample.doc], len(known)) for v in (counts, rates))
        return np.where(documents >= LEAST_DOCUMENTS, np.maximum(*map(np.abs, both)), 0.0)

    _, d_eta = fit_dense(np.zeros((len(y), 0)), y, grades, 0.0)
    at_zero = correlated(d_eta)
    l1 = penalty * float(at_zero.max(initial=0.0))
    used = at_zero > 0.3 * at_zero.max(initial=0.0)
    while True:
        index = np.flatnonzero(used)
        at = np.full(len(known), -1)
        at[index] = np.arange(len(index))
        column = at[place]
        here = column >= 0
        x = np.zeros((len(y), 2 * len(index)))
        x[sample.doc[here], column[here]] = counts[here]
        x[sample.doc[here], len(index) + column[here]] = rates[here]
        params, d_eta = fit_dense(x, y, grades, l1)
        broken = (correlated(d_eta) > 1.1 * l1) & ~used
        if not broken.any():
            break
        used |= broken
    living = lambda k: np.abs(params[: 2 * k].reshape(2, -1)).max(axis=0, initial=0.0) > 1e-9
    for strength, tolerance in ((1.0, 1e-4), (RELAXED, 2e-3)):
        alive = living(len(index))
        x, index = x[:, np.tile(alive, 2)], index[alive]
        params, _ = fit_dense(x, y, grades, strength * l1, 1500, tolerance)
    half = len(index)
    weights, thresholds = params[: 2 * half], params[2 * half] + np.concatenate([[0.0], np.cumsum(np.exp(params[2 * half + 1 :]))])
    cut = best_cut(x @ weights, y > 0, float(thresholds[0]))
    thresholds[0] = min([cut, *(thresholds[1:2] - 0.1)])
    return Model({int(h): i for i, h in enumerate(known[index])}, weights.tolist(), thresholds.tolist())


def best_cut(eta, toxic, near: float) -> float:
    """Where a cut of ``eta`` has the fewest errors: in the middle of the widest gap of those; ``near`` if there is none."""
    import numpy as np

    order = np.argsort(eta, kind="stable")
    eta, toxic = eta[order], toxic[order]
    errors = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum(~toxic[::-1])[::-1], [0]])
    gaps = [(eta[i] - eta[i - 1], -i) for i in np.flatnonzero(errors == errors.min()) if 0 < i < len(eta)]
    if not gaps:
        return near
    i = -max(gaps)[1]
    return float((eta[i - 1] + eta[i]) / 2)


def grade_of(toxic, spread):
    """1, 2 or 3 of toxic documents, by thirds of the spread of toxicity in them; 0 of clean ones."""
    import numpy as np

    cuts = np.quantile(spread[toxic > 0], [1 / 3, 2 / 3])
    return np.where(toxic > 0, 1 + (spread > cuts[0]) + (spread > cuts[1]), 0)


def chosen(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] = PER_CLASS) -> DataFrame:
    """order, half, text and toxic of the sample, stored."""
    known = labels.select(F.col("doc_id").alias("labelled"), F.col("toxic").cast("int").alias("toxic")).filter("labelled is not null and toxic in (0, 1)")
    first = [known.filter(F.col("toxic") == k).orderBy(F.xxhash64("labelled"), "labelled").limit(n) for k, n in per_class.items()]
    taken = first[0].unionByName(first[1]).dropDuplicates(["labelled", "toxic"])
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(taken), F.col("doc_id") == F.col("labelled"))
    order = F.xxhash64("doc_id", "text")
    rows = common.scratch(rows.select(order.alias("order"), "text", "toxic"), "labelled")  # an id may have any number of rows
    bounded = [rows.filter(F.col("toxic") == k).orderBy("order", "text").limit(n) for k, n in per_class.items()]
    half = F.pmod(F.shiftright("order", 20), F.lit(2)).cast("int")
    return common.scratch(bounded[0].unionByName(bounded[1]).select("order", half.alias("half"), "text", "toxic"), "sample")


def learn(docs: DataFrame, labels: DataFrame, per_class: dict[int, int] = PER_CLASS) -> Model | None:
    import numpy as np

    rows = chosen(docs, labels, per_class)
    schema = "half int, toxic int, n bigint, features array<bigint>, counts array<int>, order bigint"
    made = common.map_columns(rows, ["half", "toxic", "order", "text"], T._parse_datatype_string(schema), lambda half, toxic, order, texts: (half, toxic, *counted(texts), order))
    got = made.toArrow().sort_by([("order", "ascending"), ("n", "ascending")])
    toxic = got.column("toxic").to_numpy()
    if not toxic.sum():
        return None
    lists = lambda c: [x.values.to_numpy() for x in got.column(c)]
    sample, half = sample_of(got.column("n").to_numpy(), lists("features"), lists("counts"), toxic), got.column("half").to_numpy()
    folds = [fit(sample.part(half != k), toxic[half != k], 1) if toxic[half != k].any() else None for k in (0, 1)]
    spread = lambda half, texts: (half, [folds[h].spread(t) if folds[h] else 0.0 for h, t in zip(half.to_pylist(), texts, strict=True)])
    found = common.map_columns(rows.select("half", "text", "order"), ["half", "text", "order"], T._parse_datatype_string("half int, spread double, order bigint"), lambda half, texts, order: (*spread(half, texts), order))
    by_order = dict(zip(*(found.toArrow().column(c).to_pylist() for c in ("order", "spread")), strict=True))
    spreads = np.array([by_order[o] for o in got.column("order").to_pylist()])
    return fit(sample, grade_of(toxic, spreads))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, severity, grade, p_toxic and toxic of each row."""
    kinds = [("severity", T.DoubleType()), ("grade", T.IntegerType()), ("p_toxic", T.DoubleType()), ("toxic", T.BooleanType())]
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in kinds)])

    def made(keys, texts):
        found = [model.at_least(t) if model else [0.0] * GRADES for t in texts]
        return keys, [round(sum(p), 6) for p in found], [sum(x >= 0.5 for x in p) for p in found], [round(p[0], 6) for p in found], [p[0] >= 0.5 for p in found]

    return common.map_columns(docs, ["doc_id", "text"], schema, made)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, learn(docs, common.table(spark, sf_dir, "labels")))
