"""Quality rules by weak supervision (operator 5).

Each rule looks at counts of the whole text and votes good, bad, or abstains. Expectation
maximisation over the votes of all documents estimates how often each rule votes what on good and
on bad documents, and each document's posterior probability of being good decides, together with
the two base tests. Votes form at most 3^9 patterns (nine rules), so EM needs only the number of documents of
each pattern: an aggregate over all rows, bounded at any input size.

Null and empty texts have no words and fail the base test. Rules abstain where their ratio has no
denominator. Repeated rows are repeated; an empty table gives an empty result. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm import common

GOOD, BAD, ABSTAIN = 1, -1, 0
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_shouts", "top_word", "n_punct"]
#: name: (numerator, denominator, [from, to) of a good vote, [from, to) outside of which the vote is bad)
RULES = {
    "length": ("n_words", None, (50, 100_000), (30, 1_000_000)),
    "word_length": ("word_chars", "n_words", (3, 12), (2.2, 20)),
    "symbols": ("n_symbols", "n_words", (0, 0.05), (0, 0.15)),
    "duplicate_lines": ("n_dup_lines", "n_lines", (0, 0.15), (0, 0.35)),
    "repeats": ("n_repeat_words", "n_words", (0, 0.2), (0, 0.4)),
    "upper_case": ("n_upper", "n_letters", (0, 0.2), (0, 0.4)),
    "shouts": ("n_shouts", "n_words", (0, 0.1), (0, 0.3)),
    "punctuation": ("n_punct", "word_chars", (0, 0.1), (0, 0.2)),
    "top_word": ("top_word", "n_words", (0, 0.2), (0, 0.35)),
}
UPPER = "".join(map(chr, [*range(65, 91), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]))
LOWER = "".join(map(chr, [*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)]))
#: Posterior probability of being good from which a document is kept.
KEEP_FROM = 0.5


def counts_of(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` of a whole text; words are runs of anything but space and 0x09-0x0D."""
    text = common.text_of(text)
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    repeat, top = 0, 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < n - 2:
            number: dict = {}
            for w in windows:
                number[w] = number.get(w, 0) + 1
            until = 0
            for i, w in enumerate(windows):
                if number[w] > 1:
                    repeat += i + 3 - max(i, until)
                    until = i + 3
    if n:
        seen: dict = {}
        for w in words:
            seen[w] = seen.get(w, 0) + 1
        top = max(seen.values())
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    n_upper, n_lower = (sum(map(text.count, letters)) for letters in (UPPER, LOWER))
    return (
        n,
        len(text) - sum(text.count(c) for c in " \t\n\v\f\r"),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        repeat,
        len(lines),
        n_upper,
        n_upper + n_lower,
        text.count("!"),
        top,
        sum(map(text.count, string.punctuation)),
    )


def votes_of(counts: dict[str, int]) -> tuple[int, ...]:
    """The votes of ``RULES`` on one document's counts; ``vote_columns`` says the same of columns."""
    out = []
    for top, bottom, good, bad in RULES.values():
        of = counts[bottom] if bottom else 1
        x = counts[top] / of if of else None
        out.append(ABSTAIN if x is None else GOOD if good[0] <= x < good[1] else BAD if not bad[0] <= x < bad[1] else ABSTAIN)
    return tuple(out)


def vote_columns(counts: dict[str, Column]) -> dict[str, Column]:
    out = {}
    for name, (top, bottom, good, bad) in RULES.items():
        of = counts[bottom].cast("double") if bottom else F.lit(1.0)
        x = counts[top] / F.nullif(of, F.lit(0.0))
        vote = F.when((x >= good[0]) & (x < good[1]), GOOD).when((x < bad[0]) | (x >= bad[1]), BAD)
        out[name] = F.coalesce(vote, F.lit(ABSTAIN)).cast("tinyint")
    return out


@dataclass
class Model:
    """prior: P(good). bad_if_good, bad_if_bad: P(a vote is bad | the document is good or bad, no abstention)."""

    prior: float
    bad_if_good: list[float]
    bad_if_bad: list[float]

    def weights(self) -> list[tuple[float, float]]:
        """For each rule, what a good and a bad vote add to the log odds of good."""
        return [(math.log((1 - g) / (1 - b)), math.log(g / b)) for g, b in zip(self.bad_if_good, self.bad_if_bad, strict=True)]

    def log_odds(self, votes: Iterable[int]) -> float:
        adds = ((w[0] if v == GOOD else w[1]) for v, w in zip(votes, self.weights(), strict=True) if v != ABSTAIN)
        return math.log(self.prior / (1 - self.prior)) + sum(adds)

    def posterior(self, votes: Iterable[int]) -> float:
        return 1 / (1 + math.exp(-self.log_odds(votes)))

    def column(self, votes: dict[str, Column]) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for v, (good, bad) in zip(votes.values(), self.weights(), strict=True):
            total = total + F.when(v == GOOD, good).when(v == BAD, bad).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> Model:
    """EM over (votes, number of documents). A rule never counts as worse than chance."""
    import numpy as np

    n_rules = len(RULES)
    votes = np.array([p for p, _ in patterns], dtype=np.int8).reshape(-1, n_rules)
    weight = np.array([c for _, c in patterns], dtype=float)
    cast, bad = votes != ABSTAIN, votes == BAD
    prior, if_good, if_bad = 0.8, np.full(n_rules, 0.02), np.full(n_rules, 0.3)
    for _ in range(rounds if len(weight) else 0):
        per_vote = np.where(bad, np.log(if_good / if_bad), np.log((1 - if_good) / (1 - if_bad)))
        good = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + (per_vote * cast).sum(1), -50, 50)))
        w, u = weight * good, weight * (1 - good)
        prior = float(np.clip((w.sum() + 1) / (weight.sum() + 2), 0.5, 0.999))
        if_good = np.clip(((bad * w[:, None]).sum(0) + 0.02) / ((cast * w[:, None]).sum(0) + 1), 1e-4, 0.5)
        if_bad = np.clip(((bad * u[:, None]).sum(0) + 0.3) / ((cast * u[:, None]).sum(0) + 1), 2e-4, 0.999)
        if_bad = np.maximum(if_bad, np.minimum(2 * if_good, 0.999))
    return Model(prior, if_good.tolist(), if_bad.tolist())


def with_counts(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` and a struct column ``name`` of ``COUNTS``."""
    kind = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])

    @F.pandas_udf(kind)
    def counted(text):
        import pandas as pd

        return pd.DataFrame([counts_of(t) for t in text], columns=COUNTS, dtype="int64")

    return docs.withColumn(name, counted(F.col("text")))


def unused(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def fit_on(counted: DataFrame, name: str) -> Model:
    """The model of all rows: their vote patterns are counted, at most 3 to the number of rules."""
    votes = vote_columns({c: F.col(name)[c] for c in COUNTS})
    rows = counted.select(F.array(*votes.values()).alias("votes")).groupBy("votes").count().collect()
    return fit([(tuple(r["votes"]), r["count"]) for r in rows])


def verdict(counts: dict[str, Column], model: Model) -> dict[str, Column]:
    n = counts["n_words"]
    failed = (n < 50) | (100 * counts["n_repeat_words"] > 50 * n)
    good = model.column(vote_columns(counts))
    return {"base_failed": failed, "kept": ~failed & (good >= KEEP_FROM), "p_good": F.round(good, 6)}


def score(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and p_good of each document. Counts are stored between EM and verdict."""
    counted = common.scratch(with_counts(docs.select("doc_id", "text"), "q").select("doc_id", "q"), "counts")
    columns = {c: F.col("q")[c] for c in COUNTS}
    said = verdict(columns, fit_on(counted, "q"))
    return counted.select("doc_id", *(c.alias(n) for n, c in columns.items()), *(c.alias(n) for n, c in said.items()))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, all their columns. Texts are counted twice rather than shuffled."""
    name = unused(docs, "quality_counts")
    counted = with_counts(docs, name)
    model = fit_on(with_counts(docs.select("text"), name), name)
    return counted.filter(verdict({c: F.col(name)[c] for c in COUNTS}, model)["kept"]).drop(name)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", *COUNTS[1:5], "base_failed", "kept", "p_good")
