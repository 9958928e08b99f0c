import re
from collections import Counter

import pytest
from llm_data import TEXTS, documents, none_of, prose, rows_of

from seqloom.llm import op5_quality as op


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


MORE = [*TEXTS, "a b c a b c a b", "x\n x\nx\nx \n\n\n", "a\x0bb\x0cc\x1cd", "x y z " * 40, prose("fr", 60, 1) + " " + prose("fr", 60, 1), "ÀÉ ß # * & | <tag>"]


@pytest.mark.parametrize("text", MORE)
def test_counts(text):
    assert op.counts_of(text)[:5] == brute_counts(text)


def test_vote_columns_are_the_votes(spark):
    docs = op.with_counts(documents(spark, MORE), "c")
    votes = op.vote_columns({n: docs["c"][n] for n in op.COUNTS})
    for r in docs.select("c", *(v.alias(n) for n, v in votes.items())).collect():
        assert tuple(r)[1:] == op.votes_of(r["c"].asDict())


def test_em_finds_the_accuracies_of_made_up_rules():
    import random

    r = random.Random(6)
    counts = {}
    for _ in range(20_000):
        good = r.random() < 0.7
        votes = tuple(op.ABSTAIN if r.random() < 0.2 else op.BAD if r.random() < (0.03 if good else 0.6) else op.GOOD for _ in op.RULES)
        counts[votes] = counts.get(votes, 0) + 1
    model = op.fit(sorted(counts.items()))
    assert model.prior == pytest.approx(0.7, abs=0.03)
    assert model.bad_if_good == pytest.approx([0.03] * len(op.RULES), abs=0.02)
    assert model.bad_if_bad == pytest.approx([0.6] * len(op.RULES), abs=0.05)
    assert model.posterior([op.ABSTAIN] * len(op.RULES)) == pytest.approx(model.prior)


def test_query_on_odd_rows(spark):
    docs = documents(spark, MORE)
    got = rows_of(op.score(docs), "doc_id", *op.COUNTS[:5], "base_failed", "kept", "p_good")
    assert len(got) == len(MORE) + 2
    all_texts = [*MORE, MORE[-1], None]
    votes = [op.votes_of(dict(zip(op.COUNTS, op.counts_of(t), strict=True))) for t in all_texts]
    model = op.fit(sorted(Counter(votes).items()))
    good = {t: model.posterior(v) for t, v in zip(all_texts, votes, strict=True)}
    for doc, n, *rest in got:
        counts = brute_counts(None if doc is None else MORE[doc])
        assert (n, *rest[:4]) == counts
        assert rest[4] == (n < 50 or 100 * counts[4] > 50 * n)
        p = good[None if doc is None else MORE[doc]]
        assert rest[6] == pytest.approx(p, abs=2e-6)
        assert rest[5] == (not rest[4] and p >= op.KEEP_FROM)
    assert op.score(none_of(docs)).count() == 0


def test_good_prose_stays_and_junk_goes(spark):
    good = [prose(x, 80 + i, i) for i in range(30) for x in ("en", "de", "fr")]
    junk = ["BUY NOW!!! $$$ ### " * 25 + f"{i}" for i in range(10)] + [" ".join(f"#{i}*{j}|%$" for j in range(80)) for i in range(10)]
    docs = documents(spark, [*good, *junk])
    kept = op.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(len(good)))
