"""Documents and pages that the tests of the training-data operators share."""

import random

WORDS = {
    "en": "the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem".split(),
    "fr": "de la le et les des en un du une que est pour qui dans sur par au plus avec ce ne pas sont il être comme mais nous ou leur très même deux aussi elle été fait était".split(),
}
LONG = " ".join(f"word{i % 97} alpha{i % 1013}" for i in range(30_000))
#: Columns whose names the operators use inside.
CLASHES = ["row", "fp", "shard", "part", "q", "piece", "start", "length", "component_id", "kept", "score", "media", "digest", "quality_counts", "kept_id", "n_tokens", "severity"]


def prose(lang: str, n: int, seed: int) -> str:
    r = random.Random(f"{lang}-{seed}")
    out = []
    while len(out) < n:
        size = r.randint(5, 15)
        out += [*(r.choice(WORDS[lang]) for _ in range(size - 1)), r.choice(WORDS[lang]) + "."]
    return " ".join(out[:n])


TEXTS = [None, "", " \n\t ", "one", "one two", "Three words here", prose("en", 120, 1), prose("en", 120, 1), prose("de", 90, 2), LONG, "\x00 ... ​", "ünïcödé \U0001f600 text", "a\n\nb\n\nb\n", "!!! ### $$$"]


def documents(spark, texts=TEXTS, langs=None, clashes=True):
    """One row a text, the last one repeated; then a row without any value."""
    extra = CLASHES if clashes else []
    rows = [(i, t, (langs[i] if langs else "en"), "s", None, *("x" for _ in extra)) for i, t in enumerate(texts)]
    rows += rows[-1:] + [(None, None, None, None, None, *(None for _ in extra))]
    return spark.createDataFrame(rows, ", ".join(["doc_id bigint, text string, lang string, source string, n_chars bigint", *(f"{c} string" for c in extra)])).repartition(3)


def none_of(df):
    return df.filter("false")


def rows_of(df, *columns):
    """Rows as tuples, in order, nulls first."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: [(x is not None, x) for x in r])
