"""Main text of web pages by gradient-boosted trees over DOM nodes (operator 6).

Each page is parsed to a tree of block elements (``dom``). Boosted trees (``gbt``) give every node
the log odds that main text stands in it, from tag, attribute words, depth, densities of its
subtree, and its siblings. Hierarchical decoding then takes the most likely choice in which every
kept node's parent is kept, so that no part of a dropped subtree comes back. The trees are trained on the
driver on ``TRAINING_PAGES`` invented pages of varied layouts (``page_maker``), not on the table.

A null or empty html has an empty text. Broken markup is parsed as far as it goes. Repeated rows are
repeated; an empty table gives an empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from seqloom.llm import common, dom, gbt
from seqloom.llm.page_maker import Maker

TRAINING_PAGES = 700


def labels_of(page: dom.Page) -> np.ndarray:
    """1 for nodes in whose subtree there is main text."""
    n = len(page.tag)
    inside, out = np.zeros(n, bool), np.zeros(n)
    for i in range(n):
        inside[i] = page.label[i] == "main" or (page.label[i] != "drop" and page.parent[i] >= 0 and inside[page.parent[i]])
    for node, pieces in page.blocks:
        out[node] = max(out[node], float(inside[node] and bool("".join(pieces).strip())))
    for i in range(n - 1, 0, -1):
        out[page.parent[i]] = max(out[page.parent[i]], out[i])
    return out


@lru_cache(maxsize=1)
def model(pages: int = TRAINING_PAGES) -> gbt.Trees:
    made = [dom.Page(Maker(seed).page()) for seed in range(pages)]
    return gbt.fit(np.concatenate([p.features() for p in made]), np.concatenate([labels_of(p) for p in made]))


def main_blocks(html: str | None, trees: gbt.Trees) -> list[str]:
    return main_texts([html], trees)[0]


def main_texts(htmls: list[str | None], trees: gbt.Trees) -> list[list[str]]:
    """Blocks of main text of each page; the trees run over all their nodes at once."""
    pages = [dom.Page(common.text_of(h)) for h in htmls]
    if not pages:
        return []
    odds = trees.log_odds(np.concatenate([p.features() for p in pages]))
    out, at = [], 0
    for p in pages:
        out.append(p.texts(dom.decode(p, odds[at : at + len(p.tag)])))
        at += len(p.tag)
    return out


def extract(pages: DataFrame, trees: gbt.Trees | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row."""
    trees = trees or model()
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def made(keys, urls, htmls):
        texts = [" ".join(blocks) for blocks in main_texts(htmls, trees)]
        return keys, urls, texts, [len(t) for t in texts]

    return common.map_columns(pages, ["page_id", "url", "html"], schema, made, rows=64)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
