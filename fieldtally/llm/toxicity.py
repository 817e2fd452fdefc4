"""Toxicity scores of whole texts by a recurrent network over windows.

The network (``gru``) is trained on the driver from a bounded sample of labelled
rows: at most ``SAMPLE_DOCS`` documents of a label, those whose id has the least
hash, as many of them as ``SAMPLE_CHARS`` characters of a label hold, with all their
windows. Scoring covers all windows of all texts; a text's score is the largest of its
windows'.

Defined results: null and empty texts are scored as an empty window; without
examples of both labels, or where no example has a word, the score is the share of toxic
examples (0 without any); label rows with a null id or label are no examples; rows are
scored one by one, so null and repeated ids stay; an empty table gives no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.llm import gru
from fieldtally.llm.common import claim, cut

SAMPLE_DOCS = {0: 3000, 1: 1500}  # by label
SAMPLE_CHARS = 40_000_000  # by label
TEXTS_AT_ONCE = 400


def sample(docs: DataFrame, labels: DataFrame, train_on: Column, id_col: str, text_col: str, label_col: str):
    """Vocabulary, texts as places in it, and labels of the sampled documents."""
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & train_on)
    usable = usable.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    few = [usable.where(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS[y]) for y in (0, 1)]
    chosen = cut(few[0].unionByName(few[1]))  # 4500 rows at most
    text = F.coalesce(F.col(text_col), F.lit(""))
    sizes = docs.select(F.col(id_col).alias("id"), F.length(text).alias("n")).join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), "id")
    sizes = sizes.limit(2 * sum(SAMPLE_DOCS.values())).toPandas()  # ids may repeat
    fits = sizes["n"].groupby(sizes["label"]).cumsum() <= SAMPLE_CHARS
    fits |= ~sizes["label"].duplicated()  # one of each label at least
    chosen = docs.sparkSession.createDataFrame(sizes.loc[fits, ["id", "label"]].drop_duplicates("id"), chosen.schema) if len(sizes) else chosen

    def compact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words, places = [], []
            for t in b["text"]:
                code, found = pd.factorize(np.array(gru.words_of(t), object))
                words.append(" ".join(found))
                places.append(zlib.compress(code.astype(np.int32).tobytes(), 1))
            yield pd.DataFrame({"id": b["id"].astype(str), "label": b["label"], "words": words, "places": places})

    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(chosen), "id")
    got = rows.mapInPandas(compact, "id string, label int, words string, places binary").toPandas()
    got = got.sort_values(["id", "words"], ignore_index=True)
    at: dict[str, int] = {}
    texts = []
    for words, places in zip(got["words"], got["places"]):
        known = np.array([at.setdefault(w, len(at)) for w in words.split()], np.int64)
        texts.append(known[np.frombuffer(zlib.decompress(places), np.int32)] if len(known) else known)
    return list(at), texts, got["label"].to_numpy()


def fit(docs: DataFrame, labels: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict | float:
    """Parameters, or a constant score where one label has no examples, or no example a
    word."""
    vocabulary, texts, label = sample(docs, labels, train_on, id_col, text_col, label_col)
    if len(set(label)) < 2 or not vocabulary:
        return float(label.mean()) if len(label) else 0.0
    return gru.train(vocabulary, texts, label)


def score_toxicity(docs: DataFrame, model: dict | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` per row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if isinstance(model, float):
        return rows.select(F.col("id").alias(id_col), F.lit(model).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _scorer(shared)
        for b in batches:
            for at in range(0, len(b), TEXTS_AT_ONCE):
                part = b[at : at + TEXTS_AT_ONCE]
                score = scorer.score(part["text"].tolist()).astype(float)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "score": np.clip(score, 0, 1)})

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


_SCORERS: dict[int, gru.Scorer] = {}


def _scorer(shared) -> gru.Scorer:
    key = id(shared.value)
    claim(_SCORERS)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = gru.Scorer(shared.value)
    return _SCORERS[key]
