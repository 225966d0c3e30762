"""Pluggable models with deterministic offline defaults.

The defaults are stand-ins without any trained model: hashed word counts as vectors, word overlap
as reranker, rules as language model. Any callable of the same shape may take their place.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions.regulatory import sigmoid, token_index
from statuta.functions.text import words

WIDE = 64
Answer = Callable[[list[dict]], str]


def hashed_vectors(texts: pd.Series, wide: int = WIDE) -> list[list[float]]:
    """Signed hashed counts of words and word pairs, of length 1; all zero for texts without words."""
    found = []
    for text in texts:
        vector = np.zeros(wide)
        found_words = re.findall(r"[^\W_]+", (text or "").lower())
        for gram in [*found_words, *map(" ".join, zip(found_words, found_words[1:]))]:
            code = int.from_bytes(blake2b(gram.encode(), digest_size=8).digest(), "big")
            vector[code % wide] += 1 if code >> 63 else -1
        length = np.linalg.norm(vector)
        found.append((vector / length if length else vector).tolist())
    return found


def encode(rows: DataFrame, text: str = "embed_text", encoder: Callable[[pd.Series], list[list[float]]] = hashed_vectors) -> DataFrame:
    """``rows`` with ``dense``; the encoder is called with Arrow batches, so a model loads once a worker."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(encoder(batch))

    return rows.withColumn("dense", vectors(F.col(text)))


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct words in the text, through a sigmoid; 0.5 without any."""
    distinct = lambda c: F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), ""))
    asked = distinct(query)
    share = F.size(F.array_intersect(asked, distinct(text))) / F.greatest(F.lit(1), F.size(asked))
    return sigmoid(share * 4 - F.when(share > 0, 2).otherwise(0))


def sparse_weights(rows: DataFrame, key: str, text: str = "embed_text") -> DataFrame:
    """(key, sparse): a map from term places to weights, counts of words, as an encoder's lexical weights.

    Of words that share a place the largest count stays; texts without words have no row.
    """
    counted = rows.select(key, F.explode(words(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").cast("double").alias("weight"))
    placed = counted.groupBy(key, token_index(F.col("term")).alias("place")).agg(F.max("weight").alias("weight"))
    return placed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("place", "weight"))).alias("sparse"))


def encode_batch(rows: DataFrame, key: str, text: str = "embed_text", encoder: Callable[[pd.Series], list[list[float]]] = hashed_vectors) -> DataFrame:
    """``rows``, one per ``key``, with ``dense`` and ``sparse`` of one text; sparse is null for texts without words."""
    return encode(rows, text, encoder).join(sparse_weights(rows, key, text), key, "left")


_loaded: dict[str, object] = {}


def per_worker(name: str, load: Callable[[], object]) -> object:
    """The model of that name, loaded when it is first asked for in a Python worker and kept there."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def batch_scorer(score: Callable[[list[tuple[str, str]]], list[float]], most_tokens: int = 512, normalize: bool = True) -> Callable[[Column, Column], Column]:
    """A scorer for ``rerank`` from a model that scores pairs, called once per Arrow batch.

    Query and text together have at most ``most_tokens`` words: the text is cut to what the query
    leaves. Null texts count as empty. With ``normalize`` scores go through a sigmoid.
    """

    @F.pandas_udf("double")
    def scores(queries: pd.Series, texts: pd.Series) -> pd.Series:
        pairs = []
        for query, text in zip(queries.fillna(""), texts.fillna("")):
            asked = query.split()[:most_tokens]
            pairs.append((" ".join(asked), " ".join(text.split()[: most_tokens - len(asked)])))
        return pd.Series(score(pairs) if pairs else [], dtype=float)

    return lambda query, text: sigmoid(scores(query, text)) if normalize else scores(query, text)


def parse_answer(raw: str, ask: Answer | None = None, messages: list[dict] | None = None) -> object:
    """JSON of an answer: all of it, else a fenced block, else one more try; ValueError if none parses."""
    blocks = [b.strip().removeprefix("json").strip() for b in raw.split("```")] if "```" in raw else []
    for candidate in [raw, *blocks]:
        try:
            return json.loads(candidate)
        except ValueError:
            continue
    if ask is not None and messages is not None:
        again = [*messages, {"role": "assistant", "content": raw}, {"role": "user", "content": "Return only valid JSON."}]
        try:
            return json.loads(ask(again))
        except (ValueError, RuntimeError):
            pass
    raise ValueError(f"no JSON in the answer: {raw[:200]}")


def chained(models: list[Answer]) -> Answer:
    """The first model of the chain that answers; RuntimeError if all fail."""

    def ask(messages: list[dict]) -> str:
        errors = []
        for model in models:
            try:
                return model(messages)
            except Exception as error:
                errors.append(str(error))
        raise RuntimeError("; ".join(errors) or "no model")

    return ask


def chained_json(models: list[Callable[[list[dict], bool], str]]) -> Answer:
    """As ``chained``, of models (messages, json_mode): each is asked in JSON mode, then without, before the next one."""
    modes = lambda model: [lambda messages: model(messages, True), lambda messages: model(messages, False)]
    return chained([ask for model in models for ask in modes(model)])


def answer_rows(rows: DataFrame, prompt: str, ask: Answer, column: str = "answer") -> DataFrame:
    """``rows`` with the model's parsed answer as JSON text; null where it fails or does not parse."""

    @F.pandas_udf("string")
    def answers(prompts: pd.Series) -> pd.Series:
        found = []
        for text in prompts:
            messages = [{"role": "user", "content": text}]
            try:
                found.append(json.dumps(parse_answer(ask(messages), ask, messages), ensure_ascii=False))
            except (ValueError, RuntimeError):
                found.append(None)
        return pd.Series(found, dtype=object)

    return rows.withColumn(column, answers(F.col(prompt)))
