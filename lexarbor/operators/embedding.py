"""Models that the caller brings: embedders and tokenizers, loaded once a task and fed in batches.

`load` is called on the executor and gives the model, so that neither weights nor vocabulary travel with the plan: an embedder takes
a list of texts and gives as many vectors, a tokenizer gives as many lists of ids. Batches bound the memory of a task, whatever the
partition holds. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarbor.functions import text as tx

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]
Tokenizer = Callable[[list[str]], Sequence[Sequence[int]]]


def _mapped(load: Callable[[], Callable], batch: int, kind: str):
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in columns:
            out: list = []
            for i in range(0, len(texts), batch):
                out.extend(list(v) for v in model(texts.iloc[i : i + batch].tolist()))
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, kind)


def embed(rows: DataFrame, load: Callable[[], Embedder], text: str = "text", batch: int = 16, max_words: int = 512, out: str = "embedding") -> DataFrame:
    """rows with a vector of each text's first max_words words (a bound of the model, not of the table)."""
    return rows.withColumn(out, _mapped(load, batch, "array<float>")(tx.truncated(F.coalesce(F.col(text), F.lit("")), max_words)))


def tokenise(rows: DataFrame, load: Callable[[], Tokenizer], text: str = "text", batch: int = 256, limit: int | None = None, out: str = "ids") -> DataFrame:
    """rows with the token ids of the whole text, or the first `limit` of them."""
    ids: Column = _mapped(load, batch, "array<int>")(F.coalesce(F.col(text), F.lit("")))
    return rows.withColumn(out, ids if limit is None else F.slice(ids, 1, limit))


def tokenizer_file(path: str) -> Callable[[], Tokenizer]:
    """A loader of a tokenizer file (JSON of the `tokenizers` library) that every executor can read at path."""

    def load() -> Tokenizer:
        from tokenizers import Tokenizer as Files

        held = Files.from_file(path)
        held.encode_special_tokens = True
        return lambda texts: [e.ids for e in held.encode_batch(texts, add_special_tokens=False)]

    return load
