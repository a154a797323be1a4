"""Seams for models: what embeds, recognises, rewrites and answers can be put in; the stand-ins need no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.vectors import mock_embedding


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class MockEmbedder:
    """Hash vectors, as an expression."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def column(self, text: Column) -> Column:
        return mock_embedding(text, self.dimension)


def embed(chunks: DataFrame, provider, text: str = "text", make: Callable | None = None) -> DataFrame:
    """``chunks`` with ``embedding``: an expression where the provider has one, else Arrow batches.

    ``make`` builds a model once per Python worker.  Texts of a batch that fails are tried one by one; those that fail
    again have a null embedding and the reason in ``embed_error``."""
    if hasattr(provider, "column"):
        return chunks.withColumn("embedding", provider.column(F.col(text))).withColumn("embed_error", F.lit(None).cast("string"))
    make = make or (lambda: provider)

    @F.pandas_udf("embedding array<float>, error string")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            texts = b.fillna("").tolist()
            try:
                rows = [(v, None) for v in model.embed(texts)]
            except Exception:  # the model's own failure, whatever it is
                rows = []
                for t in texts:
                    try:
                        rows.append((model.embed([t])[0], None))
                    except Exception as e:
                        rows.append((None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=["embedding", "error"])

    out = chunks.withColumn("__v", vectors(F.col(text)))
    return out.withColumn("embedding", F.col("__v.embedding")).withColumn("embed_error", F.col("__v.error")).drop("__v")


#: Makers of embedders by name; those that need a model are added by whoever has one.
EMBEDDERS: dict[str, Callable] = {"mock": MockEmbedder}


def embedder(name: str = "mock", **options):
    """The embedder of a name."""
    if name not in EMBEDDERS:
        raise ValueError(f"no embedder {name!r}; there are {', '.join(EMBEDDERS)}")
    return EMBEDDERS[name](**options)


def available_models(fetch: Callable[[], list[str]]) -> list[str]:
    """The names that a service lists; none where it can't be reached."""
    try:
        return [n for n in fetch() if n]
    except Exception:  # the service's own failure
        return []


def choose_model(available: list[str], preferred: list[str]) -> str | None:
    """The first preferred model that is there: by name, by part of a name, by family."""
    for want in preferred:
        for test in (lambda a, w: a == w, lambda a, w: w in a, lambda a, w: a.split(":")[0] == w.split(":")[0]):
            for have in available:
                if test(have, want):
                    return have
    return available[0] if available else None
