"""Text to vectors with a function the caller supplies, each distinct text once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticktide.functions.text import BLANK_HEADLINE
from ticktide.operators import panel as P
from ticktide.session import written

Embed = Callable[[list[str]], np.ndarray]


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def embed_texts(
    texts: DataFrame, load: Callable[[], Embed], text: str = "text", batch: int = 32, blank: str | None = BLANK_HEADLINE, dim: int | None = None
) -> DataFrame:
    """Add ``vec``. ``load`` runs once per task and returns the batch function.

    Blank texts are embedded as ``blank``; with ``blank=None`` they get ``dim`` zeros.
    """
    columns = texts.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = load()
        for frame in frames:
            given = frame[text].fillna("").tolist()
            empty = [not t.strip() for t in given]
            asked = [blank if e and blank is not None else t for t, e in zip(given, empty)]
            parts = [np.asarray(embed(asked[i:i + batch]), dtype=np.float64) for i in range(0, len(asked), batch)]
            vectors = [row for part in parts for row in part]
            if blank is None:
                vectors = [np.zeros(dim or len(v)) if e else v for v, e in zip(vectors, empty)]
            yield frame[columns].assign(vec=vectors)

    return texts.mapInPandas(run, f"{schema}, vec array<double>")


def embedding_cache(
    rows: DataFrame, cache: DataFrame, load: Callable[[], Embed], text: str = "Processed_Title", spread: str = "news_id", batch: int = 32
) -> tuple[DataFrame, DataFrame]:
    """(rows with ``vec``, texts to add to the cache); what is embedded is written once, so the model runs once a text.

    ``cache``: key, text, vec. Only distinct texts the cache lacks are embedded; frequent texts
    are joined back spread over several tasks.
    """
    keyed = rows.withColumn("key", text_key(F.coalesce(text, F.lit(""))))
    distinct = keyed.groupBy("key").agg(F.first(F.coalesce(text, F.lit(""))).alias("text"))  # equal keys, equal texts
    new = written(embed_texts(distinct.join(cache.select("key"), "key", "left_anti"), load, "text", batch), "embedded")
    known = cache.select("key", "vec").unionByName(new.select("key", "vec"))
    return P.join_hot_keys(keyed, known, "key", F.col(spread)).drop("key"), new
