"""Places where users plug in models and parsers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def embedding(load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[Column], Column]:
    """A column function text -> array<float>; load runs once per worker, the model it returns gets whole batches."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(list(model(texts.fillna("").tolist())))

    return embed


def compression(compress: Callable[[str], str]) -> Callable[[DataFrame, str], DataFrame]:
    """A function that adds compressed and compression_ratio for a text column."""

    @F.pandas_udf("string")
    def shorter(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(compress)

    def add(rows: DataFrame, text: str) -> DataFrame:
        out = rows.withColumn("compressed", shorter(F.col(text)))
        return out.withColumn("compression_ratio", F.round(F.length("compressed") / F.greatest(F.length(F.coalesce(text, F.lit(""))), F.lit(1)), 4))

    return add


def parsed(docs: DataFrame, parse: Callable[[str], list[tuple[str, str, str]]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents through a format adapter: parse gives (path, type, content) rows of one document, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(k, n, *row) for k, t in zip(rows[key], rows[text], strict=True) for n, row in enumerate(parse(t or ""))]
            yield pd.DataFrame(out, columns=[key, "sort_order", "path", "type", "content"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, sort_order int, path string, type string, content string")


def adapter_function(spark: SparkSession, name: str, parse: Callable[[str], list[tuple[str, str, str]]]) -> None:
    """Registers a format adapter as a table function for SQL: SELECT d.*, r.* FROM docs d, LATERAL name(d.text) r.

    It gives the rows (sort_order, path, type, content) that parse makes of one text, in order; null counts as empty.
    """

    @F.udtf(returnType="sort_order int, path string, type string, content string")
    class Adapter:
        def eval(self, text: str):
            for n, row in enumerate(parse(text or "")):
                yield (n, *row)

    spark.udtf.register(name, Adapter)


def staged(rows: DataFrame, *stages: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Ranking strategies and context builders, functions from DataFrame to DataFrame, one after another."""
    for stage in stages:
        rows = rows.transform(stage)
    return rows
