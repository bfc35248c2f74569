"""Functions for use in SQL: a scalar one, an aggregate, and a table function."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_WORD = re.compile(r"[一-鿿]+|[a-zA-Z0-9]+")


class Ngrams:
    """``gram`` of each run of n tokens of a text."""

    def eval(self, text: str, n: int) -> Iterator[tuple[str]]:
        w = _WORD.findall((text or "").lower())
        for i in range(len(w) - n + 1):
            yield (" ".join(w[i : i + n]),)


def _geometric_mean(x: pd.Series) -> float:
    import numpy as np

    return float(np.round(np.exp(np.log(x.to_numpy(dtype=float)).mean()), 4))


def register(spark: SparkSession) -> None:
    """``tessera_ngrams(text, n)``, ``tessera_geomean(x)`` and ``tessera_tokens(text)`` in this session."""
    spark.udtf.register("tessera_ngrams", F.udtf(Ngrams, returnType="gram string"))
    spark.sql("create or replace temporary function tessera_tokens(t string) returns int return size(regexp_extract_all(lower(coalesce(t, '')), '([\\\\u4e00-\\\\u9fff]+|[a-zA-Z0-9]+)', 1))")

    @F.pandas_udf("double")
    def geomean(x: pd.Series) -> float:
        return _geometric_mean(x)

    spark.udf.register("tessera_geomean", geomean)
