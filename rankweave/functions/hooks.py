"""Where a caller plugs in a model: encoder, generator, judge, translator, ranker.

A hook is a plain function over a batch (a list in, a list out). It runs inside the partitions of
a DataFrame; ``setup`` is called once per partition to load whatever the model needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Batch = Callable[[list], list]


def map_batch(df: DataFrame, inputs: Sequence[str], fn: Callable[..., list], out: str, kind: str, setup: Callable[[], object] | None = None, fallback: object = None, strict: bool = False) -> DataFrame:
    """Add ``out`` = fn(list of input tuples); a batch that raises is retried row by row.

    A row that still raises gets ``fallback``, so one bad row never fails the job. With ``strict`` the error is
    raised instead: for models whose output has no honest stand-in.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T._parse_datatype_string(kind))])

    def run(frames):
        state = setup() if setup is not None else None
        call = (lambda rows: fn(rows, state)) if setup is not None else fn
        for frame in frames:
            rows = list(frame[list(inputs)].itertuples(index=False, name=None))
            try:
                values = list(call(rows))
                if len(values) != len(rows):
                    raise ValueError("a hook must return one value per row")
            except Exception:
                values = []
                for row in rows:
                    try:
                        values.append(list(call([row]))[0])
                    except Exception:
                        if strict:
                            raise
                        values.append(fallback)
            yield frame.assign(**{out: pd.Series(values, index=frame.index, dtype=object)})

    return df.mapInPandas(run, schema)


def hash_encoder(dims: int) -> Callable[[Column], Column]:
    """Default encoder: signed feature hashing of a token array, scaled to unit length.

    The digest of a token is taken once per batch; an empty text gives a zero vector.
    """
    @F.pandas_udf("array<double>")
    def encode(tokens: pd.Series) -> pd.Series:
        flat = tokens.explode().dropna()
        out = np.zeros((len(tokens), dims))
        if len(flat):
            codes, names = pd.factorize(flat)
            digest = [hashlib.md5(str(n).encode()).hexdigest() for n in names]
            place = np.array([int(d[:8], 16) % dims for d in digest])
            sign = np.array([1.0 if int(d[8], 16) < 8 else -1.0 for d in digest])
            row = tokens.index.get_indexer(flat.index)
            np.add.at(out, (row, place[codes]), sign[codes])
        length = np.linalg.norm(out, axis=1, keepdims=True)
        out = np.divide(out, length, out=np.zeros_like(out), where=length > 0)
        return pd.Series(list(out))

    return encode


def encode_texts(df: DataFrame, text: str, fn: Batch | None, out: str = "vec", dims: int = 64, tokenizer: Callable[[Column], Column] | None = None) -> DataFrame:
    """Embed ``text`` with a caller's batch encoder, or with ``hash_encoder``. An encoder that fails on a row fails the job."""
    if fn is None:
        from rankweave.functions.text import tokenize_words

        return df.withColumn(out, hash_encoder(dims)((tokenizer or tokenize_words)(F.col(text))))
    return map_batch(df, [text], lambda rows: fn([r[0] for r in rows]), out, "array<double>", strict=True)
