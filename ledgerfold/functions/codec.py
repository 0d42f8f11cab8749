"""Cache keys and value compression that Spark has no built-in for, as Arrow-batched functions."""

from __future__ import annotations

import base64
import hashlib
import json
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerfold.functions.text import json_string, normalize_prompt

#: Texts of this many characters or more are compressed.
COMPRESS_FROM = 1024
#: Mark of a compressed value.
MARK = "gz:"


def scalar_canonical(prompt: Column, model: Column, version: Column, params: dict[str, Column]) -> Column:
    """Canonical request text for parameters whose JSON text is at hand: keys sorted, ``", "`` and ``": "`` between, NULL as ``null``.

    Needs no Python: ``params`` maps names to columns of JSON text. ``prompt`` is normalised first.
    """
    inner = [F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ": "), F.coalesce(v, F.lit("null"))) for k, v in sorted(params.items())]
    text = lambda c: F.coalesce(json_string(c), F.lit("null"))
    return F.concat(
        F.lit('{"model": '), text(model), F.lit(', "model_version": '), text(version),
        F.lit(', "params": {'), F.concat_ws(", ", *inner), F.lit('}, "prompt": '), text(normalize_prompt(prompt)), F.lit("}"),
    )


def cache_key(canonical: Column) -> Column:
    """Key of a canonical request text."""
    return F.sha2(canonical, 256)


@F.pandas_udf(StringType())
def any_canonical(prompt: pd.Series, model: pd.Series, version: pd.Series, params: pd.Series) -> pd.Series:
    """Canonical request text for arbitrary parameters, given as a JSON object; ``prompt`` as normalised. NULL where the object is none."""

    def one(p, m, v, x):
        try:
            obj = json.loads(x) if x is not None else {}
        except ValueError:
            return None
        if p is None or m is None or not isinstance(obj, dict):
            return None
        return json.dumps({"prompt": p, "model": m, "model_version": v, "params": obj}, sort_keys=True, ensure_ascii=False)

    return pd.Series([one(*r) for r in zip(prompt, model, version, params, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def _deflate(value: pd.Series) -> pd.Series:
    return pd.Series([None if v is None else MARK + base64.b64encode(zlib.compress(v.encode("utf-8"))).decode("ascii") for v in value], dtype=object)


@F.pandas_udf(StringType())
def _inflate(value: pd.Series) -> pd.Series:
    def one(v):
        try:
            return zlib.decompress(base64.b64decode(v[len(MARK) :])).decode("utf-8")
        except (ValueError, zlib.error):
            return v

    return pd.Series([None if v is None else one(v) for v in value], dtype=object)


def compress_value(value: Column) -> Column:
    """Long texts compressed and marked, others as they are; short ones never leave the JVM."""
    return F.when(F.char_length(value) >= COMPRESS_FROM, _deflate(F.when(F.char_length(value) >= COMPRESS_FROM, value))).otherwise(value)


def decompress_value(value: Column) -> Column:
    """The text that was compressed; a value that only looks compressed is given back as it is."""
    return F.when(value.startswith(MARK), _inflate(F.when(value.startswith(MARK), value))).otherwise(value)


def key_of(prompt: str, model: str, params: dict, version: str | None = None) -> tuple[str, str]:
    """Key and canonical text of one request, for the driver."""
    canonical = json.dumps({"prompt": " ".join(prompt.lower().split()), "model": model, "model_version": version, "params": params}, sort_keys=True, ensure_ascii=False)
    return hashlib.sha256(canonical.encode("utf-8")).hexdigest(), canonical
