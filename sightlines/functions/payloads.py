"""Kinds of answers that came back as text: JSON, fenced JSON, JSON inside prose, or none."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FENCE = r"(?is)^```(?:json)?\s*(.*?)\s*```$"
_READ = T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])


def _read(candidate: str | None, text: str | None, fenced: bool) -> tuple[str, str | None]:
    """(kind, JSON text of the object) of a text that is not empty; candidate is what should be JSON."""
    try:
        value = json.loads(candidate)
    except ValueError:
        pass
    else:
        return (("fenced_json" if fenced else "json"), json.dumps(value, ensure_ascii=False)) if isinstance(value, dict) else ("non_object_json", None)
    decoder, at = json.JSONDecoder(), text.find("{")
    found = at >= 0
    while at >= 0:
        try:
            return "embedded_json", json.dumps(decoder.raw_decode(text, at)[0], ensure_ascii=False)
        except ValueError:
            at = text.find("{", at + 1)
    return ("malformed_json" if found or fenced else "plain_text"), None


@F.pandas_udf(_READ)
def _decoded(candidate: pd.Series, text: pd.Series, fenced: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if t is None else _read(c, t, bool(f)) for c, t, f in zip(candidate, text, fenced)]
    return pd.DataFrame(rows, columns=["kind", "value"])


def classify_payload(text: Column) -> Column:
    """struct(kind, value): empty, json, fenced_json, embedded_json, plain_text, malformed_json or non_object_json; value is the object as JSON text.

    Texts without a brace or bracket, number or quote at their start never leave the JVM's side of the decision: they are empty or plain.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    fenced = t.rlike(FENCE)
    plain = ~fenced & ~t.contains("{") & ~t.rlike(r'^([\["\-0-9]|true$|false$|null$|NaN$|Infinity$)')
    read = _decoded(F.when(fenced, F.regexp_extract(t, FENCE, 1)).otherwise(t), F.when((t == "") | plain, None).otherwise(t), fenced)
    none = F.lit(None).cast("string").alias("value")
    return F.when(t == "", F.struct(F.lit("empty").alias("kind"), none)).when(plain, F.struct(F.lit("plain_text").alias("kind"), none)).otherwise(read)
