"""Unicode forms that Catalyst has no expression for, as vectorised UDFs."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", unicodedata.normalize("NFC", t).casefold()), na_action="ignore")


def nfc(text: Column) -> Column:
    """The text in composed form; null stays null."""
    return _nfc(text)


def folded(text: Column) -> Column:
    """The composed text with its case folded in full (ß as ss), by which paths collide; null stays null."""
    return _folded(text)


class _Fault(ValueError):
    pass


def _object(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise _Fault("a key twice")
    return found


def _constant(name: str) -> None:
    raise _Fault(f"the constant {name}")


def _parsed(text: str):
    return json.loads(text, object_pairs_hook=_object, parse_constant=_constant)


@F.pandas_udf(StringType())
def _json_fault(texts: pd.Series) -> pd.Series:
    def look(text: str) -> str | None:
        try:
            _parsed(text)
        except _Fault as e:
            return str(e)
        except (ValueError, RecursionError):
            return "no JSON"
        return None

    return texts.map(look, na_action="ignore").astype("object").where(texts.notna(), "null")


@F.pandas_udf(StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: json.dumps(_parsed(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False), na_action="ignore")


def json_fault(text: Column) -> Column:
    """Why a text isn't strict JSON, at any depth: no JSON, a key twice in one object, the constant NaN or Infinity; null where
    nothing is wrong. A null text is named so."""
    return _json_fault(text)


def canonical_json(text: Column) -> Column:
    """JSON with its keys sorted at every depth, without blanks, nulls kept; a text that isn't strict JSON is an error."""
    return _canonical(text)
