"""What the JVM functions lack: Unicode decomposition, Han bigrams, international host names.

Vectorised pandas UDFs over Arrow batches; everything else stays with built-in functions.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HAN = re.compile(r"[㐀-鿿]+")
_NOT_WORD = re.compile(r"[^\w]+|_+")


def _clean(s: str | None) -> str:
    bare = "".join(c for c in unicodedata.normalize("NFKD", (s or "").lower()) if not unicodedata.combining(c))
    return _NOT_WORD.sub(" ", bare).strip()


def _pieces(s: str | None) -> list[str]:
    out: dict[str, None] = {}
    for word in _clean(s).split():
        for run in _HAN.findall(word):
            out.update(dict.fromkeys([run[i : i + 2] for i in range(len(run) - 1)] or [run]))
        rest = _HAN.sub(" ", word).split()
        out.update(dict.fromkeys(w for w in rest if len(w) > 1))
    return list(out)


def _intent(s: str | None, stop: frozenset) -> list[str]:
    words = _clean(s).split()
    out = dict.fromkeys(w for w in words if len(w) > 1 and w not in stop)
    for w in words:  # languages that write without spaces: neighbouring letters
        if len(w) > 2 and _HAN.search(w):
            out.update(dict.fromkeys(w[i : i + 2] for i in range(len(w) - 1)))
    return list(out)


def _ascii_host(host: str | None) -> str:
    h = (host or "").strip().rstrip(".").lower()
    try:
        return h.encode("idna").decode() if h else ""
    except UnicodeError:
        return h


@F.pandas_udf(T.StringType())
def clean_text(s: pd.Series) -> pd.Series:
    """Lower case without marks; everything but letters and digits is one space."""
    return s.map(_clean)


@F.pandas_udf(T.ArrayType(T.StringType()))
def word_tokens(s: pd.Series) -> pd.Series:
    """Distinct words of two letters or more, and bigrams of Han runs."""
    return s.map(_pieces)


def intent_words(stop_words: list[str]):
    """A function of a text column: its distinct words of two letters or more that are no stop words, and bigrams of words with Han letters."""
    stop = frozenset(stop_words)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def tokens(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _intent(x, stop))

    return tokens


@F.pandas_udf(T.StringType())
def compatible(s: pd.Series) -> pd.Series:
    """Widths, ligatures and the like in their plain form (NFKC)."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x) if isinstance(x, str) else x)


@F.pandas_udf(T.StringType())
def ascii_host(s: pd.Series) -> pd.Series:
    """Host names in their ASCII form; what has none stays as it is."""
    return s.map(_ascii_host)
