"""Text primitives with Unicode whitespace, full case folding and normal forms."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that count as whitespace (fixed values, the set of Python's str.isspace).
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
#: The same as a Java character class body.
SPACE = r"\t\n\x0B\f\r\x1C-\x1F \x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Unicode normal forms.
FORMS = ("NFC", "NFD", "NFKC", "NFKD")
WORD = r"([A-Za-z0-9']+)"
ASCII_ONLY = r"^[\x00-\x7F]*$"


def collapse(c: Column) -> Column:
    """Each run of whitespace becomes one space."""
    return F.regexp_replace(c, f"[{SPACE}]+", " ")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def squeeze(c: Column) -> Column:
    return F.btrim(collapse(c), F.lit(" "))


def newlines(c: Column) -> Column:
    """CRLF and lone CR become LF."""
    return F.regexp_replace(c, "\r\n?", "\n")


def words(c: Column) -> Column:
    """ASCII word tokens in order."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(1))


def tokens(c: Column) -> Column:
    """Longest runs of non-whitespace, in order."""
    return F.regexp_extract_all(c, F.lit(f"([^{SPACE}]+)"), F.lit(1))


def once(f, kind: T.DataType):
    """A function of one string over Arrow batches; null stays null.

    Declared non-deterministic, which it is not, so that the planner neither copies it into the filters
    it derives nor computes it again for every use of its result: a text crosses to Python once.
    """
    if isinstance(kind, T.StructType):
        names = kind.names

        def run(s: pd.Series) -> pd.DataFrame:
            rows = [(None,) * len(names) if x is None else f(x) for x in s]
            return pd.DataFrame(rows, columns=names, dtype=object)

    else:

        def run(s: pd.Series) -> pd.Series:
            return s.map(f, na_action="ignore")

    return F.pandas_udf(run, kind).asNondeterministic()


def _text_udf(f):
    return once(f, T.StringType())


_SPACES = re.compile(r"\s+")


def cleaner(form: str, fold: bool, collapse: bool, strip: bool, fold_last: bool = False) -> Callable[[str], str]:
    """Normal form, line ends, folding, blanks, edges, as one function of a string.

    ``fold_last`` folds after the blanks have collapsed instead of before.
    """
    if form not in FORMS:
        raise ValueError(f"form must be one of {FORMS}")

    def clean(x: str) -> str:
        x = unicodedata.normalize(form, x).replace("\r\n", "\n").replace("\r", "\n")
        if fold and not fold_last:
            x = x.casefold()
        if collapse:
            x = _SPACES.sub(" ", x)
        if fold and fold_last:
            x = x.casefold()
        return x.strip() if strip else x

    return clean


@cache
def _form_udf(form: str):
    return _text_udf(lambda x: unicodedata.normalize(form, x))


@cache
def _fold_udf():
    return _text_udf(str.casefold)


def normal_form(c: Column, form: str = "NFKC") -> Column:
    """Unicode normal form, for which Spark has no built-in: Arrow batches.

    Every row goes, not only non-ASCII ones: a choice by row would name its input three times, and
    nested choices would compute a text's earlier steps over and over.
    """
    if form not in FORMS:
        raise ValueError(f"form must be one of {FORMS}")
    return _form_udf(form)(c)


def casefold(c: Column) -> Column:
    """Full case folding (sharp s, ligatures, final sigma)."""
    return _fold_udf()(c)


def lines(c: Column) -> Column:
    """Lines at any line end, with no empty one after the last."""
    parts = F.split(c, "\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
