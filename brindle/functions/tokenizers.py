"""Tokenizers by script: analyzers are plugged in, and runs of the script stand in for those that aren't."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

from . import values as V
from .text import HAN, KANA, THAI, find_all, generic_tokens

#: A tokenizer turns a text column into a column of arrays of words.
Tokenizer = Callable[[Column], Column]


def script_runs(pattern: str, stop: list[str] | None = None) -> Tokenizer:
    """Runs of a script, without stop words."""
    return lambda t: F.filter(find_all(t, pattern), lambda w: ~w.isin(*stop)) if stop else find_all(t, pattern)


def plugged(analyze: Callable[[str], list[str]], least: int = 2, stop: list[str] | None = None) -> Tokenizer:
    """A Python analyzer as a tokenizer, run over Arrow batches; words shorter than `least` and stop words are left out. Null texts have no words."""
    out = frozenset(stop or ())

    @pandas_udf(ArrayType(StringType()))
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: [w for w in analyze(x) if len(w) >= least and w not in out] if isinstance(x, str) else [])

    return lambda t: run(t)


DEFAULTS: dict[str, Tokenizer] = {
    "ja": script_runs("[\\u3040-\\u30ff\\u4e00-\\u9fff]{2,}", V.STOP_JA),
    "zh": script_runs(HAN + "{2,}", V.STOP_ZH),
    "th": script_runs(THAI + "{2,}"),
}


def routed(t: Column, slug: Column | None = None, tokenizers: dict[str, Tokenizer] | None = None, exclusive: bool = True) -> dict[str, Column]:
    """The words of a text by tokenizer: generic, ja, zh and th.

    Kana send a text to ja, Han characters without kana to zh, Thai to th, always beside the generic tokenizer. Rounds
    before this rule (`exclusive` false) ran ja and zh both on any text with Han characters.
    """
    use = DEFAULTS | (tokenizers or {})
    none = F.array().cast("array<string>")
    kana, han = t.rlike(KANA), t.rlike(HAN)
    when = {"ja": kana if exclusive else kana | han, "zh": (han & ~kana) if exclusive else kana | han, "th": t.rlike(THAI)}
    return {"generic": generic_tokens(t, slug)} | {k: F.when(c, use[k](t)).otherwise(none) for k, c in when.items()}


def all_words(parts: dict[str, Column]) -> Column:
    """The words of all tokenizers, in their order."""
    return F.concat(*parts.values())
