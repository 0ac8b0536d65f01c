"""Tokens: numbers, currency and percent signs, and words; normalised for comparison.

Texts of plain characters are tokenised by built-in expressions. Others (those whose digits, letters, case folding or
compatibility forms the JVM and Unicode may see differently) take an Arrow function.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..config import TokenizerConfig

#: a text of these alone needs no Unicode tables: ASCII, Latin-1 letters but for the sharp s, and common punctuation
PLAIN = r"^[\x00-\x7f¡£§«»¿-ÖØ-Þà-öø-ÿ–—‘-„…€]*$"
#: groups repeat possessively: nothing follows that a step back could help, and a long chain needs no stack
TOKEN = r"[0-9]+(?:[.,][0-9]+)*+|[%$€£]|[A-Za-z0-9À-ÖØ-Þà-öø-ÿ]+(?:['’\-][A-Za-z0-9À-ÖØ-Þà-öø-ÿ]+)*+"
SIGNS = {"%": "percent", "$": "dollar", "€": "euro", "£": "pound"}


def plain_tokens(text: Column, config: TokenizerConfig = TokenizerConfig()) -> Column:
    """Normalised tokens of a plain text."""

    found = F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))
    found = F.transform(found, lambda t: F.replace(F.lower(t), F.lit("’"), F.lit("'")))
    if config.normalize_numbers:
        found = F.transform(found, lambda t: F.when(t.rlike("^[0-9]"), F.replace(t, F.lit(","), F.lit(""))).otherwise(t))
    signs = {s: w for s, w in SIGNS.items() if (config.normalize_percent if s == "%" else config.normalize_currency)}
    if signs:
        words = F.create_map(*[F.lit(x) for pair in signs.items() for x in pair])
        found = F.transform(found, lambda t: F.coalesce(F.try_element_at(words, t), t))
    return found


def token_spans(text: Column) -> Column:
    """array<struct<start,end>> of a plain text's tokens, by a left fold: nothing between two tokens can start one."""
    raw = F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(s: Column, t: Column) -> Column:
        at = F.call_function("locate", t, text, s["at"] + 1)
        end = at - 1 + F.length(t)
        return F.struct(end.cast("int").alias("at"), F.concat(s["spans"], F.array(F.struct((at - 1).cast("int").alias("start"), end.cast("int").alias("end")))).alias("spans"))

    return F.aggregate(raw, zero, add)["spans"]


_PLAIN, _TOKEN = re.compile(PLAIN), re.compile(TOKEN)


def scan(text: str) -> list[tuple[int, int]]:
    """(start, end) of every token of any text, by the character classes of str."""
    if _PLAIN.match(text):
        return [m.span() for m in _TOKEN.finditer(text)]
    spans, i, n = [], 0, len(text)
    while i < n:
        c, j = text[i], i + 1
        if c.isdigit():
            while j < n and (text[j].isdigit() or (text[j] in ".," and j + 1 < n and text[j - 1].isdigit() and text[j + 1].isdigit())):
                j += 1
        elif c in SIGNS:
            pass
        elif c.isalnum():
            while j < n and (text[j].isalnum() or (text[j] in "'’-" and j + 1 < n and text[j - 1].isalnum() and text[j + 1].isalnum())):
                j += 1
        else:
            i = j
            continue
        spans.append((i, j))
        i = j
    return spans


def normalise(token: str, config: TokenizerConfig = TokenizerConfig()) -> str:
    """The form in which tokens are compared; may be empty."""
    t = unicodedata.normalize("NFKC", token).casefold().replace("’", "'")
    if config.normalize_numbers and t[:1].isdigit():
        t = t.replace(",", "")
    if t in SIGNS and (config.normalize_percent if t == "%" else config.normalize_currency):
        return SIGNS[t]
    return t


def tokens_with_spans(text: str, config: TokenizerConfig = TokenizerConfig()) -> tuple[list[str], list[tuple[int, int]]]:
    found = [(normalise(text[a:b], config), (a, b)) for a, b in scan(text)]
    found = [x for x in found if x[0]]
    return [t for t, _ in found], [s for _, s in found]


def arrow_tokens(rows: DataFrame, text: str = "text", config: TokenizerConfig = TokenizerConfig(), tokenizer=None) -> DataFrame:
    """rows with `tokens`, by the character classes of str or by a function of a text that returns (tokens, spans)."""
    names = rows.columns
    at = names.index(text)
    own = tokenizer or (lambda t: tokens_with_spans(t, config))

    def run(source) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = [[str(x) for x in own(t)[0]] if t is not None else [] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], names=[*names, "tokens"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("tokens", ArrayType(StringType()))]))
