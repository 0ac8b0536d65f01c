"""Passages and tokens of one text in Python: the same as by the expressions of segments and tokens, for Arrow batches."""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa

from ..config import TokenizerConfig
from .tokens import PLAIN, SIGNS, TOKEN, normalise

#: characters of a chunk of texts
CHUNK = 2_000_000
_PLAIN, _TOKEN = re.compile(PLAIN), re.compile(TOKEN)
_GROUPED = re.compile(r"[0-9],[0-9]")
_ENDS = {True: re.compile(r"[.?!;\n]"), False: re.compile(r"[.?!;]")}


_DIGIT = "[" + "".join(re.escape(chr(k)) for k in range(sys.maxunicode + 1) if chr(k).isdigit()) + "]"
#: tokens.scan() as a pattern: digits as str.isdigit() has them, letters as str.isalnum()
_ANY = re.compile(rf"{_DIGIT}+(?:[.,]{_DIGIT}+)*+|[%$€£]|[^\W_]+(?:['’\-][^\W_]+)*+")


def sentences(text: str, newlines: bool = True) -> list[tuple[int, int]]:
    """(start, end) of the segments of with_sentences()."""
    cuts, n = [0], len(text)
    for m in _ENDS[newlines].finditer(text):
        at = m.end()
        if text[at - 1] in ";\n" or (at < n and text[at].isspace()):
            cuts.append(at)
    cuts.append(n)
    found = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        piece = text[a:b].lstrip()
        kept = piece.rstrip()
        if kept:
            found.append((b - len(piece), b - len(piece) + len(kept)))
    return found


def passages(text: str, size: int = 1, stride: int = 1) -> list[tuple[int, int, int, int]]:
    """(start, end, segment_start, segment_end) of the windows() of a text's sentences."""
    size, stride, s = max(1, size), max(1, stride), sentences(text)
    if size == stride == 1:
        return [(a, b, k, k + 1) for k, (a, b) in enumerate(s)]
    n = len(s)
    starts = range(0, max(0, -(-(n - size) // stride)) * stride + 1, stride) if n else ()
    return [(s[a][0], s[min(n, a + size) - 1][1], a, min(n, a + size)) for a in starts]


def tokenizer(config: TokenizerConfig = TokenizerConfig()):
    """A function of a text and of the (start, end, ...) of its parts that gives the tokens of each part."""
    signs = {s: w for s, w in SIGNS.items() if (config.normalize_percent if s == "%" else config.normalize_currency)}
    normal = lru_cache(100_000)(lambda t: normalise(t, config))

    def marks(low: str) -> tuple[bool, bool]:
        return any(c in low for c in signs), config.normalize_numbers and _GROUPED.search(low) is not None

    def plain(low: str, signed: bool, grouped: bool) -> list[str]:
        found = _TOKEN.findall(low)
        if grouped:
            found = [t.replace(",", "") for t in found]  # only numbers hold any
        return [signs.get(t, t) for t in found] if signed else found

    def other(part: str) -> list[str]:
        found = [normal(t) if len(t) < 100 else normalise(t, config) for t in _ANY.findall(part)]
        return [t for t in found if t]

    def cut(text: str, parts) -> list[list[str]]:
        # lower case keeps the places of plain characters
        if text.isascii() or _PLAIN.match(text):
            low = text.lower().replace("’", "'")
            signed, grouped = marks(low)
            if not signed and not grouped:
                return [_TOKEN.findall(low, p[0], p[1]) for p in parts]
            return [plain(low[p[0] : p[1]], signed, grouped) for p in parts]
        pieces = [text[p[0] : p[1]] for p in parts]
        return [plain(low := t.lower().replace("’", "'"), *marks(low)) if _PLAIN.match(t) else other(t) for t in pieces]

    return cut


def chunked(batch, at: int, most: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows of a batch, of bounded length; a null text is empty."""
    lo, held, texts = 0, 0, []
    for k, value in enumerate(batch.column(at)):
        t = value.as_py() or ""
        texts.append(t)
        held += len(t)
        if held >= most:
            yield lo, texts
            lo, held, texts = k + 1, 0, []
    if texts:
        yield lo, texts


def token_digests(config: TokenizerConfig = TokenizerConfig()):
    """An Arrow function of (doc_id, text): doc_id, n_tokens and the MD5 of the tokens, of a bounded length of texts at a time;
    null for a null text."""

    def run(source) -> Iterator[pa.RecordBatch]:
        cut = tokenizer(config)
        for batch in source:
            for lo, texts in chunked(batch, 1):
                n, digest = [], []
                for t in texts:
                    tokens = cut(t, [(0, len(t))])[0]
                    n.append(len(tokens))
                    digest.append(hashlib.md5(" ".join(tokens).encode()).hexdigest())
                absent = batch.column(1).slice(lo, len(texts)).is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(n, pa.int32(), mask=absent), pa.array(digest, pa.string(), mask=absent)], names=["doc_id", "n_tokens", "digest"])

    return run
