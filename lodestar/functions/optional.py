"""Tokenizers, segmenters and a claim decomposer over libraries that may be missing.

Tokenizers are functions of a text that return (tokens, spans); segmenters and decomposers return (start, end) pairs.
Each loads its model once in a worker, at the first text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from importlib import import_module

Spans = list[tuple[int, int]]


def _library(name: str):
    try:
        return import_module(name)
    except ImportError as e:
        raise RuntimeError(f"{name} is not installed: pip install {name}") from e


def _once(make: Callable):
    """make(), called at first use in each worker; the result never travels."""
    held: list = []

    def get():
        if not held:
            held.append(make())
        return held[0]

    return get


def _strip(text: str, start: int, end: int) -> tuple[int, int] | None:
    piece = text[start:end]
    left = len(piece) - len(piece.lstrip())
    size = len(piece.strip())
    return (start + left, start + left + size) if size else None


def tiktoken_tokenizer(encoding_name: str = "cl100k_base", encoding=None) -> Callable[[str], tuple[list[int], Spans]]:
    """Byte-pair tokens; byte offsets become character offsets, so a token inside a character has an empty span.
    encoding: a function without arguments that makes the encoding, for one from local files."""
    library = _library("tiktoken")
    get = _once(encoding if encoding is not None else lambda: library.get_encoding(encoding_name))

    def tokenize(text: str):
        ids = get().encode(text, disallowed_special=())
        at, starts = 0, []
        for c in text:
            starts += [at] * len(c.encode("utf-8"))
            at += 1
        starts.append(at)
        spans, place = [], 0
        for i in ids:
            end = place + len(get().decode_single_token_bytes(i))
            spans.append((starts[place], starts[end]))
            place = end
        return ids, spans

    return tokenize


def huggingface_tokenizer(tokenizer=None, path: str | None = None, name: str | None = None, add_special_tokens: bool = False) -> Callable[[str], tuple[list[int], Spans]]:
    """A tokenizer of `tokenizers` or `transformers`: an object, a local file, or a hub name."""
    if tokenizer is not None:
        kind = type(tokenizer).__module__.split(".")[0]
        if kind not in ("tokenizers", "transformers") and not callable(getattr(tokenizer, "encode_plus", None)):
            raise TypeError(f"not a tokenizer of tokenizers or transformers: {type(tokenizer)!r}")
        get = _once(lambda: tokenizer)
    else:
        library = _library("tokenizers")
        get = _once(lambda: library.Tokenizer.from_file(path) if path else library.Tokenizer.from_pretrained(name))

    def tokenize(text: str):
        t = get()
        if type(t).__module__.split(".")[0] == "tokenizers":
            e = t.encode(text, add_special_tokens=add_special_tokens)
            found = [(i, (a, b)) for i, (a, b) in zip(e.ids, e.offsets, strict=True) if a < b]
        else:
            e = t(text, add_special_tokens=add_special_tokens, return_offsets_mapping=True)
            special = set(getattr(t, "all_special_ids", ())) if add_special_tokens else set()
            found = [(i, tuple(o)) for i, o in zip(e["input_ids"], e["offset_mapping"], strict=True) if not (i in special and tuple(o) == (0, 0))]
        return [i for i, _ in found], [s for _, s in found]

    return tokenize


def pysbd_segmenter(language: str = "en", clean: bool = False) -> Callable[[str], Spans]:
    """Rule-based sentences; each is found again in the text from where the last one ended, or left out."""
    library = _library("pysbd")
    get = _once(lambda: library.Segmenter(language=language, clean=clean))

    def segment(text: str) -> Spans:
        found, cursor = [], 0
        for s in get().segment(text):
            for form in (s, s.strip()):
                at = text.find(form, cursor) if form else -1
                if at >= 0:
                    cursor = at + len(form)
                    span = _strip(text, at, cursor)
                    found += [span] if span else []
                    break
        return found

    return segment


def _pipeline(model: str):
    library = _library("spacy")

    def load():
        try:
            return library.load(model)
        except OSError as e:
            raise RuntimeError(f"spaCy model {model!r} is not installed") from e

    return _once(load)


#: Words that join clauses, and kinds of words that head one.
JOINING, HEADS = ("and", "or", "but"), ("VERB", "AUX", "ADJ")


def _clause_cuts(sentence) -> Iterable[tuple[int, int]]:
    for t in sentence:
        if t.dep_ == "cc" and t.lower_ in JOINING and t.head.pos_ in HEADS:
            main = t.head == sentence.root or t.head.dep_ == "ROOT" or (t.head.dep_ == "conj" and t.head.head == sentence.root)
            start, end = t.idx, t.idx + len(t)
            if main and sentence.start_char < start and end < sentence.end_char:
                yield start, end


def by_paragraph(segmenter: Callable[[str], Spans], kind: str = "sentence") -> Callable[[str], list[tuple[int, int, str, int]]]:
    """A segmenter of answers out of one of texts: each paragraph is cut on its own, and a segment carries its kind and
    the number of its paragraph. Paragraphs part at a newline, blanks, and newlines; blank ones don't count."""

    def segment(text: str) -> list[tuple[int, int, str, int]]:
        found, at, number = [], 0, 0
        for end, after in [*(m.span() for m in re.finditer(r"\n[ \t]*\n+", text)), (len(text), len(text))]:
            span = _strip(text, at, end)
            if span:
                found += [(span[0] + s[0], span[0] + s[1], kind, number) for s in segmenter(text[span[0] : span[1]])]
                number += 1
            at = after
        return found

    return segment


def spacy_answer_segmenter(model: str = "en_core_web_sm", split_clauses: bool = False) -> Callable[[str], list[tuple[int, int, str, int]]]:
    """Sentences, or clauses, of each paragraph of an answer by a spaCy pipeline, with kind and paragraph."""
    return by_paragraph(spacy_segmenter(model, split_clauses), "clause" if split_clauses else "sentence")


def spacy_segmenter(model: str = "en_core_web_sm", split_clauses: bool = True) -> Callable[[str], Spans]:
    """Sentences of a spaCy pipeline, cut again at the words that join clauses."""
    get = _pipeline(model)

    def segment(text: str) -> Spans:
        found = []
        for sentence in get()(text).sents:
            at = sentence.start_char
            for start, end in [*(sorted(_clause_cuts(sentence)) if split_clauses else []), (sentence.end_char, sentence.end_char)]:
                span = _strip(text, at, start)
                found += [span] if span else []
                at = end
        return found

    return segment


def spacy_claim_decomposer(model: str = "en_core_web_sm", min_claim_tokens: int = 2) -> Callable[[str], Spans]:
    """Claims of a span: cut before conjoined parts, at the joining word or at a comma or semicolon. Pieces of too few
    words are dropped; a span that gives none, or has nothing to cut, is one claim."""
    get = _pipeline(model)

    def decompose(text: str) -> Spans:
        doc, cuts = get()(text), []
        skip = lambda k: next((i for i in range(k, len(text)) if not text[i].isspace()), len(text))
        for t in doc:
            if t.dep_ != "conj":
                continue
            joint = next((c for c in t.head.children if c.dep_ == "cc" and c.i < t.i), None)
            if joint is not None:
                cuts.append((joint.idx, skip(joint.idx + len(joint.text))))
                continue
            mark = next((m for m in doc if m.i < t.i and m.text in (",", ";") and (not cuts or m.idx > cuts[-1][1])), None)
            start, end = (mark.idx if mark is not None else t.idx), skip(t.idx)
            if start < end:
                cuts.append((start, end))
        found, at = [], 0
        for start, end in [*sorted(set(cuts)), (len(text), len(text))]:
            span = _strip(text, at, start) if at < start else None
            if span and len(text[span[0] : span[1]].split()) >= min_claim_tokens:
                found.append(span)
            at = end
        return found or [(0, len(text))]

    return decompose
