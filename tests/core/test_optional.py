from importlib.util import find_spec

import pytest

from lodestar.functions import optional


def test_missing_libraries_say_so():
    for name, make in (("pysbd", optional.pysbd_segmenter), ("spacy", optional.spacy_segmenter), ("spacy", optional.spacy_claim_decomposer)):
        if find_spec(name) is None:
            with pytest.raises(RuntimeError, match=name):
                make()
    with pytest.raises(TypeError):
        optional.huggingface_tokenizer(object())


def test_byte_pair_spans():
    tiktoken = pytest.importorskip("tiktoken")
    make = lambda: tiktoken.Encoding("bytes", pat_str=r"[\s\S]", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    ids, spans = optional.tiktoken_tokenizer(encoding=make)("aé")
    assert ids == [97, 0xC3, 0xA9] and spans == [(0, 1), (1, 1), (1, 2)]


def test_word_level_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer(tokenizers.models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    assert optional.huggingface_tokenizer(t)("a b c") == ([0, 1, 2], [(0, 1), (2, 3), (4, 5)])
