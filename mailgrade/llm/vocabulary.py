"""Tokenizer files of the box: a path parameter, opened once in each Python worker."""

from __future__ import annotations

import os

_OPEN: dict[str, object] = {}


def resolve(name: str) -> str:
    """A path as it is; a bare file name is looked up among the public tokenizers."""
    if os.path.dirname(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def sentence_pieces(name: str):
    if name not in _OPEN:
        import sentencepiece

        _OPEN[name] = sentencepiece.SentencePieceProcessor(model_file=resolve(name))
    return _OPEN[name]


def tokenizer(name: str):
    if name not in _OPEN:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        _OPEN[name] = Tokenizer.from_file(resolve(name))
    return _OPEN[name]
