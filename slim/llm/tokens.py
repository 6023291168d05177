"""The public byte-level BPE vocabulary, read where the tasks run."""

from __future__ import annotations

END_MARK, END_ID = "<|endoftext|>", 50256


def ranks_path() -> str:
    """Where the ranks file lies; looked up on the machine that reads it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str | None = None):
    """An encoder with the ids of the tokenizers library's ``byte_bpe_50k.json``
    without added special tokens (the tests compare them): the end mark, where
    a text holds it, is one id as there."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path or ranks_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding(
        "byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_MARK: END_ID}
    )

    def encode(text: str | None) -> list[int]:
        if not text:
            return []
        return bpe.encode(text, allowed_special="all") if END_MARK in text else bpe.encode_ordinary(text)

    return encode
