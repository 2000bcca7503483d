"""Token ids of whole texts by byte-level tokenizers.

Where a tokenizer's file has the ids of its merges in their order and every token is reached by its own merges, merging
the pair whose token has the least id gives the same ids as applying the listed merges: a token's last two parts are
those of its listed merge, whatever stands around them. ``tiktoken`` merges in that way and several times faster, so it
takes such files; all others, and texts with very long runs of white space, go through ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Texts are taken together up to this many bytes; a longer one goes alone.
BATCH_BYTES = 1 << 20
#: Runs of white space from which the pattern of the faster library runs out of stack.
LONG_RUN = 20_000
_long_run = re.compile(rf"\s{{{LONG_RUN}}}").search


@cache
def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


def token_bytes(token: str) -> bytes:
    return bytes(map(byte_letters().__getitem__, token))


def _library(file: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file)


@cache
def _fast(file: str):
    """The faster library's encoding of the file, or None where it might give other ids; once for each worker process."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(file, encoding="utf-8") as f:
        told = json.load(f)
    model, split = told["model"], told["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain = plain and told["normalizer"] is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    if not plain:
        return None
    special = {t["content"]: t["id"] for t in told["added_tokens"]}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    tokens = sorted(vocab, key=vocab.__getitem__)
    alone = Tokenizer(_library(file).model).encode_batch(tokens)
    if sorted(merged) != merged or len(set(merged)) < len(merged) or any(e.ids != [vocab[t]] for t, e in zip(tokens, alone, strict=True)):
        return None
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: what the byte-level pre-tokenizer splits by
    return tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks={token_bytes(t): i for t, i in vocab.items()}, special_tokens=special)


class ByteEncoder:
    """Ids of texts as the tokenizer in the file gives them with add_special_tokens=False; strings of special tokens in a text are plain text unless ``special``."""

    def __init__(self, file: str, special: bool):
        self.lib = _library(file)
        self.lib.encode_special_tokens = not special
        self.fast = _fast(file)
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()] if special else []

    def encode(self, texts: list[str]) -> list[array]:
        """Each text's ids, an array of unsigned 32-bit integers."""
        return [array("I", self._ids(t)) for t in texts]

    def _ids(self, text: str) -> list[int]:
        if self.fast is None or any(a in text for a in self.added) or len(text) >= LONG_RUN and _long_run(text):
            return self.lib.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def bytes_of_ids(self) -> list[bytes]:
        """The bytes that each id stands for, by id; tokens outside the model's vocabulary stand for their text."""
        vocab = self.lib.get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocab.values()) + 1)
        added = {t.content for t in self.lib.get_added_tokens_decoder().values()}
        for t, i in vocab.items():
            out[i] = t.encode() if t in added else token_bytes(t)
        return out


def text_slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive slices of at most BATCH_BYTES or one text; null texts are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64, count=len(texts) + 1, offset=8 * texts.offset) if len(texts) else np.zeros(1, np.int64)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + BATCH_BYTES, "right")) - 1)
        yield i, texts.slice(i, j - i).to_pylist()
        i = j
