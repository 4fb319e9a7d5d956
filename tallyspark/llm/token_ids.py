"""Byte-level BPE ids of whole texts, those that the `tokenizers` library gives for a vocabulary file.

Where the file is a plain byte-level BPE whose merges stand in order of their ids, `tiktoken` computes the same ids from the same
vocabulary in a fraction of the time. Texts with characters whose class differs between Unicode versions, which the two
libraries might cut differently, texts that spell an added token, texts with a run of white space too long for `tiktoken`'s
regex engine (it gives up after a million steps back), and files of any other kind go to `tokenizers` itself, at its defaults.
"""

from __future__ import annotations

import json
import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Fixed value: how the byte-level pre-tokenizer cuts a text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Anything but Latin, Greek, Cyrillic, common punctuation, kana, Han and Hangul of the first Unicode versions.
_ODD = "[^\x00-ɏͰ-ͳΆ-ώЀ-џ‐-‧‰-⁞€、-】ぁ-ゔァ-ヺ一-龥가-힣]"
#: Longest run of white space that may take the fast path.
_RUN = 1000


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Ids by their bytes, if ids alone tell which merge comes first."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not spec.get("normalizer") and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    if not plain or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
        return None
    vocab = model["vocab"]
    merged = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
    if merged != sorted(merged) or len(set(merged)) != len(merged):
        return None
    added = {t["content"] for t in spec.get("added_tokens", [])}
    byte = _bytes_of()
    return {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in added}


class Encoder:
    """encode(texts) -> for each text its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ranks = _ranks(spec)
        self.slow = re.compile("|".join([_ODD, rf"\s{{{_RUN}}}", *(re.escape(t["content"]) for t in spec.get("added_tokens", []))]))
        self.fast = None
        if ranks:
            import tiktoken

            self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or self.slow.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            a = array("I", self.ids(t))
            if array("H", [1]).tobytes()[0] == 0:  # a big-endian machine
                a.byteswap()
            out.append(a.tobytes())
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder for a vocabulary file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
