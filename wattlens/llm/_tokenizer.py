"""A byte-level BPE vocabulary read from a ``tokenizers`` JSON file, for use inside tasks."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

#: Fixed value: the split pattern of byte-level pre-tokenisation.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Longer texts are cut before white space that follows other text, where a new piece starts anyway.
SEGMENT_CHARS = 1 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Symbols and merges of the file; raises ValueError if its set-up is another than byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if (model["type"], pre["type"], pre["add_prefix_space"], pre["use_regex"], spec["normalizer"], bool(model.get("ignore_merges"))) != ("BPE", "ByteLevel", False, True, None, False):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids: dict[str, int] = model["vocab"]
        symbols = byte_symbols()
        self.byte_ids = [0] * 256
        for ch, b in symbols.items():
            self.byte_ids[b] = self.ids[ch]
        self._merges = model["merges"]
        self._split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    @functools.cached_property
    def merges(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(left, right) -> (rank, merged)"""
        out = {}
        for rank, merge in enumerate(self._merges):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            out[self.ids[left], self.ids[right]] = rank, self.ids[left + right]
        self._merges = []
        return out

    def ranks(self) -> dict[bytes, int]:
        """The ids of all byte strings."""
        symbols = byte_symbols()
        return {bytes(symbols[ch] for ch in s): i for s, i in self.ids.items() if s not in self.special}

    def parts(self, text: str) -> list[str]:
        """The text cut before and after each special string."""
        if not self.special:
            return [text]
        return [p for p in re.split("(" + self._split.pattern + ")", text) if p]

    def plain_parts(self, text: str) -> tuple[list[str], int]:
        """The text between special strings, and how many of these there are."""
        if self._split is None or not self._split.search(text):
            return [text], 0
        parts = self._split.split(text)
        return parts, len(parts) - 1


_BREAK = re.compile(r"(?<=\S)(?=\s)")


def segments(text: str, size: int = SEGMENT_CHARS) -> Iterator[str]:
    """Cuts that change no token: before white space that follows something else."""
    at = 0
    while len(text) - at > size:
        m = _BREAK.search(text, at + size)
        if m is None:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:] if at else text


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """The file's vocabulary in tiktoken, whose ids are the same (tests compare them) at several times the speed."""
    import tiktoken

    v = vocabulary(path)
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=v.ranks(), special_tokens=v.special)
