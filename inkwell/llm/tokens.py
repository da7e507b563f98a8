"""Token ids of the ``tokenizers`` library, with the merges run by ``tiktoken``.

Both byte-level vocabularies are lists of merges whose ids ascend in their order, and
that is all that ``tiktoken`` needs: it joins the pair with the lowest id first.  Its
ranks are read from the same vocabulary file.  Texts in which the two libraries could
differ (characters outside plain Latin text, strings of added tokens) go to an
unaltered ``tokenizers`` library whole.  Nothing is kept between texts.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import regex

#: Printable ASCII, line ends, and Latin letters that are already composed.
_PLAIN = re.compile("[\\n\\x20-\\x7e\\u00a1-\\u00ac\\u00ae-\\u012f\\u0132-\\u017e]*")
#: The two pre-tokenizers' patterns.
_BYTE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: The first of them where no two white space characters meet: none has to look ahead.
_SINGLE_SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
#: Stands for the end of a word in the second vocabulary; no plain text holds it.
_END, _EDGE = "\x01", "\x02"
#: Characters that are encoded at a time; a longer text is cut in front of a space.
_STRETCH = 1 << 20


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: visible Latin-1 characters stand for themselves, the
    other bytes, in order, for the characters from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _stretches(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > _STRETCH and (end := text.find(" ", at + _STRETCH)) > 0:
        yield text[at:end]
        at = end
    yield text[at:]


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder().values()
        # Strings of added tokens have one id each; the library finds them in whole texts.
        self.added = [t.content for t in added]
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix, byte_of = model["end_of_word_suffix"], {c: b for b, c in _byte_letters().items()}
        self.word_ends = suffix is not None
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{path}: ids do not ascend in the order of merges")
        ranks = {}
        for name, i in model["vocab"].items():
            word = name.removesuffix(suffix) if suffix else name
            if all(c in byte_of for c in word):
                ranks[bytes(byte_of[c] for c in word) + (_END.encode() if word != name else b"")] = i
        merges = lambda name, pattern: tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        if self.word_ends:
            self.by_words, self.end = merges("words", f"[^{_END}]+{_END}|{_END}"), ranks[_END.encode()]
            self.pieces = regex.compile(_WORD_PIECES).findall
            self.kinds: dict[str, str] = {}
        else:
            self.by_single, self.by_pieces = merges("single", _SINGLE_SPACED), merges("pieces", _BYTE_PIECES)

    def _kind(self, c: str) -> str:
        """L of a letter, N of a number, Z of white space, P of anything else."""
        if (found := self.kinds.get(c)) is None:
            kind = unicodedata.category(c)[0]
            found = self.kinds[c] = "Z" if c.isspace() else kind if kind in "LN" else "P"
        return found

    def _ended(self, text: str) -> str:
        """The text's words with an end mark after each, and perhaps more end marks."""
        if "'" in text:
            return _END.join(self.pieces(text)) + _END
        found = [(c, k) for c in set(text) if (k := self._kind(c)) != "L"]
        for c, k in found:
            if k == "P":
                text = text.replace(c, _EDGE + c + _EDGE)
        text = text.replace(_EDGE + _EDGE, "").replace(_EDGE, _END)  # signs side by side are one word
        for c, k in found:
            if k == "N":
                text = text.replace(c, _END + c + _END)
            elif k == "Z":
                text = text.replace(c, _END)
        return text.replace(_END + _END, _END) + _END

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not _PLAIN.fullmatch(text) or any(a.lower() in text.lower() for a in self.added if a[0] in text):
            return _packed(self.library.encode(text, add_special_tokens=False).ids)
        if self.word_ends:
            out = np.frombuffer(b"".join(_packed(self.by_words(self._ended(t))) for t in _stretches(text.lower())), "<u4")
            return out[out != self.end].tobytes()
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
            if re.search(r"\s{500}", text):
                return _packed(self.library.encode(text, add_special_tokens=False).ids)
            return _packed(self.by_pieces(text))
        return b"".join(_packed(self.by_single(t)) for t in _stretches(text))


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return Encoder(path)


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
