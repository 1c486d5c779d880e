"""Token ids of texts, by a word cache in front of the tokenizers library.

A byte-level BPE with the usual pre-tokeniser pattern treats ``" word"`` on its own wherever a
single space stands between two characters that are not white space. So a text is cut there, and
each distinct piece is encoded once per worker, by the library's own model; the ids are those of
the whole text. Texts that cannot be cut so are cut at fewer places, and texts that hold an added token's string, such as
``<|endoftext|>``, are not cut: the library's default call makes one id of it.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: Python's \\S is a subset of the pattern's, so a cut here is always a boundary of pre-tokens.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: The pre-tokeniser pattern of byte-level BPE (a fixed value).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_coders: dict[str, Coder] = {}


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE shows printable bytes as themselves and the others as letters from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Coder(dict):
    """piece -> its ids as little-endian 16-bit (vocabularies to 65,536 ids) or 32-bit integers.

    None marks a piece with white space at an end or nothing in it: its text is cut more carefully.
    The cache takes up to ``most`` pieces, the first and so the common ones; that bounds memory and
    changes no result.
    """

    def __init__(self, path: str, most: int = 1_400_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        #: Texts that hold one of these go to the library as they are, as it cuts them out first.
        self.added = [t.content for t in added]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.most = most
        self.inner: dict[str, bytes] = {}
        shape = json.loads(self.tokenizer.to_str())
        before = shape.get("pre_tokenizer") or {}
        self.direct = shape.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        #: A normaliser may make an added token of other text.
        self.always_whole = shape.get("normalizer") is not None and any(t.normalized for t in added)
        self.find = regex.compile(_PATTERN).findall
        self.letters = _byte_letters()
        self.space = self.letters[ord(" ")]
        self.tokenize = self.tokenizer.model.tokenize
        self.marks = {m: self._part(m) for m in ".,;:!?)" if self.direct}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _part(self, shown: str) -> bytes:
        """The ids of one pre-token, shown in the letters of byte-level BPE."""
        return array(self.code, [t.id for t in self.tokenize(shown)]).tobytes()

    def piece(self, text: str) -> bytes:
        """The ids of a short text."""
        if not self.direct:
            return self.whole(text)
        out = []
        for part in self.find(text):
            # " word" is kept as the piece "word", which other texts cut out as it is.
            cache, key = (self, part[1:]) if part[0] == " " and len(part) > 1 and not part[1].isspace() else (self.inner, part)
            ids = cache.get(key)
            if ids is None:
                ids = self._part(part.encode("utf-8").decode("latin-1").translate(self.letters))
                if len(cache) < self.most:
                    cache[key] = ids
            out.append(ids)
        return out[0] if len(out) == 1 else b"".join(out)

    def __missing__(self, p: str) -> bytes | None:
        if self.direct and p.isalpha():  # letters only: " word" is one pre-token
            ids = self._part(self.space + (p if p.isascii() else p.encode("utf-8").decode("latin-1").translate(self.letters)))
        elif p and self.direct and p[-1] in self.marks and p[:-1].isalpha():  # a word and one mark: two pre-tokens
            ids = self[p[:-1]] + self.marks[p[-1]]
        else:
            ids = None if not p or p[0].isspace() or p[-1].isspace() else self.piece(" " + p)
        if len(self) < self.most:
            self[p] = ids
        return ids

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        get, out = self.__getitem__, []
        for t in texts:
            if t and (self.always_whole or any(map(t.__contains__, self.added))):
                out.append(self.whole(t))
                continue
            first, *rest = (t or "").split(" ")
            try:
                if rest and (not first or first[-1].isspace()):
                    raise TypeError
                out.append((self.piece(first) if len(first) < 1000 else self.whole(first)) + b"".join(map(get, rest)))
            except TypeError:  # two neighbours are white space: cut elsewhere only
                first, *rest = _CUT.split(t)
                out.append(self.whole(first) + b"".join(self.whole(" " + x) for x in rest))
        return out


def coder(path: str) -> Coder:
    """One per Python worker and vocabulary file."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def batches(rows, most: int = 4_000_000):
    """Lists of (key, text) of about ``most`` characters from an iterator of such pairs."""
    held, size = [], 0
    for key, text in rows:
        held.append((key, text))
        size += len(text or "")
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
