"""Token ids of whole texts by the tokenizers library, word by word where that gives the same ids.

Most words of a corpus repeat, and a vocabulary whose pre-tokenizer never joins text across a blank gives a
word the same ids wherever it stands. Nor does it join letters with the mark that ends a word, so a new word is
looked up without it, and letters alone are one piece, which the library's model cuts without the steps around
it. Each worker keeps the ids of up to ``KNOWN`` words and ``STEMS`` words without their mark; texts whose white
space does not allow it, and vocabularies of other kinds, are encoded whole.
"""

from __future__ import annotations

import json
import os
import sys
from array import array
from collections.abc import Callable
from unicodedata import is_normalized

from rillflow.llm.common import slices

KNOWN, STEMS = 400_000, 400_000
MARKS = frozenset(",.;:!?")
#: Characters of text that are split into words at once.
AT_ONCE = 1 << 20
# The two pre-tokenizers that are known not to join text across a blank.
_LED_BY_SPACE = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_FREE_OF_SPACE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file; what it knows stays for later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others
    from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Known(dict):
    """Ids by word; an unknown word is made and kept while there is room."""

    def __init__(self, make: Callable[[str], bytes | None], most: int) -> None:
        self.make, self.most = make, most

    def __missing__(self, word: str) -> bytes | None:
        ids = self.make(word)
        if len(self) < self.most:
            self[word] = ids
        return ids


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder != "little":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, normalizer = spec["pre_tokenizer"] or {}, spec["normalizer"]
        steps = pre.get("pretokenizers", [{}])
        self.led = pre == _LED_BY_SPACE and normalizer is None
        self.free = steps[0].get("pattern") == {"Regex": _FREE_OF_SPACE} and steps[0].get("invert") is True and steps[0].get("behavior") == "Removed"
        self.cut = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.marks = dict(zip(sorted(MARKS), self._whole(sorted(MARKS))))
        #: Ids of words without their mark, at the start of a line or anywhere, and after a blank; of words as they stand.
        bare, after = (_Known(lambda w, p=prefix: self._piece(p, w), STEMS) for prefix in ("", " "))
        self.bare = _Known(lambda w: self._word("", w, bare), KNOWN)
        self.after = _Known(lambda w: self._word(" ", w, after), KNOWN)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [_packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, prefix: str, word: str) -> bytes:
        """A word of letters alone is one piece for the model; lower case and normal form are made before."""
        if not word.isalpha() or not (word.isascii() or is_normalized("NFC", word)) or (self.free and word != word.lower()):
            return self._whole([prefix + word])[0]
        if not word.isascii() or prefix:
            word = (prefix + word).encode().decode("latin-1").translate(self.letters)
        return _packed([t.id for t in self.cut(word)])

    def _ends_in_letter(self, stem: str) -> bool:
        """Whether the vocabulary sees letters and digits only, in lower case and normal form too, and so parts them from a mark."""
        return stem.isalnum() and (stem.isascii() or not self.free or (is_normalized("NFC", stem) and stem.lower().isalnum()))

    def _word(self, prefix: str, word: str, stems: _Known) -> bytes | None:
        """A word as it stands; None if white space inside it may join its neighbours."""
        if self.led and word.split() != [word]:
            return None
        mark = b""
        if word[-1:] in MARKS and self._ends_in_letter(word[:-1]):
            word, mark = word[:-1], self.marks[word[-1]]
        if self.free and (word.isascii() or ("Σ" not in word and is_normalized("NFC", word))):
            word = word.lower()
        return stems[word] + mark

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.free:
            known = self.bare.__getitem__
            return [b"".join(map(known, t.replace("\n", " ").split(" "))) for t in texts]
        if not self.led:
            return self._whole(texts)
        out: list[bytes] = []
        for a, b in slices([len(t) for t in texts], AT_ONCE):
            some = [self._after_blanks(t) for t in texts[a:b]]
            whole = [i for i, x in enumerate(some) if x is None]
            for i, x in zip(whole, self._whole([texts[a + i] for i in whole])):
                some[i] = x
            out += some
        return out

    def _after_blanks(self, text: str) -> bytes | None:
        """The ids of a text whose words are parted by single blanks and line ends; None for others."""
        if not text or "  " in text or "\n " in text or " \n" in text or "\n\n" in text or text[0].isspace() or text[-1].isspace():
            return b"" if not text else None
        bare, after = self.bare, self.after.__getitem__
        lines = (line.split(" ") for line in text.split("\n"))
        try:
            return self.end_of_line.join(b"".join([bare[x[0]], *map(after, x[1:])]) for x in lines)
        except TypeError:  # a word with white space of another kind inside
            return None

    @property
    def end_of_line(self) -> bytes:
        if not hasattr(self, "_end"):
            self._end = self._whole(["\n"])[0]
        return self._end
