"""The vocabulary of a word-level BPE file, and the steps from text to pre-tokens.

The file is that of the `tokenizers` library: NFC, white space to one blank, lower case; pieces by
a pattern; bytes as printable letters; merges with a mark at each word's end. A text is first cut
at ASCII white space, which no later step can see across, so that every piece of text between
blanks ("chunk") has ids of its own and can be looked up in a bounded cache.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import regex

from ridgeline.llm.common import kept

#: The default vocabulary file, a name for public_tokenizers.path().
WORD_BPE = "word_bpe_49k.json"
#: White space as the file's own patterns see it (Unicode's property White_Space).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: ASCII characters that are neither space, letters nor digits, and begin no piece with what is before.
MARKS = frozenset(bytes([b]) for b in b"!#$%&()*+,-./:;<=>?@[]^_`{|}~\\\"")
#: The same for texts in UTF-8 whose only characters beyond ASCII are the letters from U+00C0 to U+017F, lower-cased;
#: and what such texts don't hold (a capital I with a dot becomes two characters).
LATIN = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|(?:[a-z]+|[\xc3-\xc5][\x80-\xbf])+|[0-9]|[^\t-\r a-z0-9\x80-\xff]+")
BEYOND = re.compile(rb"[\xc2\xc6-\xff]|\xc3[\x97\xb7]|\xc4\xb0")
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_BPE)


def byte_letters() -> list[str]:
    """The printable letter for each byte: itself where it is visible in Latin-1, otherwise the next
    free code point from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*ids.values(), *self.special.values()])
        self.strings = [""] * self.size
        for table in (ids, self.special):
            for text, i in table.items():
                self.strings[i] = text
        if self.size > 1 << 16:
            raise ValueError("pairs of ids are held as two halves of 32 bits: at most 65,536 ids")
        if any(not c or any(x.isspace() for x in c) for c in self.special):
            raise ValueError("texts are cut at white space: special tokens must have none inside")
        #: What every special token begins with; and whether none can stand in a word with one mark after it.
        self.opening = os.path.commonprefix(list(self.special))
        self.simple = all(sum(not x.isalpha() for x in c) > 1 for c in self.special)
        opening = [self.opening] if self.opening else list(self.special)
        self.marked = re.compile(b"|".join([re.escape(c.encode()) for c in opening]) or rb"(?!)")
        letters = byte_letters()
        #: Ids of each byte inside a word and at its end.
        self.inner = [ids[c] for c in letters]
        self.final = [ids[c + end] for c in letters]
        #: (left id * 2**16 + right id) to (rank, id of both together).
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            self.merges[ids[a] << 16 | ids[b]] = (rank, ids[a + b])
        self.splits = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None

    def ending(self) -> np.ndarray:
        """For each id whether it ends a word: a byte at a word's end, or what a merge made with such a one."""
        out = np.zeros(self.size, dtype=bool)
        out[self.final] = True
        for pair, (_, both) in self.merges.items():
            out[both] |= out[pair & 0xFFFF]
        return out

    def tokens(self, text: bytes) -> list[bytes] | None:
        """A whole text's pre-tokens at once, or None if it has characters or special tokens that need more."""
        if self.marked.search(text):
            return None
        if text.isascii():
            return LATIN.findall(text.lower())
        return None if BEYOND.search(text) else LATIN.findall(text.decode().lower().encode())

    def pieces(self, chunk: bytes) -> list[bytes | int]:
        """A chunk's pre-tokens, as bytes, and its special tokens, as ids, in order."""
        # Most chunks are one word, or a word with a mark after it; others go through the pattern.
        if self.simple and chunk.isalpha():
            return [chunk.lower()]
        if chunk.isascii():
            if self.simple and chunk[:-1].isalpha() and chunk[-1:] in MARKS:
                return [chunk[:-1].lower(), chunk[-1:]]
            text = chunk.decode("ascii")
            if not self.special or self.opening and self.opening not in text:
                return [p.encode() for p in PIECES.findall(text.lower())]
        else:
            text = chunk.decode("utf-8", "surrogatepass")
            word = unicodedata.normalize("NFC", text).lower()
            if self.simple and word.isalpha() and "Σ" not in text:
                return [word.encode()]
        out: list[bytes | int] = []
        at = 0
        for m in self.splits.finditer(text) if self.splits else ():
            out += plain(text[at : m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + plain(text[at:])

    @property
    def sorted_merges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pair keys in order, with their ranks and results."""
        if not hasattr(self, "_sorted"):
            keys = np.fromiter(self.merges, dtype=np.int64, count=len(self.merges))
            order = np.argsort(keys)
            both = np.array(list(self.merges.values()), dtype=np.int64).reshape(-1, 2)[order]
            self._sorted = keys[order], both[:, 0].copy(), both[:, 1].copy()
        return self._sorted


def plain(text: str) -> list[bytes]:
    text = unicodedata.normalize("NFC", text)
    # Letter by letter: a sigma at a word's end becomes the same small letter as elsewhere.
    text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
    return [p.encode("utf-8", "surrogatepass") for p in PIECES.findall(text)]


@kept
def load(path: str) -> Vocabulary:
    return Vocabulary(path)
