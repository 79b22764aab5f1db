"""Encoding whole texts piece by piece through a bounded memo.

A text is cut only where the tokenizer itself must cut, so the joined ids of the pieces are the ids of the whole
text. Words repeat, so most pieces come from the memo; what a batch of texts misses is split into words, and the
words that are missing too are encoded together. Pieces and words each have a memo in two generations.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable

#: Bytes that a worker remembers at most, of pieces and of the words that they are made of.
MEMO_BYTES = 320 << 20

#: What an entry takes besides its characters and ids: two objects and a place in a table.
_ENTRY = 180

#: Pieces with characters from here on take the library's whole chain, lest Unicode versions differ; those below are all composed.
PLAIN_BELOW = "\u0130"

# Between a non-blank and one space before a non-blank, every byte-level pre-tokenizer starts a new match.
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= \S)")


def cut_at_blanks(text: str) -> list[str]:
    """Pieces for tokenizers that drop white space: words between spaces and line feeds."""
    return text.replace("\n", " ").split(" ")


def cut_byte_level(text: str) -> list[str]:
    """Pieces for byte-level tokenizers, which keep white space: a space goes with the word after it.

    A line feed alone between two words is a piece of its own. Pieces of a text with other white space come out
    such that ``is_loose`` holds for one of them.
    """
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if "\0" not in text else [""]


def is_loose(piece: str) -> bool:
    """Whether white space other than one leading space stands at an end of the piece, or it is empty: not a sure cut."""
    body = piece[1:] if piece[:1] == " " else piece
    return piece != "\n" and (not body or body[0].isspace() or body[-1].isspace())


def cut_loose(text: str) -> list[str]:
    """Surely right pieces of any text: cut only before a single space between two words."""
    return _BEFORE_SPACE.split(text)


_MARKS = frozenset(".,;:!?")


def plain_words(piece: str) -> list[str] | None:
    """The words of a piece of common letters with at most one space before and one mark after them, else None.

    Every split pattern in use takes the letters, with the space where it keeps spaces, as one match and the mark as another.
    """
    body = piece[1:] if piece[:1] == " " else piece
    if not piece.isascii() and max(piece) >= PLAIN_BELOW:
        return None
    if body.isalpha():
        return [piece]
    return [piece[:-1], piece[-1]] if piece[-1:] in _MARKS and body[:-1].isalpha() else None


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes()


#: Stands for the ids of a piece that has none of its own.
LOOSE = False


class Kept:
    """A memo in two generations: when the young one holds half of ``most`` bytes, it becomes the older one, which is forgotten.

    What is met in the older generation moves into the young one, so frequent keys stay.
    """

    def __init__(self, most: int):
        self.most, self.young, self.older, self.held = most, {}, {}, 0

    def turn(self) -> None:
        if 2 * self.held > self.most:
            self.older, self.young, self.held = self.young, {}, 0

    def put(self, keys: list[str], values: list[bytes]) -> None:
        self.young.update(zip(keys, values, strict=True))
        self.held += _ENTRY * len(keys) + sum(map(len, keys)) + sum(map(len, values))

    def missing(self, keys: set[str]) -> list[str]:
        """The keys that neither generation holds; the others are in the young one afterwards."""
        new = keys.difference(self.young)
        old = list(new.intersection(self.older))
        self.put(old, list(map(self.older.__getitem__, old)))
        return list(new.difference(old))


class Memo:
    """Ids of texts as little-endian unsigned 32-bit integers, put together from remembered pieces.

    ``cut`` gives the pieces of a text, ``split`` the words of a piece, ``learn`` the ids of words that were not met
    before, all of a batch at once; a piece of letters, or of letters with a space before them, is a word.
    Where ``loose`` holds for a piece, its text is cut by ``cut_loose`` instead.
    ``control`` maps strings that stand for one id wherever they occur to that id; the texts between them are
    encoded on their own, as the library does.
    """

    def __init__(self, cut: Callable[[str], list[str]], split: Callable[[str], list[str]], learn: Callable[[list[str]], list[bytes]],
                 loose: Callable[[str], bool] | None = None, control: dict[str, int] | None = None):
        self.cut, self.split, self.learn, self.loose = cut, split, learn, loose
        self.control = {k: packed([i]) for k, i in (control or {}).items()}
        self.between = re.compile("(" + "|".join(map(re.escape, sorted(self.control, key=len, reverse=True))) + ")") if control else None
        self.kept = Kept(MEMO_BYTES)

    def _learnt(self, pieces: list[str]) -> None:
        """Remember the ids of pieces that are not loose."""
        whole, made, words, split = [], [], [], self.split
        for p in pieces:
            ws = split(p)
            if len(ws) == 1 and ws[0] == p:
                whole.append(p)
            else:
                made.append(p)
                words.append(ws)
        every = set(whole).union(*words)
        blank = [w for w in every if not w[-1:].isalnum() and self.loose and self.loose(w)]  # not kept: as pieces they have no ids
        new = self.kept.missing(every.difference(blank))
        self.kept.put(new, self.learn(new))
        young, own = self.kept.young, dict(zip(blank, self.learn(blank), strict=True))
        get = (lambda w: own[w] if w in own else young[w]) if own else young.__getitem__
        self.kept.put(made, [b"".join(map(get, ws)) for ws in words])

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without control strings."""
        cuts, young = [self.cut(t) for t in texts], self.kept.young
        found = [list(map(young.get, c)) for c in cuts]
        gaps = []
        for i, f in enumerate(found):
            at = -1
            while True:
                try:
                    at = f.index(None, at + 1)
                except ValueError:
                    break
                gaps.append((i, at))
        new = self.kept.missing({cuts[i][at] for i, at in gaps})
        if self.loose:
            bad = set(filter(self.loose, new))
            young.update(dict.fromkeys(bad, LOOSE))
            new = [p for p in new if p not in bad]
        self._learnt(new)
        for i, at in gaps:
            found[i][at] = young[cuts[i][at]]
        out = []
        for t, f in zip(texts, found, strict=True):
            try:
                out.append(b"".join(f))
            except TypeError:  # a loose piece has no ids of its own
                out.append(self._loosely(t))
        return out

    def _loosely(self, text: str) -> bytes:
        words = [self.split(p) for p in cut_loose(text) if p]
        new = list(set().union(*words))
        return b"".join(map(dict(zip(new, self.learn(new), strict=True)).__getitem__, [w for ws in words for w in ws]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        self.kept.turn()
        if not self.between or not any(k in t for k in self.control for t in texts):
            return self._plain(texts)
        parts = [self.between.split(t) for t in texts]  # every second part is a control string
        flat = iter(self._plain([p for ps in parts for p in ps[::2]]))
        return [b"".join([self.control[p] if i % 2 else next(flat) for i, p in enumerate(ps)]) for ps in parts]

    def ids(self, text: str) -> bytes:
        """The ids of one text."""
        return self.encode([text])[0]


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies, by rule: shown as it is, or from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


SPACE = _byte_letters()[0x20]


class _Library:
    """Words and their ids by the tokenizers library.

    Pieces of common letters are normalised and split here and go straight to the library's merge model, each
    distinct word once; others are left whole and take the library's whole chain.
    """

    def __init__(self, path: str, pattern: str, lower: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.lower = self.whole.model, lower
        self.found, self.letters = regex.compile(pattern).findall, _byte_letters()
        self.control = {t.content: i for i, t in self.whole.get_added_tokens_decoder().items()}

    def plain(self, piece: str) -> bool:
        return piece.isascii() or max(piece) < PLAIN_BELOW

    def split(self, piece: str) -> list[str]:
        if not self.plain(piece):
            return [piece]
        if self.lower:
            piece = piece.lower()
        return plain_words(piece) or self.found(piece)

    def learn(self, words: list[str]) -> list[bytes]:
        tokens, letters, out = self.model.tokenize, self.letters, []
        for w in words:
            if w.isascii() and w[1:].isalnum():  # such letters stand for themselves
                out.append(packed([t.id for t in tokens(SPACE + w[1:] if w[0] == " " else w)]))
            elif self.plain(w):
                out.append(packed([t.id for t in tokens(w.encode().decode("latin-1").translate(letters))]))
            else:
                out.append(packed(self.whole.encode(w, add_special_tokens=False).ids))
        return out


#: The split patterns of the two vocabularies.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""

_MADE: dict[tuple[str, str], Memo] = {}


def library_memo(path: str, kind: str) -> Memo:
    """This worker's memo over the tokenizers library, as its ``encode`` without adding special tokens; ``kind`` is ``byte`` or ``word``."""
    if (path, kind) not in _MADE:
        byte = kind == "byte"
        library = _Library(path, BYTE_PATTERN if byte else WORD_PATTERN, lower=not byte)
        _MADE[path, kind] = Memo(cut_byte_level if byte else cut_at_blanks, library.split, library.learn, is_loose if byte else None, library.control)
    return _MADE[path, kind]


def slices(column, rows: int = 128) -> Iterable[list[str]]:
    """A text column of an Arrow batch, a few texts at a time; null counts as empty."""
    for i in range(0, len(column), rows):
        yield [t or "" for t in column[i : i + rows].to_pylist()]
