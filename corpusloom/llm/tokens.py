"""Token ids of whole texts by a byte-level BPE file of the tokenizers library.

Byte-level BPE works piece by piece: the text is cut by a pattern and each
piece is merged on its own. So each distinct piece is given to the library's
model once and remembered; a text's ids are those of its pieces in order. Texts with
characters outside the range where both regular-expression engines provably
cut alike, and texts that hold one of the file's added tokens, go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

DEFAULT_FILE = "byte_bpe_50k.json"
#: Distinct pieces in one generation of what a worker remembers.
REMEMBER = 250_000

#: Tab, line ends, ASCII, and Latin letters: texts of these alone are cut here. The classes are those of the library's pattern within them.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\u024f]*")
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_BLANK = " \t\n\r"
#: Fixed value: the pattern by which byte-level BPE of this kind cuts texts.
PIECES = re.compile(f" ?[{_LETTER}]+| ?[{_NUMBER}]+|'(?:[stmd]|re|ve|ll)| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: itself if printable, else from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = _byte_letters()


@cache
def encoder(path: str) -> Encoder:
    """One a worker process and file."""
    return Encoder(path)


class Encoder(dict):
    """Maps a piece to its ids, as little-endian unsigned 32-bit bytes.

    Pieces are remembered in two generations: when the young one is full it
    becomes the old one, from which pieces that occur again come back.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.old: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(map(re.escape, added)) if added else "(?!)").search
        self.merge = self.tokenizer.model.tokenize

    def __missing__(self, piece: str) -> bytes:
        known = self.old.get(piece)
        if known is None:
            known = array("I", [t.id for t in self.merge(piece.encode().decode("latin-1").translate(LETTERS))]).tobytes()
        self[piece] = known
        return known

    def ids(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit bytes."""
        if not PLAIN.fullmatch(text) or self.added(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) > REMEMBER:
            self.old = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, PIECES.findall(text)))


def vocabulary(path: str) -> int:
    """One more than the file's largest id, added tokens included."""
    return 1 + max(encoder(path).tokenizer.get_vocab(with_added_tokens=True).values())


def encoded(texts: list[str], path: str) -> Iterator[tuple[int, bytes]]:
    """(position, ids) of each text, in order; a text that is the same as the one before isn't worked off again."""
    e, last, ids = encoder(path), None, b""
    for i, t in enumerate(texts):
        if t != last:
            last, ids = t, e.ids(t)
        yield i, ids
