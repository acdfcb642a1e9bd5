"""Token ids of whole texts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import array
import functools
import os
import re

#: Words, and pieces of words, that one Python worker remembers (about 160 bytes each); a full memory is emptied.
WORDS, PIECES = 600_000, 60_000

#: Texts of these characters only are cut into pieces here: for all of them the pattern below and the library's own
#: splitter agree on what is a letter, a digit or a space. Any other text goes to the library whole.
_PLAIN = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ſЀ-ҁ‐-‧‰-⁞]")

#: Fixed value: the published split pattern of this vocabulary.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_PLAIN_BYTES = bytes([9, 10, 13, *range(32, 127)])

#: White space that joins in ways that cutting at each space and line end would not reproduce.
_JOINED = ("  ", " \n", "\n\n\n", "\n\n ", "\t", "\r")


#: Marks that are a piece of their own after letters.
_ENDS = (".", ",", ";", ":", "!", "?")


class Encoder(dict):
    """Word -> its ids as little-endian unsigned 32-bit integers, filled as words appear.

    Byte-level BPE never merges across the pieces that the split pattern cuts, so a text's ids are its pieces' ids in
    order. Where no white space but single spaces before words and line ends occurs, pieces never reach across a
    space, so a text can be cut there first: a key stands for the word with its space, or with the line end that it
    starts with. Strings of special tokens in a text are ordinary text, as the vocabulary's description advises.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.vocab_size = self.whole.get_vocab_size()
        self.split = regex.compile(_PIECES).findall
        self.pieces = Pieces(self.whole.model)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS:
            self.clear()
        if word.isalpha():
            ids = self.pieces.ids(f" {word}")
        elif word[-1:] in _ENDS and word[:-1].isalpha():
            ids = self[word[:-1]] + self.pieces[word[-1]]
        else:
            ids = self._cut(word if word[:1] == "\n" else f" {word}")
        self[word] = ids
        return ids

    def _cut(self, text: str) -> bytes:
        """Ids of the text's pieces; letters after a space are a word of their own."""
        return b"".join([self[p[1:]] if p[0] == " " and p[1:].isalpha() else self.pieces[p] for p in self.split(text)])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        # Deleting the plain bytes of an ASCII text is the quickest way to see whether it has others.
        if text.encode().translate(None, _PLAIN_BYTES) if text.isascii() else _PLAIN.search(text):
            return array.array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        if text.endswith((" ", "\n\n")) or any(x in text for x in _JOINED):
            return self._cut(text)
        words = text.replace("\n", " \n").split(" ")
        return self._cut(words[0]) + b"".join(map(self.__getitem__, words[1:]))


class Pieces(dict):
    """Piece -> its ids, by the library's model."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters = model, _byte_letters()
        self.space = chr(self.letters[0x20])

    def ids(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            shown = piece.replace(" ", self.space)
        else:
            shown = piece.encode("utf-8").decode("latin-1").translate(self.letters)
        return array.array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= PIECES:
            self.clear()
        self[piece] = ids = self.ids(piece)
        return ids


def _byte_letters() -> dict[int, int]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next one from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process, kept between tasks."""
    return Encoder(path)
