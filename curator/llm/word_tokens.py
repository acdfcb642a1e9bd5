"""Token ids of whole texts with a public BPE vocabulary of lower-cased words."""

from __future__ import annotations

import array
import functools
import os
import re

import numpy as np

from curator.llm.tokens import _byte_letters

#: Words that one Python worker remembers (about 160 bytes each); a full memory is emptied.
WORDS = 600_000

#: Texts of these characters only are cut at white space here; among them tab, line ends and the space are the only
#: white space, for the library as for `str.split`. Any other text goes to the library whole.
_OTHER = re.compile(r"[^\t\n\r -~À-ÖØ-öø-ſ‐-‧‰-⁞]")
_PLAIN_BYTES = bytes([9, 10, 13, *range(32, 127)])
_MARKS = (".", ",", ";", ":", "!", "?")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder(dict):
    """Word between white space -> its ids as little-endian unsigned 32-bit integers, filled as words appear.

    The vocabulary drops white space and never reaches across it, so the ids of a text are those of its words in
    order. Inside a word, letters and a mark after them are pieces of their own, and letters count in lower case. A word
    of plain letters goes to the library's model directly; it is composed already, and its lower case is letter by letter.
    Strings of special tokens in a text are ordinary text, as the vocabulary's description advises.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.vocab_size = self.whole.get_vocab_size()
        self.model, self.letters = self.whole.model, _byte_letters()

    def _ids(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS:
            self.clear()
        if word.isalpha() and "İ" not in word:
            low = word.lower()
            if low != word:
                ids = self[low]
            else:
                shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
                ids = array.array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()
        elif word[-1] in _MARKS and word[:-1].isalpha():
            ids = self[word[:-1]] + self[word[-1]]
        else:
            ids = self._ids(word)
        self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if text.encode().translate(None, _PLAIN_BYTES) if text.isascii() else _OTHER.search(text):
            return self._ids(text)
        return b"".join(map(self.__getitem__, text.split()))


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker process, kept between tasks."""
    return WordEncoder(path)
