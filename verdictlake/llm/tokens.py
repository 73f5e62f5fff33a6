"""Token ids of the public byte-level vocabulary, by the ``tokenizers`` library.

Text is cut at single blanks, where the library's own pre-tokeniser must cut too; each
distinct piece is encoded once and remembered, so that frequent words cost a dictionary
lookup. Texts with other white space around blanks, with characters whose class differs between
regular-expression engines, or with the vocabulary's special string are encoded whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from .textops import KEPT

VOCABULARY = "byte_bpe_50k.json"
#: Words remembered per worker, and the bytes that they may take with their ids, about; the rest is encoded anew each time, which bounds the memory.
REMEMBERED, REMEMBERED_BYTES = 1_000_000, 256 << 20
#: Bytes of a remembered word beside its own and its ids'.
_ENTRY = 180
#: Where a cut at each blank would differ from the library's: blanks beside other white space.
_WHOLE = re.compile("  |[\n\t\r\x0b\x0c] | [\n\t\r\x0b\x0c]|[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]|<\\|endoftext\\|>")
#: Punctuation that may be cut off a word's end. Not the apostrophe, which begins contractions.
_SUFFIX = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_WHOLE_ASCII = ("  ", "\n ", " \n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "<|endoftext|>")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of a vocabulary file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _uneven(text: str) -> bool:
    """Whether a cut at each blank would differ from the library's; plain searches settle it for Latin-1 texts."""
    if any(x in text for x in _WHOLE_ASCII):
        return True
    if text.isascii():
        return False
    if "\x85" in text or "\xa0" in text:
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(_WHOLE.search(text))
    return False


class _Known(dict):
    """Words to the ids of a blank and the word; a word that is not known is noted and stands for itself."""

    def __init__(self):
        self.new: dict[str, bytes] = {}

    def __missing__(self, word: str) -> str:
        self.new[word] = b""
        return word


class Encoder:
    """Encodes texts to arrays of little-endian 16-bit (or, for larger vocabularies, 32-bit) ids.

    ``path`` is a file of the ``tokenizers`` library with a byte-level pre-tokeniser;
    by default the public 50k vocabulary.
    """

    def __init__(self, path: str | None = None, remembered: int = REMEMBERED, remembered_bytes: int = REMEMBERED_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 1 << 16 else "<u4")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # byte-level: one character of a token stands for one byte
            self.widths[i] = len(token)
        self.remembered, self.room = remembered, remembered_bytes
        self.tokenizer.model._resize_cache(0)  # every piece is asked for once
        self.known = _Known()
        self.tails: dict[str, bytes] = {}

    def _learn(self) -> None:
        """Encodes the words that were noted.

        Where a letter meets ASCII punctuation that ends the word, the pre-tokeniser cuts too: only what stands before it is encoded.
        """
        known, new = self.known, self.known.new
        split, plain = [], {}
        for word in new:
            stem = word.rstrip(_SUFFIX)
            if len(stem) < len(word) and stem and stem[-1] < "\u0250" and stem[-1].isalpha():
                split.append((word, stem))
                if stem not in known and stem not in new:
                    plain[stem] = b""
            else:
                plain[word] = b""
        words = list(plain)
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            # Words that begin with their own blank cannot touch each other: one call takes them all,
            # and the bytes that each id stands for tell where a word ends.
            ids = np.array(self._whole("".join([" " + w for w in part])), self.dtype)
            ends = np.cumsum(self.widths[ids])
            stops = np.cumsum([len(w.encode()) + 1 for w in part])
            cuts = np.searchsorted(ends, stops)
            if ends[-1] == stops[-1] and (ends[cuts] == stops).all():
                raw, size, low = ids.tobytes(), self.dtype.itemsize, 0
                for word, high in zip(part, ((cuts + 1) * size).tolist(), strict=True):
                    plain[word] = raw[low:high]
                    low = high
            else:
                for word, coded in zip(part, self.tokenizer.encode_batch_fast([" " + w for w in part], add_special_tokens=False), strict=True):
                    plain[word] = np.array(coded.ids, self.dtype).tobytes()
        new.update(plain)
        for word, stem in split:
            tail = word[len(stem) :]
            if tail not in self.tails:
                if len(self.tails) > 50_000:
                    self.tails.clear()
                self.tails[tail] = np.array(self._whole(tail), self.dtype).tobytes()
            new[word] = (new[stem] if stem in new else known[stem]) + self.tails[tail]
        if len(known) < self.remembered and self.room > 0:
            size = sum(map(len, new)) + sum(map(len, new.values())) + _ENTRY * len(new)
            if size <= self.room:
                self.room -= size
                known.update(new)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text, without special tokens."""
        get, new, rows = self.known.__getitem__, self.known.new, []
        new.clear()
        for text in texts:
            if _uneven(text):
                rows.append(text)
            else:
                words = text.split(" ")
                rows.append((words[0], list(map(get, words[1:]))))
        if new:
            self._learn()
        out = []
        for row in rows:
            if isinstance(row, str):
                ids = np.array(self._whole(row), self.dtype)
            else:
                first, parts = row
                head = np.array(self._whole(first), self.dtype).tobytes()
                ids = np.frombuffer(head + b"".join([p if type(p) is bytes else new[p] for p in parts]), self.dtype)
            out.append(ids)
        return out


@lru_cache(maxsize=2)
def encoder(path: str | None = None, remembered_bytes: int = REMEMBERED_BYTES) -> Encoder:
    """The worker process's encoder: tasks that run in it later find the vocabulary loaded and its words known."""
    return Encoder(path, remembered_bytes=remembered_bytes)


KEPT["encoder"] = encoder.cache_clear
