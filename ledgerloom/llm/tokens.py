"""Exact byte-level BPE through the ``tokenizers`` library, with a bounded cache of pre-token ids.

Byte-level BPE never merges across pre-tokens, so the ids of a text are the ids of its pre-tokens one after
the other.  Each distinct pre-token is encoded once per worker by the library and looked up afterwards.  Texts
with characters on which regex engines might disagree, or with an added token's string, go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

VOCAB_FILE = "byte_bpe_50k.json"
#: Pre-tokens kept in each of the cache's two generations, per Python worker.
CACHE_ENTRIES = 450_000
#: Letters among the plain characters below.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
#: The pre-token pattern of the vocabulary for plain texts; alternatives that start differently may change places.
PRE_TOKEN = re.compile(rf" ?[{_LETTER}]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s0-9{_LETTER}]+|\s+(?!\S)|\s+")
#: Characters whose classes are the same in every regex engine: ASCII, Latin letters and common punctuation.
PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\xa0-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-ɏ–—‘-”…]*")


def vocab_path(name: str = VOCAB_FILE) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class _Cache(dict):
    """Ids by pre-token; what is missing comes from the generation before, or else from the library."""

    def __init__(self, encoder: PreTokenEncoder, before: dict[str, bytes]):
        self.pre_token, self.before = encoder.pre_token, before

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.before.get(word) or self.pre_token(word)
        return found


class _Counts(_Cache):
    """Numbers of ids by pre-token."""

    def __missing__(self, word: str) -> int:
        found = self[word] = self.before.get(word) or len(self.pre_token(word)) // self.itemsize
        return found

    def __init__(self, encoder: PreTokenEncoder, before: dict[str, int]):
        super().__init__(encoder, before)
        self.itemsize = encoder.dtype.itemsize


class PreTokenEncoder:
    """Encodes texts to little-endian id bytes; equal to the library's ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.typecode = "H" if self.dtype.itemsize == 2 else "I"
        self.cache_entries, self.cache = cache_entries, _Cache(self, {})
        self.counts = _Counts(self, {})
        self.tokenize = self.library.model.tokenize
        self.printable = {byte: char for char, byte in printable_bytes().items()}
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.pieces = piece_bytes(self.library)
        self.lengths = np.array([len(x) for x in self.pieces], dtype=np.int64)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def is_plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not any(s in text for s in self.specials)

    def encode(self, text: str) -> bytes:
        if not self.is_plain(text):
            return self.whole(text)
        cache = self.cache
        if len(cache) >= self.cache_entries:
            cache.before = {}
            cache = self.cache = _Cache(self, cache)
        return b"".join(map(cache.__getitem__, PRE_TOKEN.findall(text)))

    def count(self, text: str) -> int:
        """Number of ids of a text; the cache holds numbers, which need less memory than ids."""
        if not self.is_plain(text):
            return len(self.whole(text)) // self.dtype.itemsize
        counts = self.counts
        if len(counts) >= self.cache_entries:
            counts.before = {}
            counts = self.counts = _Counts(self, counts)
        return sum(map(counts.__getitem__, PRE_TOKEN.findall(text)))

    def pre_token(self, word: str) -> bytes:
        """Ids of one pre-token: the library's BPE model takes its bytes as printable characters."""
        if word.isascii() and word[1:].isalpha() and word[0] == " ":  # most of them
            shown = self.printable[32] + word[1:]
        else:
            shown = word.encode("utf-8").decode("latin-1").translate(self.printable)
        found = self.tokenize(shown)
        return array(self.typecode, [t.id for t in found]).tobytes()

    def ids(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, dtype=self.dtype)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """As the library's ``decode(ids, skip_special_tokens=False)`` for a byte-level vocabulary."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


def printable_bytes() -> dict[str, int]:
    """The byte that each printable character of a byte-level vocabulary stands for."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + n): b for n, b in enumerate(rest)}


def piece_bytes(library) -> list[bytes]:
    """The bytes of each id."""
    byte_of = printable_bytes()
    added = library.get_added_tokens_decoder()
    pieces = [b""] * library.get_vocab_size(with_added_tokens=True)
    for token, at in library.get_vocab(with_added_tokens=True).items():
        pieces[at] = token.encode() if at in added else bytes(byte_of[c] for c in token)
    return pieces


@lru_cache(maxsize=2)
def encoder(path: str) -> PreTokenEncoder:
    """One encoder per Python worker and vocabulary; its cache lives across batches and tasks."""
    return PreTokenEncoder(path)


def content_cuts(values: np.ndarray, mask_bits: int, least: int, most: int) -> list[int]:
    """Ends of content-defined chunks of ``values`` (bytes or ids), the last of them ``len(values)``.

    A rolling polynomial hash over the last eight bytes or four ids marks a cut where its top ``mask_bits`` bits are zero,
    so equal passages are cut at equal places; cuts closer than ``least`` are skipped and none is later than ``most``.
    """
    n = len(values)
    if n <= least:
        return [n] if n else []
    if values.dtype.itemsize == 1:  # eight bytes are one machine word
        padded = np.ascontiguousarray(values)
        if n < 8:
            return [n]
        words = np.empty(n - 7, dtype=np.uint64)
        for phase in range(8):
            usable = (n - phase) // 8
            if usable:
                words[phase::8] = np.frombuffer(padded[phase : phase + usable * 8].tobytes(), dtype="<u8")
        words *= np.uint64(0x9E3779B97F4A7C15)
        places = np.flatnonzero(words < np.uint64(1 << (64 - mask_bits))) + 8
    else:
        wide = values.astype(np.uint32)
        rolling = wide[3:] + wide[2:-1] * np.uint32(0x01000193) + wide[1:-2] * np.uint32(0x85EBCA6B) + wide[:-3] * np.uint32(0xC2B2AE35)
        rolling *= np.uint32(0x9E3779B1)
        places = np.flatnonzero(rolling < np.uint32(1 << (32 - mask_bits))) + 4
    cuts, last = [], 0
    for place in places.tolist():
        while place - last > most:
            last += most
            cuts.append(last)
        if place - last >= least and place < n:
            cuts.append(place)
            last = place
    while n - last > most:
        last += most
        cuts.append(last)
    return [*cuts, n]
