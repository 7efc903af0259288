"""Token ids of whole texts: each distinct piece of a batch is encoded once by the tokenizer.

Byte-level BPE never merges across the pieces of its splitting pattern, so a text's ids are its
pieces' ids in order. Where a text has plain letters, digits, signs and single blanks, pieces begin
where the kind of byte changes, which arrays find for a whole batch; Arrow then numbers the distinct
pieces, and only those that a bounded memory lacks reach the tokenizer's model. Any other text
(other scripts, runs of blanks, apostrophes, control characters, special token strings) is encoded
whole by the tokenizer itself.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Most pieces of a half of the memory.
_MEMORY = 300_000
_SLICE_CHARS = 2_000_000
_BLANK, _LETTER, _DIGIT, _SIGN = range(4)

#: Kinds of UTF-8 bytes in plain texts, where every letter outside ASCII is Latin (U+00C0 to U+024F).
_KIND = bytearray([_SIGN] * 256)
for _bytes, _kind in ((b"\t\n\x0b\x0c\r ", _BLANK), (range(48, 58), _DIGIT), ([*range(65, 91), *range(97, 123), *range(128, 256)], _LETTER)):
    for _b in _bytes:
        _KIND[_b] = _kind
_KIND = bytes(_KIND)
_PLAIN_BYTES = bytes(b for b in [9, 10, *range(32, 127), *range(0x80, 0xC0), *range(0xC3, 0xCA)] if b != 0x27)


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes lists of texts with a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Pieces and their ids; the older half is given up when the younger one is full.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _plain(self, raw: bytes) -> bool:
        """Whether pieces begin where kinds change: no other scripts or signs, no special tokens, no runs of white space."""
        if raw.translate(None, _PLAIN_BYTES) or b"\xc3\x97" in raw or b"\xc3\xb7" in raw or any(s in raw for s in self.special):
            return False
        blank = np.frombuffer(raw.translate(_KIND), dtype=np.uint8) == _BLANK
        return not (blank[1:] & blank[:-1]).any()

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, four bytes each."""
        out = list(map(self.known.get, pieces))
        tokenize, older = self.model.tokenize, self.older.get
        for k, ids in enumerate(out):
            if ids is None:
                piece = pieces[k]
                ids = older(piece)
                if ids is None:
                    # of ASCII, only white space has another letter
                    plain = piece.isascii() and piece[-1] > " "
                    letters = piece.replace(" ", self.letters[32]) if plain else piece.encode("utf-8").decode("latin-1").translate(self.letters)
                    ids = array("I", [t.id for t in tokenize(letters)]).tobytes()
                if len(self.known) >= _MEMORY:
                    self.older, self.known = self.known, {}
                    older = self.older.get
                out[k] = self.known[piece] = ids
        return out

    def _encode_plain(self, texts: list[bytes], raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the texts (``raw`` is the texts joined), and how many each has."""
        if not raw:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(sizes)
        octets = np.frombuffer(raw, dtype=np.uint8)
        kind = np.frombuffer(raw.translate(_KIND), dtype=np.uint8)
        first = np.ones(len(octets), dtype=bool)
        np.not_equal(kind[1:], kind[:-1], out=first[1:])
        # a single blank (not another white space) joins what follows it in its text
        first[1:] &= octets[:-1] != 0x20
        first[ends[:-1][ends[:-1] < len(octets)]] = True
        starts = np.flatnonzero(first)
        offsets = np.append(starts, len(octets)).astype(np.int64)
        pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(raw))
        coded = pieces.dictionary_encode()
        encoded = self._pieces(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        lengths = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded)) // 4
        flat = np.frombuffer(b"".join(encoded), dtype=np.uint32)
        at = coded.indices.to_numpy(zero_copy_only=False)
        n = lengths[at]
        last = np.cumsum(n)
        source = (np.cumsum(lengths) - lengths)[at] - (last - n)
        ids = flat[np.arange(int(last[-1])) + np.repeat(source, n)]
        total = np.concatenate([[0], last])
        return ids, np.diff(total[np.searchsorted(starts, np.concatenate([[0], ends]))])

    def encode(self, texts: list[str | None]) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
        """For slices of the list: their places, all ids and the number of ids of each text."""
        start = 0
        while start < len(texts):
            stop, chars = start, 0
            while stop < len(texts) and (stop == start or chars + len(texts[stop] or "") <= _SLICE_CHARS):
                chars += len(texts[stop] or "")
                stop += 1
            part = [(t or "").encode("utf-8", "replace") for t in texts[start:stop]]
            whole = b"".join(part)
            plain = [True] * len(part) if self._plain(whole) else [self._plain(t) for t in part]
            if not all(plain):
                whole = b"".join(t for t, p in zip(part, plain, strict=True) if p)
            ids, n = self._encode_plain([t for t, p in zip(part, plain, strict=True) if p], whole)
            if not all(plain):
                odd = iter(self.tokenizer.encode_batch([t.decode() for t, p in zip(part, plain, strict=True) if not p], add_special_tokens=False))
                even = iter(np.split(ids, np.cumsum(n)[:-1]) if len(n) else [])
                each = [next(even) if p else np.array(next(odd).ids, dtype=np.uint32) for p in plain]
                ids, n = np.concatenate(each), np.array([len(x) for x in each], dtype=np.int64)
            yield range(start, stop), ids, n
            start = stop
