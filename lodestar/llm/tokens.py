"""Token ids of texts by a public tokenizer file, fast enough to run over a corpus.

``PieceMemo`` gives the ids that the tokenizer gives for the whole text. It rests on properties of the
vocabulary file ``word_bpe_49k.json``: a text is lower-cased, cut into contractions, runs of letters,
single digits and runs of signs, white space is dropped, and each piece gives its own ids. Texts of
ASCII and Latin-1 letters are cut here by the file's own rule, with numpy over many texts at once. Of
other texts, a chunk between white space that holds anything else goes to the tokenizer as it is, for
white space always ends a piece.

Distinct pieces are remembered in a hash table of arrays, which is looked up for all pieces at once:
a slot holds a 64-bit hash, the piece's length and its first 8 bytes, which must all agree. Unknown
pieces go to the tokenizers library's model, unknown chunks to the whole tokenizer. (A vocabulary for
which the model alone does not give the same ids, on a few probes, is not cut here at all.) The memo
is bounded: when it is full, only the pieces of the present texts stay. The ids are the same whether
a piece is remembered or not.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

END = 1
MEMO = 400_000
_MEMOS: dict[str, PieceMemo] = {}
_PROBES = ("the", "question", "übergrößen", "élève", "##", "...", "7", "&", "'s")
_PLAIN_ASCII = bytes([9, 10, 13, *range(32, 127)])
_OTHER = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ]")
_GAP = re.compile(rb"[ \t\n\r]")
_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[97:123] = _LETTER
_CLASS[128:] = _LETTER  # in texts that are cut here, only Latin-1 letters have such bytes
#: A byte-level vocabulary writes a byte as the character of its number if that prints, else as one after 255.
_BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}
_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(1).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def default_tokenizer() -> str:
    """The path of the tokenizer file that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the hash's base and of its inverse modulo 2**64, up to what was asked for."""

    size = 0

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > cls.size:
            cls.size = max(n, 1 << 21)
            cls.up, cls.down = _powers(cls.size, _BASE), _powers(cls.size, pow(_BASE, -1, 1 << 64))
        return cls.up[:n], cls.down


def cut(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes of a plain text, and where its pieces begin and end."""
    data = np.frombuffer(text.lower(), np.uint8)
    if not text.isascii():  # À to Þ: their second byte is 32 below that of the small letter
        capital = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)
        data = data.copy()
        data[1:][capital] += 32
    kind = _CLASS[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[:-1] |= kind == _DIGIT
    quote = np.flatnonzero((data == 39) & edge[:-1])
    if len(quote):  # 's 't 're 've 'm 'll 'd
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        one, two = padded[quote + 1], padded[quote + 2]
        size = np.where(np.isin(one, list(b"stmd")), 2, np.where(((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108), 3, 0))
        at, size = quote[size > 0], size[size > 0]
        edge[at + 1] = False
        edge[at + size] = True
    at = np.flatnonzero(edge)
    real = kind[at[:-1]] != _SPACE
    return data, at[:-1][real], at[1:][real]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, check) of pieces: a polynomial hash of all bytes, and the length with the first 8 bytes."""
    up, down = _Powers.get(len(data))
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up, out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * down[starts]
    size = (ends - starts).astype(np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= (h >> np.uint64(29)) + size
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    first = np.zeros(len(starts), np.uint64)
    for k in range(8):
        first |= np.where(size > k, padded[starts + k], 0).astype(np.uint64) << np.uint64(8 * k)
    return np.maximum(h, 1), first ^ (size << np.uint64(48)) * np.uint64(0xC2B2AE3D27D4EB4F)


def segments(text: bytes, most: int) -> list[bytes]:
    """A long text in parts that end at white space, which no piece crosses."""
    out, at = [], 0
    while len(text) - at > most and (gap := _GAP.search(text, at + most)):
        out.append(text[at : gap.start()])
        at = gap.start()
    return [*out, text[at:]]


class PieceMemo:
    def __init__(self, path: str, most: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.model = self.tokenizer.model
        self.by_model = all(self._piece(p.encode()) == self._whole([p])[0] for p in _PROBES)
        self._clear()

    @classmethod
    def shared(cls, path: str) -> PieceMemo:
        """One memo for each Python worker, kept from task to task."""
        if path not in _MEMOS:
            _MEMOS[path] = cls(path)
        return _MEMOS[path]

    def _clear(self) -> None:
        self.mask = (1 << max(10, (3 * self.most).bit_length())) - 1
        self.slot_hash, self.slot_key = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.int32)
        self.keys = self.used = 0
        self.check, self.start = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.int64)
        self.length, self.flat = np.zeros(1 << 14, np.int32), np.zeros(1 << 16, np.uint32)

    def _piece(self, piece: bytes) -> list[int]:
        text = piece.decode("latin-1")
        return [t.id for t in self.model.tokenize(text if text.isascii() else text.translate(_BYTE_CHARS))]

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.encode(texts, add_special_tokens=False)]

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The key of each hash, -1 if there is none."""
        out = np.full(len(h), -1, np.int64)
        left, at = np.arange(len(h)), (h & np.uint64(self.mask)).astype(np.int64)
        while len(left):
            there = self.slot_hash[at]
            same = there == h[left]
            out[left[same]] = self.slot_key[at[same]]
            on = ~same & (there != 0)
            left, at = left[on], (at[on] + 1) & self.mask
        return out

    def _add(self, h: np.ndarray, check: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Remember new pieces with distinct hashes."""
        n, m, total = self.keys, len(h), len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + m > len(self.start):
            self.check, self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.check, self.start, self.length))
        self.flat[self.used : self.used + total] = ids
        self.check[n : n + m], self.length[n : n + m] = check, lengths
        self.start[n : n + m] = self.used + np.cumsum(lengths) - lengths
        self.used, self.keys = self.used + total, n + m
        left, at = np.arange(m), (h & np.uint64(self.mask)).astype(np.int64)
        while len(left):  # who finds its slot free writes; of several the last stays, the others go on
            free = self.slot_hash[at] == 0
            self.slot_hash[at[free]] = h[left[free]]
            self.slot_key[at[free]] = n + left[free]
            on = self.slot_hash[at] != h[left]
            left, at = left[on], (at[on] + 1) & self.mask

    def _gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some keys one after the other, and the length of each."""
        lengths = self.length[which].astype(np.int64)
        before = np.cumsum(lengths) - lengths
        return self.flat[np.repeat(self.start[which] - before, lengths) + np.arange(int(lengths.sum()))], lengths

    def _plain(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a plain text: where its pieces begin, the ids of all, the number of each, as from the memo."""
        data, starts, ends = cut(text)
        h, check = hashes(data, starts, ends)
        which = self._find(h)
        known = which >= 0
        wrong = np.flatnonzero(known)[self.check[which[known]] != check[known]]  # another piece of equal hash
        new, at = np.unique(h[~known], return_index=True)
        if len(new):
            at = np.flatnonzero(~known)[at]
            if self.keys + len(new) > self.most:
                keep = np.unique(which[known], return_index=True)
                held = (h[known][keep[1]], self.check[keep[0]], *self._gather(keep[0]))
                self._clear()
                if len(held[0]) + len(new) > self.most:  # more pieces than the memo holds: cut the text instead
                    return None
                self._add(*held)
            raw = data.tobytes()
            ids = [self._piece(raw[a:b]) for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            self._add(new, check[at], np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))
            which = self._find(h)
            wrong = np.flatnonzero(self.check[which] != check)
        body, lengths = self._gather(which)
        if len(wrong):
            raw = data.tobytes()
            parts = np.split(body, np.cumsum(lengths)[:-1])
            for k in wrong.tolist():
                parts[k] = np.array(self._piece(raw[starts[k] : ends[k]]), np.uint32)
            body, lengths = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return starts, body, lengths

    def _odd(self, text: bytes) -> np.ndarray:
        """The ids of a text that is not plain, chunk by chunk."""
        chunks = [c.decode("utf-8", "replace") for c in text.split()] if self.by_model else [text.decode("utf-8", "replace")]
        return np.array(list(chain.from_iterable(self._whole(chunks))), np.uint32)

    def _is_plain(self, text: bytes) -> bool:
        if not self.by_model or b"<|" in text:  # perhaps a special token
            return False
        return not text.translate(None, _PLAIN_ASCII) if text.isascii() else not _OTHER.search(text.decode("utf-8", "replace"))

    def ids(self, texts: list[bytes], end: int | None = END, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other (each followed by ``end``), and where each text's begin; one more entry for the end."""
        out: list[np.ndarray] = [None] * len(texts)
        waiting: list[int] = []
        size = 0

        def flush():
            if not waiting:
                return
            got = self._plain(b"\n".join([texts[k] for k in waiting]))
            if got is None:
                if len(waiting) == 1:
                    out[waiting[0]] = self._odd(texts[waiting[0]])
                else:
                    for k in waiting:
                        out[k] = (self._plain(texts[k]) or (0, self._odd(texts[k])))[1]
                return
            starts, body, lengths = got
            ends = np.concatenate([[0], np.cumsum(lengths)])
            stops = np.cumsum([len(texts[k]) + 1 for k in waiting])
            at = ends[np.concatenate([[0], np.searchsorted(starts, stops)])].tolist()
            for k, a, b in zip(waiting, at[:-1], at[1:], strict=True):
                out[k] = body[a:b]

        for k, text in enumerate(texts):
            if not self._is_plain(text):
                out[k] = self._odd(text)
                continue
            if len(text) > 2 * most:
                parts = [self._plain(part) or (0, self._odd(part)) for part in segments(text, most)]
                out[k] = np.concatenate([x[1] for x in parts])
                continue
            waiting.append(k)
            size += len(text)
            if size >= most:
                flush()
                waiting, size = [], 0
        flush()
        tail = np.array([] if end is None else [end], np.uint32)
        ends = np.concatenate([[0], np.cumsum([len(x) + len(tail) for x in out])]).astype(np.int64)
        return np.concatenate([x for o in out for x in (o, tail)]) if out else tail[:0], ends
