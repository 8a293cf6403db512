"""Exact tokenizing by units: texts are cut where no token can span, and each distinct unit is encoded once per worker.

Kind "word" (white space dropped, lower case): units end at spaces and newlines, which never reach a token.
Kind "byte" (byte-level, one space joined to the next word): a unit starts at each space or newline that follows
another character and precedes one that is neither; no pre-token spans such a start. Texts with runs of white
space, which the cut does not cover, go to the tokenizer whole.

New units that are one run of letters, perhaps with one full stop or comma behind, are merged by ``BatchMerges``, which
applies the tokenizer's own merge list to thousands of words at once; all other units go to the tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import accumulate, islice

import numpy as np

_RUN = re.compile(r"\s\s")  # of any white space, that of other scripts too
MAX_UNITS = 400_000  # units kept per worker; the memory bound of the cache
CACHED_UNIT = 12  # longer units are too seldom met again to be kept
MAX_UNIT = 48  # longer units go to the tokenizer


def _byte_chars() -> list[str]:
    """The printable character that byte-level tokenizers use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class BatchMerges:
    """Byte-pair merging of many words at once: in each round every word makes its best-ranked, leftmost merge."""

    NONE = np.int32(2**31 - 1)

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        chars = _byte_chars()
        self.first = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + end] for c in chars], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 17 | vocab[b] for a, b in pairs], np.int64)
        made = [vocab[a[: len(a) - len(end)] + b if end and a.endswith(end) else a + b] for a, b in pairs]
        self.made = np.array(made, np.int32)
        self.bits = 19
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.NONE, np.int32)
        for rank, (slot, key) in enumerate(zip(self._slot(keys).tolist(), keys.tolist())):
            while self.keys[slot] >= 0 and self.keys[slot] != key:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            if self.keys[slot] < 0:
                self.keys[slot], self.ranks[slot] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; negative ids are padding."""
        keys = (a.astype(np.int64) << 17) | b
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.ranks[slot], self.NONE)
        on = np.flatnonzero((held != keys) & (held >= 0) & (a >= 0).ravel() & (b >= 0).ravel())
        at = slot[on]
        while len(on):
            at = (at + 1) & ((1 << self.bits) - 1)
            held = self.keys[at]
            hit = held == keys[on]
            out[on[hit]] = self.ranks[at[hit]]
            more = ~hit & (held >= 0)
            on, at = on[more], at[more]
        return np.where((a >= 0) & (b >= 0), out, self.NONE)

    def encode(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, tail: np.ndarray, dtype) -> list[bytes]:
        """The ids of the words data[start : start + size] as bytes, each followed by its tail's id if that isn't negative."""
        n, step = len(start), np.dtype(dtype).itemsize
        order = np.argsort(size, kind="stable")
        sizes = size[order]
        out: list[bytes] = []
        low = 0
        while low < n:
            top = int(sizes[low])
            high = min(int(np.searchsorted(sizes, max(top + 2, top * 6 // 5), "right")), low + 20_000)
            at = order[low:high]
            ids = self._merge(data, start[at], size[at])
            count = (ids >= 0).sum(1)
            ids = np.concatenate([ids, np.full((len(at), 1), -1, np.int32)], 1)
            ids[np.arange(len(at)), count] = tail[at]
            kept = ids >= 0
            flat = ids[kept].astype(dtype).tobytes()
            ends = [0, *accumulate((kept.sum(1) * step).tolist())]
            out += map(flat.__getitem__, map(slice, ends, ends[1:]))
            low = high
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        return list(map(out.__getitem__, back.tolist()))

    def _merge(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        n, wide = len(size), int(size.max(initial=1))
        col = np.arange(wide)
        raw = data[np.minimum(start[:, None] + col, len(data) - 1)]
        a = np.where(col < size[:, None], self.first[raw], np.int32(-1))
        a[np.arange(n), size - 1] = self.last[data[start + size - 1]]
        done = a.copy()
        rows = np.arange(n)
        r = self._rank(a[:, :-1].ravel(), a[:, 1:].ravel()).reshape(n, wide - 1)
        while wide > 1 and len(rows):
            pos = r.argmin(1)
            here = np.arange(len(rows))
            best = r[here, pos]
            on = best < self.NONE
            if not on.all():
                done[rows[~on]] = -1
                done[rows[~on], : a.shape[1]] = a[~on]
                rows, a, r, pos, best = rows[on], a[on], r[on], pos[on], best[on]
                here = np.arange(len(rows))
                if not len(rows):
                    break
            shift = col[None, : a.shape[1] - 1] > pos[:, None]
            moved = np.where(shift, a[:, 1:], a[:, :-1])
            moved[here, pos] = self.made[best]
            a = moved
            if a.shape[1] == 1:
                done[rows] = -1
                done[rows, :1] = a
                break
            r = np.where(shift[:, :-1], r[:, 1:], r[:, :-1])
            left = np.maximum(pos - 1, 0)
            right = np.minimum(pos, a.shape[1] - 2)
            r[here, left] = self._rank(a[here, left], a[here, left + 1])
            r[here, right] = self._rank(a[here, right], a[here, right + 1])
        return done


class UnitEncoder:
    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.kind = kind
        self.size = 1 + max(self.tok.get_vocab().values())
        self.dtype = np.uint16 if self.size <= 65536 else np.uint32
        self.merges = BatchMerges(path)
        letters = b"abcdefghijklmnopqrstuvwxyz" + (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" if kind == "byte" else b"")
        self.odd = np.array([b not in letters if b < 128 else b == 0xC2 or b > 0xC8 for b in range(256)])
        self.odd[10] = False
        self.tails = np.zeros(256, np.int32)
        for c in ".,":
            (self.tails[ord(c)],) = self.tok.encode(c, add_special_tokens=False).ids
        self.cache: dict[str, bytes] = {"": b""}

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, units: list[str]) -> list[bytes]:
        """The ids of units that the cache lacks."""
        blob = "\n".join(units)
        if self.kind == "word":
            blob = blob.replace("\u0130", "\0").lower()  # its lower case has two characters
        data = np.frombuffer((blob + "\n").encode(), np.uint8)
        end = np.flatnonzero(data == 10)
        start = np.concatenate([[0], end[:-1] + 1])
        if len(end) != len(units):
            return self._raw(units)
        # 0xC2 leads signs, from 0xC9 on come marks and scripts that need normalising; both go to the tokenizer
        odd = self.odd[data]
        odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        if self.kind == "byte":
            odd[start] &= data[start] != 32
        closed = (data[end - 1] == 46) | (data[end - 1] == 44)
        odd[(end - 1)[closed]] = False
        bad = np.concatenate([[0], np.cumsum(odd)])
        size = end - start - closed
        plain = (bad[end] == bad[start]) & (size > (data[start] == 32)) & (size <= MAX_UNIT)
        tail = np.where(closed, self.tails[data[end - 1]], -1)
        on = np.flatnonzero(plain)
        found = iter(self.merges.encode(data, start[on], size[on], tail[on], self.dtype))
        rest = iter(self._raw([units[i] for i in np.flatnonzero(~plain).tolist()]))
        return [next(found) if p else next(rest) for p in plain.tolist()]

    def _units(self, text: str) -> list[str] | None:
        if self.kind == "word":
            return text.replace("\n", " ").split(" ")
        if not text or _RUN.search(text):
            return None
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if "\0" not in text else None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the tokenizer's own encode gives them."""
        cut = [self._units(t) for t in texts]
        if len(self.cache) > MAX_UNITS:
            self.cache = dict(islice(self.cache.items(), MAX_UNITS // 2))  # what came first is what comes often
        flat: list[str] = []
        ends = []
        for u in cut:
            flat += u or ()
            ends.append(len(flat))
        found = list(map(self.cache.get, flat))
        gaps = [i for i, x in enumerate(found) if x is None]
        if gaps:
            missing = list({flat[i] for i in gaps})
            fresh = dict(zip(missing, self._new(missing)))
            for i in gaps:
                found[i] = fresh[flat[i]]
            self.cache.update((k, v) for k, v in fresh.items() if len(k) <= CACHED_UNIT)
        out = [b"".join(found[i:j]) for i, j in zip([0, *ends], ends)]
        whole = [i for i, u in enumerate(cut) if u is None]
        for i, ids in zip(whole, self._raw([texts[i] for i in whole])):
            out[i] = ids
        return [np.frombuffer(x, self.dtype) for x in out]


@lru_cache(maxsize=4)
def encoder(path: str, kind: str) -> UnitEncoder:
    """This worker's encoder; it and its cache last from task to task."""
    return UnitEncoder(path, kind)
