"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the UTF-8 bytes cuts each text where its content says, so that texts which share a passage share
chunks. A chunk's inside, from its first to its last safe cut, is encoded once per worker while the bounded store holds
it. A join between two insides is re-encoded together with one known unit of each side; if the ids of those units don't
come out as stored, the window grows to the whole text, so the ids always are the tokenizer's own.
"""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .unit_cache import _byte_chars, encoder

WINDOW, BITS, LEAST, MOST = 16, 10, 256, 8192  # bytes of the rolling hash; log2 of the mean chunk; bounds of a chunk
STORE_BYTES = 48_000_000  # per worker and generation, two generations
_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)
_CUT = re.compile(rb"[!-~](?=[ \n][!-~])")


def chunk_ends(data: bytes) -> list[int]:
    """Where the chunks end: after bytes whose rolling hash has BITS leading zeros, within LEAST to MOST bytes."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    gear = _GEAR[np.frombuffer(data, np.uint8)]
    h, reach = gear.copy(), 1
    while reach < WINDOW:  # h covers `reach` bytes; doubling covers WINDOW in four steps
        h[reach:] = h[reach:] + (h[:-reach] << np.uint32(reach)) if reach < n else h
        reach *= 2
    ends, last = [], 0
    for e in (np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1).tolist():
        while e - last > MOST:
            last += MOST
            ends.append(last)
        if e - last >= LEAST:
            ends.append(e)
            last = e
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


class ChunkCodec:
    def __init__(self, path: str):
        self.units = encoder(path, "byte")
        self.new: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}
        self.held = self.reused = self.repaired = self.whole = 0
        tok = self.units.tok
        value = {c: bytes([b]) for b, c in enumerate(_byte_chars())}
        self.bytes_of = [b""] * tok.get_vocab_size()
        for word, i in tok.get_vocab().items():
            self.bytes_of[i] = b"".join(value.get(c, c.encode()) for c in word)
        self.name_of = [str(i) for i in range(tok.get_vocab_size())]

    def _look(self, key: bytes):
        got = self.new.get(key) or self.old.get(key)
        return got

    def _keep(self, key: bytes, value: tuple) -> None:
        self.held += len(value[0]) + 300
        if self.held > STORE_BYTES:
            self.old, self.new, self.held = self.new, {}, 0
        self.new[key] = value

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plans, todo, want = [], [], {}
        for text in texts:
            data = text.encode()
            plan, start = [], 0
            for end in chunk_ends(data):
                chunk = data[start:end]
                key = xxhash.xxh3_128_digest(chunk)
                if key in want:
                    s, e = want[key][:2]
                elif got := self._look(key):
                    s, e = got[1:3]
                    self.reused += 1
                else:
                    cuts = [m.end() for m in _CUT.finditer(chunk)]
                    s, e = (cuts[0], cuts[-1]) if len(cuts) > 2 else (0, 0)
                    first, last = (chunk[s : cuts[1]], chunk[cuts[-2] : e]) if e else (b"", b"")
                    want[key] = (s, e, first, last, chunk[s:e])
                if e:
                    plan.append((start + s, start + e, key))
                start = end
            plans.append((data, plan))
        keys = [k for k, v in want.items() if v[1]]
        for part in range(3):
            todo += [want[k][(4, 2, 3)[part]].decode() for k in keys]
        ids = self.units.encode(todo)
        n = len(keys)
        fresh = {}
        for i, k in enumerate(keys):
            s, e, first, last, _ = want[k]
            fresh[k] = (ids[i].tobytes(), s, e, first, last, ids[n + i].tobytes(), ids[2 * n + i].tobytes())
        for k, v in want.items():
            self._keep(k, fresh.get(k) or (b"", 0, 0))
        gaps, spans = [], []
        for data, plan in plans:
            at, left, spots = 0, b"", []
            for s, e, key in plan:
                v = fresh.get(key) or self._look(key)
                if v is None or not v[0]:  # the store let it go meanwhile: the window covers it
                    continue
                spots.append((len(gaps), left, v))
                gaps.append((left[4] if left else b"") + data[at:s] + v[3])
                at, left = e, v
            spots.append((len(gaps), left, None))
            gaps.append((left[4] if left else b"") + data[at:])
            spans.append(spots)
        joined = self.units.encode([g.decode() for g in gaps])
        out = []
        for text, (data, _), spots in zip(texts, plans, spans):
            parts: list[bytes] | None = []
            for g, left, v in spots:
                raw = joined[g].tobytes()
                head, tail = left[6] if left else b"", v[5] if v else b""
                if not (raw.startswith(head) and raw.endswith(tail) and len(raw) >= len(head) + len(tail)):
                    parts = None
                    break
                parts.append(raw[len(head) : len(raw) - len(tail)])
                self.repaired += 1
                if v:
                    parts.append(v[0])
            if parts is None:
                self.whole += 1
                out.append(self.units.encode([text])[0])
            else:
                out.append(np.frombuffer(b"".join(parts), self.units.dtype))
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> ChunkCodec:
    return ChunkCodec(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) per row. Null texts count as empty and have no ids; ties and repeated rows each keep their row."""

    def run(batches):
        c = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = c.encode([t or "" for t in part.column(1).to_pylist()])
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = pa.array(np.concatenate([*ids, np.empty(0, c.units.dtype)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "ids"])

    d = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count and hashes of each text's ids and of their decoded text; the ids stay in the worker."""

    def run(batches):
        c = codec(path)
        names = c.name_of.__getitem__
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = c.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(x) for x in rows], pa.int64()),
                    pa.array([sha256(",".join(map(names, x.tolist())).encode()).hexdigest() for x in rows], pa.string()),
                    pa.array([sha256(c.decode(x).encode()).hexdigest() for x in rows], pa.string()),
                ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    d = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
