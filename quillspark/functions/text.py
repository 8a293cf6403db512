"""Text analysis: tokens, Porter stems, edit distance, variable-byte codes."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = (  # possessive: a token never gives back what it took
    "(?:https?|ftp)://[^\\p{IsWhite_Space}<>\"')\\]}]*+"
    "|\\p{IsAlphabetic}[\\p{IsAlphabetic}\\p{N}]*+(?:['’]\\p{IsAlphabetic}[\\p{IsAlphabetic}\\p{N}]*+)*+"
    "|[0-9]++(?:[.,][0-9]++)*+"
)
_URL = "^(?:https?|ftp)://"
_MARK = "://"  # only URLs have it


def found(text: Column) -> Column:
    """The matches of TOKEN in order: ``tokens`` with the marks that end a URL still on it."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def tokens(text: Column) -> Column:
    """Words, numbers and URLs of a text in order; a token's position is its index."""
    return F.transform(found(text), lambda t: F.when(F.contains(t, F.lit(_MARK)), F.regexp_replace(t, "[.,?!]+$", "")).otherwise(t))


def terms(text: Column) -> Column:
    """Tokens in lower case, URLs as they are; stems are a later step over distinct terms."""
    return F.transform(found(text), lambda t: F.when(F.contains(t, F.lit(_MARK)), F.regexp_replace(t, "[.,?!]+$", "")).otherwise(F.lower(t)))


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN))


_KNOWN: dict[str, str] = {}
KNOWN_TOKENS = 1 << 19  # stems that a worker keeps


def terms_of(tokens: list[str], stemmed: bool = True) -> list[str]:
    """The terms of distinct matches of ``found``, as ``terms`` and the stems have them."""
    if not stemmed:
        return [t.rstrip(".,?!") if _MARK in t else t.lower() for t in tokens]
    if len(_KNOWN) > KNOWN_TOKENS:
        _KNOWN.clear()
    out, known, new = [], _KNOWN.get, stem.__wrapped__
    for t in tokens:
        term = known(t)
        if term is None:
            term = _KNOWN[t] = t.rstrip(".,?!") if _MARK in t else new(t.lower())
        out.append(term)
    return out


_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_P = "^(?:[^aeiou][^aeiouy]*[aeiouy]|[aeiou])"
_HAS_VOWEL = re.compile(_P)
_M0 = re.compile(f"{_P}[aeiou]*{_C}")
_M1 = re.compile(f"{_P}[aeiou]*{_C}(?:{_V})?$")
_M2 = re.compile(f"{_P}[aeiou]*{_C}{_V}[^aeiou]")
_CVC = re.compile("[^aeiou][aeiouy][^aeiouwxy]$")
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"


def _by_end(rules) -> dict[str, list[tuple[str, str]]]:
    """The rules by the last two letters of their suffixes, in order."""
    out: dict[str, list[tuple[str, str]]] = {}
    for suffix, new in rules:
        out.setdefault(suffix[-2:], []).append((suffix, new))
    return out


_TWO, _THREE = (_by_end(tuple(r.split(":")) for r in x.split()) for x in (_STEP2, _STEP3))
_FOUR = _by_end((s, "") for s in _STEP4.split())


_ENDS = ("s", "ed", "ing", "y", "ion", "e", "ll", *(r.split(":")[0] for r in f"{_STEP2} {_STEP3} {_STEP4}".split()))


def _first(word: str, rules, ok) -> str:
    """The first rule whose suffix is there and whose stem passes; a rule that fails lets later ones try."""
    for suffix, new in rules.get(word[-2:], ()):
        if word.endswith(suffix) and ok(word[: len(word) - len(suffix)]):
            return word[: len(word) - len(suffix)] + new
    return word


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeiou"


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """Porter's stem; words of up to two letters are only lowered, anything with other characters stays."""
    w = word.lower()
    if len(w) <= 2:
        return w
    if not w.isalpha() and not all(c.isalpha() or c in "'’" for c in w):
        return word
    if not w.endswith(_ENDS):  # no step has anything to cut
        return w
    m0, m2 = _M0.match, _M2.match
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if m0(w[:-3]):
            w = w[:-1]
    else:
        cut = w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else None
        if cut is not None and not _HAS_VOWEL.match(cut):
            cut = None
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
            elif _M1.match(w) and _CVC.search(w):
                w += "e"
    if w.endswith("y") and _HAS_VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    w = _first(w, _TWO, m0)
    w = _first(w, _THREE, m0)
    if w.endswith("ion") and w[:-3].endswith(("s", "t")) and m2(w[:-3]):
        w = w[:-3]
    else:
        w = _first(w, _FOUR, m2)
    if w.endswith("e"):
        s = w[:-1]
        if m2(s) or _M1.match(s) and not _CVC.search(s):
            w = s
    if w.endswith("ll") and m2(w[:-1]):
        w = w[:-1]
    return w


def stem_udf(word) -> Column:
    """Stems by an Arrow function; meant for distinct terms."""
    return F.pandas_udf(lambda words: words.map(stem, na_action="ignore"), "string")(word)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def osa(a: str, b: str) -> int:
    """Edits between two strings, a swap of neighbours among them, no part edited twice."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
    return row[-1]


def osa_udf(a, b) -> Column:
    return F.pandas_udf(lambda x, y: pd.Series([osa(u, v) for u, v in zip(x, y)], dtype="int32"), "int")(a, b)


def vbyte(n: int) -> bytes:
    """Seven bits a byte, low ones first; the last byte has its top bit set."""
    out = bytearray()
    while n > 127:
        out.append(n & 127)
        n >>= 7
    out.append(n | 128)
    return bytes(out)


def unvbyte(data: bytes) -> list[int]:
    out, n, shift = [], 0, 0
    for b in data:
        n |= (b & 127) << shift
        shift += 7
        if b & 128:
            out.append(n)
            n = shift = 0
        elif shift > 35:
            raise ValueError("a number is too long")
    if shift:
        raise ValueError("the data end within a number")
    return out


def stems_of(words) -> Column:
    """Stems of an array of terms, by an Arrow function with a dictionary a worker; URLs stay."""
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda ws: [w if "://" in w else stem(w) for w in ws], na_action="ignore")

    return F.pandas_udf(run, "array<string>")(words)


def analyze(text: str | None) -> list[str]:
    """The terms of a query on the driver: tokens in lower case, stemmed; the same steps as for the index."""
    return [x[0] for x in spans(text or "")]


_PY_TOKEN = None


def _token_pattern():
    global _PY_TOKEN
    if _PY_TOKEN is None:
        import regex

        _PY_TOKEN = regex.compile(TOKEN.replace("\\p{IsWhite_Space}", "\\p{White_Space}").replace("\\p{IsAlphabetic}", "\\p{Alphabetic}"))
    return _PY_TOKEN


def raw_spans(text: str) -> list[tuple[str, int, int]]:
    """(token, start, end) in code points, as ``tokens`` finds them."""
    out = []
    for m in _token_pattern().finditer(text):
        t = m.group()
        if re.match(_URL, t):
            t = t.rstrip(".,?!")
        out.append((t, m.start(), m.start() + len(t)))
    return out


def raw_tokens(text: str) -> list[str]:
    """The tokens of ``raw_spans`` alone."""
    return [t.rstrip(".,?!") if _MARK in t else t for t in _token_pattern().findall(text)]


def spans(text: str) -> list[tuple[str, int, int]]:
    """(term, start, end) with stems, offsets in code points."""
    return [(t if re.match(_URL, t) else stem(t.lower()), a, b) for t, a, b in raw_spans(text)]


SPANS = pa.struct([("token", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("position", pa.int32())])
PIECE_CHARS = 1 << 20  # of texts whose tokens a worker holds at once; a longer text alone


def pieces(texts: pa.Array):
    """(first, number) of stretches of texts of about PIECE_CHARS."""
    ends, at = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE_CHARS, "right")))
        yield at, to - at
        at = to


def _byte_spans(texts: pa.Array) -> tuple[pa.StructArray, np.ndarray]:
    """The tokens of texts, one text behind another, with their byte offsets, and how many each text has."""
    words, starts, ends, sizes = [], [], [], []
    for t in texts.to_pylist():
        found = raw_spans(t or "")
        sizes.append(len(found))
        if not found:
            continue
        words += [x[0] for x in found]
        a, b = (np.array([x[k] for x in found], np.int64) for k in (1, 2))
        if not t.isascii():
            points = np.frombuffer(t.encode("utf-32-le"), np.uint32)
            at = np.append(0, np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)))
            a, b = at[a], at[b]
        starts.append(a)
        ends.append(b)
    n = np.array(sizes, np.int64)
    join = lambda x: pa.array(np.concatenate(x) if x else [], pa.int32())
    position = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return pa.StructArray.from_arrays([pa.array(words, pa.string()), join(starts), join(ends), pa.array(position, pa.int32())], fields=list(SPANS)), n


def byte_spans(text) -> Column:
    """Array of (token, start, end, position) with UTF-8 byte offsets of each token."""
    def run(texts: pa.Array) -> pa.Array:
        parts = [_byte_spans(texts.slice(at, n)) for at, n in pieces(texts)]
        return as_lists(pa.concat_arrays([x for x, _ in parts] or [pa.array([], SPANS)]), np.concatenate([n for _, n in parts] or [np.zeros(0, np.int64)]), texts)

    return F.arrow_udf(run, "array<struct<token:string,start:int,end:int,position:int>>")(text)


def byte_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, token, start, end, position): ``byte_spans`` of (doc_id, text) as rows, a few texts at once."""
    def run(batches):
        for b in batches:
            for at, n in pieces(b.column(1)):
                spans, sizes = _byte_spans(b.column(1).slice(at, n))
                ids = b.column(0).slice(at, n).take(pa.array(np.repeat(np.arange(n), sizes)))
                yield pa.RecordBatch.from_arrays([ids, *spans.flatten()], names=["doc_id", *SPANS.names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, token string, start int, end int, position int")


STOP_WORDS = frozenset("""
a i be de he ie me re we if of eg am an in on un co do go no so to up or as is us at it by my via inc etc had and ltd
see she the one are due off all him can ten con own who too two top her per for nor our has was his its get yet not
but out put you few how now six may why any find once made side take name same some mine nine done none here were fire
more else have five give move each much such with both back call well fill mill will full seem them whom from than
been then when even thin upon down also into onto keep ever over four your this hers ours less thus that what cant
part last most must next thru show they only many very could would found third hence since three while whole alone
noone there where these those whose above being along among which thick until still often again under other after
never their seems yours eight might front hasnt least first about below every fifty empty forty sixty indeed seemed
should behind beyond around toward thence whence beside became become anyone before please twelve itself myself during
though enough detail system bottom eleven herein within rather either former latter others across always amount cannot
except almost anyhow anyway hereby nobody namely mostly twenty hundred someone sincere nowhere because himself herself
nothing seeming through several fifteen between therein wherein whether neither whither another further whoever
however whereas towards besides becomes perhaps serious couldnt amongst against without somehow thereby whereby
already describe sometime everyone anywhere yourself anything becoming although hereupon together whenever wherever
whatever moreover interest amoungst formerly latterly meanwhile somewhere elsewhere therefore otherwise something
thereupon whereupon hereafter sometimes ourselves beforehand everywhere everything thereafter whereafter afterwards
themselves yourselves throughout nevertheless
""".split())


def stop_stems() -> list[str]:
    """The English stop words as the index holds them."""
    return sorted({stem(w) for w in STOP_WORDS})


def gaps(values: Column) -> Column:
    """Differences of an ascending array, the first value as it is."""
    return F.transform(values, lambda x, i: x - F.coalesce(F.get(values, i - 1), F.lit(0)))


def ungap(values: Column) -> Column:
    """The running sums of an array of gaps."""
    return F.transform(values, lambda _, i: F.aggregate(F.slice(values, 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x))


def pack(values: list[int]) -> bytes:
    """Gaps of an ascending list in variable bytes."""
    return b"".join(vbyte(b - a) for a, b in zip([0, *values], values))


def unpack(data: bytes) -> list[int]:
    """The list back; ValueError if the bytes are damaged."""
    out, at = [], 0
    for gap in unvbyte(data):
        at += gap
        out.append(at)
    return out


def pack_lists(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``pack`` of each of the lists that stand one behind another in ``values``: all bytes, and how many each list has."""
    at = np.cumsum(sizes) - sizes
    gaps = np.diff(values.astype(np.int64), prepend=0)
    some = sizes > 0
    gaps[at[some]] = values[at[some]]
    if len(gaps) and gaps.min() < 0:
        raise ValueError("a list doesn't ascend")
    width = np.ones(len(gaps), np.int64)
    k = 7
    while len(more := np.flatnonzero(gaps >> k)):
        width[more] += 1
        k += 7
    ends = np.cumsum(width)
    data = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    rows, k = np.arange(len(gaps)), 0
    while len(rows):
        data[ends[rows] - width[rows] + k] = gaps[rows] >> 7 * k & 127
        k += 1
        rows = rows[width[rows] > k]
    data[ends - 1] |= 128
    return data, np.diff(np.append(0, ends)[np.append(at, len(gaps))])


def unpack_lists(data: np.ndarray, sizes: np.ndarray | None = None, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The lists back, one behind another, and how many values each has; given are these, or how many bytes each list has."""
    last = data >= 128
    ends = np.flatnonzero(last)
    if len(data) and not last[-1]:
        raise ValueError("the data end within a number")
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    width = ends - starts + 1
    if len(width) and width.max() > 6:
        raise ValueError("a number is too long")
    gaps, rows, k = np.zeros(len(ends), np.int64), np.arange(len(ends)), 0
    while len(rows):
        gaps[rows] |= (data[starts[rows] + k] & 127).astype(np.int64) << 7 * k
        k += 1
        rows = rows[width[rows] > k]
    if sizes is None:
        to = np.cumsum(lengths)
        if len(to) and not last[to[lengths > 0] - 1].all():
            raise ValueError("the data end within a number")
        sizes = np.diff(np.searchsorted(ends, to, "left"), prepend=0)
    if sizes.sum() != len(gaps):
        raise ValueError("there are more or fewer numbers than told")
    total = np.append(0, np.cumsum(gaps))
    return total[1:] - np.repeat(total[np.cumsum(sizes) - sizes], sizes), sizes


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists, and how many each has; none for null."""
    return lists.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _bytes(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all blobs, and how many each has; none for null."""
    blobs = blobs.cast(pa.binary()) if blobs.null_count == 0 else pa.array([x or b"" for x in blobs.to_pylist()], pa.binary())
    _, offsets, data = blobs.buffers()
    ends = np.frombuffer(offsets, np.int32)[blobs.offset : blobs.offset + len(blobs) + 1] if len(blobs) else np.zeros(1, np.int32)
    return np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]], np.diff(ends).astype(np.int64)


def as_blobs(data: np.ndarray, sizes: np.ndarray, like: pa.Array | None = None) -> pa.Array:
    """Stretches of bytes as binaries; null where ``like`` is."""
    offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32(), mask=np.append(like.is_null().to_numpy(zero_copy_only=False), False) if like is not None and like.null_count else None)
    if offsets.null_count:
        return pa.array([None if gone else data[b - n : b].tobytes() for gone, n, b in zip(like.is_null().to_pylist(), sizes.tolist(), np.cumsum(sizes).tolist())], pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets.buffers()[1], pa.py_buffer(data)])


def as_lists(values: pa.Array, sizes: np.ndarray, like: pa.Array | None = None) -> pa.Array:
    """Stretches of values as lists; null where ``like`` is."""
    gone = np.append(like.is_null().to_numpy(zero_copy_only=False), False) if like is not None and like.null_count else None
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32(), mask=gone), values)


def _pack_arrow(lists: pa.Array) -> pa.Array:
    return as_blobs(*pack_lists(*_flat(lists)), lists)


def _unpack_arrow(blobs: pa.Array) -> pa.Array:
    data, lengths = _bytes(blobs)
    values, sizes = unpack_lists(data, lengths=lengths)
    return as_lists(pa.array(values, pa.int32()), sizes, blobs)


def _positions_arrow(tf: pa.Array, blobs: pa.Array) -> pa.Array:
    counts, n = _flat(tf)
    values, _ = unpack_lists(_bytes(blobs)[0], counts.astype(np.int64))
    return as_lists(as_lists(pa.array(values, pa.int32()), counts), n, tf)


def pack_udf(values) -> Column:
    return F.arrow_udf(_pack_arrow, "binary")(values)


def unpack_udf(data) -> Column:
    return F.arrow_udf(_unpack_arrow, "array<int>")(data)


def positions_udf(tf, data) -> Column:
    """The positions by document of a block, from how many each has and from their packed lists one behind another."""
    return F.arrow_udf(_positions_arrow, "array<array<int>>")(tf, data)


def packed_size(values: Column) -> Column:
    """How many bytes ``pack`` takes, by built-ins: one for each started group of seven bits."""
    width = lambda g: F.greatest(F.lit(1), F.ceil(F.length(F.bin(g)) / 7))
    return F.aggregate(gaps(values), F.lit(0).cast("long"), lambda a, g: a + width(g.cast("long")).cast("long"))


def percent_decode(text: str) -> str:
    """``+`` is a space, ``%XX`` a byte; a bad escape leaves the sign and takes the two bytes with it; bad UTF-8 becomes U+FFFD."""
    data, out, at = text.encode(), bytearray(), 0
    while at < len(data):
        b = data[at]
        if b == 37:
            two = data[at + 1 : at + 3].decode("latin-1")
            good = re.fullmatch("[0-9a-fA-F]{2}", two)
            out.append(int(two, 16) if good else 37)
            at += 3
        else:
            out.append(32 if b == 43 else b)
            at += 1
    return out.decode("utf-8", "replace")


def query_params(query: str) -> dict[str, str]:
    """The decoded pairs of a query string; of equal keys the last counts."""
    pairs = (p.partition("=") for p in query.split("&")) if query else ()
    return {percent_decode(k): percent_decode(v) for k, _, v in pairs}


def percent_decode_udf(text) -> Column:
    return F.pandas_udf(lambda s: s.map(percent_decode, na_action="ignore"), "string")(text)


def fnv1a(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h
