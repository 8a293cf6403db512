import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text
from quillspark.operators import index, suggest, vectors
from quillspark.sources.shared import saved

ODD = [(0, "The quick fox's den\nthe Foxes see http://A.org/x?. the end", "web foxes"), (1, None, "a"), (2, "", None), (3, " \n\n", " "), (4, "\nno title 3.14 and 2,5.", ""),
       (5, "only a title of the the THE", "the"), (6, "x" * 300 + " é日本 ’tis O’Neil's\r\nthe   end", "b"), (None, "the unknown", "c"), (-(2**63), "the first\nof all", "d")]
SCHEMA = "doc_id long, text string, source string"


def _rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("more", [[], [(0, "the second text of nought\nfox", "foxes"), (4, None, "again")]], ids=["ids", "repeated"])
def test_stored_index_is_the_built_one(spark, more):
    docs = spark.createDataFrame(ODD + more, SCHEMA)
    want, got = index.Index.build(docs, index.fields(docs)), index.Index.stored(saved(index.term_table(docs)), docs)
    for name in ("postings", "lengths", "field_postings", "field_lengths", "vocabulary", "frequencies", "field_stats"):
        assert _rows(getattr(got, name)) == _rows(getattr(want, name)), name
    none = index.Index.stored(saved(index.term_table(docs.limit(0))), docs)
    assert none.postings.count() == none.field_postings.count() == none.lengths.count() == 0


def test_frequent_terms_are_spread_over_files(spark):
    docs = spark.createDataFrame(ODD * 3, SCHEMA).repartition(3)
    rows = index.blocks(docs, True, ["fox", "the", "the"]).filter("term IS NOT NULL")
    parts = {}
    for r in rows.select("term", "part").distinct().collect():
        parts.setdefault(r.term, set()).add(r.part)
    assert parts["the"] <= {1, 2, 3} and all(p == {0} for t, p in parts.items() if t < "fox") and all(p == {3} for t, p in parts.items() if t > "the")
    assert _rows(rows.filter("n > 0").groupBy("term").agg(F.sum("total"))) == _rows(index.term_rows(docs).groupBy("term").agg(F.count("*").alias("sum(total)")))
    bounds = index.term_bounds(docs, docs.count())
    assert bounds == sorted(bounds)


def test_packed_lists_by_column():
    rng = random.Random(3)
    lists = [None if rng.random() < 0.1 else sorted(rng.choice((0, 127, 128, 16384, 2**31 - 1, rng.randrange(500))) for _ in range(rng.randrange(6))) for _ in range(2000)]
    packed = text._pack_arrow(pa.array(lists, pa.list_(pa.int32())))
    assert packed.to_pylist() == [None if x is None else text.pack(x) for x in lists]
    assert text._unpack_arrow(packed).to_pylist() == lists and text._unpack_arrow(packed.slice(70, 9)).to_pylist() == lists[70:79]
    for bad in ([b"\x01"], [b"\x01", b"\x81"], [b"\x01\x01\x01\x01\x01\x01\x01\x81"]):
        with pytest.raises(ValueError):
            text._unpack_arrow(pa.array(bad, pa.binary()))


def test_byte_rows(spark):
    texts = ["They're é日本 at https://a.org/s?q=1. now 𝒳y", None, "", "plain 3.14 text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = text.byte_rows(docs).collect()
    assert all(texts[r.doc_id].encode()[r.start : r.end].decode() == r.token for r in rows)
    again = docs.select("doc_id", F.inline(text.byte_spans("text")))
    assert _rows(again) == sorted(map(str, text.byte_rows(docs).select(sorted(again.columns)).collect())) and {r.doc_id for r in rows} == {0, 3}


def test_embedding_many_texts_is_embedding_each():
    texts = ["rust memory systems, rust!", None, "", "a http://x.y/z", "日本語 O'Neil é ß supersonic wing", "x" * 50] * 3
    for n in (8, 64):
        assert vectors.embed_all(pa.array(texts), n).tolist() == [vectors.embed(t, n) for t in texts]


def test_phrases_of_some_texts_are_those_of_all():
    texts = [[["The", "license", "42", "file"], [], ["é", "a", "日本"]], [], [["http://x", "The", "license"]], [["The", "license"]]]
    want = {}
    for t in texts:
        for ws in t:
            for n in (1, 2, 3):
                for i in range(len(ws) - n + 1):
                    if all(map(suggest.usable, ws[i : i + n])):
                        g = " ".join(ws[i : i + n]).lower()
                        want[g] = want.get(g, 0) + 1
    for at, n in ((0, 4), (1, 3), (3, 1)):
        batch = pa.RecordBatch.from_arrays([pa.array([[]] * (4 - n) + texts[at:], pa.list_(pa.list_(pa.string()))).slice(4 - n)], names=["w"])
        got = {}
        for b in suggest._counted_grams(3)([batch]):
            for term, k in zip(*(c.to_pylist() for c in b.columns)):
                got[term] = got.get(term, 0) + k
        assert (got == want) == (at == 0) and got["the license"] == {0: 3, 1: 2, 3: 1}[at]
    assert suggest._token_ends(batch.column(0)).tolist() == [2]
