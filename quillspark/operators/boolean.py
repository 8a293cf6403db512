"""Boolean queries: lexer, parser, and a compiler to one filter over per-document flags."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import analyze, raw_spans


class QueryError(ValueError):
    """A query that can't be parsed; ``kind`` is empty, quote, parenthesis, token or end."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


@dataclass(frozen=True)
class Node:
    kind: str  # term, phrase, prefix, and, or, not
    value: str = ""
    kids: tuple["Node", ...] = ()


_LEX = re.compile(r'\s*(?:(?P<p>[()])|"(?P<q>[^"]*)(?P<qe>"?)|(?P<a>&&)|(?P<o>\|\|)|(?P<n>!|-)|(?P<w>(?:(?!&&|\|\|)[^\s()"!])+))')


def lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise QueryError("token", f"unexpected text at {at}")
        if m["q"] is not None and not m["qe"]:
            raise QueryError("quote", f"unclosed quote at {m.start('q') - 1}")
        if m["p"]:
            out.append((m["p"], m["p"]))
        elif m["q"] is not None:
            out.append(("phrase", m["q"].strip()))
        elif m["w"]:
            w = m["w"]
            kind = w.lower() if w.lower() in ("and", "or", "not") else "prefix" if w.endswith("*") else "term"
            out.append((kind, w[:-1] if kind == "prefix" else w))
        else:
            kind = "and" if m["a"] else "or" if m["o"] else "not"
            out.append((kind, kind))
        at = m.end()
    return out


def parse(text: str) -> Node:
    """OR binds weakest, then AND, written or implied, then NOT."""
    toks = lex(text)
    if not toks:
        raise QueryError("empty", "empty query")
    at = 0

    def peek():
        return toks[at][0] if at < len(toks) else ""

    def many(kind: str, part) -> Node:
        nonlocal at
        kids = [part()]
        while peek() == kind or kind == "and" and peek() in ("term", "phrase", "prefix", "not", "("):
            at += peek() == kind
            kids.append(part())
        return kids[0] if len(kids) == 1 else Node(kind, kids=tuple(kids))

    def unary() -> Node:
        nonlocal at
        kind = peek()
        if not kind:
            raise QueryError("end", "unexpected end of query")
        value = toks[at][1]
        at += 1
        if kind == "not":
            return Node("not", kids=(unary(),))
        if kind == "(":
            inner = either()
            if peek() != ")":
                raise QueryError("parenthesis", "unmatched parenthesis")
            at += 1
            return inner
        if kind in ("term", "phrase", "prefix"):
            return Node(kind, value)
        raise QueryError("token", f"unexpected {value}")

    def either() -> Node:
        return many("or", lambda: many("and", unary))

    tree = either()
    if at < len(toks):
        raise QueryError("token", f"unexpected {toks[at][1]}")
    return tree


def phrase(index, words: list[str]) -> DataFrame:
    """Documents where the words follow one another: equal starts after each word's offset is taken off."""
    wanted = F.array(*[F.struct(F.lit(w).alias("term"), F.lit(k).alias("k")) for k, w in enumerate(words)])
    rows = index.postings.filter(F.col("term").isin(words)).select("doc_id", "term", F.explode("positions").alias("pos"))
    hits = rows.select("doc_id", "pos", "term", F.explode(wanted).alias("w")).filter(F.col("w.term") == F.col("term"))
    starts = hits.groupBy("doc_id", (F.col("pos") - F.col("w.k")).alias("start")).agg(F.countDistinct("w.k").alias("n"))
    return starts.filter(F.col("n") == len(words)).select("doc_id").distinct()


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    """The postings of ``left`` whose documents ``right`` has."""
    return left.join(right.select("doc_id").distinct(), "doc_id", "left_semi")


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """The postings of both, ``left``'s where both have a document."""
    return left.unionByName(right.join(left.select("doc_id").distinct(), "doc_id", "left_anti"))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right.select("doc_id").distinct(), "doc_id", "left_anti")


def run(tree: Node | str, index) -> DataFrame:
    """doc_ids that match. One pass over the postings sets a flag for each word and prefix; phrases join on their words' positions.

    Words and phrases go through the analysis of the index: a word that gives several terms counts with its first. Prefixes are only
    lowered; they meet the terms as they are in the index. A word without any term matches nothing.
    """
    tree = parse(tree) if isinstance(tree, str) else tree
    words_of = analyze if index.stemmed else lambda s: [t.lower() if "://" not in t else t for t, _, _ in raw_spans(s)]
    docs = index.doc_ids()
    flags: dict[str, Column] = {}
    phrases: dict[str, list[str]] = {}

    def leaf(n: Node) -> Column:
        name = f"f{len(flags) + len(phrases)}"
        words = words_of(n.value)
        if n.kind == "phrase" and len(words) > 1:
            phrases[name] = words
        elif n.kind == "prefix":
            flags[name] = F.col("term").startswith(n.value.strip().lower())
        else:
            flags[name] = F.col("term") == (words[0] if words else "")
        return F.coalesce(F.col(name), F.lit(False))

    def build(n: Node) -> Column:
        if n.kind == "not":
            return ~build(n.kids[0])
        if n.kind in ("and", "or"):
            out = build(n.kids[0])
            for k in n.kids[1:]:
                out = out & build(k) if n.kind == "and" else out | build(k)
            return out
        return leaf(n)

    test = build(tree)
    out = docs.select("doc_id")
    if flags:
        wanted = None
        for c in flags.values():
            wanted = c if wanted is None else wanted | c
        hit = index.frequencies.select("term", "doc_id").filter(wanted).groupBy("doc_id").agg(*[F.bool_or(c).alias(n) for n, c in flags.items()])
        out = out.join(hit, "doc_id", "left")
    for name, words in phrases.items():
        out = out.join(phrase(index, words).withColumn(name, F.lit(True)), "doc_id", "left")
    return out.filter(test).select("doc_id")
