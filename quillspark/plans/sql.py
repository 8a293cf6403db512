"""DuckDB SQL of the registered queries: the analysis of text, Porter's stems included, as common table expressions."""

from __future__ import annotations

from ..functions.text import _STEP2, _STEP3, _STEP4, STOP_WORDS

_RE = "(?:https?|ftp)://[^\\s\\p{Z}<>\"'')\\]}]*|\\p{L}(?:[''’]\\p{L}|[\\p{L}\\p{N}])*|[0-9](?:[.,]?[0-9])*"
_URL = "'^(?:https?|ftp)://'"


def terms(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '{_RE}'), lambda t: CASE WHEN regexp_matches(t, {_URL}) THEN regexp_replace(t, '[.,?!]+$', '') ELSE lower(t) END)"


_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_P = "^(?:[^aeiou][^aeiouy]*[aeiouy]|[aeiou])"


def _m(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def _vowel(x):
    return _m(x, _P)


def _m0(x):
    return _m(x, f"{_P}[aeiou]*{_C}")


def _m1(x):
    return _m(x, f"{_P}[aeiou]*{_C}(?:{_V})?$")


def _m2(x):
    return _m(x, f"{_P}[aeiou]*{_C}{_V}[^aeiou]")


def _cvc(x):
    return _m(x, "[^aeiou][aeiouy][^aeiouwxy]$")


def _l(n):
    return f"left(w, length(w) - {n})"


def _rules(rules, ok) -> str:
    return "CASE " + " ".join(f"WHEN ends_with(w, '{s}') AND {ok(_l(len(s)))} THEN {_l(len(s))} || '{n}'" for s, n in rules) + " ELSE w END"


def stems(source: str) -> str:
    """CTEs that end in stems(t, term): the stem of each distinct t of ``source``."""
    two = [tuple(r.split(":")) for r in _STEP2.split()]
    three = [tuple(r.split(":")) for r in _STEP3.split()]
    four = "CASE WHEN ends_with(w, 'ion') AND (ends_with(" + _l(3) + ", 's') OR ends_with(" + _l(3) + ", 't')) AND " + _m2(_l(3)) + f" THEN {_l(3)} " + _rules([(s, "") for s in _STEP4.split()], _m2)[5:]
    steps = [
        f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {_l(2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {_l(1)} ELSE w END AS w, false AS cut",
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_m0(_l(3))} THEN {_l(1)} ELSE w END WHEN ends_with(w, 'ed') AND {_vowel(_l(2))} THEN {_l(2)} WHEN ends_with(w, 'ing') AND {_vowel(_l(3))} THEN {_l(3)} ELSE w END AS w, "
        f"NOT ends_with(w, 'eed') AND ((ends_with(w, 'ed') AND {_vowel(_l(2))}) OR (ends_with(w, 'ing') AND {_vowel(_l(3))})) AS cut",
        f"CASE WHEN NOT cut THEN w WHEN ends_with(w, 'at') OR ends_with(w, 'bl') OR ends_with(w, 'iz') THEN w || 'e' WHEN length(w) > 1 AND right(w, 1) = left(right(w, 2), 1) AND right(w, 1) NOT IN ('a', 'e', 'i', 'o', 'u', 'l', 's', 'z') THEN {_l(1)} "
        f"WHEN {_m1('w')} AND {_cvc('w')} AND NOT (length(w) > 1 AND right(w, 1) = left(right(w, 2), 1) AND right(w, 1) NOT IN ('a', 'e', 'i', 'o', 'u') AND right(w, 1) NOT IN ('l', 's', 'z')) THEN w || 'e' ELSE w END AS w, false AS cut",
        f"CASE WHEN ends_with(w, 'y') AND {_vowel(_l(1))} THEN {_l(1)} || 'i' ELSE w END AS w, false AS cut",
        f"{_rules(two, _m0)} AS w, false AS cut",
        f"{_rules(three, _m0)} AS w, false AS cut",
        f"{four} AS w, false AS cut",
        f"CASE WHEN ends_with(w, 'e') AND ({_m2(_l(1))} OR ({_m1(_l(1))} AND NOT {_cvc(_l(1))})) THEN {_l(1)} ELSE w END AS w, false AS cut",
        f"CASE WHEN ends_with(w, 'll') AND {_m2(_l(1))} THEN {_l(1)} ELSE w END AS w, false AS cut",
    ]
    out = f"p0 AS (SELECT t, t AS w, false AS cut FROM (SELECT DISTINCT t FROM {source}) WHERE length(t) > 2 AND regexp_full_match(t, '[\\p{{L}}''’]+'))"
    for k, s in enumerate(steps, 1):
        out += f", p{k} AS (SELECT t, {s} FROM p{k - 1})"
    return out + f", stems AS MATERIALIZED (SELECT d.t, coalesce(p.w, d.t) AS term FROM (SELECT DISTINCT t FROM {source}) d LEFT JOIN p{len(steps)} p ON p.t = d.t)"


def rows(extra: str = "") -> str:
    """rows(doc_id, pos, term) of the documents; ``extra`` adds SELECTs of more (text words) to the stemmed vocabulary."""
    more = f" UNION ALL {extra}" if extra else ""
    return (f"tok AS MATERIALIZED (SELECT doc_id, unnest(range(len(ts))) AS pos, unnest(ts) AS t FROM (SELECT doc_id, {terms('text')} AS ts FROM documents)), words AS (SELECT t FROM tok{more}), "
            f"{stems('words')}, rows AS MATERIALIZED (SELECT doc_id, pos, term FROM tok JOIN stems USING (t))")


def tf(extra: str = "") -> str:
    return f"{rows(extra)}, tf AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf FROM rows GROUP BY 1, 2), lens AS (SELECT doc_id, len({terms('text')}) AS len FROM documents)"


def voc(extra: str = "") -> str:
    return f"{tf(extra)}, voc AS MATERIALIZED (SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM tf GROUP BY 1)"


N = "(SELECT count(*) FROM documents)"


def idf(df: str, n: str = N) -> str:
    return f"ln(({n} - {df} + 0.5) / ({df} + 0.5) + 1)"


def listed(words: list[str]) -> str:
    """(query_id, t, w) of one query's words."""
    return " UNION ALL ".join(f"SELECT 1 AS query_id, '{w}' AS t, 1.0 AS w" for w in words)


def bm25(asked: str) -> str:
    """sc(query_id, doc_id, score) for asked(query_id, t, w)."""
    return (f"asked AS ({asked}), {voc('SELECT t FROM asked')}, wanted AS (SELECT DISTINCT query_id, term, w FROM asked JOIN stems USING (t)), {score()}")


def score(wanted: str = "wanted", out: str = "sc") -> str:
    return (f"{out} AS MATERIALIZED (SELECT w.query_id, tf.doc_id, sum(w.w * {idf('voc.df')} * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * lens.len / (SELECT avg(len) FROM lens)))) AS score "
            f"FROM tf JOIN {wanted} w USING (term) JOIN voc USING (term) JOIN lens USING (doc_id) GROUP BY 1, 2)")


def top(k: int, n: int = 9, out: int = 6, src: str = "sc") -> str:
    return (f"SELECT query_id, doc_id, round(score, {out}) AS score, rank::INT AS rank FROM (SELECT query_id, doc_id, round(score, {n}) AS score, "
            f"row_number() OVER (PARTITION BY query_id ORDER BY round(score, {n}) DESC, doc_id) AS rank FROM {src}) WHERE rank <= {k}")


_PARTS = ("SELECT doc_id, 'title' AS field, split_part(text, chr(10), 1) AS text FROM documents UNION ALL SELECT doc_id, 'body', substr(text, length(split_part(text, chr(10), 1)) + 2) FROM documents "
          "UNION ALL SELECT doc_id, 'anchor', source FROM documents")


def field_tf(extra: str = "") -> str:
    """ftf(field, term, doc_id, tf) and flens(field, doc_id, len)."""
    more = f" UNION ALL {extra}" if extra else ""
    return (f"parts AS MATERIALIZED (SELECT doc_id, field, {terms('text')} AS ts FROM ({_PARTS}) WHERE length(trim(text)) > 0), ftok AS MATERIALIZED (SELECT doc_id, field, unnest(ts) AS t FROM parts), words AS (SELECT t FROM ftok{more}), "
            f"{stems('words')}, ftf AS MATERIALIZED (SELECT field, term, doc_id, count(*) AS tf FROM ftok JOIN stems USING (t) GROUP BY 1, 2, 3), flens AS (SELECT field, doc_id, len(ts) AS len FROM parts)")


def bm25f(asked: str) -> str:
    return (f"asked AS ({asked}), {field_tf('SELECT t FROM asked')}, wanted AS (SELECT DISTINCT query_id, term, w FROM asked JOIN stems USING (t)), {score_f()}")


def score_f(wanted: str = "wanted", out: str = "sc") -> str:
    w = "CASE ftf.field WHEN 'title' THEN 4.0 WHEN 'body' THEN 1.0 ELSE 2.5 END"
    b = "CASE ftf.field WHEN 'title' THEN 0.5 WHEN 'body' THEN 0.75 ELSE 0.6 END"
    return (f"favg AS (SELECT field, avg(len) AS av FROM flens GROUP BY 1), soft AS MATERIALIZED (SELECT term, doc_id, sum({w} * tf / (1 - {b} + {b} * len / av)) AS x FROM ftf JOIN flens USING (field, doc_id) JOIN favg USING (field) GROUP BY 1, 2), "
            f"fdf AS MATERIALIZED (SELECT term, count(DISTINCT doc_id) AS df FROM ftf GROUP BY 1), {out} AS MATERIALIZED (SELECT w.query_id, soft.doc_id, sum(w.w * {idf('fdf.df')} * x * 2.2 / (1.2 + x)) AS score FROM soft JOIN {wanted} w USING (term) JOIN fdf USING (term) GROUP BY 1, 2)")


def stop_terms() -> str:
    """SELECT of the stop words as t."""
    return "SELECT unnest([" + ", ".join(f"'{w}'" for w in sorted(STOP_WORDS)) + "]) AS t"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"


def neighbours(where: str) -> str:
    """kt(query_id, doc_id, score, rank) of the vectors that ``where`` picks from q."""
    return (f"kn AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(greatest(-1.0, least(1.0, {dot('v.embedding', 'q.embedding')} / (sqrt({dot('v.embedding', 'v.embedding')}) * sqrt({dot('q.embedding', 'q.embedding')})))), 12) AS score "
            f"FROM embeddings v CROSS JOIN embeddings q WHERE {where}), kt AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM kn)")


def grams(text: str, source: str, most: int, weight: int, boundaries: bool = True) -> str:
    """SELECT of (term, tf, df) of words and phrases."""
    usable = "(NOT starts_with(w, 'http') AND NOT regexp_full_match(w, '[0-9]+') AND strlen(w) >= 2)"
    if boundaries:
        cut = f"unnest(string_split(regexp_replace(coalesce({text}, ''), '({_RE})|[.!?\\n]', chr(1) || '\\1' || chr(2), 'g'), chr(1) || chr(2)))"
        words = "regexp_extract_all(p, '\\x01([^\\x02]*)\\x02', 1)"
    else:
        cut, words = f"coalesce({text}, '')", f"regexp_extract_all(p, '{_RE}')"
    fix = f"list_transform({words}, lambda w: CASE WHEN regexp_matches(w, {_URL}) THEN regexp_replace(w, '[.,?!]+$', '') ELSE w END)"
    tagged = f"SELECT list_transform({fix}, lambda w: {{'w': lower(w), 'ok': {usable}}}) AS ws FROM (SELECT {cut} AS p FROM {source})"
    one = " UNION ALL ".join(f"SELECT unnest(list_transform(list_filter(list_transform(range(1, len(ws) - {n} + 2), lambda i: ws[i:i + {n - 1}]), lambda g: list_bool_and(list_transform(g, lambda e: e.ok))), lambda g: array_to_string(list_transform(g, lambda e: e.w), ' '))) AS term FROM tagged WHERE len(ws) >= {n}" for n in range(1, most + 1))
    return f"(WITH tagged AS MATERIALIZED ({tagged}) SELECT term, count(*) * {weight} AS tf, count(*) AS df FROM ({one}) GROUP BY 1)"
