"""DuckDB SQL for the corpus queries that SQL expresses.

The others have none: they need XXH64, merges, alignments, a network, a knapsack, a binary search or offsets of pattern
matches. Tests hold those against brute force, the library, exact round trips or held-out accuracy.
"""

from __future__ import annotations

from quirion.llm import pipeline
from quirion.llm.line_dedup import FRINGE, LEAST, PASSAGE

#: Unicode white space, for a dialect that knows the ASCII kind only.
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _words(e: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({e}), '{_WS}'), lambda w: w <> '')"


_UNITS = r"[^.,;:!?\n]*[.,;:!?]+|[^.,;:!?\n]+|\n"


def _same(a: str, b: str) -> str:
    """How many elements two lists share from their start."""
    equal = f"list_transform(range(1, least(len({a}), len({b})) + 1), lambda i: {a}[i] = {b}[i])"
    return f"CAST(coalesce(nullif(list_position({equal}, false), 0) - 1, least(len({a}), len({b}))) AS BIGINT)"


# Here neighbouring words are compared themselves, where the operator compares their marks.
_LINE_DEDUP = f"""
WITH parts AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_UNITS}')) AS txt, generate_subscripts(regexp_extract_all(text, '{_UNITS}'), 1) AS nth FROM documents),
split_ AS (SELECT doc_id, nth, txt, {_words("txt")} AS words FROM parts),
placed AS (SELECT *, CAST(sum(length(txt)) OVER w - length(txt) AS BIGINT) AS at_, CAST(sum(len(words)) OVER w - len(words) AS BIGINT) AS word FROM split_ WINDOW w AS (PARTITION BY doc_id ORDER BY nth)),
texts AS (SELECT doc_id, flatten(list(words ORDER BY nth)) AS ws FROM placed GROUP BY doc_id),
units AS (
  SELECT p.doc_id, at_, at_ + length(txt) AS until_, word, len(words) AS n, array_to_string(words, ' ') AS norm,
    list_reverse(ws[greatest(1, word - {FRINGE} + 1):word]) AS before_, ws[word + len(words) + 1:word + len(words) + {FRINGE}] AS after_
  FROM placed p JOIN texts t ON p.doc_id IS NOT DISTINCT FROM t.doc_id WHERE len(words) >= {LEAST}),
least_ AS (SELECT norm, min({{'last': doc_id IS NULL, 'id': doc_id, 'at_': at_}}) AS f FROM units GROUP BY norm HAVING count(*) > 1),
firsts AS (SELECT u.* FROM units u JOIN least_ l ON u.norm = l.norm AND u.doc_id IS NOT DISTINCT FROM l.f.id AND u.at_ = l.f.at_),
repeated AS (
  SELECT u.*, f.doc_id AS first_doc_id, f.at_ AS first_start, {_same("u.before_", "f.before_")} AS p, {_same("u.after_", "f.after_")} AS q
  FROM units u JOIN firsts f ON u.norm = f.norm WHERE NOT (u.doc_id IS NOT DISTINCT FROM f.doc_id AND u.at_ = f.at_)),
steps AS (
  SELECT *, CASE WHEN word - lag(word + n) OVER w <= lag(q) OVER w + p THEN 0 ELSE 1 END AS new_
  FROM repeated WINDOW w AS (PARTITION BY doc_id ORDER BY at_)),
runs AS (SELECT *, sum(new_) OVER (PARTITION BY doc_id ORDER BY at_) AS run FROM steps),
passages AS (
  SELECT doc_id, min(at_) AS "start", max(until_) AS "end", max(word + n) - min(word) AS n_words, max(word + n) - min(word) + arg_min(p, at_) + arg_max(q, at_) AS shared_words,
    count(*) AS n_units, arg_min(first_doc_id, at_) AS first_doc_id, arg_min(first_start, at_) AS first_start
  FROM runs GROUP BY doc_id, run)
SELECT doc_id, "start", "end", CAST(n_words AS BIGINT) AS n_words, CAST(shared_words AS BIGINT) AS shared_words, n_units, first_doc_id, first_start FROM passages WHERE shared_words >= {PASSAGE}
"""


def oracle_sql() -> dict[str, str]:
    found = {"op8_line_dedup": _LINE_DEDUP}
    return found | ({"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {})
