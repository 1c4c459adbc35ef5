"""Pieces of DuckDB SQL that say what the column functions say."""

from __future__ import annotations

from loamspark.functions.text import TERM_GROUPS
from loamspark.plans.questions import values_sql


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def any_of(expr: str, terms) -> str:
    return "(" + " OR ".join(f"contains({expr}, {text(t)})" for t in terms) + ")"


def stem(t: str) -> str:
    rules = (("ing", 4), ("ed", 3), ("es", 3), ("s", 2))
    cases = " ".join(f"WHEN length({t}) > {n} AND suffix({t}, '{s}') THEN left({t}, length({t}) - {len(s)})" for s, n in rules)
    return f"CASE {cases} ELSE {t} END"


def low(expr: str) -> str:
    return f"replace(lower({expr}), '®', ' ')"


def latin(expr: str) -> str:
    return f"list_filter(flatten(list_transform(regexp_extract_all({low(expr)}, '[a-z0-9_./+-]+'), lambda t: [t, {stem('t')}])), lambda t: t <> '')"


def cjk(expr: str) -> str:
    runs = f"regexp_extract_all({expr}, '[\\x{{4e00}}-\\x{{9fff}}]+')"
    singles = "list_transform(generate_series(1, length(r)), lambda i: substr(r, CAST(i AS INT), 1))"
    pairs = "list_transform(generate_series(1, length(r) - 1), lambda i: substr(r, CAST(i AS INT), 2))"
    return f"flatten(list_transform({runs}, lambda r: list_concat({singles}, {pairs})))"


def expansions(expr: str) -> str:
    groups = ", ".join(f"CASE WHEN {any_of(low(expr), g)} OR {any_of(expr, g)} THEN [{', '.join(map(text, g))}] ELSE [] END" for g in TERM_GROUPS)
    return f"list_reduce([{groups}], lambda a, b: list_concat(a, list_filter(b, lambda x: NOT list_contains(a, x))))"


def tokens(expr: str, expanded: str) -> str:
    """Tokens of a text with its expansions, which are a column of their own."""
    merged = f"(CASE WHEN len({expanded}) = 0 THEN {expr} ELSE {expr} || chr(10) || array_to_string({expanded}, ' ') END)"
    return f"list_concat({latin(merged)}, {cjk(merged)})"


def bm25(postings: str, lengths: str, asked: str) -> str:
    """question_id, chunk_id, score of all matches, from relations of the index and of question tokens."""
    return f"""
  SELECT question_id, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5
         / (tf + 1.5 * (1 - 0.75 + 0.75 * (CASE WHEN dl = 0 THEN 1 ELSE dl END) / greatest(avgdl, 1.0)))), 9) AS score
  FROM {postings} p JOIN {asked} a USING (token) JOIN (SELECT token, count(*) AS df FROM {postings} GROUP BY token) USING (token)
  JOIN {lengths} USING (chunk_id), (SELECT count(*) AS n, avg(dl) AS avgdl FROM {lengths})
  GROUP BY question_id, chunk_id"""


ASKED = values_sql()
#: Index over whole documents by Latin tokens, and benchmark items as questions.
INDEX = f"""
dt AS (SELECT doc_id AS chunk_id, {latin("coalesce(text, '')")} AS ts FROM documents),
postings AS (SELECT token, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(ts) AS token FROM dt) GROUP BY token, chunk_id),
lengths AS (SELECT chunk_id, CAST(len(ts) AS BIGINT) AS dl FROM dt)"""
ITEMS = f"""
asked AS (SELECT question_id, token, count(*) AS qtf FROM (SELECT item_id AS question_id, unnest({latin("text")}) AS token FROM benchmark) GROUP BY question_id, token)"""
