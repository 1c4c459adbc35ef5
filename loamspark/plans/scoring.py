"""Queries of scores and text forms of chunks: heuristics, task preference, weighted text, titles, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamspark.functions import quality
from loamspark.functions import text as X
from loamspark.operators import answering, ranking
from loamspark.operators.intent import DISCOURAGED, INTENT_CHIPS, INTENT_IGNORED, INTENT_TERMS, PREFERRED, query_intent, task_plan
from loamspark.operators.scoping import CODE_TEXT
from loamspark.plans import sql as S
from loamspark.plans.questions import frame
from loamspark.plans.retrieval import TASK_ROUTE, table
from loamspark.session import materialized

#: Values that the rows below take in turn by doc_id; None is null.
TURNS = {
    "doc_type": ("source_code", "guide", "datasheet", "project_doc", "api_reference", "trm", "build_config", "catalog", "product_catalog", "project_config", None),
    "content_domain": ("project", "docs", None),
    "block_type": ("text", "code", "table", "toc", "formula", "heading", None),
    "symbol_name": (None, "app_main", "gatt_write", "", "Widget"),
    "chip_family": ("esp32", None, "esp32c3", ""),
    "table_parse_confidence": ("low", "high", None),
    "location_label": ("行 1-3", None, ""),
    "source_uri": (None, "main.c", "https://example.org/en/x"),
    "document_title": ("Get Started", "Chip datasheet", "BLE 概述", "build system notes", None, "NimBLE overview"),
    "version": ("v5.1", None, "latest"),
    "said": (
        "NimBLE host stack", "bluedroid classic bluetooth", "sdkconfig and Kconfig", "GATT notify service", "技术规格书", "toolchain with python",
        "component requirements", "programming guide", "plain words", "app_main calls init",
    ),
}
#: White space as the column functions know it, for patterns without a Unicode mode.
SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _lit(value) -> str:
    return "NULL" if value is None else S.text(value)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of all kinds."""
    n = F.col("doc_id")
    turn = lambda values: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        *[turn(values).alias(name) for name, values in TURNS.items()],
        F.when(n % 4 == 1, (n % 300).cast("int")).alias("page_number"),
        F.when(n % 6 == 5, F.array().cast("array<string>")).when(n % 6 == 4, None).otherwise(F.slice(F.array(F.lit("A"), "lang", "source"), 1, (n % 3 + 1).cast("int"))).alias("section_path"),
        F.when(n % 8 == 3, 1).alias("line_start"),
        (n % 9 == 0).alias("is_entrypoint"),
        (n % 4).cast("int").alias("retrieval_priority"),
        F.lit("en").alias("language"),
        F.concat(F.lit("p"), (n % 7).cast("string")).alias("page_label"),
        none.alias("context_before"),
        F.when(n % 5 == 2, "after it").alias("context_after"),
        F.concat_ws(" ", turn(TURNS["said"]), F.coalesce("text", F.lit(""))).alias("content"),
    )


def _turn_sql(name: str) -> str:
    values = TURNS[name]
    return f"[{', '.join(map(_lit, values))}][doc_id % {len(values)} + 1]"


ROWS = f"""
d AS (
  SELECT doc_id, {', '.join(f'{_turn_sql(n)} AS {n}' for n in TURNS)}, CASE WHEN doc_id % 4 = 1 THEN doc_id % 300 END AS page_number,
         CASE WHEN doc_id % 6 = 5 THEN CAST([] AS VARCHAR[]) WHEN doc_id % 6 <> 4 THEN ['A', lang, source][1:doc_id % 3 + 1] END AS section_path,
         CASE WHEN doc_id % 8 = 3 THEN 1 END AS line_start, doc_id % 9 = 0 AS is_entrypoint, doc_id % 4 AS retrieval_priority, 'p' || (doc_id % 7) AS page_label,
         CASE WHEN doc_id % 5 = 2 THEN 'after it' END AS context_after, {_turn_sql('said')} || ' ' || coalesce(text, '') AS content
  FROM documents)"""


# --- heuristics ---------------------------------------------------------------------------------


def heuristic_adjust(spark, sf_dir):
    """The additive rules for every inline question and every row."""
    asked = frame(spark).withColumn("intent", query_intent(F.col("question"))).withColumn("__asked", ranking.sought("asked", F.col("question"), X.lowered(F.col("question"))))
    made = rows(spark, sf_dir).withColumns({"__text": X.lowered(F.col("content")), "__title": X.lowered(F.coalesce("document_title", F.lit("")))})
    made = made.withColumns({"__said": ranking.sought("text", F.col("__text")), "__titled": ranking.sought("title", F.col("__title"))})
    # Kept, or Spark would put what is sought into the rules again, for each pair.
    asked, made = materialized(asked), materialized(made.drop("content", "__title"))
    value = ranking.adjustment(F.col("intent"), F.col("__asked"), F.col("__text"), F.col("__said"), F.col("__titled"))
    return made.join(F.broadcast(asked)).select("question_id", "doc_id", F.round(value, 6).alias("adjustment"))


def adjust_sql(asked: str, chunks: str) -> str:
    """SELECT of question_id, doc_id and the heuristics, from questions and from chunks with their ``weighted`` text."""
    flag = {name: S.any_of("low", terms) for name, terms in INTENT_TERMS.items()}
    words = r"list_distinct(list_filter(regexp_extract_all(question, '[\pL\pM\p{Nd}\p{Pc}]+'), lambda w: regexp_full_match(w, '[a-zA-Z_][a-zA-Z0-9_]{2,}')))"
    hints = f"list_filter({words}, lambda w: contains(w, '_') OR regexp_matches(substr(w, 2), '[A-Z]') OR NOT lower(w) IN ({', '.join(map(S.text, INTENT_IGNORED))}))"
    kinds = lambda of: "flatten([" + ", ".join(f"CASE WHEN {flag[n]} THEN [{', '.join(map(S.text, k))}] ELSE [] END" for n, k in of.items()) + "])"
    chips = f"list_filter([{', '.join(map(S.text, INTENT_CHIPS))}], lambda c: contains(low, c))"
    says, titled = (lambda t: S.any_of("body", t)), (lambda t: S.any_of("title", t))
    asks = lambda t: f"({S.any_of('question', t)} OR {S.any_of('low', t)})"
    add = lambda cond, value, other=0: f"(CASE WHEN coalesce({cond}, false) THEN {value} ELSE {other} END)"
    case = lambda *whens, other="0": "(CASE " + " ".join(f"WHEN coalesce({c}, false) THEN {v}" for c, v in whens) + f" ELSE {other} END)"
    typed = lambda *names: f"doc_type IN ({', '.join(map(S.text, names))})"
    r, code, symbolic = ranking, "(f_code OR f_build)", "coalesce(symbol_name, '') <> ''"
    located = "(coalesce(source_uri, '') <> '' OR coalesce(len(section_path), 0) > 0)"
    rules = [
        add(f"{asks(r.SOFTWARE_ASKED)} AND {says(r.SOFTWARE_TEXT)}", 0.16),
        add(f"{asks(r.SOFTWARE_ASKED)} AND {says(r.SOFTWARE_GUIDES)}", 0.08),
        add(f"{asks(r.SOFTWARE_ASKED)} AND ({titled(['datasheet'])} OR {says(['技术规格书'])})", -0.18),
        add(f"{asks(r.BLE_ONLY)} AND {says(['nimble'])}", 0.18),
        add(f"{asks(r.BLE_ONLY)} AND {says(['bluedroid'])} AND {says(['classic'])}", -0.06),
        add(f"{asks(r.CLASSIC)} AND {says(['bluedroid'])}", 0.16),
        add(f"{asks(r.CLASSIC)} AND {says(['nimble'])}", -0.04),
        add("list_contains(preferred, doc_type)", 0.18),
        add("list_contains(discouraged, doc_type)", -0.18),
        case((f"NOT {code}", 0), (typed(*r.CODE_TYPES), 0.24), (typed("guide", "api_reference"), 0.03), other="-0.16"),
        add("f_code AND content_domain = 'project'", 0.18),
        add(f"NOT {code} AND content_domain = 'project'", -0.36),
        add(f"f_build AND {says(r.CONFIG_TEXT)}", 0.18),
        case(("NOT f_code", 0), (symbolic, f"0.16 + {add(S.any_of(S.low('symbol_name'), r.SYMBOL_TEXT), 0.04)}"), ("block_type = 'code'", 0.04)),
        add("f_code AND doc_type = 'project_doc'", -0.10),
        case(
            ("len(hints) = 0", 0),
            (f"list_contains(list_transform(hints, lambda h: lower(h)), {S.low('symbol_name')})", 0.42),
            ("len(list_filter(hints, lambda h: contains(body, lower(h)))) > 0", 0.16),
            (typed("source_code", "build_config", "project_config"), -0.06),
        ),
        case(("NOT f_bluetooth", 0), (says(r.BLUETOOTH_TEXT), 0.20), other="-0.46"),
        case(("coalesce(chip_family, '') = '' OR len(chips) = 0", 0), ("list_contains(chips, chip_family)", 0.12), other="-0.06"),
        add("f_pdf AND page_number IS NOT NULL", 0.12),
        case(("NOT f_pdf", 0), (typed("datasheet", "trm", "hardware_design", "schematic"), 0.14), (typed("programming_guide_home", "product_catalog", "catalog"), -0.22)),
        add(f"f_locations AND {located}", 0.10),
        add("f_locations AND page_number IS NOT NULL", 0.04),
        add(f"f_exchange AND {says(r.EXAMPLE_TEXT)}", 0.16),
        add(f"f_exchange AND {titled(['概述', 'overview', '架构'])} AND NOT {says(['gatt'])}", -0.08),
        case(("NOT f_exchange", 0), (says(r.EXCHANGE_TEXT), 0.14), other="-0.16"),
        add(f"{asks(r.SETUP_ASKED)} AND ({titled(r.SETUP_TEXT)} OR {says(r.SETUP_TEXT)})", 0.70),
        add(f"{asks(r.SETUP_ASKED)} AND ({titled(['build system'])} OR {says(['component requirements'])})", -0.55),
        add(f"{asks(r.SETUP_ASKED)} AND block_type = 'code'", -0.25),
        add("is_entrypoint AND NOT f_catalog", -0.16),
        case(("coalesce(block_type, '') <> 'formula'", 0), (asks(r.FORMULA_ASKED), 0.08), other="-0.24"),
        case(("NOT coalesce(block_type = 'table' AND table_parse_confidence = 'low', false)", 0), (asks(r.TABLE_ASKED), -0.10), other="-0.04"),
        "retrieval_priority * 0.03",
    ]
    flags = ", ".join(f"{flag[n]} AS f_{n}" for n in ("code", "build", "bluetooth", "locations", "exchange", "catalog"))
    questions = f"SELECT question_id, question, {S.low('question')} AS low FROM {asked}"
    intents = f"SELECT *, {flags}, {flag['pdf']} OR {flag['figures']} AS f_pdf, {hints} AS hints, {kinds(PREFERRED)} AS preferred, {kinds(DISCOURAGED)} AS discouraged, {chips} AS chips FROM ({questions})"
    texts = f"""SELECT *, {S.low('weighted')} AS body, {S.low("coalesce(document_title, '')")} AS title FROM {chunks}"""
    return f"SELECT question_id, doc_id, CAST({' + '.join(rules)} AS DOUBLE) AS adjustment FROM ({intents}), ({texts})"


def _adjust_query() -> str:
    inner = adjust_sql(f"(SELECT question_id, question FROM {S.ASKED})", "(SELECT *, content AS weighted FROM d)")
    return f"WITH {ROWS} SELECT question_id, doc_id, round(adjustment, 6) AS adjustment FROM ({inner})"


def task_rescore(spark, sf_dir):
    """What the task of every inline question adds to the score of every row."""
    asked = frame(spark).select("question_id", task_plan(F.col("question"), 5).alias("plan"))
    return rows(spark, sf_dir).join(F.broadcast(asked)).select("question_id", "doc_id", F.round(answering.task_preference(F.col("plan")), 6).alias("preference"))


def preference_sql(asked: str) -> str:
    """SELECT of question_id, doc_id and the task's preference, from questions with their task and the rows d."""
    head = "concat_ws(' ', document_title, array_to_string(section_path, ' > '), substr(content, 1, 800))"
    head = f"regexp_replace(replace(lower({head}), '\\', '/'), '{SPACE}+', ' ', 'g')"
    coded = f"(coalesce(doc_type IN ({', '.join(map(S.text, ranking.CODE_TYPES))}), false) OR coalesce(block_type = 'code', false) OR coalesce(symbol_name, '') <> '' OR line_start IS NOT NULL OR {S.any_of('head', CODE_TEXT)})"
    return f"""
SELECT question_id, doc_id, CAST(
         CASE WHEN task_type <> 'table_lookup' THEN 0 WHEN block_type = 'table' THEN 0.35 WHEN table_parse_confidence = 'low' THEN -0.05 ELSE 0 END
       + CASE WHEN task_type <> 'book_index' THEN 0 WHEN block_type = 'toc' THEN 0.40 WHEN depth BETWEEN 1 AND 2 THEN 0.08 ELSE 0 END
       + CASE WHEN task_type = 'code_symbol_lookup' AND {coded} THEN 0.25 ELSE 0 END
       + CASE WHEN task_type IN ('book_index', 'table_lookup') AND page_number IS NOT NULL THEN 0.08 ELSE 0 END
       + CASE WHEN task_type IN ('book_index', 'table_lookup', 'code_symbol_lookup') AND (coalesce(location_label, '') <> '' OR depth > 0 OR coalesce(source_uri, '') <> '') THEN 0.06 ELSE 0 END
       AS DOUBLE) AS preference FROM {asked}, (SELECT *, coalesce(len(section_path), 0) AS depth, {head} AS head FROM d)"""


def _rescore_query() -> str:
    routed = TASK_ROUTE[: TASK_ROUTE.index("SELECT question_id, task_type, CASE")].rstrip()
    return f"{routed}, {ROWS} SELECT question_id, doc_id, round(preference, 6) AS preference FROM ({preference_sql('q')})"


# --- text forms -----------------------------------------------------------------------------------


def chunk_texts(spark, sf_dir):
    """Metadata text, weighted text and its hash, and the input of a remote embedding."""
    made = rows(spark, sf_dir)
    return made.select("doc_id", X.metadata_text().alias("metadata"), X.text_hash(X.weighted_text()).alias("weighted_sha256"), F.sha2(X.remote_input(F.col("content")), 256).alias("remote_sha256"))


METADATA = "concat_ws(' ', replace(doc_type, '_', ' '), content_domain, nullif(chip_family, ''), version, 'en', nullif(symbol_name, ''))"
WEIGHTED = f"""concat_ws(chr(10), coalesce(document_title, ''), coalesce(document_title, ''), {METADATA}, coalesce(array_to_string(section_path, ' > '), ''),
              concat_ws(' ', page_label, nullif(location_label, ''), source_uri), coalesce(context_after, ''), content)"""
CHUNK_TEXTS = rf"""
WITH {ROWS},
m AS (SELECT *, {METADATA} AS metadata,
             regexp_replace(regexp_replace(content, '{SPACE}+', ' ', 'g'), '^ | $', '', 'g') AS flat FROM d)
SELECT doc_id, metadata,
       sha256({WEIGHTED}) AS weighted_sha256,
       sha256(CASE WHEN length(flat) > 7500 THEN substr(flat, 1, 5625) || ' ... ' || right(flat, 1855) WHEN flat = '' THEN ' ' ELSE flat END) AS remote_sha256
FROM m"""


#: What the texts below end with, in turn: no mark, a mark that proves a page, one that only cuts, both.
ENDS = ("", "\r\n\r\nWas this page helpful", " \x00© Copyright x", "\n© 版权所有\n\n\n\nPreviousNext y")


def _ended(spark, sf_dir) -> DataFrame:
    end = F.element_at(F.array(*map(F.lit, ENDS)), (F.col("doc_id") % len(ENDS) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.coalesce("text", F.lit("")), end).alias("t"))


def text_forms(spark, sf_dir):
    """Importer normal form, page ends cut, heading and file name cleaned; compatibility forms stay, as SQL cannot fold them."""
    t = F.col("t")
    return _ended(spark, sf_dir).select(
        "doc_id",
        F.sha2(X.import_normalized(t, False), 256).alias("normal_sha256"),
        F.length(X.without_boilerplate(t, False)).cast("long").alias("n_kept"),
        F.sha2(X.without_boilerplate(t, False), 256).alias("kept_sha256"),
        X.heading_text(F.concat(F.substring(t, 1, 40), F.lit(""))).alias("heading"),
        X.safe_filename(F.concat(F.lit("/a b/"), "source", F.lit(" 表/"), F.substring(t, 1, 12), F.lit(".md"))).alias("filename"),
    )


def _text_forms_sql() -> str:
    ends = ", ".join("'" + e.replace("'", "''") + "'" if e.isprintable() else "concat(" + ", ".join(f"chr({ord(c)})" if not c.isprintable() else S.text(c) for c in e) + ")" for e in ENDS)
    stripped = lambda x: f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"
    normal = lambda x: stripped(f"regexp_replace(replace(regexp_replace({x}, '\\r\\n?', chr(10), 'g'), chr(0), ''), '\\n{{3,}}', chr(10) || chr(10), 'g')")
    places = ", ".join(f"nullif(instr(n, {S.text(m)}), 0)" for m in (*X.GUARD_MARKS, *X.CUT_MARKS))
    base = "regexp_extract('/a b/' || source || ' 表/' || substr(t, 1, 12) || '.md', '([^/]*)/*$', 1)"
    return f"""
WITH e AS (SELECT doc_id, source, coalesce(text, '') || [{ends}][doc_id % {len(ENDS)} + 1] AS t FROM documents),
b AS (SELECT *, {normal('t')} AS n FROM e),
k AS (SELECT *, CASE WHEN {S.any_of('n', X.GUARD_MARKS)} THEN {normal(f'substr(n, 1, CAST(least({places}) - 1 AS INT))')} ELSE n END AS kept FROM b)
SELECT doc_id, sha256(n) AS normal_sha256, length(kept) AS n_kept, sha256(kept) AS kept_sha256, {stripped(f"regexp_replace(substr(t, 1, 40), '{SPACE}+', ' ', 'g')")} AS heading,
       regexp_replace({base}, '[^a-zA-Z0-9._-]+', '_', 'g') AS filename
FROM k"""


READABILITY = rf"""
WITH n AS (SELECT doc_id, regexp_replace(text, '{SPACE}+', '', 'g') AS dense FROM documents),
g AS (SELECT doc_id, length(dense) AS n, length(regexp_replace(dense, '{X.ODD.replace("'", "''")}', '', 'g')) AS good FROM n)
SELECT doc_id, CASE WHEN n > 0 THEN round(good / n, 6) ELSE 0.0 END AS readability FROM g"""


# --- titles and tables ------------------------------------------------------------------------------

#: What titles begin with, in turn.
HEADS = ("第3章 ", "第 十二 节 ", "2.1 ", "1.2.3.4.5.6.7 ", "Chapter 4 ", "section 9 ", "", "**`## ", "a | b ", "f(x) = {", "if (x) ", "== 12 - ", "SRCS ", "${X}")
WHOLE = ("前言", "第2版 前言", "----", "", "项目 project(")


def section_titles(spark, sf_dir):
    """Whether titles may stand in a path, and the level that their numbering states; 0 for none."""
    n = F.col("doc_id")
    head = F.element_at(F.array(*map(F.lit, HEADS)), (n % len(HEADS) + 1).cast("int"))
    whole = F.element_at(F.array(*map(F.lit, WHOLE)), (n % len(WHOLE) + 1).cast("int"))
    title = F.when(n % 6 == 0, whole).otherwise(F.concat(head, F.substring(F.coalesce("text", F.lit("")), F.lit(1), (n % 90).cast("int"))))
    rows = table(spark, sf_dir, "documents").select("doc_id", title.alias("t"))
    return rows.select("doc_id", quality.is_section_title(F.col("t")).alias("accepted"), F.coalesce(quality.heading_level(F.col("t")), F.lit(0)).cast("long").alias("level"))


def _titles_sql() -> str:
    flat = lambda x: f"regexp_replace(regexp_replace({x}, '{SPACE}+', ' ', 'g'), '^ | $', '', 'g')"
    # A word boundary behind a CJK character is stated for letters of any script.
    pattern = lambda p: S.text(p.replace("章\\b", "章(?:[^\\pL\\pN_]|$)").replace("节\\b", "节(?:[^\\pL\\pN_]|$)"))
    named = " ".join(f"WHEN regexp_matches(c, {pattern(p)}) THEN {k}" for k, p in quality.TITLE_LEVELS)
    worded = " ".join(f"WHEN regexp_matches(c, {pattern(p)}, 'i') THEN {k}" for k, p in quality.NAMED_LEVELS)
    number = f"regexp_extract(c, {S.text(quality.TITLE_NUMBER)}, 1)"
    matches = lambda column, patterns: " OR ".join(f"regexp_matches({column}, {S.text(p)})" for p in patterns)
    lists = lambda values: f"[{', '.join(map(S.text, values))}][doc_id % {len(values)} + 1]"
    return f"""
WITH r AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN {lists(WHOLE)} ELSE {lists(HEADS)} || substr(coalesce(text, ''), 1, CAST(doc_id % 90 AS INT)) END AS t FROM documents),
b AS (SELECT doc_id, {flat('t')} AS c, {flat("regexp_replace(t, '[*`#]+', '', 'g')")} AS bare FROM r),
f AS (SELECT *, lower(bare) AS low FROM b)
SELECT doc_id, NOT (bare = '' OR length(bare) > {quality.LONGEST_TITLE} OR {S.any_of('low', quality.CODE_MARKS)}
       OR (regexp_matches(bare, {S.text(quality.CODE_SIGNS)}) AND NOT regexp_matches(bare, {S.text(quality.NUMBERED)}))
       OR {matches('low', quality.REFUSED_LOWER)} OR {matches('bare', quality.REFUSED_TITLES)}) AS accepted,
       CAST(CASE {named} WHEN {number} <> '' THEN least(len(string_split({number}, '.')), 6) {worded} ELSE 0 END AS BIGINT) AS level
FROM f"""


def _tables(spark, sf_dir) -> DataFrame:
    """Lines of documents as table rows: their words in columns, some tables broken."""
    text = F.coalesce("text", F.lit(""))
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 6), lambda x: F.concat(F.lit("| "), F.array_join(F.slice(F.split(x, " "), 1, 4), " | "), F.lit(" |")))
    packed = F.when(F.col("doc_id") % 5 == 1, F.lit("\n| 1.5 2.5 3.5 4.5 a b c d | x |")).when(F.col("doc_id") % 5 == 2, F.lit("\nCol1|")).otherwise(F.lit(""))
    rule = F.when(F.col("doc_id") % 2 == 0, F.lit("|---|---|\n")).otherwise(F.lit(""))
    made = F.when(F.col("doc_id") % 7 == 0, F.regexp_replace(text, r"\|", "")).otherwise(F.concat(rule, F.array_join(lines, "\n"), packed))
    return table(spark, sf_dir, "documents").select("doc_id", "source", made.alias("t"))


def table_confidence(spark, sf_dir):
    t = F.col("t")
    return _tables(spark, sf_dir).select("doc_id", quality.is_bad_table(t).alias("bad"), quality.table_confidence(t).alias("confidence"))


TABLE_CONFIDENCE = rf"""
WITH s AS (
  SELECT doc_id, coalesce(text, '') AS text, list_transform(string_split(coalesce(text, ''), chr(10))[1:6], lambda x: '| ' || array_to_string(string_split(x, ' ')[1:4], ' | ') || ' |') AS ls FROM documents),
m AS (
  SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN replace(text, '|', '')
    ELSE CASE WHEN doc_id % 2 = 0 THEN '|---|---|' || chr(10) ELSE '' END || array_to_string(ls, chr(10))
         || CASE doc_id % 5 WHEN 1 THEN chr(10) || '| 1.5 2.5 3.5 4.5 a b c d | x |' WHEN 2 THEN chr(10) || 'Col1|' ELSE '' END END AS t FROM s),
l AS (
  SELECT doc_id, t, list_filter(list_transform(string_split_regex(t, '\r\n|[\n\r]'), lambda x: regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')),
                                lambda x: contains(x, '|') AND NOT regexp_matches(x, '{quality.SEPARATOR}')) AS ls,
         regexp_extract_all(t, '[\pL\pM\p{{Nd}}\p{{Pc}}\x{{4e00}}-\x{{9fff}}.+/-]+') AS toks, length(t) - length(replace(t, '|', '')) AS bars FROM m),
c AS (SELECT *, flatten(list_transform(ls, lambda x: string_split(regexp_replace(x, '^\|+|\|+$', '', 'g'), '|'))) AS cs, list_distinct(list_transform(ls, lambda x: length(x) - length(replace(x, '|', '')))) AS widths FROM l),
j AS (
  SELECT *, contains(t, '|') AND (
           {S.any_of('t', quality.TABLE_MARKS)} OR (bars > 20 AND len(list_distinct(toks)) < 20) OR len(cs) = 0
           OR (len(cs) >= 12 AND len(list_filter(cs, lambda x: regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g') <> '')) / len(cs) < 0.35)
           OR (bars > 12 AND len(list_filter(toks, lambda k: regexp_matches(k, '[A-Za-z\x{{4e00}}-\x{{9fff}}]'))) <= 3 AND len(list_filter(toks, lambda k: regexp_matches(k, '^\d+(?:\.\d+)?$'))) >= 8)) AS bad,
         len(list_filter(cs, lambda x: len(regexp_extract_all(x, '{quality.CELL_TOKEN}')) >= 8
             AND len(list_filter(regexp_extract_all(x, '{quality.CELL_TOKEN}'), lambda k: regexp_matches(k, '\d'))) >= 4)) > 0 AS packed FROM c)
SELECT doc_id, bad, CASE WHEN bad OR len(ls) < 2 OR len(widths) > 2 OR packed THEN 'low' WHEN len(ls) >= 3 AND len(widths) = 1 THEN 'high' ELSE 'medium' END AS confidence FROM j"""


QUERIES = {f.__name__: f for f in (heuristic_adjust, task_rescore, chunk_texts, text_forms, section_titles, table_confidence)}
ORACLE_SQL = {
    "heuristic_adjust": _adjust_query(),
    "task_rescore": _rescore_query(),
    "chunk_texts": CHUNK_TEXTS,
    "text_forms": _text_forms_sql(),
    "readability_scores": READABILITY,
    "section_titles": _titles_sql(),
    "table_confidence": TABLE_CONFIDENCE,
}
