"""Reports of issues and metadata of named documents: queries with planted names, and SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamspark.functions import metadata, quality
from loamspark.plans import sql as S
from loamspark.plans.maintenance import table
from loamspark.plans.scoring import SPACE

#: Names, titles and formats that pages take in turn, one for each rule of the metadata and some that two rules claim.
FILES = (
    "chip_datasheet_en.pdf", "CMakeLists.txt", "main.c", "20240102030405_notes.md", "settings.yaml", "board_sch.pdf", "readme.md", "x/y/Kconfig", "产品.html", "catalog_2024.pdf",
    "guide v5.1.2.md", "技术参考手册.pdf", "esptool notes.txt", "plain.txt", "a\\b\\sdkconfig", "latest.json",
)
TITLES = (
    "ESP-IDF 编程指南 - ESP32-C3", "ESP32 硬件参考", "文档入口", "Hardware Design Guidelines", "安全概述", "a title", "快速入门", "DevKit board", "资料导入总览", "The API of it",
    "Datasheet", "stable release", "[English] words", "架构", None, "",
)
FORMATS = ("web", "code", "text", "markdown", "pdf")


def _turn(values: tuple, n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def metadata_derive(spark, sf_dir):
    """Metadata of pages under names and titles that every rule claims in turn."""
    n = F.col("page_id")
    named = table(spark, sf_dir, "pages").select("page_id", "url", _turn(FILES, n).alias("filename"), _turn(TITLES, F.floor(n / 3)).alias("title"), _turn(FORMATS, n).alias("format"), (n % 4).cast("int").alias("chunks"))
    m = metadata.document_metadata(F.col("filename"), F.col("title"), F.concat(F.lit("/in/"), "filename"), F.col("url"), F.col("format"), F.col("chunks"))
    return named.select("page_id", m.alias("m")).select("page_id", "m.*")


def _list(values: tuple) -> str:
    return "[" + ", ".join("NULL" if v is None else S.text(v) for v in values) + "]"


def _metadata_sql() -> str:
    folded = lambda x: f"regexp_replace(replace(lower(regexp_replace(coalesce({x}, ''), '^{SPACE}+|{SPACE}+$', '', 'g')), '\\', '/'), '{SPACE}+', ' ', 'g')"
    base = lambda x: f"regexp_extract({x}, '([^/]*)/*$', 1)"
    has = lambda *terms: S.any_of("merged", terms)
    ends = lambda column, *tails: "(" + " OR ".join(f"suffix({column}, {S.text(t)})" for t in tails) + ")"
    cases = [
        (has("datasheet", "技术规格书"), "datasheet", "hardware", 2, False),
        (has("technical reference manual", "技术参考手册"), "trm", "hardware", 2, False),
        (has("hardware design guidelines", "硬件设计指南"), "hardware_design", "hardware", 2, False),
        (has("/security/", "flash 加密", "安全概述"), "security", "software", 1, False),
        ("format = 'code'", "source_code", "project", 2, False),
        (f"base IN ({', '.join(map(S.text, metadata.BUILD_FILES))})", "build_config", "project", 2, False),
        (f"{ends('name', '.yaml', '.yml', '.json', '.toml', '.ini')} AND format IN ('code', 'text')", "project_config", "project", 1, False),
        (f"{ends('name', '.md', '.markdown', '.mdx')} AND {has(*metadata.DESIGN_WORDS)}", "project_doc", "project", 1, False),
        (f"{has('/api-reference/')} OR contains(' ' || merged || ' ', ' api ')", "api_reference", "software", 1, False),
        (has("/api-guides/", *metadata.GUIDE_WORDS), "guide", "software", 1, False),
        (has("esptool", "vs code 扩展"), "tooling", "tooling", 1, False),
        (f"{has('devkit', 'schematic')} OR {ends('merged', '_sch.pdf')}", "schematic", "hardware", 0, False),
        (has("产品文档页", "/products/socs/"), "product_catalog", "catalog", -3, True),
        (f"{has('资料导入总览')} OR contains(stem, 'catalog')", "catalog", "catalog", -2, True),
        ("regexp_matches(heading, '^esp-idf 编程指南 - esp32(?:-[a-z0-9]+)?$')", "programming_guide_home", "software", -2, True),
        (ends("heading", "硬件参考"), "hardware_reference_home", "hardware", -2, True),
        ("contains(heading, '文档入口')", "index", "catalog", -2, True),
    ]
    chosen = "CASE " + " ".join(f"WHEN {c} THEN {{'t': '{t}', 'd': '{d}', 'p': {p}, 'e': {str(e).lower()}}}" for c, t, d, p, e in cases) + " ELSE {'t': 'other', 'd': 'general', 'p': 0, 'e': false} END"
    chip = " ".join(f"WHEN contains(merged, '{c}') THEN '{c}'" for c in metadata.CHIP_FAMILIES)
    number = r"regexp_extract(merged, '\bv\d+(?:\.\d+){1,2}\b')"
    parts = ", ".join(f"CASE WHEN coalesce({c}, '') <> '' THEN {folded(c)} END" for c in ("filename", "title", "path", "url", "format"))
    return f"""
WITH n AS (
  SELECT page_id, url, {_list(FILES)}[page_id % {len(FILES)} + 1] AS filename, {_list(TITLES)}[(page_id // 3) % {len(TITLES)} + 1] AS title,
         {_list(FORMATS)}[page_id % {len(FORMATS)} + 1] AS format, page_id % 4 AS chunks FROM pages),
p AS (SELECT *, '/in/' || filename AS path FROM n),
f AS (
  SELECT *, concat_ws(' ', {parts}) AS merged, {folded('filename')} AS name, {folded('title')} AS heading, {folded(base("replace(filename, chr(92), '/')"))} AS base,
         lower(regexp_replace({base('filename')}, '\\.[a-z0-9]+$', '', 'i')) AS stem, concat_ws(' ', filename, coalesce(title, ''), path, url, format) AS raw FROM p),
k AS (SELECT *, {chosen} AS k FROM f),
s AS (SELECT *, chunks <= 2 AND k.t IN ('programming_guide_home', 'hardware_reference_home', 'index') AS small FROM k)
SELECT page_id, k.t AS doc_type, k.d AS content_domain, CASE {chip} END AS chip_family,
       CASE WHEN {number} <> '' THEN {number} WHEN contains(merged, 'stable') THEN 'stable' WHEN contains(merged, 'latest') THEN 'latest' END AS version,
       CASE WHEN contains(lower(raw), 'zh_cn') OR regexp_matches(raw, '[\\x{{4e00}}-\\x{{9fff}}]') THEN 'zh-CN' WHEN {S.any_of('lower(raw)', ('_en.', '/en/', '[english]', 'english'))} THEN 'en' END AS language,
       k.e OR small AS is_entrypoint, CAST(CASE WHEN small THEN least(k.p, -2) ELSE k.p END AS INT) AS retrieval_priority
FROM s"""


_KIND = "CASE WHEN contains(text, '|') THEN 'table' WHEN doc_id % 10 = 3 THEN 'code' ELSE 'text' END"
CODE_ISSUES = rf"""
WITH c AS (SELECT doc_id, source, text, {_KIND} AS kind FROM documents),
w AS (
  SELECT *, lag(doc_id) OVER d AS p, lag(kind) OVER d AS p_kind, lead(doc_id) OVER d AS n, lead(kind) OVER d AS n_kind FROM c WINDOW d AS (PARTITION BY source ORDER BY doc_id)),
k AS (
  SELECT *, len(list_filter(string_split_regex(text, '\r\n|[\n\r]'), lambda x: trim(x) <> '')) AS lines,
         (NOT coalesce(p = doc_id - 1, false) OR p_kind = 'code') AND (NOT coalesce(n = doc_id + 1, false) OR n_kind = 'code') AS alone FROM w WHERE kind = 'code')
SELECT count(*) FILTER (lines = 1) AS single_line, count(*) FILTER (length(text) < 100) AS short, count(*) FILTER (alone) AS without_text_beside FROM k"""


def _section_sql() -> str:
    flat = lambda x: f"regexp_replace(regexp_replace({x}, '{SPACE}+', ' ', 'g'), '^ | $', '', 'g')"
    matches = lambda column, patterns: "(" + " OR ".join(f"regexp_matches({column}, {S.text(p)})" for p in patterns) + ")"
    valid = f"""NOT (bare = '' OR length(bare) > {quality.LONGEST_TITLE} OR {S.any_of('blow', quality.CODE_MARKS)}
       OR (regexp_matches(bare, {S.text(quality.CODE_SIGNS)}) AND NOT regexp_matches(bare, {S.text(quality.NUMBERED)})) OR {matches('blow', quality.REFUSED_LOWER)} OR {matches('bare', quality.REFUSED_TITLES)})"""
    noise = rf"""({S.any_of('low', ('z-library', '1lib', 'z-lib'))} OR regexp_matches(t, '(?i)第\s*\d+\s*页') OR regexp_matches(t, '(?i)\bpage\s*\d+\b')
       OR regexp_matches(t, '\d{{4}}\s*年\s*\d+\s*月.*印刷') OR (regexp_matches(t, '第\s*\d+\s*版') AND NOT contains(t, '前言')))"""
    return rf"""
WITH p AS (SELECT doc_id, unnest([lang, substr(text, 1, 60)]) AS part FROM documents),
f AS (SELECT doc_id, {flat('part')} AS t FROM p),
b AS (SELECT *, lower(t) AS low, {flat("regexp_replace(t, '[*`#]+', '', 'g')")} AS bare FROM f),
c AS (SELECT *, lower(bare) AS blow FROM b WHERE t IS NOT NULL),
i AS (
  SELECT doc_id, CASE WHEN NOT ({valid}) THEN 'invalid_title_rule' WHEN {noise} THEN 'page_or_print_noise'
         WHEN regexp_matches(t, '(?i)^(图|表|figure|fig\.|table)\s*\d') THEN 'figure_or_table_caption' WHEN regexp_matches(t, 'https?://|www\.') THEN 'url_in_section_path'
         WHEN regexp_matches(t, '^\d+\s*{quality.TEXTBOOK}$') THEN 'running_header_or_repeated_title' WHEN {S.any_of('low', quality.CODE_MARKS)} THEN 'code_in_section_path' END AS issue FROM c)
SELECT issue, count(*) AS parts, count(DISTINCT doc_id) AS chunks FROM i WHERE issue IS NOT NULL GROUP BY issue"""


QUERIES = {"metadata_derive": metadata_derive}
ORACLE_SQL = {"metadata_derive": _metadata_sql(), "code_issue_counts": CODE_ISSUES, "section_issue_counts": _section_sql()}
