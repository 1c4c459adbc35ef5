"""Quality functions on columns: section titles and paths, tables, chunk texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamspark.functions.text import STRINGS, compact, contains_any, let, one_line, strip

#: Code that must not become a section title.
CODE_MARKS = (
    "idf_component_register", "target_link_libraries", "add_custom_command", "externalproject_add", "set_target_properties",
    "add_dependencies", "target_include_directories", "target_compile_options", "target_compile_definitions",
    "cmake_minimum_required", "project(", "${", "#include",
)
#: Placeholders of failed table extraction.
TABLE_MARKS = ("Col1", "Col2", "Col3", "Col4", "Col5", "|||||")
NUMERAL = "一二三四五六七八九十百零0-9"
SEPARATOR = r"^\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?$"
CELL_TOKEN = r"[A-Za-z0-9.\-/\x{4e00}-\x{9fff}]+"


#: Levels that a title's numbering states; the first pattern that fits decides.
TITLE_LEVELS = (
    (1, rf"^第\s*[{NUMERAL}]+\s*章\b"),
    (2, rf"^第\s*[{NUMERAL}]+\s*节\b"),
    (1, rf"^第\s*[{NUMERAL}]+\s*版\s*前言$"),
    (1, r"^(?:序|前言|绪论)$"),
)
TITLE_NUMBER = r"^(\d+(?:\.\d+)*)\s+\S+"
NAMED_LEVELS = ((1, r"^chapter\s+\d+\b"), (2, r"^section\s+\d+\b"))
#: What may not be a section title, by its lower-case form and as it is.
REFUSED_LOWER = (r"\b(?:srcs|include_dirs|requires|priv_requires)\b", r"\b(?:if|for|while|switch|return)\s*\(")
REFUSED_TITLES = (r"\|", r"^\s*(?:\$?\{?[\w./+-]+\}?=|[A-Za-z_][\w:.-]*\()", r"^[-=:_./\\\d\s]+$")
CODE_SIGNS, NUMBERED = "[{};]", r"^\d+(?:\.\d+)*\s+"
LONGEST_TITLE = 80


def heading_level(title: Column) -> Column:
    """Level that a title states by its numbering; null if none."""

    def level(t: Column) -> Column:
        number = F.regexp_extract(t, rf"(?U){TITLE_NUMBER}", 1)
        named = [F.when(t.rlike(f"(?U){p}"), n) for n, p in TITLE_LEVELS]
        counted = F.when(number != "", F.least(F.size(F.split(number, r"\.")), F.lit(6)))
        return F.coalesce(*named, counted, *[F.when(t.rlike(f"(?Ui){p}"), n) for n, p in NAMED_LEVELS])

    return let(compact(title), level)


def bare_title(title: Column) -> Column:
    return compact(F.regexp_replace(title, "[*`#]+", ""))


def is_section_title(title: Column) -> Column:
    """Whether a text may stand in a section path."""

    def refused(b: Column) -> Column:
        t, low = b["t"], b["low"]
        found = (t == "") | (F.length(t) > LONGEST_TITLE) | contains_any(low, CODE_MARKS) | (t.rlike(CODE_SIGNS) & ~t.rlike(f"(?U){NUMBERED}"))
        for column, patterns in ((low, REFUSED_LOWER), (t, REFUSED_TITLES)):
            found = found | column.rlike(f"(?U){'|'.join(f'(?:{p})' for p in patterns)}")
        return found

    both = let(bare_title(title), lambda t: F.struct(t.alias("t"), F.lower(t).alias("low")))
    return F.coalesce(~let(both, refused), F.lit(False))


def clean_section_path(path: Column) -> Column:
    """A path rebuilt by levels: a numbered title drops its equals and deeper ones before it."""
    none = F.array().cast(STRINGS)
    titles = F.filter(F.transform(path, bare_title), is_section_title)

    def add(acc: Column, title: Column) -> Column:
        level = heading_level(title)
        head = F.slice(acc, 1, 1)
        top = F.concat(F.filter(head, lambda x: heading_level(x).isNull()), F.array(title))
        under = F.concat(F.filter(acc, lambda x: heading_level(x).isNull() | (heading_level(x) < level)), F.array(title))
        plain = F.when(F.array_contains(acc, title), acc).otherwise(F.concat(acc, F.array(title)))
        return F.when(level == 1, top).when(level.isNotNull(), under).otherwise(plain)

    return F.aggregate(F.coalesce(titles, none), none, add)


def table_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r\n|[\n\r]", -1), strip), lambda x: F.contains(x, F.lit("|")))


def data_lines(text: Column) -> Column:
    return F.filter(table_lines(text), lambda x: ~x.rlike(SEPARATOR))


def pipes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))


def cells(lines: Column) -> Column:
    return F.flatten(F.transform(lines, lambda x: F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|", -1)))


def is_packed(cell: Column) -> Column:
    """Whether a cell holds a whole row of values."""
    tokens = F.regexp_extract_all(cell, F.lit(CELL_TOKEN), 0)
    return (F.size(tokens) >= 8) & (F.size(F.filter(tokens, lambda t: t.rlike(r"\d"))) >= 4)


def is_bad_table(text: Column) -> Column:
    """Whether a table's extraction failed: placeholders, repetition, empty cells or bare numbers."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?U)[\w\x{4e00}-\x{9fff}.+/-]+"), 0)
    parts = F.struct(tokens.alias("tokens"), F.transform(cells(data_lines(text)), strip).alias("cells"), pipes(text).alias("pipes"), contains_any(text, TABLE_MARKS).alias("marked"))

    def bad(p: Column) -> Column:
        words = F.size(F.filter(p["tokens"], lambda t: t.rlike(r"[A-Za-z\x{4e00}-\x{9fff}]")))
        numbers = F.size(F.filter(p["tokens"], lambda t: t.rlike(r"(?U)^\d+(?:\.\d+)?$")))
        n = F.size(p["cells"])
        return (
            p["marked"]
            | ((p["pipes"] > 20) & (F.size(F.array_distinct(p["tokens"])) < 20))
            | (n == 0)
            | ((n >= 12) & (F.size(F.filter(p["cells"], lambda c: c != "")) / n < 0.35))
            | ((p["pipes"] > 12) & (words <= 3) & (numbers >= 8))
        )

    return F.when(F.coalesce(F.contains(text, F.lit("|")), F.lit(False)), let(parts, bad)).otherwise(F.lit(False))


def table_confidence(text: Column) -> Column:
    """low, medium or high."""

    def rated(lines: Column) -> Column:
        widths = F.array_distinct(F.transform(lines, pipes))
        return F.when((F.size(lines) < 2) | (F.size(widths) > 2) | F.exists(cells(lines), is_packed), "low").when((F.size(lines) >= 3) & (F.size(widths) == 1), "high").otherwise("medium")

    return F.when(is_bad_table(text), "low").otherwise(let(data_lines(text), rated))


def is_page_noise(text: Column) -> Column:
    """Page numbers, print runs and library stamps."""
    low = F.lower(text)
    return (
        contains_any(low, ("z-library", "1lib", "z-lib"))
        | text.rlike(r"(?Ui)第\s*\d+\s*页")
        | text.rlike(r"(?Ui)\bpage\s*\d+\b")
        | text.rlike(r"(?U)\d{4}\s*年\s*\d+\s*月.*印刷")
        | (text.rlike(r"(?U)第\s*\d+\s*版") & ~F.contains(text, F.lit("前言")))
    )


#: Running header of the textbook that the report looks for.
TEXTBOOK = "汽车理论"


def section_issue(part: Column) -> Column:
    """The first class of defect that a path's part has; null if none."""

    def issue(t: Column) -> Column:
        return (
            F.when(~is_section_title(t), "invalid_title_rule")
            .when(is_page_noise(t), "page_or_print_noise")
            .when(t.rlike(r"(?Ui)^(图|表|figure|fig\.|table)\s*\d"), "figure_or_table_caption")
            .when(t.rlike(r"https?://|www\."), "url_in_section_path")
            .when(t.rlike(rf"(?U)^\d+\s*{TEXTBOOK}$"), "running_header_or_repeated_title")
            .when(contains_any(F.lower(t), CODE_MARKS), "code_in_section_path")
        )

    return let(one_line(part, 500), issue)


def is_separator_row(row: Column) -> Column:
    t = strip(F.regexp_replace(strip(row), r"^\|+|\|+$", ""))
    return (t != "") & t.rlike(r"^[-:| ]+$") & F.contains(t, F.lit("---"))


def is_bad_start(text: Column) -> Column:
    """Whether a text begins like the rest of a sentence."""

    def bad(t: Column) -> Column:
        starts = t.rlike("^[a-z]") | t.rlike("^(的|了|和|与|及|或|擦|系数|中心|距离|变形|关系|曲线|则|因此|所以|而|但|并)") | t.rlike("^[，,。.；;：:）)]")
        return (F.length(t) >= 30) & starts

    return F.coalesce(let(compact(text), bad), F.lit(False))


def is_chapter(title: Column) -> Column:
    t = one_line(title, 160)
    return F.coalesce((heading_level(t) == 1) & (t.rlike(rf"(?U)^第\s*[{NUMERAL}]+\s*章") | t.rlike(r"(?Ui)^chapter\s+\d+\b")), F.lit(False))


def has_two_chapters(path: Column) -> Column:
    return F.size(F.filter(path, is_chapter)) > 1
