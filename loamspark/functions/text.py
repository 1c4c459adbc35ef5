"""Text functions on columns: normalisation, tokens, expansions, weighted texts, hashes."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Groups of terms that stand for each other.
TERM_GROUPS = (
    ("bluetooth", "blue tooth", "bt", "蓝牙"),
    ("ble", "bluetooth le", "bluetooth low energy", "低功耗蓝牙", "蓝牙低能耗"),
    ("ble-only", "ble only", "only ble", "纯 ble", "纯ble", "只支持 ble", "仅支持 ble"),
    ("classic bluetooth", "classic bt", "br/edr", "经典蓝牙", "传统蓝牙"),
    ("host stack", "host api", "host apis", "host", "主机栈", "主机堆栈", "协议栈", "蓝牙主机"),
    ("nimble", "nimble host", "apache nimble"),
    ("bluedroid", "esp-bluedroid"),
    ("gatt", "generic attribute", "属性协议"),
    ("gap", "generic access", "接入规范"),
    ("advertising", "advertise", "广播"),
    ("scan", "scanning", "扫描"),
    ("pairing", "bonding", "配对", "绑定"),
    ("security", "smp", "安全"),
    ("service", "services", "服务"),
    ("characteristic", "characteristics", "特征", "特征值"),
    ("api", "apis", "接口"),
    ("guide", "guides", "programming guide", "development guide", "指南", "开发指南"),
    ("overview", "architecture", "概述", "架构"),
    ("example", "examples", "示例"),
    ("controller", "host", "控制器", "主机"),
    ("audio", "a2dp", "音频"),
    ("spp", "serial port profile"),
    ("wi-fi", "wifi", "wireless", "无线", "无线能力", "蓝牙", "bluetooth"),
    ("toolchain", "tools", "python", "git", "software", "软件", "软件组件", "开发环境"),
    ("component", "components", "项目组件"),
    ("resources", "documents", "sdk", "hardware design guidelines", "资源", "资源入口", "文档"),
    ("performance", "index", "indexes", "评价指标", "衡量指标", "最高车速", "加速", "爬坡"),
    ("rolling resistance", "rolling resistance coefficient", "滚动阻力", "滚动阻力系数", "路面", "轮胎", "车速"),
)
#: Marks of generated documentation pages; the first group proves one.
GUARD_MARKS = (
    "此文档对您有帮助吗", "Was this page helpful", "反馈已收到", "Thank you! We received your feedback",
    "利用Sphinx构建", "Built withSphinx", "PreviousNext", "上一页下一页",
)
CUT_MARKS = ("如果您有其他意见", "我们重视您的反馈", "Let us know how we can improve this page", "© 版权所有", "© Copyright", "Download HTML")
NEW_SESSION = "新会话"
#: Anything but ASCII letters and digits, CJK and common punctuation.
ODD = r"""[^A-Za-z0-9\x{4e00}-\x{9fff}.,;:!?()\[\]{}<>\-_+/\\|@#$%^&*~`'"，。；：？！、（）《》【】“”‘’·…]+"""
LATIN_TOKEN = r"[a-z0-9_./+-]+"
CJK_RUN = r"[\x{4e00}-\x{9fff}]+"
#: White space that is not one blank already; what is matched is what changes.
SPACES = r"(?U)\s(?:(?<! )\s*|\s+)"
STRINGS = "array<string>"
#: Suffixes that a stem loses, the last that fits first, and the length that a word must exceed.
SUFFIXES = (("s", 2), ("es", 3), ("ed", 3), ("ing", 4))


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition; Spark has no builtin for it."""
    return texts.str.normalize("NFKC")


def lowered(text: Column, unicode: bool = False) -> Column:
    """Lower case, registered sign to a blank; compatibility forms folded first if ``unicode``."""
    return F.replace(F.lower(nfkc(text) if unicode else text), F.lit("®"), F.lit(" "))


def strip(text: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def compact(text: Column, unicode: bool = False) -> Column:
    """Runs of white space made one blank, ends stripped."""
    return F.trim(F.regexp_replace(nfkc(text) if unicode else text, SPACES, " "))


def empty_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def contains_any(text: Column, terms) -> Column:
    """Whether any literal term occurs; one pattern, so that plans stay small."""
    return F.coalesce(text.rlike("|".join(map(re.escape, terms))), F.lit(False))


def stem(token: Column) -> Column:
    """First suffix that fits is cut: ing, ed, es, s, each with a least length."""
    out = token
    for suffix, longer_than in SUFFIXES:
        fits = (F.length(token) > longer_than) & F.endswith(token, F.lit(suffix))
        out = F.when(fits, F.substring(token, F.lit(1), F.length(token) - len(suffix))).otherwise(out)
    return out


def latin_words(text: Column, unicode: bool = False) -> Column:
    """Latin tokens without their stems; none is empty."""
    return F.regexp_extract_all(lowered(text, unicode), F.lit(LATIN_TOKEN), 0)


def latin_tokens(text: Column, unicode: bool = False) -> Column:
    """Every token followed by its stem; both count. A stem is never empty, as its suffix is the shorter part."""
    return F.flatten(F.transform(latin_words(text, unicode), lambda t: F.array(t, stem(t))))


def cjk_tokens(text: Column) -> Column:
    """Single characters and neighbouring pairs of each run."""

    def of_run(run: Column) -> Column:
        n = F.length(run)
        singles = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(run, i, F.lit(1)))
        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast(STRINGS))
        return F.concat(singles, pairs)

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(CJK_RUN), 0), of_run))


def expansions(text: Column, groups=TERM_GROUPS) -> Column:
    """All terms of every group of which one occurs, each once, in order of the groups."""
    known = F.array(*[F.array(*map(F.lit, g)) for g in groups])

    def found(both: Column) -> Column:
        held = lambda t: F.contains(both["low"], t) | F.contains(both["raw"], t)
        return F.array_distinct(F.flatten(F.filter(known, lambda g: F.exists(g, held))))

    return let(F.struct(lowered(text).alias("low"), text.alias("raw")), found)


def tokenize(text: Column, groups=TERM_GROUPS) -> Column:
    """Latin and CJK tokens of the text with its expansions; repeats stay.

    Compatibility forms are folded beforehand, by ``nfkc`` in a column of its own: Spark
    does not run a Python function inside a lambda.
    """
    merged = F.concat_ws("\n", text, F.nullif(F.array_join(expansions(text, groups), " "), F.lit("")))
    return F.when(text.isNotNull(), let(merged, lambda m: F.concat(latin_tokens(m), cjk_tokens(m))))


def with_tokens(rows: DataFrame, text: Column, name: str = "tokens") -> DataFrame:
    """rows with the tokens of a text, compatibility forms folded in a column of its own first."""
    return rows.withColumn("__folded", nfkc(text)).withColumn(name, tokenize(F.col("__folded"))).drop("__folded")


def metadata_text(c=F.col) -> Column:
    parts = [F.replace(c("doc_type"), F.lit("_"), F.lit(" ")), *[c(n) for n in ("content_domain", "chip_family", "version", "language", "symbol_name")]]
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def weighted_text(c=F.col) -> Column:
    """What a chunk is indexed by: title twice, metadata, path, location, context, content."""
    blank = F.lit("")
    join = lambda sep, *names: F.concat_ws(sep, *[F.nullif(c(n), blank) for n in names])
    title = F.coalesce(c("document_title"), blank)
    return F.concat_ws(
        "\n",
        title,
        title,
        metadata_text(c),
        F.coalesce(F.array_join(c("section_path"), " > "), blank),
        join(" ", "page_label", "location_label", "source_uri"),
        join("\n", "context_before", "context_after"),
        F.coalesce(c("content"), blank),
    )


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_fingerprint(c=F.col) -> Column:
    """Content, path, page label and location, a line each; nulls are empty lines."""
    blank = F.lit("")
    parts = [c("content"), F.array_join(c("section_path"), "|"), c("page_label"), c("location_label")]
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p, blank) for p in parts]), 256)


def remote_input(text: Column) -> Column:
    """Input for a remote embedding: white space compacted, the middle of long texts cut, never empty."""
    flat = compact(text)
    cut = F.concat(F.substring(flat, 1, 5625), F.lit(" ... "), F.right(flat, F.lit(1855)))
    return F.when(F.length(flat) > 7500, cut).when(flat == "", F.lit(" ")).otherwise(flat)


def l2_normalize(vector: Column) -> Column:
    """Unit length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(vector)


def dot(a: Column, b: Column) -> Column:
    """Sum of products; 0 for empty vectors or vectors of different length."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), total).otherwise(F.lit(0.0))


def snippet(text: Column, limit: int = 320) -> Column:
    cut = lambda t: F.concat(F.regexp_replace(F.substring(t, 1, limit), r"(?U)\s+$", ""), F.lit("..."))
    return let(strip(text), lambda t: F.when(F.length(t) > limit, cut(t)).otherwise(t))


def one_line(text: Column, limit: int = 240) -> Column:
    """One line of at most ``limit`` characters, dots where it was longer."""
    return let(compact(text), lambda t: F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("..."))).otherwise(t))


def session_title(text: Column, limit: int = 30) -> Column:
    """A session's title from its first question; blank questions have the default title."""
    flat = one_line(F.coalesce(text, F.lit("")), limit)
    return F.when(flat == "", F.lit(NEW_SESSION)).otherwise(flat)


def folded(text: Column) -> Column:
    """White space and case folded, for comparing titles."""
    return F.lower(compact(text))


def slug(text: Column) -> Column:
    """Words joined by hyphens, in lower case; never empty."""
    joined = F.regexp_replace(F.regexp_replace(strip(F.lower(text)), r"(?U)[^\w\x{4e00}-\x{9fff}-]+", "-"), "-{2,}", "-")
    trimmed = F.regexp_replace(joined, "^-+|-+$", "")
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit("section")).otherwise(trimmed)


def safe_filename(name: Column) -> Column:
    base = F.regexp_extract(name, r"([^/]*)/*$", 1)
    cleaned = F.regexp_replace(base, r"[^a-zA-Z0-9._-]+", "_")
    return F.when(F.coalesce(cleaned, F.lit("")) == "", F.lit("upload.txt")).otherwise(cleaned)


def import_normalized(text: Column, unicode: bool = True) -> Column:
    """Line ends made one kind, NUL dropped, three or more made two, ends stripped."""
    base = nfkc(text) if unicode else text
    base = F.replace(F.regexp_replace(base, "\r\n?", "\n"), F.lit("\x00"), F.lit(""))
    return strip(F.regexp_replace(base, "\n{3,}", "\n\n"))


def sentences(text: Column) -> Column:
    """Split behind sentence ends; blanks dropped."""
    parts = F.split(text, r"(?U)(?<=[。！？；.!?;])\s*", -1)
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def readability(text: Column) -> Column:
    """Share of ordinary characters among those that are no white space."""
    dense = F.regexp_replace(text, r"(?U)\s+", "")
    good = F.regexp_replace(dense, ODD, "")
    return F.when(F.length(dense) > 0, F.length(good) / F.length(dense)).otherwise(F.lit(0.0))


def without_boilerplate(text: Column, unicode: bool = True) -> Column:
    """Text up to the first page-end mark, if one of the marks that prove a generated page occurs."""
    base = import_normalized(text, unicode)
    places = [F.nullif(F.locate(mark, base), F.lit(0)) for mark in (*GUARD_MARKS, *CUT_MARKS)]
    cut = F.least(*places)
    return F.when(contains_any(base, GUARD_MARKS), import_normalized(F.substring(base, F.lit(1), cut - 1), False)).otherwise(base)


def heading_text(text: Column) -> Column:
    """Permalink glyphs dropped, white space compacted."""
    return compact(F.replace(text, F.lit("\uf0c1"), F.lit("")))
