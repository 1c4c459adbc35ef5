"""Document metadata from names, titles and addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loamspark.functions.text import SPACES, contains_any, let, nfkc, strip

#: Chip families, longer names before their prefixes.
CHIP_FAMILIES = ("esp32p4", "esp32c61", "esp32c6", "esp32c5", "esp32c3", "esp32c2", "esp32h4", "esp32h2", "esp32s3", "esp32s2", "esp32", "esp8266")
BUILD_FILES = ("cmakelists.txt", "kconfig", "kconfig.projbuild", "sdkconfig", "sdkconfig.defaults")
DESIGN_WORDS = ("readme", "design", "architecture", "spec", "方案", "设计", "架构")
GUIDE_WORDS = ("快速入门", "构建系统", "idf.py", "ota 升级", "非易失性存储")


def lookup(text: Column, unicode: bool = False) -> Column:
    """Case, slashes and white space folded."""
    base = strip(F.coalesce(nfkc(text) if unicode else text, F.lit("")))
    return F.regexp_replace(F.replace(F.lower(base), F.lit("\\"), F.lit("/")), SPACES, " ")


def joined(*values: Column) -> Column:
    """Folded values that are not empty, joined by blanks."""
    return F.concat_ws(" ", *[F.when(F.coalesce(v, F.lit("")) != "", lookup(v)) for v in values])


def without_stamp(name: Column) -> Column:
    """A name without its 14-digit upload stamp."""
    return F.regexp_replace(name, r"^\d{14}_", "")


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.[a-z0-9]+$", "")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def lookup_variants(*values: Column) -> Column:
    """Every folded form under which a document may be named."""
    forms = []
    for value in values:
        full = lookup(value)
        for form in (full, basename(full)):
            bare = without_stamp(form)
            forms += [form, bare, without_extension(form), without_extension(bare)]
    return F.array_distinct(F.filter(F.array(*forms), lambda x: x.isNotNull() & (x != "")))


def chip_family(*values: Column) -> Column:
    """The first family of the list that occurs."""
    return let(joined(*values), lambda text: F.coalesce(*[F.when(F.contains(text, F.lit(chip)), F.lit(chip)) for chip in CHIP_FAMILIES]))


def language(*values: Column) -> Column:
    text = F.concat_ws(" ", *[F.coalesce(v, F.lit("")) for v in values])
    low = F.lower(text)
    return F.when(F.contains(low, F.lit("zh_cn")) | text.rlike(r"[\x{4e00}-\x{9fff}]"), "zh-CN").when(contains_any(low, ("_en.", "/en/", "[english]", "english")), "en")


def version(*values: Column) -> Column:

    def found(text: Column) -> Column:
        number = F.regexp_extract(text, r"(?U)\bv\d+(?:\.\d+){1,2}\b", 0)
        return F.when(number != "", number).when(F.contains(text, F.lit("stable")), "stable").when(F.contains(text, F.lit("latest")), "latest")

    return let(joined(*values), found)


def _cases(f: Column) -> list[tuple]:
    """Conditions on folded names with type, domain, priority and whether it is an entry point; the first that holds counts."""
    has = lambda *terms: contains_any(f["merged"], terms)
    ends = lambda text, *tails: reduce(lambda a, b: a | b, [F.endswith(text, F.lit(t)) for t in tails])
    return [
        (has("datasheet", "技术规格书"), "datasheet", "hardware", 2, False),
        (has("technical reference manual", "技术参考手册"), "trm", "hardware", 2, False),
        (has("hardware design guidelines", "硬件设计指南"), "hardware_design", "hardware", 2, False),
        (has("/security/", "flash 加密", "安全概述"), "security", "software", 1, False),
        (f["format"] == "code", "source_code", "project", 2, False),
        (f["base"].isin(*BUILD_FILES), "build_config", "project", 2, False),
        (ends(f["name"], ".yaml", ".yml", ".json", ".toml", ".ini") & f["format"].isin("code", "text"), "project_config", "project", 1, False),
        (ends(f["name"], ".md", ".markdown", ".mdx") & has(*DESIGN_WORDS), "project_doc", "project", 1, False),
        (has("/api-reference/") | F.contains(F.concat(F.lit(" "), f["merged"], F.lit(" ")), F.lit(" api ")), "api_reference", "software", 1, False),
        (has("/api-guides/", *GUIDE_WORDS), "guide", "software", 1, False),
        (has("esptool", "vs code 扩展"), "tooling", "tooling", 1, False),
        (has("devkit", "schematic") | ends(f["merged"], "_sch.pdf"), "schematic", "hardware", 0, False),
        (has("产品文档页", "/products/socs/"), "product_catalog", "catalog", -3, True),
        (has("资料导入总览") | F.contains(f["stem"], F.lit("catalog")), "catalog", "catalog", -2, True),
        (f["heading"].rlike(r"^esp-idf 编程指南 - esp32(?:-[a-z0-9]+)?$"), "programming_guide_home", "software", -2, True),
        (ends(f["heading"], "硬件参考"), "hardware_reference_home", "hardware", -2, True),
        (F.contains(f["heading"], F.lit("文档入口")), "index", "catalog", -2, True),
    ]


def document_metadata(filename: Column, title: Column, source_path: Column, source_url: Column, source_format: Column, chunk_count: Column) -> Column:
    """Struct of doc_type, content_domain, chip_family, version, language, is_entrypoint, retrieval_priority."""
    values = (filename, title, source_path, source_url, source_format)
    folded = F.struct(
        joined(*values).alias("merged"),
        lookup(filename).alias("name"),
        lookup(title).alias("heading"),
        lookup(basename(F.replace(filename, F.lit("\\"), F.lit("/")))).alias("base"),
        F.lower(without_extension(basename(filename))).alias("stem"),
        source_format.alias("format"),
    )
    made = lambda kind, domain, priority, entry: F.struct(F.lit(kind).alias("doc_type"), F.lit(domain).alias("content_domain"), F.lit(entry).alias("is_entrypoint"), F.lit(priority).alias("retrieval_priority"))

    def classified(f: Column) -> Column:
        chosen = made("other", "general", 0, False)
        for condition, *result in reversed(_cases(f)):
            chosen = F.when(F.coalesce(condition, F.lit(False)), made(*result)).otherwise(chosen)
        return chosen

    def completed(kind: Column) -> Column:
        small_home = F.coalesce((chunk_count <= 2) & kind["doc_type"].isin("programming_guide_home", "hardware_reference_home", "index"), F.lit(False))
        return F.struct(
            kind["doc_type"].alias("doc_type"),
            kind["content_domain"].alias("content_domain"),
            chip_family(*values).alias("chip_family"),
            version(*values).alias("version"),
            language(*values).alias("language"),
            (kind["is_entrypoint"] | small_home).alias("is_entrypoint"),
            F.when(small_home, F.least(kind["retrieval_priority"], F.lit(-2))).otherwise(kind["retrieval_priority"]).alias("retrieval_priority"),
        )

    return let(let(folded, classified), completed)
