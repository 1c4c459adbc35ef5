"""What a question asks for: task routing, intent flags and scope flags, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamspark.functions.metadata import lookup
from loamspark.functions.text import STRINGS, compact, contains_any, let, lowered

IDENTIFIER = r"(?U)\b[a-zA-Z_][a-zA-Z0-9_]{2,}\b"

#: Words that decide the task, in order of the tasks.
TASK_TERMS = {
    "book_index": ("全书", "知识点索引", "索引", "章节索引", "按章整理", "按章节", "目录结构", "章节结构", "全书结构"),
    "table_lookup": ("表格", "参数表", "数值", "对应值", "同比", "环比", "table", "coefficient", "value", "参数"),
    "code_symbol_lookup": ("代码", "源码", "函数", "方法", "类", "模块", "定义", "调用", "symbol", "file", "文件", "目录"),
    "qa_explanation": ("为什么", "原理", "解释", "总结", "概述", "说明", "how", "why"),
}
#: Identifiers that are ordinary words here, by who asks.
ROUTE_IGNORED = ("esp32", "bluetooth", "nimble", "bluedroid", "guide", "table", "code")
INTENT_IGNORED = ("esp32", "ble", "bluetooth", "nimble", "bluedroid", "guide", "api", "code", "main")
HINT_IGNORED = ("esp32", "ble", "bluetooth", "nimble", "bluedroid", "guide", "api", "scope", "code")

#: Words that set intent flags.
INTENT_TERMS = {
    "pdf": (".pdf", "datasheet", "trm", "手册", "规格书", "技术参考手册"),
    "figures": ("页码", "第几页", "参数表", "表", "table", "寄存器", "电流", "电压", "功耗", "引脚", "封装"),
    "code": (
        "代码", "源码", "实现", "函数", "方法", "类", "模块", "组件", "文件", "目录", "main.c", "app_main", "cmakelists", "kconfig",
        "sdkconfig", "menuconfig", "示例代码", "example code",
    ),
    "build": ("sdkconfig", "menuconfig", "kconfig", "cmakelists", "组件依赖", "分区表配置", "构建脚本"),
    "locations": ("位置", "章节", "url", "链接", "哪一节", "哪个章节"),
    "howto": ("怎么", "如何", "开发", "配置", "初始化", "api", "menuconfig", "示例", "教程", "快速入门", "guide"),
    "exchange": ("手机", "互发", "收发", "gatt", "gap", "notify", "write", "service", "characteristic", "特征", "服务", "blufi", "spp"),
    "bluetooth": ("蓝牙", "ble", "nimble", "bluedroid", "经典蓝牙", "br/edr"),
    "catalog": ("总览", "入口", "文档页", "产品页", "选型", "系列资料", "catalog"),
}
INTENT_CHIPS = ("esp32c3", "esp32s3", "esp32s2", "esp32c6", "esp32h2", "esp32")
#: Document types that an intent prefers or discourages.
PREFERRED = {
    "pdf": ("datasheet", "trm", "hardware_design", "schematic"),
    "figures": ("datasheet", "trm", "hardware_design"),
    "code": ("source_code", "build_config", "project_config", "project_doc"),
    "build": ("build_config", "project_config", "guide"),
    "locations": ("guide", "api_reference", "tooling", "security"),
    "howto": ("guide", "api_reference", "tooling", "security"),
    "exchange": ("guide", "api_reference"),
    "bluetooth": ("guide", "api_reference"),
    "catalog": ("catalog", "product_catalog", "programming_guide_home", "hardware_reference_home", "index"),
}
DISCOURAGED = {name: ("datasheet", "trm", "product_catalog") for name in ("code", "howto", "exchange")}

#: Words that widen or narrow the searched chunks.
SCOPE_CATALOG = ("文档页", "产品页", "产品文档", "选型", "系列", "有哪些资料", "总览", "catalog")
SCOPE_BLUETOOTH = ("蓝牙", "ble", "bluetooth", "nimble", "bluedroid", "gatt", "gap", "spp", "a2dp", "blufi", "br/edr")
SCOPE_CODE = (
    "代码", "源码", "实现", "函数", "方法", "类", "模块", "组件", "文件", "目录", "main.c", "app_main", "cmakelists", "kconfig",
    "sdkconfig", "menuconfig", "示例代码",
)


def _identifiers(question: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(question, F.lit(IDENTIFIER), 0))


def _marked(word: Column) -> Column:
    """An underscore, or an upper-case letter after the first."""
    return F.contains(word, F.lit("_")) | F.substring(word, 2, 1000).rlike(r"\p{Lu}")


def identifier_hints(question: Column, ignored=HINT_IGNORED, lower: bool = True) -> Column:
    """Words of a question that may name a symbol."""
    kept = F.filter(_identifiers(question), lambda w: _marked(w) | ~F.lower(w).isin(*ignored))
    return F.array_distinct(F.transform(kept, F.lower)) if lower else kept


def task_type(question: Column) -> Column:
    flat = F.lower(compact(question))
    symbol = F.exists(_identifiers(question), lambda w: _marked(w) & ~F.lower(w).isin(*ROUTE_IGNORED))
    chosen = F.lit("qa_fact")
    for name in reversed(TASK_TERMS):
        asked = contains_any(flat, TASK_TERMS[name])
        chosen = F.when((asked | symbol) if name == "code_symbol_lookup" else asked, F.lit(name)).otherwise(chosen)
    return chosen


def task_plan(question: Column, top_k: int) -> Column:
    """Struct of the task and what it prefers."""
    return let(task_type(question), lambda kind: _plan(kind, top_k))


def _plan(kind: Column, top_k: int) -> Column:
    blocks = {"book_index": ("toc", "text"), "table_lookup": ("table", "text"), "code_symbol_lookup": ("code", "text")}
    styles = {"book_index": "structured_index", "table_lookup": "table_focused", "code_symbol_lookup": "code_focused", "qa_explanation": "explanatory"}
    preferred, style = F.array().cast(STRINGS), F.lit("direct")
    for name, kinds in blocks.items():
        preferred = F.when(kind == name, F.array(*map(F.lit, kinds))).otherwise(preferred)
    for name, said in styles.items():
        style = F.when(kind == name, F.lit(said)).otherwise(style)
    return F.struct(
        kind.alias("task_type"),
        F.when(kind == "book_index", F.lit(max(top_k * 10, 40))).otherwise(F.lit(max(top_k * 8, 30))).alias("candidate_limit"),
        preferred.alias("preferred_block_types"),
        kind.isin(*blocks).alias("require_locations"),
        kind.isin("book_index", "table_lookup").alias("require_page_numbers"),
        (kind == "code_symbol_lookup").alias("prefer_code"),
        (kind == "code_symbol_lookup").alias("prefer_symbol_lookup"),
        (kind == "table_lookup").alias("prefer_tables"),
        (kind == "book_index").alias("prefer_toc"),
        style.alias("answer_style"),
    )


def query_intent(question: Column, low: Column | None = None) -> Column:
    """Struct of flags and sets that ranking uses; ``low`` is the question in lower case, as a column if it is folded."""
    low = lowered(question) if low is None else low
    flags = F.struct(*[contains_any(low, terms).alias(name) for name, terms in INTENT_TERMS.items()])

    def types(asked: Column, table: dict[str, tuple[str, ...]]) -> Column:
        parts = [F.when(asked[name], F.array(*map(F.lit, kinds))).otherwise(F.array().cast(STRINGS)) for name, kinds in table.items()]
        return F.array_sort(F.array_distinct(F.concat(*parts)))

    chips = let(low, lambda v: F.filter(F.array(*[F.when(F.contains(v, F.lit(c)), F.lit(c)) for c in INTENT_CHIPS]), lambda c: c.isNotNull()))
    return let(
        flags,
        lambda asked: F.struct(
            chips.alias("preferred_chip_families"),
            types(asked, PREFERRED).alias("preferred_doc_types"),
            types(asked, DISCOURAGED).alias("discouraged_doc_types"),
            (asked["pdf"] | asked["figures"]).alias("prefer_pdf"),
            asked["pdf"].alias("explicit_doc_lookup"),
            asked["locations"].alias("prefer_locations"),
            asked["exchange"].alias("prefer_examples"),
            asked["exchange"].alias("prefer_interactive_comm"),
            asked["catalog"].alias("prefer_catalog"),
            asked["catalog"].alias("allow_entrypoints"),
            asked["bluetooth"].alias("prefer_bluetooth"),
            (asked["code"] | asked["build"]).alias("prefer_code"),
            asked["code"].alias("prefer_project"),
            asked["build"].alias("prefer_build_config"),
            asked["code"].alias("prefer_symbol_lookup"),
            identifier_hints(question, INTENT_IGNORED, lower=False).alias("identifier_hints"),
        ),
    )


def analyzed(questions: DataFrame, top_k: int) -> DataFrame:
    """Questions with plan, intent, hints and scope flags."""
    q = F.col("question")
    folded = lookup(q)
    return questions.withColumn("__low", lowered(q, True)).withColumns(
        {
            "plan": task_plan(q, top_k),
            "intent": query_intent(q, F.col("__low")),
            "hints": identifier_hints(q),
            "wants_catalog": contains_any(folded, SCOPE_CATALOG),
            "wants_bluetooth": contains_any(folded, SCOPE_BLUETOOTH),
            "wants_code": contains_any(folded, SCOPE_CODE),
        }
    ).drop("__low")
