"""Blocks to chunks: document representation, profiles, strategies, labels, fallback packing."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamspark.functions.metadata import document_metadata
from loamspark.functions.quality import clean_section_path, is_bad_table, table_confidence
from loamspark.functions.text import STRINGS, compact, empty_to_null, let, sentences, strip
from loamspark.operators.ordered import per_document
from loamspark.schemas import CHUNKS, DOCUMENTS, conform
from loamspark.session import materialized

#: Built-in profiles, then files' profiles in order of name; (id, formats, keywords, strategy).
PROFILES = (
    ("source_code", ("code",), (), "source_code"),
    ("markdown_guide", ("markdown",), (), "markdown_guide"),
    ("web_article", ("web",), (), "web_article"),
    ("pdf_document", ("pdf", "pdf+ocr", "pdf+pymupdf4llm"), (), "pdf_document"),
    ("espidf", ("markdown", "web"), ("esp-idf", "espressif", "esp32"), "markdown_guide"),
    ("vehicle_textbook", ("pdf", "pdf+ocr", "pdf+pymupdf4llm"), ("汽车理论", "textbook", "chapter"), "pdf_document"),
)
#: What a format's documents have where no profile fits.
KINDS = {"code": "source_code", "markdown": "markdown_guide", "web": "web_article", "pdf": "pdf_document"}
CONNECTORS = ("or:", "for example:", "cmakelists.txt:", "minimal project:", "example:")
CONNECTOR = r"(?U)(?:is in|implementation is in|content of|file is|following|below)\s*[\w./+-]*:?\s*$"


def block_type(role: Column) -> Column:
    return F.when(role.isin("text", "table", "toc", "code", "formula"), role).otherwise("text")


def page_region(order: Column, count: Column) -> Column:
    """Third of the page in which a block begins; a lone one is in the middle, one without a page nowhere."""
    share = (order - 1) / count
    return F.when(order.isNull(), None).when(count == 1, "middle").when(share < 0.33, "top").when(share < 0.66, "middle").otherwise("bottom")


def document_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with id, place on the page and region; pages in the order in which they first occur."""
    page = F.coalesce(F.col("page_number"), F.lit(-1))
    first = F.min("seq").over(W.partitionBy("document_id", page))
    on_page = W.partitionBy("document_id", page).orderBy("seq")
    placed = blocks.withColumns({"page_first": first, "order_on_page": F.row_number().over(on_page), "page_blocks": F.count("*").over(W.partitionBy("document_id", page))})
    name = F.concat(F.lit("block:"), F.coalesce(F.col("page_number").cast("string"), F.lit("na")), F.lit(":"), F.col("order_on_page").cast("string"))
    named = placed.withColumn("block_id", name)
    named = named.withColumn("order_on_page", F.when(F.col("page_number").isNotNull(), F.col("order_on_page")))
    return named.withColumns({"page_region": page_region(F.col("order_on_page"), F.col("page_blocks")), "block_type": block_type(F.col("role")), "extraction_confidence": F.lit(1.0)}).drop("page_blocks")


def resolve_profile(documents: DataFrame, profiles=PROFILES) -> DataFrame:
    """documents with profile_id and chunk_strategy: the best-scoring profile whose format and keywords fit, earlier ones first."""
    fold = lambda c: F.regexp_replace(strip(F.lower(F.coalesce(c, F.lit("")))), r"(?U)\s+", " ")
    joined = F.concat_ws(" ", *[F.when(F.coalesce(F.col(c), F.lit("")) != "", fold(F.col(c))) for c in ("filename", "title", "source_path", "source_url", "source_format")])
    documents = documents.withColumns({"__merged": joined, "__kind": fold(F.col("source_format"))})
    merged, kind = F.col("__merged"), F.col("__kind")
    scored = []
    for place, (name, formats, keywords, strategy) in enumerate(profiles):
        hits = sum((F.contains(merged, F.lit(k)).cast("int") for k in keywords), F.lit(0))
        fits = (kind.isin(*formats) if formats else F.lit(True)) & ((hits > 0) if keywords else F.lit(True))
        score = F.lit(1 if formats else 0) + hits * 10
        scored.append(F.when(fits, F.struct(score.alias("score"), F.lit(-place).alias("place"), F.lit(name).alias("profile_id"), F.lit(strategy).alias("chunk_strategy"))))
    documents = documents.withColumn("__best", F.array_max(F.array(*scored)))
    best = F.col("__best")
    by_kind = F.coalesce(*[F.when(F.startswith(kind, F.lit(k)) if k == "pdf" else kind == k, F.lit(name)) for k, name in KINDS.items()])
    return documents.withColumns(
        {"profile_id": F.coalesce(best["profile_id"], by_kind, F.lit("general")), "chunk_strategy": F.coalesce(best["chunk_strategy"], by_kind, F.lit("generic_text"))}
    ).drop("__merged", "__kind", "__best")


def merged_profiles(overrides: Iterable[dict], base: tuple = PROFILES) -> tuple:
    """Profiles with fields of others put over them by id; an override keeps its profile's place, new ones follow.

    An override has profile_id and any of source_formats, title_keywords and
    chunk_strategy; what it leaves out is the profile's own, for a new one nothing and the
    generic strategy.
    """
    fold = lambda values: tuple(" ".join(str(v).lower().split()) for v in values or ())
    known = {name: {"source_formats": formats, "title_keywords": keywords, "chunk_strategy": chosen} for name, formats, keywords, chosen in base}
    for override in overrides:
        own = known.setdefault(str(override["profile_id"]), {"source_formats": (), "title_keywords": (), "chunk_strategy": GENERIC})
        own.update({k: v for k, v in override.items() if k in own})
    return tuple((name, fold(p["source_formats"]), tuple(k for k in fold(p["title_keywords"]) if k), str(p["chunk_strategy"])) for name, p in known.items() if name != "general")


def load_profiles(spark: SparkSession, folder: str, base: tuple = PROFILES) -> tuple:
    """``base`` with the profiles of a folder's ``*.yaml`` files, in order of name; the file's name is the id of one that states none.

    The files are configuration, a few small ones, read through Spark from wherever it reads.
    """
    import yaml

    files = spark.read.option("recursiveFileLookup", False).option("pathGlobFilter", "*.yaml").text(folder, wholetext=True).select(F.input_file_name().alias("name"), "value")
    overrides = []
    for name, text in sorted((r["name"].rsplit("/", 1)[-1], r["value"]) for r in files.collect()):
        held = yaml.safe_load(text)
        if isinstance(held, dict):
            overrides.append({**held, "profile_id": held.get("profile_id") or name.removesuffix(".yaml")})
    return merged_profiles(overrides, base)


def strategy(name: Column) -> Column:
    """Unknown strategies are the generic one."""
    return F.when(name.isin(*STRATEGIES), name).otherwise(GENERIC)


def register_strategy(name: str, change: Callable[[DataFrame], DataFrame]) -> None:
    """``change`` makes of the ordered blocks of all documents with this strategy what short texts are merged in; columns stay."""
    STRATEGIES[name] = change


def _neighbours(rows: DataFrame) -> DataFrame:
    by = W.partitionBy("document_id").orderBy("seq")
    names = ("block_type", "content", "section_path", "page_number", "source_uri")
    columns = {}
    for side, move in (("p", F.lag), ("n", F.lead)):
        for name in names:
            columns[f"{side}_{name}"] = move(name).over(by)
        columns[f"{side}_there"] = F.coalesce(move(F.lit(True)).over(by), F.lit(False))
    return rows.withColumns(columns)


def is_short_code(kind: Column, text: Column) -> Column:
    filled = F.size(F.filter(F.split(text, r"\r\n|[\n\r]", -1), lambda x: strip(x) != ""))
    return (kind == "code") & ((F.length(text) < 120) | (filled == 1))


def is_connector(text: Column) -> Column:
    """Short text that only leads to code."""
    return let(F.lower(compact(text)), lambda t: (t != "") & (F.length(t) <= 100) & (t.isin(*CONNECTORS) | t.rlike(CONNECTOR)))


def attach_code_context(rows: DataFrame) -> DataFrame:
    """Short code gets its neighbouring texts of the same scope as context; connector texts go.

    Rows: document_id, seq, block_type, content, section_path, page_number, source_uri,
    context_before, context_after.
    """
    near = _neighbours(rows)
    same = lambda s: F.col(f"{s}_there") & (F.col(f"{s}_section_path").eqNullSafe(F.col("section_path"))) & (F.col(f"{s}_page_number").eqNullSafe(F.col("page_number"))) & (F.col(f"{s}_source_uri").eqNullSafe(F.col("source_uri")))
    short = is_short_code(F.col("block_type"), F.col("content"))

    def context(old: str, s: str) -> Column:
        text = compact(F.substring(F.col(f"{s}_content"), 1, 500))
        usable = short & same(s) & (F.col(f"{s}_block_type") == "text") & (text != "")
        return F.when(usable, F.concat_ws("\n", F.nullif(F.col(old), F.lit("")), text)).otherwise(F.col(old))

    beside = lambda s: same(s) & is_short_code(F.col(f"{s}_block_type"), F.col(f"{s}_content"))
    dropped = (F.col("block_type") == "text") & is_connector(F.col("content")) & (F.coalesce(beside("p"), F.lit(False)) | F.coalesce(beside("n"), F.lit(False)))
    out = near.withColumns({"context_before": context("context_before", "p"), "context_after": context("context_after", "n"), "dropped": F.coalesce(dropped, F.lit(False))})
    return out.where("not dropped").drop("dropped", *[c for c in out.columns if c[:2] in ("p_", "n_") and c not in rows.columns])


def _as_they_are(rows: DataFrame) -> DataFrame:
    return rows


GENERIC = "generic_text"
#: What each strategy does with the blocks before short texts are merged.
STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = dict.fromkeys((GENERIC, "markdown_guide", "web_article", "pdf_document"), _as_they_are) | {"source_code": attach_code_context}


def merge_short(rows: DataFrame, short: int = 50, limit: int = 1800) -> DataFrame:
    """Texts under ``short`` characters joined to the text before, else to the one after, in the same scope.

    Each decision changes the next, so a document's rows are folded in order.
    """
    scope = lambda r: (r["section_path"], r["page_number"], r["source_uri"])
    joins = lambda a, b: a["block_type"] == "text" == b["block_type"] and scope(a) == scope(b) and len(a["content"]) + len(b["content"]) <= limit

    def fold(queue: list[dict]) -> list[dict]:
        done: list[dict] = []
        for i, row in enumerate(queue):
            if row["block_type"] == "text" and len(row["content"]) < short:
                if done and joins(done[-1], row):
                    done[-1]["content"] = f"{done[-1]['content']}\n\n{row['content']}".strip()
                    for end in ("line_end", "paragraph_end"):
                        done[-1][end] = row[end] or done[-1][end]
                    continue
                if i + 1 < len(queue) and joins(row, queue[i + 1]):
                    after = queue[i + 1]
                    after["content"] = f"{row['content']}\n\n{after['content']}".strip()
                    for start in ("line_start", "paragraph_start"):
                        after[start] = row[start] or after[start]
                    continue
            done.append(row)
        return done

    return per_document(rows, fold, rows.schema, "seq")


def normal_content(text: Column, code: Column) -> Column:
    """Line ends stripped; blank lines dropped unless it is code."""
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n", -1), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    return F.when(code, F.regexp_replace(F.array_join(lines, "\n"), "^\n+|\n+$", "")).otherwise(strip(F.array_join(F.filter(lines, lambda x: x != ""), "\n")))


def finalized(rows: DataFrame) -> DataFrame:
    """Page labels, ends of ranges, location labels and table confidence filled in."""
    span = lambda word, a, b: F.when(a == b, F.concat(F.lit(word), a.cast("string"))).otherwise(F.concat(F.lit(word), a.cast("string"), F.lit("-"), b.cast("string")))
    page = F.concat(F.lit("第 "), F.col("page_number").cast("string"), F.lit(" 页"))
    line_end, paragraph_end = F.coalesce("line_end", "line_start"), F.coalesce("paragraph_end", "paragraph_start")
    label = F.coalesce(
        F.nullif(F.col("location_label"), F.lit("")),
        F.when(F.col("line_start").isNotNull() & line_end.isNotNull(), span("行 ", F.col("line_start"), line_end)),
        F.when(F.col("paragraph_start").isNotNull() & paragraph_end.isNotNull(), span("段落 ", F.col("paragraph_start"), paragraph_end)),
        page,
    )
    return rows.withColumns(
        {
            "page_label": F.coalesce(F.nullif(F.col("page_label"), F.lit("")), page),
            "line_end": line_end,
            "paragraph_end": paragraph_end,
            "location_label": label,
            "table_parse_confidence": F.when(F.col("block_type") == "table", table_confidence(F.col("content"))),
        }
    )


def given_blocks(rows: DataFrame) -> DataFrame:
    """Blocks handed in by a caller: contents and labels normalised, failed tables and empty ones dropped."""
    code = F.col("block_type") == "code"
    out = rows.withColumns({"content": normal_content(F.col("content"), code), "section_path": clean_section_path(F.col("section_path")), **{c: empty_to_null(F.col(c)) for c in ("symbol_name", "page_label", "source_uri", "location_label")}})
    return out.where((F.col("content") != "") & ~((F.col("block_type") == "table") & is_bad_table(F.col("content"))))


def packed_text(text: Column, size: int = 700, overlap: int = 120) -> Column:
    """Array of chunks: paragraphs, or sentences of long ones, packed up to ``size``; a cut carries the last characters on."""
    none = F.array().cast(STRINGS)
    clean = strip(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n{3,}", "\n\n"))
    paragraphs = F.filter(F.transform(F.split(clean, r"\n(?U)\s*\n", -1), strip), lambda p: p != "")
    units = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) > size, sentences(p)).otherwise(F.array(p))))
    state = F.struct(none.alias("done"), F.lit("").alias("cur"))

    def add(acc: Column, unit: Column) -> Column:
        wider = F.concat(acc["cur"], F.lit("\n\n"), unit)
        carried = strip(F.concat(F.right(acc["cur"], F.lit(overlap)) if overlap else F.lit(""), F.lit("\n"), unit))
        fits = F.length(wider) <= size
        return (
            F.when(acc["cur"] == "", F.struct(acc["done"].alias("done"), unit.alias("cur")))
            .when(fits, F.struct(acc["done"].alias("done"), wider.alias("cur")))
            .otherwise(F.struct(F.array_append(acc["done"], acc["cur"]).alias("done"), carried.alias("cur")))
        )

    packed = F.aggregate(F.coalesce(units, none), state, add, lambda acc: F.array_append(acc["done"], acc["cur"]))
    return F.filter(F.transform(packed, strip), lambda c: c != "")


def build_chunks(documents: DataFrame, blocks: DataFrame, profiles: tuple = PROFILES) -> tuple[DataFrame, DataFrame]:
    """The document and chunk tables of documents (id, title, filename, source_*) and their blocks.

    Each document's profile chooses the strategy that its blocks go through. Documents
    without any chunk are left out; chunk indexes are dense from 0.
    """
    chosen = resolve_profile(documents, profiles).select("id", strategy(F.col("chunk_strategy")).alias("chunk_strategy"))
    ir = document_blocks(blocks).where(strip(F.col("text")) != "").withColumnRenamed("text", "content")
    order = W.partitionBy("document_id").orderBy("page_first", "seq")
    ir = ir.withColumn("seq", F.row_number().over(order)).drop("page_first", "role")
    for name in ("context_before", "context_after"):
        if name not in ir.columns:
            ir = ir.withColumn(name, F.lit(None).cast("string"))
    ir = ir.join(chosen.withColumnRenamed("id", "document_id"), "document_id")
    changes: dict[Callable, list[str]] = {}  # strategies that do the same are one branch
    for name in {p[3] for p in profiles} | set(KINDS.values()) | {GENERIC}:
        changes.setdefault(STRATEGIES.get(name, STRATEGIES[GENERIC]), []).append(name if name in STRATEGIES else GENERIC)
    ir = materialized(ir)  # or each branch would make the blocks again
    branches = [change(ir.where(F.col("chunk_strategy").isin(*named))) for change, named in changes.items()]
    rows = finalized(merge_short(reduce(DataFrame.unionByName, branches)))
    # Read for the counts, the documents and the chunks; without a cut the blocks would be made for each.
    indexed = materialized(rows.withColumn("chunk_index", F.row_number().over(W.partitionBy("document_id").orderBy("seq")) - 1))
    counts = indexed.groupBy("document_id").agg(F.count("*").cast("int").alias("chunk_count"))
    known = documents.drop("chunk_count").join(counts.withColumnRenamed("document_id", "id"), "id")
    meta = document_metadata(*[F.col(c) for c in ("filename", "title", "source_path", "source_url", "source_format")], F.col("chunk_count"))
    named = [c for c in known.columns if c not in ("doc_type", "content_domain", "chip_family", "version", "language", "is_entrypoint", "retrieval_priority")]
    described = known.withColumn("m", meta).select(*named, "m.*")
    shared = described.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), "doc_type", "content_domain", "chip_family", "version", "language", "is_entrypoint", "retrieval_priority")
    chunks = indexed.join(shared, "document_id").withColumn("id", F.concat("document_id", F.lit(":"), F.col("chunk_index").cast("string")))
    return conform(described, DOCUMENTS), conform(chunks, CHUNKS)


def packed_chunks(texts: DataFrame) -> DataFrame:
    """document_id, chunk_index, content from plain texts (document_id, text): the fallback without blocks."""
    return texts.select("document_id", F.posexplode(packed_text(F.col("text"))).alias("chunk_index", "content"))


