"""Files of mixed kinds to documents and blocks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamspark.operators.blocks import Block, block_rows, blocks_of_lines, blocks_of_paragraphs, is_title, tidy
from loamspark.operators.ordered import per_row
from loamspark.schemas import BLOCKS, names
from loamspark.sources.html import cut_page_end

#: Suffixes by kind, and what a directory scan passes over.
SUFFIXES = {
    "text": (".txt", ".text"),
    "markdown": (".md", ".markdown", ".mdx"),
    "docx": (".docx",),
    "pdf": (".pdf",),
    "code": (
        ".c", ".h", ".cpp", ".hpp", ".cc", ".hh", ".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".go", ".rs", ".swift", ".kt", ".json",
        ".yaml", ".yml", ".toml", ".ini", ".sh", ".bash", ".zsh", ".sql", ".html", ".css", ".scss", ".less", ".xml",
    ),
}
SKIPPED_FOLDERS = (
    ".git", ".idea", ".vscode", ".venv", "venv", "node_modules", "dist", "build", "__pycache__", ".pytest_cache", ".mypy_cache",
    ".ruff_cache", ".next", ".nuxt", "coverage", "data", "logs", "target",
)
SKIPPED_FILES = (".ds_store",)
ENCODINGS = ("utf-8", "utf-8-sig", "gb18030", "gbk", "big5", "latin-1")
UNSUPPORTED = "unsupported file type"


def file_kind(path: Column) -> Column:
    """text, markdown, docx, pdf or code by suffix; null for others."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    kind = F.lit(None).cast("string")
    for name, suffixes in SUFFIXES.items():
        kind = F.when(suffix.isin(*suffixes), name).otherwise(kind)
    return kind


def read_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, filename, content, kind, error: files with their bytes; unknown kinds have an error instead."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    kind = file_kind(F.col("path"))
    return files.select(
        "path",
        F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"),
        F.when(kind.isNotNull(), F.col("content")).alias("content"),
        kind.alias("kind"),
        F.when(kind.isNull(), UNSUPPORTED).alias("error"),
    )


def read_directory(spark: SparkSession, root: str, include_hidden: bool = False) -> DataFrame:
    """Files below a folder, known kinds only, without hidden and generated ones; in order of path."""
    files = read_files(spark, root, recursive=True)
    inside = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), "^" + re.escape(re.sub("^[a-z]+:/*", "/", root).rstrip("/")) + "/", "")
    parts = F.split(inside, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    skip = F.exists(folders, lambda p: p.isin(*SKIPPED_FOLDERS)) | F.lower("filename").isin(*SKIPPED_FILES)
    if not include_hidden:
        skip = skip | F.exists(parts, lambda p: F.startswith(p, F.lit(".")))
    return files.where("error is null").where(~skip).orderBy("path")


@lru_cache(maxsize=1)
def frequent_characters() -> frozenset[str]:
    """The first level of the GB 2312 character set, which is ordered by use: rows 16 to 55."""
    rows = (bytes((0xA0 + row, 0xA0 + cell)) for row in range(16, 56) for cell in range(1, 95))
    return frozenset("".join(pair.decode("gb2312", "ignore") for pair in rows))


#: Signs that readable text has besides letters and digits.
ORDINARY_SIGNS = ".,;:!?()[]{}<>-_+/\\|@#$%^&*~`'\"，。；：？！、（）《》【】“”‘’·…"
_ORDINARY = re.compile(f"[0-9A-Za-z一-鿿{re.escape(ORDINARY_SIGNS)}]")


def readable_share(text: str) -> float:
    """Share of ordinary characters among those that are no white space."""
    visible = "".join(text.split())
    return len(_ORDINARY.findall(visible)) / len(visible) if visible else 0.0


def plausibility(text: str) -> float:
    """How much a decoded text looks like one."""
    chars = [c for c in text if not c.isspace()]
    if not chars:
        return 0.0
    cjk = [c for c in chars if "一" <= c <= "鿿"]
    known = sum(c in frequent_characters() for c in cjk) / len(cjk) if cjk else 0.0
    return readable_share(text) + 0.35 * known + 0.05 * sum(map(str.isascii, chars)) / len(chars)


def decoded(raw: bytes) -> tuple[str, str]:
    """Text and encoding: as a byte-order mark says, else the most plausible that fits, earlier ones first."""
    if raw.startswith(b"\xef\xbb\xbf"):
        return tidy(raw.decode("utf-8-sig", "replace")), "utf-8-sig"
    found = []
    for encoding in ENCODINGS:
        try:
            text = tidy(raw.decode(encoding))
        except UnicodeDecodeError:
            continue
        found.append((plausibility(text), text, encoding))
    best = max(found, key=lambda f: f[0])  # the first of equals; Latin-1 always fits
    return best[1], best[2]


WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_paragraphs(raw: bytes) -> Iterator[tuple[str, int | None]]:
    """Text and heading level of each paragraph of a Word file."""
    with zipfile.ZipFile(io.BytesIO(raw)) as package:
        body = ElementTree.fromstring(package.read("word/document.xml"))
        names: dict[str, str] = {}
        if "word/styles.xml" in package.namelist():
            for style in ElementTree.fromstring(package.read("word/styles.xml")).iter(f"{WORD}style"):
                name = style.find(f"{WORD}name")
                names[style.get(f"{WORD}styleId", "")] = "" if name is None else name.get(f"{WORD}val", "")
    for paragraph in body.iter(f"{WORD}p"):
        pieces = []
        for node in paragraph.iter():
            pieces.append(node.text or "" if node.tag == f"{WORD}t" else "\t" if node.tag == f"{WORD}tab" else "\n" if node.tag in (f"{WORD}br", f"{WORD}cr") else "")
        style = paragraph.find(f"{WORD}pPr/{WORD}pStyle")
        key = "" if style is None else style.get(f"{WORD}val", "")
        level = re.search(r"(?i)(?:heading|标题)\s*([1-6])", names.get(key, key))
        yield "".join(pieces), int(level.group(1)) if level else None


def docx_blocks(raw: bytes) -> tuple[str, list[Block]]:
    """Text and blocks of a Word file; headings make the section path."""
    path: list[str] = []
    texts, paragraphs = [], []
    for number, (text, level) in enumerate(docx_paragraphs(raw), start=1):
        text = tidy(text)
        if not text:
            continue
        if level:
            path = [*path[: level - 1], text] if is_title(text) else path
            continue
        texts.append(text)
        paragraphs.append(Block(text, section_path=list(path), paragraph_start=number, paragraph_end=number, location_label=f"段落 {number}"))
    return "\n".join(texts), list(blocks_of_paragraphs(paragraphs))


def file_blocks(kind: str, filename: str, raw: bytes) -> tuple[str, str | None, list[Block]]:
    """Text, encoding and blocks of one file that is no PDF."""
    if kind == "docx":
        return (*docx_blocks(raw)[:1], None, docx_blocks(raw)[1])
    text, encoding = decoded(raw)
    if kind != "code":
        text = cut_page_end(text)
    return text, encoding, list(blocks_of_lines(text.splitlines(), filename, filename, "code" if kind == "code" else "text"))


EXTRACTED = "document_id string, filename string, source_path string, source_format string, encoding string, text string, error string"


def extracted_files(files: DataFrame) -> DataFrame:
    """One row a file: text and encoding, or the error that reading it gave. PDF pages come from a page provider instead."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                try:
                    text, encoding, _ = file_blocks(r.kind, r.filename, bytes(r.content))
                    error = None if text else "no text"
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    text, encoding, error = None, None, f"{type(e).__name__}: {e}"
                rows.append((r.document_id, r.filename, r.path, r.kind, encoding, text, error))
            yield pd.DataFrame(rows, columns=names(EXTRACTED))

    named = files.where("kind is not null and kind <> 'pdf'").select(F.sha2("path", 256).alias("document_id"), "path", "filename", "kind", "content")
    return named.mapInPandas(run, EXTRACTED)


def blocks_of_files(files: DataFrame) -> DataFrame:
    """Block table of files; those that cannot be read give nothing."""

    def made(r: dict) -> list[dict]:
        try:
            return block_rows(r["document_id"], file_blocks(r["kind"], r["filename"], bytes(r["content"]))[2])
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return []

    named = files.where("kind is not null and kind <> 'pdf'").select(F.sha2("path", 256).alias("document_id"), "filename", "kind", "content")
    return per_row(named, made, BLOCKS)


def file_documents(files: DataFrame) -> DataFrame:
    """Document rows of files, before metadata is derived."""
    got = extracted_files(files).where("error is null")
    return got.select(
        F.col("document_id").alias("id"),
        F.regexp_replace("filename", r"\.[^.]+$", "").alias("title"),
        "filename",
        "source_path",
        F.lit("file").alias("source_type"),
        F.lit(None).cast("string").alias("source_url"),
        "source_format",
        "encoding",
        F.lit(None).cast("int").alias("page_count"),
        F.current_timestamp().alias("created_at"),
    )


def is_pdf(content: Column) -> Column:
    """Whether bytes begin as a PDF does."""
    return F.substring(content, 1, 4) == F.lit("%PDF").cast("binary")


def catalog_text(sources: DataFrame) -> DataFrame:
    """One Markdown text of sources (seq, category, title, kind, description, url), grouped by category in order of appearance."""
    entry = F.concat_ws("\n", F.concat(F.lit("### "), "title"), F.lit(""), F.concat(F.lit("- 类型："), F.when(F.col("kind") == "pdf", "PDF").otherwise("网页")), F.concat(F.lit("- 作用："), "description"), F.concat(F.lit("- 官方链接："), "url"), F.lit(""))
    groups = sources.groupBy("category").agg(F.min("seq").alias("first"), F.array_sort(F.collect_list(F.struct("seq", entry.alias("text")))).alias("entries"))
    text = F.concat(F.lit("## "), "category", F.lit("\n\n"), F.array_join(F.transform("entries", lambda e: e["text"]), "\n"))
    return groups.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", text.alias("text")))), lambda g: g["text"]), "\n").alias("text"))
