"""Which chunks a question searches: named documents, low-signal types, and filters that hold only if something passes them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamspark.functions.metadata import lookup, lookup_variants
from loamspark.functions.text import STRINGS, contains_any
from loamspark.operators.intent import SCOPE_BLUETOOTH
from loamspark.operators.ranking import CODE_TYPES
from loamspark.session import materialized, sent_whole

#: Words that a hint can lie inside, in folded text.
HINT_WORD, HINT_WORD_END = "[a-z0-9_]{3,}", "[^a-z0-9_]+"
#: Fixed value: shorter names of documents are not looked for. Heads that are searched for hints at a time.
LEAST_NAME, HEADS = 6, 2048
LOW_SIGNAL = ("catalog", "product_catalog")
#: Text that marks a chunk as code.
CODE_TEXT = ("app_main", "cmakelists", "kconfig", "sdkconfig", "idf_component_register", "#include", "void ", "static ", "def ", "class ")


def _head(c: Callable[[str], Column], length: int, symbol: bool = False) -> Column:
    path = F.coalesce(F.array_join(c("section_path"), " > "), F.lit(""))
    parts = [F.coalesce(c("document_title"), F.lit("")), path, F.substring(F.coalesce(c("content"), F.lit("")), 1, length)]
    return lookup(F.concat_ws("\n", *([F.coalesce(c("symbol_name"), F.lit(""))] if symbol else []), *parts))


def is_bluetooth_chunk(c=F.col) -> Column:
    return contains_any(_head(c, 800), SCOPE_BLUETOOTH)


def is_code_chunk(c=F.col) -> Column:
    named = c("doc_type").isin(*CODE_TYPES) | (c("block_type") == "code") | (F.coalesce(c("symbol_name"), F.lit("")) != "") | c("line_start").isNotNull()
    return F.coalesce(named, F.lit(False)) | contains_any(_head(c, 800), CODE_TEXT)


def matches_hint(hints: Column, c=F.col) -> Column:
    text = _head(c, 1000, symbol=True)
    return F.exists(hints, lambda h: F.contains(text, h))


def named_documents(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """(question_id, document_id): documents of which a name of six characters or more occurs in the question.

    A name is looked up by its first six characters among all runs of six in the questions, the
    stated small side, so that it meets only questions that hold those.
    """
    variants = lookup_variants(F.col("title"), F.col("filename"), F.col("source_path"))
    names = documents.select(F.col("id").alias("document_id"), F.explode(F.filter(variants, lambda v: F.length(v) >= LEAST_NAME)).alias("name"))
    asked = questions.select("question_id", lookup(F.col("question")).alias("folded")).where(F.length("folded") >= LEAST_NAME)
    runs = F.transform(F.sequence(F.lit(1), F.length("folded") - LEAST_NAME + 1), lambda i: F.substring(F.col("folded"), i, F.lit(LEAST_NAME)))
    begun = materialized(asked.select("question_id", F.explode(F.array_distinct(runs)).alias("run")))
    met = names.join(sent_whole(begun)(begun), F.substring("name", 1, LEAST_NAME) == F.col("run")).join(sent_whole(asked)(asked), "question_id")
    return met.where(F.contains("folded", "name")).select("question_id", "document_id").distinct()


def keep_if_any(pairs: DataFrame, predicate: Column, key: str = "question_id") -> DataFrame:
    """Rows that pass, or all rows of a key none of whose rows passes."""
    found = pairs.groupBy(key).agg(F.max(predicate.cast("int")).alias("__any"))
    return pairs.join(found, key).where(predicate | (F.col("__any") == 0)).drop("__any")


def cascade(presence: Column, flags: int, used: list[Column]) -> Column:
    """Which combinations of flags stay, as bits, after filters applied one after another.

    ``presence`` has a bit for each combination that occurs; ``used[k]`` says whether the
    filter on flag k is asked for at all. A filter that nothing passes changes nothing.
    """
    kept = F.lit((1 << (1 << flags)) - 1).cast("long")
    for k, asked in enumerate(used):
        mask = sum(1 << combo for combo in range(1 << flags) if combo >> k & 1)
        some = presence.bitwiseAND(kept).bitwiseAND(F.lit(mask).cast("long")) != 0
        kept = F.when(asked & some, kept.bitwiseAND(F.lit(mask).cast("long"))).otherwise(kept)
    return kept


def with_hints(heads: DataFrame, hints: list[str]) -> DataFrame:
    """``heads`` (id, document_id, profile, head) with ``held`` in place of the head: those of the hints that lie inside a word of it.

    Hints are looked for in the distinct words of many heads, and no row is made for a word.
    """
    if not hints:
        return heads.select("id", "document_id", "profile", F.array().cast(STRINGS).alias("held"))
    schema = T.StructType([*heads.select("id", "document_id", "profile").schema.fields, T.StructField("held", T.ArrayType(T.StringType()))])
    sought = pa.array(hints, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(start, HEADS) for b in batches for start in range(0, b.num_rows, HEADS)):
            split = pc.split_pattern_regex(batch.column(3), pattern=HINT_WORD_END)
            rows, coded = pc.list_parent_indices(split).to_numpy().astype(np.int64), split.flatten().dictionary_encode()
            codes = coded.indices.to_numpy()
            inside = [np.flatnonzero(pc.match_substring(coded.dictionary, h).to_numpy(zero_copy_only=False)) for h in hints]
            of = np.repeat(np.arange(len(hints)), [len(w) for w in inside])
            words = np.concatenate(inside)
            of = of[np.argsort(words, kind="stable")]  # hints, word by word
            each = np.bincount(words, minlength=len(coded.dictionary))
            first, n = (np.cumsum(each) - each)[codes], each[codes]
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            keys = np.unique(np.repeat(rows, n) * len(hints) + of[at])
            ends = pa.array(np.searchsorted(keys // len(hints), np.arange(batch.num_rows + 1)), pa.int32())
            held = pa.ListArray.from_arrays(ends, sought.take(pa.array(keys % len(hints))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], held], names=["id", "document_id", "profile", "held"])

    return heads.select("id", "document_id", "profile", "head").mapInArrow(run, schema)


@dataclass(frozen=True)
class Symbols:
    """Dictionaries made at ingestion: words(word, id) of the heads of chunks, symbols(symbol, id) that chunks define."""

    words: DataFrame
    symbols: DataFrame

    @staticmethod
    def of(chunks: DataFrame) -> Symbols:
        words = chunks.select("id", F.explode(F.array_distinct(F.regexp_extract_all(_head(F.col, 1000, symbol=True), F.lit(HINT_WORD), 0))).alias("word"))
        symbols = chunks.select(F.lower("symbol_name").alias("symbol"), "id").where("symbol != ''")
        return Symbols(words, symbols)

    def write(self, path: str, mode: str = "overwrite") -> None:
        """Dealt and sorted by word, so that a scan prunes row groups."""
        self.words.repartitionByRange("word").sortWithinPartitions("word").write.mode(mode).parquet(f"{path}/words")
        self.symbols.repartitionByRange("symbol").sortWithinPartitions("symbol").write.mode(mode).parquet(f"{path}/symbols")

    @staticmethod
    def read(spark, path: str) -> Symbols:
        return Symbols(spark.read.parquet(f"{path}/words"), spark.read.parquet(f"{path}/symbols"))

    def holding(self, hints: DataFrame) -> DataFrame:
        """(question_id, id): chunks whose head holds a hint (question_id, hint) anywhere, inside a longer word too.

        A hint has word characters only, so it lies inside one word of the dictionary; the
        words are reached by the hint's first three letters, never by all pairs.
        """
        grams = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))
        asked = hints.select("hint").distinct().withColumn("gram", F.substring("hint", 1, 3))
        opened = self.words.select("word").distinct().select("word", F.explode(F.array_distinct(grams(F.col("word")))).alias("gram"))
        found = opened.join(asked, "gram").where(F.contains("word", F.col("hint"))).select("hint", "word")
        return self.words.join(found, "word").join(hints, "hint").select("question_id", "id").distinct()


@dataclass(frozen=True)
class Scope:
    """What each question searches, without a row for every question and chunk.

    chunks(id, document_id, profile): a profile is what the filters tell chunks apart by
    (low signal, bluetooth, code, block type), of which there are few. allowed(question_id,
    profile) are whole profiles that a question searches; listed(question_id, id) are chunks
    it searches one by one, found through a document's name or an identifier. A question has
    rows in one of the two. exact(question_id, id): chunks that define a symbol it names.
    """

    chunks: DataFrame
    allowed: DataFrame
    listed: DataFrame
    exact: DataFrame

    def within(self, rows: DataFrame, id_col: str = "chunk_id") -> DataFrame:
        """The rows (question_id, ``id_col``, ...) whose chunk the question searches."""
        profiles = self.chunks.select(F.col("id").alias(id_col), "profile")
        open_ = rows.join(profiles, id_col).join(self.allowed, ["question_id", "profile"]).select(rows.columns)
        return open_.unionByName(rows.join(self.listed.withColumnRenamed("id", id_col), ["question_id", id_col], "left_semi").select(rows.columns))

    def without(self, questions: DataFrame) -> Scope:
        """The scope of all questions but these."""
        left = lambda rows: rows.join(questions.select("question_id"), "question_id", "left_anti")
        return replace(self, allowed=left(self.allowed), listed=left(self.listed))

    def sums(self, values: dict[str, Column], per_chunk: DataFrame | None = None) -> DataFrame:
        """question_id and sums over the searched chunks, added up by profile before questions meet them."""
        rows = self.chunks if per_chunk is None else self.chunks.join(per_chunk, "id")
        each = [F.sum(v).alias(n) for n, v in values.items()]
        again = [F.sum(n).alias(n) for n in values]
        by_profile = rows.groupBy("profile").agg(*each).join(self.allowed, "profile").groupBy("question_id").agg(*again)
        return by_profile.unionByName(rows.join(self.listed, "id").groupBy("question_id").agg(*each))

    def pairs(self) -> DataFrame:
        """(question_id, id) written out, for small tables and tests."""
        return self.chunks.join(self.allowed, "profile").select("question_id", "id").unionByName(self.listed)


def question_scope(analyzed: DataFrame, chunks: DataFrame, named: DataFrame, symbols: Symbols | None = None) -> Scope:
    """The scope of analysed questions: named documents, else the catalogue, else filters that hold only if something passes them.

    Presence of filter combinations comes from counts by profile and, for questions with
    identifiers, counts of the chunks that hold them; the decision is one mask a question.
    """
    named = materialized(named)
    kind = F.coalesce("block_type", F.lit("-"))
    marks = [F.coalesce(F.col("doc_type").isin(*LOW_SIGNAL), F.lit(False)), is_bluetooth_chunk(), is_code_chunk()]
    profile = F.concat(*[F.when(m, "1").otherwise("0") for m in marks], kind)
    has_named = named.select("question_id").distinct().withColumn("names_some", F.lit(True))
    asked = materialized(
        analyzed.select("question_id", "plan", "hints", "wants_catalog", "wants_bluetooth", "wants_code").join(has_named, "question_id", "left").na.fill(False, ["names_some"])
    )
    code = F.col("plan.prefer_code") | F.col("wants_code")
    hints = materialized(asked.where(~F.col("names_some") & ~F.col("wants_catalog") & code).select("question_id", F.explode("hints").alias("hint")))
    sent = sent_whole(hints)
    # Without a dictionary made at ingestion, the chunks are searched for the hints in the pass that makes their profiles.
    sought = sorted(r["hint"] for r in hints.select("hint").distinct().collect()) if symbols is None else []
    parts = materialized(with_hints(chunks.select("id", "document_id", profile.alias("profile"), _head(F.col, 1000, symbol=True).alias("head")), sought))
    slim = parts.drop("held")
    # A row for each combination of three flags and a block type.
    known = [(r["profile"], r["n"]) for r in slim.groupBy("profile").agg(F.count("*").alias("n")).collect()]

    cells = [F.struct(F.lit(p).alias("profile"), F.lit(n).alias("n")) for p, n in known] or [F.struct(F.lit("").alias("profile"), F.lit(0).alias("n"))]
    dealt = asked.where("not names_some").withColumn("cell", F.explode(F.array(*cells))).select("*", "cell.*").drop("cell").where("n > 0")
    low = F.substring("profile", 1, 1) == "1"
    narrowed = dealt.where(~F.col("wants_catalog") & ~low)

    some_hints = F.size("hints") > 0
    if symbols is None:
        holding = parts.where(~low).select("id", "profile", F.explode("held").alias("hint")).join(sent(hints), "hint").select("question_id", "id", "profile").distinct()
    else:
        holding = symbols.holding(hints).join(slim.where(~low), "id").select("question_id", "id", "profile")
    held = materialized(holding)
    counted = narrowed.join(held.groupBy("question_id", "profile").agg(F.count("*").alias("n_held")), ["question_id", "profile"], "left").na.fill(0, ["n_held"])

    block_type = F.substring(F.col("profile"), 4, 100)
    listed_type = F.array_contains(F.col("plan.preferred_block_types"), block_type)
    flags = [F.substring("profile", 2, 1) == "1", F.coalesce(listed_type, F.lit(False)), F.substring("profile", 3, 1) == "1"]
    plain = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(flags)), F.lit(0))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at)
    here = F.when(F.col("n_held") < F.col("n"), bit(plain)).otherwise(F.lit(0)).bitwiseOR(F.when(F.col("n_held") > 0, bit(plain + 8)).otherwise(F.lit(0)))
    marked = counted.select("*", plain.alias("plain"), here.alias("here"))
    presence = marked.groupBy("question_id").agg(F.bit_or("here").alias("presence"))
    used = [F.col("wants_bluetooth") & ~some_hints & (F.col("plan.task_type") != "book_index"), F.size("plan.preferred_block_types") > 0, code, code & some_hints]
    kept = marked.join(presence, "question_id").withColumn("kept", cascade(F.col("presence"), 4, used))
    has = lambda at: F.call_function("shiftright", F.col("kept").cast("long"), at).bitwiseAND(F.lit(1).cast("long")) == 1
    decided = materialized(kept.select("question_id", "profile", has(F.col("plain")).alias("whole"), has(F.col("plain") + 8).alias("held")))

    allowed = decided.where("whole").select("question_id", "profile").unionByName(dealt.where("wants_catalog").select("question_id", "profile"))
    hinted = held.join(decided.where("held and not whole"), ["question_id", "profile"]).select("question_id", "id")
    listed = hinted.unionByName(slim.join(named, "document_id").select("question_id", "id"))
    scope = Scope(slim, materialized(allowed), materialized(listed), listed.limit(0))
    defined = Symbols.of(chunks).symbols if symbols is None else symbols.symbols
    defining = defined.join(sent(hints), F.col("hint") == F.col("symbol")).select("question_id", "id").distinct()
    return replace(scope, exact=materialized(scope.within(defining, "id")))
