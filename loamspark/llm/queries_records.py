"""Queries over ``conversations`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamspark.llm import chat_format, role_repair, warc_fixity
from loamspark.llm.common import read_table

PLANTED = r"\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn rows and one conversation in the messages layout, each by its own fingerprint."""
    rows = read_table(spark, sf_dir, "conversations")
    said = lambda role: F.struct(F.lit(role).alias("role"), F.lit(PLANTED).alias("content"))
    planted = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.array(said("user"), said("assistant")).alias("messages"))
    done = chat_format.format_chat(rows).unionByName(chat_format.format_chat(planted))
    read = done.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    stated = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(stated, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(length(coalesce(string_agg(text, '') FILTER (role = 'assistant'), '')) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(replace(replace(role, '%', '%25'), chr(10), '%0A')) + 2
                + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + 9) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


#: Pages an archive; the first two digits of a page's mark say what happens to its copy.
PER_ARCHIVE = 128
CHANGED, LOST, CUT = ("00", "01", "02"), ("03",), ("04",)


def damaged(pages: DataFrame) -> DataFrame:
    """Pages of the replica: of some a byte is changed, some are lost, of some the second half is lost."""
    mark = F.substring(F.sha2("url", 256), 1, 2)
    html = F.coalesce("html", F.lit(""))
    changed = F.concat(F.lit("#"), F.substring(html, F.lit(2), F.length(html)))
    half = F.substring(html, F.lit(1), F.floor(F.length(html) / 2).cast("int"))
    kept = pages.where(~F.coalesce(mark.isin(*LOST), F.lit(False)))
    return kept.withColumn("html", F.when(mark.isin(*CHANGED), changed).when(mark.isin(*CUT), half).otherwise(html))


def op2_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives of all pages against a replica written from damaged pages, at the offsets its own bytes have."""
    pages = read_table(spark, sf_dir, "pages")
    index = lambda x: warc_fixity.with_offsets(warc_fixity.digested(warc_fixity.page_records(x, PER_ARCHIVE)))
    found = warc_fixity.audit(index(pages), index(damaged(pages)), base=1 << 15, fanout=8)
    return found.fillna(-1, ["found_offset", "expected_length", "found_length"])


OP2_SQL = r"""
WITH m AS (SELECT page_id, url, coalesce(html, '') AS html, substr(sha256(url), 1, 2) AS mark FROM pages),
v AS (
  SELECT 'a' AS side, page_id, url, html FROM m
  UNION ALL
  SELECT 'b', page_id, url, CASE WHEN mark IN ('00', '01', '02') THEN '#' || substr(html, 2)
         WHEN mark = '04' THEN substr(html, 1, CAST(floor(length(html) / 2) AS INTEGER)) ELSE html END
  FROM m WHERE mark <> '03'),
r AS (
  SELECT side, 'part-' || CAST(floor(page_id / 128) AS BIGINT) || '.warc' AS archive, page_id, url,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
         || 'Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS payload
  FROM v),
d AS (SELECT side, archive, page_id, url, CAST(octet_length(encode(payload)) AS BIGINT) AS length, sha256(payload) AS digest FROM r),
o AS (
  SELECT DISTINCT side, archive, length, digest,
         CAST(sum(length) OVER (PARTITION BY side, archive ORDER BY page_id, url, digest ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS pos FROM d),
once AS (SELECT *, count(*) OVER (PARTITION BY archive, pos, length, digest) AS sides FROM o),
l1 AS (SELECT *, row_number() OVER (PARTITION BY side, archive, length, digest ORDER BY pos) AS n FROM once WHERE sides = 1),
j1 AS (
  SELECT coalesce(a.archive, b.archive) AS archive, a.pos, a.length, a.digest, b.pos AS pos2, b.length AS length2, b.digest AS digest2
  FROM (SELECT * FROM l1 WHERE side = 'a') a FULL JOIN (SELECT * FROM l1 WHERE side = 'b') b
    ON a.archive = b.archive AND a.length = b.length AND a.digest = b.digest AND a.n = b.n),
l2 AS (
  SELECT 'a' AS side, archive, pos, length, digest FROM j1 WHERE pos2 IS NULL
  UNION ALL SELECT 'b', archive, pos2, length2, digest2 FROM j1 WHERE pos IS NULL),
n2 AS (SELECT *, row_number() OVER (PARTITION BY side, archive, pos ORDER BY length, digest) AS n FROM l2),
j2 AS (
  SELECT coalesce(a.archive, b.archive) AS archive, a.pos, a.length, a.digest, b.pos AS pos2, b.length AS length2, b.digest AS digest2
  FROM (SELECT * FROM n2 WHERE side = 'a') a FULL JOIN (SELECT * FROM n2 WHERE side = 'b') b ON a.archive = b.archive AND a.pos = b.pos AND a.n = b.n)
SELECT archive, pos AS "offset", pos2 AS found_offset, 'moved' AS status, length AS expected_length, length2 AS found_length, digest AS expected, digest2 AS found
FROM j1 WHERE pos IS NOT NULL AND pos2 IS NOT NULL
UNION ALL
SELECT archive, coalesce(pos, pos2), coalesce(pos2, -1), CASE WHEN pos2 IS NULL THEN 'missing' WHEN pos IS NULL THEN 'extra' ELSE 'corrupt' END,
       coalesce(length, -1), coalesce(length2, -1), digest, digest2
FROM j2
"""


def damaged_turns(rows: DataFrame) -> DataFrame:
    """Rows of ``conversations`` dropped, emptied, cut, repeated or given another role by a checksum of their place."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    mark = F.pmod(F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")), F.lit(20))
    text = F.when(mark == 1, F.lit("")).when(mark == 2, F.regexp_replace(filled("text"), "[.!?]", "")).otherwise(filled("text"))
    role = F.when(mark == 4, F.lit("user")).otherwise(filled("role"))
    copies = F.when(mark == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where(mark != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, the cheapest edits and the digest of what they leave."""
    rows = read_table(spark, sf_dir, "conversations")
    found = role_repair.repair(damaged_turns(rows))
    digests = role_repair.line_digests(found.lines)
    every = rows.select("conv_id").distinct().withColumn("c", role_repair.conversation_key(F.col("conv_id")))
    counted = lambda n: F.coalesce(n, F.lit(0)).cast("long").alias(n)
    return every.join(found.report, "c", "left").join(digests, "c", "left").select(
        "conv_id",
        *map(counted, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


QUERIES = {"op1_chat_format": op1_chat_format, "op2_merkle_audit": op2_merkle_audit, "op13_structure_repair": op13_structure_repair}
ORACLE_SQL = {"op1_chat_format": OP1_SQL, "op2_merkle_audit": OP2_SQL}
