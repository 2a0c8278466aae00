"""WARC fixity audit: Merkle trees over records and their offset ranges.

A ledger lists the records of each archive in order, with offset, length and digest.
Leaves hash (offset, length, digest); an inner node hashes its children, each with its
offset range, so order and place are covered, not only content.  The audit compares the
roots of two replicas and goes down only where they differ, level by level, to the
records, which it names changed, moved, missing or extra.

Null payloads count as empty.  Records without an id are spread over archives of their
own; repeated records are numbered; empty tables give no archives.  Groups are of
``FANOUT`` rows, and an archive holds about ``ARCHIVE_ROWS`` records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

FANOUT = 16
#: Records of an archive; a power of two.
ARCHIVE_ROWS = 1024


def warc_records(pages: DataFrame) -> DataFrame:
    """archive_id, record_id and payload (the bytes of a response record, as text) of each page."""
    html = F.coalesce("html", F.lit(""))
    bits = ARCHIVE_ROWS.bit_length() - 1
    loose = -1 - F.pmod(F.xxhash64("url", "html"), F.lit(1 << 20))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce("url", F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return pages.select(
        F.coalesce(F.shiftright("page_id", bits), loose).alias("archive_id"),
        F.col("page_id").alias("record_id"),
        F.concat(head, html, F.lit("\r\n\r\n")).alias("payload"),
    )


def ledger(records: DataFrame) -> DataFrame:
    """archive_id, record_id, nth (of equal ids), place, offset, length and digest."""
    each = records.select(
        "archive_id", "record_id",
        F.octet_length("payload").cast("long").alias("length"),
        F.sha2(F.col("payload").cast("binary"), 256).alias("digest"),
    )
    order = Window.partitionBy("archive_id").orderBy(F.col("record_id").asc_nulls_last(), "digest")
    same = Window.partitionBy("archive_id", "record_id").orderBy("digest")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return each.select(
        "archive_id", "record_id",
        F.row_number().over(same).alias("nth"),
        (F.row_number().over(order) - 1).cast("long").alias("place"),
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"),
        "length", "digest",
    )


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"), 256)


def leaves(book: DataFrame) -> DataFrame:
    """Level 0: side, archive_id, node, start, end, hash."""
    return book.select(
        "side", "archive_id", F.col("place").alias("node"), F.col("offset").alias("start"),
        (F.col("offset") + F.col("length")).alias("end"), _hash(F.col("offset"), F.col("length"), F.col("digest")).alias("hash"),
    )


def parents(level: DataFrame) -> DataFrame:
    """The level above, from at most FANOUT children a node."""
    text = F.concat_ws(":", F.col("start").cast("string"), F.col("end").cast("string"), "hash")
    child = F.struct("node", text.alias("text"))
    ordered = F.transform(F.array_sort(F.collect_list(child)), lambda c: c.text)
    up = level.groupBy("side", "archive_id", F.floor(F.col("node") / FANOUT).cast("long").alias("node"))
    return up.agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        F.sha2(F.array_join(ordered, "|").cast("binary"), 256).alias("hash"),
    )


def _differing(nodes: DataFrame) -> DataFrame:
    """Nodes (archive_id, node) whose hash differs between the sides, or that one side lacks."""
    side = lambda n: F.max(F.when(F.col("side") == n, F.col("hash")))
    both = nodes.groupBy("archive_id", "node").agg(side(0).alias("a"), side(1).alias("b"))
    return both.where(~F.col("a").eqNullSafe(F.col("b")))


def audit(primary: DataFrame, replica: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of two ledgers: roots (archive_id, n_records, root_a, root_b) and damaged records."""
    books = settle(
        primary.withColumn("side", F.lit(0)).unionByName(replica.withColumn("side", F.lit(1))), "ledgers"
    )
    most = books.agg(F.max("place")).first()[0] or 0
    levels = [leaves(books)]
    depth = 3
    while FANOUT**depth <= most:
        depth += 1
    for k in range(depth):
        levels.append(settle(parents(levels[-1]), f"level-{k + 1}"))
    one = lambda n, c: F.max(F.when(F.col("side") == n, F.col(c)))
    counts = books.where("side = 0").groupBy("archive_id").agg(F.count("*").alias("n_records"))
    roots = levels[-1].groupBy("archive_id").agg(one(0, "hash").alias("root_a"), one(1, "hash").alias("root_b"))
    roots = roots.join(counts, "archive_id", "left").withColumn("n_records", F.coalesce("n_records", F.lit(0)))
    wrong = _differing(levels[-1]).select("archive_id", "node")
    for level in reversed(levels[1:-1]):
        below = level.withColumn("_up", F.floor(F.col("node") / FANOUT).cast("long"))
        up = wrong.withColumnRenamed("node", "_up")
        wrong = settle(_differing(below.join(up, ["archive_id", "_up"])).select("archive_id", "node"), "wrong")
    suspects = books.withColumn("node", F.floor(F.col("place") / FANOUT).cast("long")).join(wrong, ["archive_id", "node"])
    rows = suspects.groupBy("archive_id", "record_id", "nth").agg(
        *[one(n, c).alias(f"{c}_{s}") for n, s in ((0, "a"), (1, "b")) for c in ("offset", "length", "digest")]
    )
    status = (
        F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra")
        .when(F.col("digest_a") != F.col("digest_b"), "changed").when(F.col("offset_a") != F.col("offset_b"), "moved")
    )
    damaged = rows.withColumn("status", status).where("status is not null")
    return roots, damaged


# --------------------------------------------------------------------------
# a second replica, for a table that has only one


def worn_copy(records: DataFrame, book: DataFrame) -> DataFrame:
    """Ledger of a copy with faults that follow from the ids: of 97 records one has a
    changed first byte and one is blank; every seventh archive has lost its last five."""
    key = F.conv(F.substring(F.md5(F.col("record_id").cast("string").cast("binary")), 1, 7), 16, 10).cast("long") % 97
    flipped = F.concat(F.lit("#"), F.substring("payload", 2, 2147483647))
    blank = F.repeat(F.lit(" "), F.octet_length("payload"))
    payload = F.when(key == 0, flipped).when(key == 1, blank).otherwise(F.col("payload"))
    copied = ledger(records.withColumn("payload", payload))
    last = book.groupBy("archive_id").agg(F.count("*").alias("_n"))
    lost = (F.pmod("archive_id", F.lit(7)) == 3) & (F.col("place") >= F.col("_n") - 5)
    return copied.join(last, "archive_id").where(~lost).drop("_n")


def audit_pages(pages: DataFrame) -> DataFrame:
    """One row for each archive (status ``intact`` or ``damaged``) and each damaged record."""
    records = warc_records(pages)
    book = ledger(records)
    roots, damaged = audit(book, worn_copy(records, book))
    same = F.col("root_a").eqNullSafe(F.col("root_b"))
    none = lambda kind: F.lit(None).cast(kind)
    archives = roots.select(
        "archive_id", none("long").alias("record_id"), none("int").alias("nth"),
        F.when(same, "intact").otherwise("damaged").alias("status"), F.lit(0).cast("long").alias("offset"),
        F.col("n_records").cast("long").alias("extent"), F.col("root_a").alias("hash_a"), F.col("root_b").alias("hash_b"),
    )
    records = damaged.select(
        "archive_id", "record_id", "nth", "status", F.coalesce("offset_a", "offset_b").alias("offset"),
        F.coalesce("length_a", "length_b").alias("extent"), F.col("digest_a").alias("hash_a"), F.col("digest_b").alias("hash_b"),
    )
    return archives.unionByName(records)


AUDIT_SQL = """
WITH rec AS (
  SELECT page_id >> 10 AS archive_id, page_id AS record_id,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
      || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
      || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
      || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS payload
  FROM pages),
keyed AS (SELECT *, ('0x' || substr(md5(record_id::VARCHAR), 1, 7))::BIGINT % 97 AS k FROM rec),
sides AS (
  SELECT 0 AS side, archive_id, record_id, payload FROM keyed
  UNION ALL
  SELECT 1, archive_id, record_id,
    CASE WHEN k = 0 THEN '#' || substr(payload, 2) WHEN k = 1 THEN repeat(' ', strlen(payload)) ELSE payload END
  FROM keyed),
placed AS (
  SELECT side, archive_id, record_id, strlen(payload) AS length, sha256(payload) AS digest,
    row_number() OVER (PARTITION BY side, archive_id ORDER BY record_id) - 1 AS place,
    coalesce(sum(strlen(payload)) OVER (PARTITION BY side, archive_id ORDER BY record_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offs,
    count(*) OVER (PARTITION BY side, archive_id) AS n
  FROM sides),
book AS (SELECT * FROM placed WHERE NOT (side = 1 AND archive_id % 7 = 3 AND place >= n - 5)),
l0 AS (SELECT side, archive_id, place AS node, offs AS s, offs + length AS e,
  sha256(offs || ':' || length || ':' || digest) AS h FROM book),
l1 AS (SELECT side, archive_id, node // 16 AS node, min(s) AS s, max(e) AS e,
  sha256(string_agg(s || ':' || e || ':' || h, '|' ORDER BY node)) AS h FROM l0 GROUP BY side, archive_id, node // 16),
l2 AS (SELECT side, archive_id, node // 16 AS node, min(s) AS s, max(e) AS e,
  sha256(string_agg(s || ':' || e || ':' || h, '|' ORDER BY node)) AS h FROM l1 GROUP BY side, archive_id, node // 16),
l3 AS (SELECT side, archive_id, node // 16 AS node,
  sha256(string_agg(s || ':' || e || ':' || h, '|' ORDER BY node)) AS h FROM l2 GROUP BY side, archive_id, node // 16),
roots AS (SELECT archive_id, max(h) FILTER (side = 0) AS hash_a, max(h) FILTER (side = 1) AS hash_b FROM l3 GROUP BY archive_id)
SELECT r.archive_id, NULL::BIGINT AS record_id, NULL::INTEGER AS nth,
  CASE WHEN hash_a IS NOT DISTINCT FROM hash_b THEN 'intact' ELSE 'damaged' END AS status, 0::BIGINT AS "offset",
  (SELECT count(*) FROM book b WHERE b.side = 0 AND b.archive_id = r.archive_id) AS extent, hash_a, hash_b
FROM roots r
UNION ALL
SELECT a.archive_id, a.record_id, 1, CASE WHEN b.digest IS NULL THEN 'missing' ELSE 'changed' END, a.offs, a.length, a.digest, b.digest
FROM (SELECT * FROM book WHERE side = 0) a LEFT JOIN (SELECT * FROM book WHERE side = 1) b USING (archive_id, record_id)
WHERE a.digest IS DISTINCT FROM b.digest
"""
