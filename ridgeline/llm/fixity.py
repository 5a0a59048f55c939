"""WARC fixity: Merkle trees over ordered offset ranges, compared between replicas.

A record's place (archive, ordinal, offset, length) comes from the archive's index, so a lost or
changed record does not shift its neighbours.  Leaves hash the record bytes with their offset range;
``fan`` neighbouring nodes are hashed into their parent, level by level, up to one root per archive.
Two replicas compare roots first and then only the children of nodes that differ, down to the records.

Every level is one grouping by (archive, ordinal div fan), so a group has ``fan`` rows at most however
large the archive is, and the levels above the leaves hold 1 / (fan - 1) of the records together.

Defined results: null headers and payloads are empty; null page ids share the archives of their own
below 0; records equal in all columns keep separate ordinals; empty tables give no rows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import stored

FAN = 16
#: Page ids that share one archive file; a null id's archive follows from its url's length.
PER_ARCHIVE = 1000


def archive_of(page_id: Column, url: Column) -> Column:
    """The archive of a page: its id div PER_ARCHIVE; null ids are spread over archives -1 to -1000."""
    spread = -1 - F.coalesce(F.length(url), F.lit(0)) % PER_ARCHIVE
    return F.coalesce(F.floor(page_id / PER_ARCHIVE), spread).cast("long")


def record(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC response record as text: header lines, blank line, payload and the closing blank lines."""
    payload = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit("\r\n\r\n"),
        payload,
        F.lit("\r\n\r\n"),
    )


def index(pages: DataFrame) -> DataFrame:
    """(archive, ordinal, offset, length, page_id, digest): the archives' index with each record's SHA-256."""
    rec = record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select(
        archive_of(F.col("page_id"), F.col("url")).alias("archive"),
        F.col("page_id").cast("long").alias("page_id"),
        F.octet_length(rec).cast("long").alias("length"),
        F.sha2(rec, 256).alias("digest"),
    )
    order = Window.partitionBy("archive").orderBy("page_id", "digest")
    return rows.select(
        "archive",
        (F.row_number().over(order) - 1).cast("long").alias("ordinal"),
        F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        "length",
        "page_id",
        "digest",
    )


def leaves(records: DataFrame) -> DataFrame:
    """(level 0, archive, node, offset, end, hash) from (archive, ordinal, offset, length, digest)."""
    end = F.col("offset") + F.col("length")
    return records.select(
        F.lit(0).alias("level"),
        "archive",
        F.col("ordinal").alias("node"),
        "offset",
        end.alias("end"),
        F.sha2(F.concat_ws(":", "offset", end, "digest"), 256).alias("hash"),
    )


def parents(nodes: DataFrame, level: int, fan: int = FAN) -> DataFrame:
    """The level above: up to ``fan`` neighbours in order, hashed together over their offset range."""
    return (
        nodes.groupBy("archive", F.floor(F.col("node") / fan).cast("long").alias("up"))
        .agg(F.min("offset").alias("offset"), F.max("end").alias("end"), F.sort_array(F.collect_list(F.struct("node", "hash"))).alias("below"))
        .select(
            F.lit(level).alias("level"),
            "archive",
            F.col("up").alias("node"),
            "offset",
            "end",
            F.sha2(F.array_join(F.transform("below", lambda x: F.concat_ws(":", x["node"], x["hash"])), ","), 256).alias("hash"),
        )
    )


def height(records: DataFrame, fan: int = FAN) -> int:
    """Levels above the leaves until the largest archive has one root."""
    most = records.agg(F.max("ordinal")).first()[0] or 0
    levels = 1
    while most >= fan:
        most, levels = most // fan, levels + 1
    return levels


def tree(records: DataFrame, levels: int, fan: int = FAN) -> list[DataFrame]:
    """The levels, leaves first, each stored: a level is read for its parents and again in the audit."""
    out = [stored(leaves(records), "leaves")]
    for level in range(1, levels + 1):
        out.append(stored(parents(out[-1], level, fan), f"level{level}"))
    return out


def audit(left: list[DataFrame], right: list[DataFrame], fan: int = FAN) -> DataFrame:
    """(archive, ordinal, state) of the records that differ: changed, missing (on the right) or extra.

    Roots are compared first; a level's nodes are read for comparison only below a node that differs.
    """
    suspects = None
    for level in reversed(range(len(left))):
        a, b = left[level], right[level]
        if suspects is not None:
            up = F.floor(F.col("node") / fan).cast("long")
            a, b = (
                x.join(suspects, (x["archive"] == F.col("s_archive")) & (up == F.col("s_node")), "left_semi") for x in (a, b)
            )
        pairs = a.select("archive", "node", F.col("hash").alias("h")).join(
            b.select(F.col("archive").alias("o_archive"), F.col("node").alias("o_node"), F.col("hash").alias("o")),
            (F.col("archive") == F.col("o_archive")) & (F.col("node") == F.col("o_node")),
            "full",
        )
        differ = pairs.filter(~F.col("h").eqNullSafe(F.col("o"))).select(
            F.coalesce("archive", "o_archive").alias("s_archive"),
            F.coalesce("node", "o_node").alias("s_node"),
            F.when(F.col("o").isNull(), "missing").when(F.col("h").isNull(), "extra").otherwise("changed").alias("state"),
        )
        suspects = stored(differ, f"differ{level}")
    return suspects.select(F.col("s_archive").alias("archive"), F.col("s_node").alias("ordinal"), "state")


def compare(records: DataFrame, replica: DataFrame, fan: int = FAN) -> DataFrame:
    """Both replicas' records, as ``index`` gives them, to the differing ones with their place and page."""
    mine, other = stored(records, "records"), stored(replica, "replica")
    levels = max(height(mine, fan), height(other, fan))
    found = audit(tree(mine, levels, fan), tree(other, levels, fan), fan)
    place = lambda x: x.select(F.col("archive").alias("p_archive"), F.col("ordinal").alias("p_ordinal"), "offset", "length", "page_id")
    known = place(mine).join(found.filter("state <> 'extra'"), (F.col("p_archive") == F.col("archive")) & (F.col("p_ordinal") == F.col("ordinal")))
    added = place(other).join(found.filter("state = 'extra'"), (F.col("p_archive") == F.col("archive")) & (F.col("p_ordinal") == F.col("ordinal")))
    return known.union(added).select("archive", "ordinal", "offset", "length", "page_id", "state")


def decayed(pages: DataFrame, records: DataFrame) -> DataFrame:
    """A replica with decay, for tests and the query: of every 97 page ids one payload changed by a
    byte, of every 89 one record lost.  Places stay those of the index."""
    html = F.coalesce("html", F.lit(""))
    worn = F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("#"), F.substring(html, 2, 2**31 - 1))).otherwise(html)
    kept = pages.filter((F.col("page_id") % 89 != 7) | F.col("page_id").isNull())
    # Read from the index by page: the copy's digest replaces the original one.
    digests = kept.select(
        F.col("page_id").alias("c_page"),
        F.sha2(record(F.col("page_id"), F.col("url"), F.col("html")), 256).alias("c_digest"),
        F.sha2(record(F.col("page_id"), F.col("url"), worn), 256).alias("w_digest"),
    ).distinct()
    match = F.col("page_id").eqNullSafe(F.col("c_page")) & (F.col("digest") == F.col("c_digest"))
    return records.join(digests, match).select("archive", "ordinal", "offset", "length", "page_id", F.col("w_digest").alias("digest"))
