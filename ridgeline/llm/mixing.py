"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Each source's documents are shuffled and served up to ``most`` times.  A served copy's virtual finish
time is its source's words up to and with it, divided by the source's target; a source with a larger
target therefore advances more words per unit of virtual time.  All copies are range-sorted by finish
time and taken while the running total stays within the budget; the copy at the head of each source's
queue then fills what is left of that source's target in part.

No window holds a source or the whole corpus: running sums are taken inside hash buckets or ranges
of finish time, on top of prefix sums of the bucket totals.

Defined results: a null or blank text has size 0 and takes 0; a null source is a source of its own,
last in order; null ids and repeated rows count like any others; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.numeric import quoted
from ridgeline.llm.common import same, stored

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, turn): turn, a hash of id and text, is the shuffled order inside a source."""
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        turn_of(F.col("doc_id"), F.col("text")).alias("turn"),
    )


def turn_of(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit("")))))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the budget by weight, none above ``most`` times its size.

    A source is capped exactly when the level at which it would be (its cap over its weight) uses up
    no more than the budget; the others share what the capped ones leave, by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")))
    ratio = F.col("cap") / F.col("weight")
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = Window.orderBy("ratio").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    w = weighed.withColumn("cap", (most * F.col("source_size")).cast("double")).withColumn("ratio", ratio)
    w = w.withColumns(
        {
            "budget": F.lit(share) * F.sum("source_size").over(whole),
            "heavy": F.sum("weight").over(whole),
            "caps": F.sum("cap").over(level),
            "light": F.sum("weight").over(level),
        }
    )
    w = w.withColumn("capped", F.col("caps") + F.col("ratio") * (F.col("heavy") - F.col("light")) <= F.col("budget"))
    w = w.withColumns(
        {
            "left": F.col("budget") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(whole), F.lit(0.0)),
            "open": F.sum(F.when(~F.col("capped"), F.col("weight"))).over(whole),
        }
    )
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("left") * F.col("weight") / F.col("open"))
    return w.select("source", "source_size", target.alias("target"))


def queued(sizes: DataFrame, bucket_rows: int) -> DataFrame:
    """Adds ``after``, the source's words up to and with this document in shuffled order."""
    buckets = max(1, math.ceil(sizes.count() / bucket_rows))
    cut = sizes.withColumn("bucket", F.floor(F.conv(F.substring("turn", 1, 8), 16, 10).cast("long") * buckets / 2**32).cast("long"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("source", "bucket").agg(F.sum("size").alias("n")).select(
        F.col("source").alias("of"), F.col("bucket").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("turn", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = cut.withColumn("after", F.sum("size").over(inside))
    return summed.join(totals, same(F.col("source"), F.col("of")) & (F.col("bucket") == F.col("at"))).select(
        "doc_id", "source", "size", "turn", (F.col("after") + F.col("base")).alias("after")
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, bucket_rows: int = 16384) -> DataFrame:
    """One row per document: doc_id, turn, size, source_size, target and taken."""
    sizes = stored(sized(docs), "sizes")
    goal = stored(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    aim = goal.select(F.col("source").alias("of"), "source_size", "target")
    line = stored(queued(sizes, bucket_rows).join(aim, same(F.col("source"), F.col("of"))).drop("of"), "queue")
    # Finish times of every serving; where all sources advance evenly, finish times are evenly filled too.
    copies = line.filter("size > 0 AND target > 0").select(
        "doc_id", "source", "size", "turn", "target", F.explode(F.array(*[F.lit(i) for i in range(most)])).alias("serving"),
        "after", "source_size",
    )
    copies = copies.withColumn("done", F.col("after") + F.col("serving") * F.col("source_size"))
    copies = copies.filter("done - size < target")  # later ones start after their source's target is met
    copies = copies.withColumn("finish", F.col("done") / F.col("target"))
    ranges = max(1, math.ceil(most * line.count() / bucket_rows))
    copies = copies.withColumn("range", F.floor(F.least(F.col("finish"), F.lit(2.0)) * ranges).cast("long"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = copies.groupBy("range").agg(F.sum("size").alias("n")).select(F.col("range").alias("at"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("range").orderBy("finish", F.col("source").asc_nulls_last(), "serving", "turn", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    budget = goal.agg(F.lit(share) * F.sum("source_size")).scalar()
    served = copies.withColumn("total", F.sum("size").over(inside)).join(bases, F.col("range") == F.col("at"))
    served = served.withColumn("whole", (F.col("total") + F.col("base") <= budget) & (F.col("done") <= F.ceil("target")))
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.floor(F.col("target")) - (F.col("done") - F.col("size"))))
    taken = served.withColumn("words", F.when(F.col("whole"), F.col("size")).otherwise(part)).filter("words > 0")
    per = taken.groupBy("doc_id", "turn", "source", "after").agg(F.sum("words").alias("taken"))
    per = per.select(F.col("doc_id").alias("d"), F.col("turn").alias("t"), F.col("source").alias("s"), F.col("after").alias("a"), "taken")
    match = same(F.col("doc_id"), F.col("d")) & (F.col("turn") == F.col("t")) & same(F.col("source"), F.col("s")) & (F.col("after") == F.col("a")) & (F.col("size") > 0)
    return line.join(per, match, "left").select("doc_id", "source", "turn", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def taken_copies(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The documents' rows as often as the mix takes them, always whole: a copy that the mix takes in part stays when
    that is at least half of its words.

    Rows equal in id, text and source share what the mix takes of them: every row first gets as many copies as there
    are for all, the others go to the rows in the order of a hash of all columns.  Rows that differ in any column are kept apart.
    """
    look = F.xxhash64(*[F.col(quoted(c)) for c in docs.columns])
    keyed = docs.select(F.struct("*").alias("row"), turn_of(F.col("doc_id"), F.col("text")).alias("turn"), "source", look.alias("look"))
    per = mixed.filter("size > 0").groupBy("turn", "source").agg(
        F.floor((2 * F.sum("taken") + F.max("size")) / (2 * F.max("size"))).alias("copies"), F.count(F.lit(1)).alias("rows")
    )
    per = per.select(F.col("turn").alias("m_turn"), F.col("source").alias("m_source"), "copies", "rows").filter("copies > 0")
    kinds = keyed.groupBy("turn", "source", "look").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("turn", "source").orderBy("look").rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    shared = kinds.join(per, (F.col("turn") == F.col("m_turn")) & same(F.col("source"), F.col("m_source")))
    over = F.least(F.greatest(F.col("copies") % F.col("rows") - F.col("before"), F.lit(0)), F.col("n"))
    times = (F.floor(F.col("copies") / F.col("rows")) * F.col("n") + over).cast("int")
    shared = shared.select(F.col("turn").alias("k_turn"), F.col("source").alias("k_source"), F.col("look").alias("k_look"), times.alias("times")).filter("times > 0")
    match = (F.col("turn") == F.col("k_turn")) & same(F.col("source"), F.col("k_source")) & (F.col("look") == F.col("k_look"))
    served = keyed.dropDuplicates(["turn", "source", "look"]).join(shared, match)
    served = served.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return served.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns])
