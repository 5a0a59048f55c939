"""Secret scans: an incremental ledger of scanned blobs.

Every version of every path is addressed by the hash of its content.  Only pairs of (blob, rule
version) that the ledger does not hold are scanned, once per distinct content however many paths
carry it; findings are then joined back to all paths.  Copies are merged before their texts are
shuffled, so a text that a third of all paths share moves once per input task.

Defined results: a null text is the empty blob; rows are kept one for one, repeated rows and null
ids included; an empty table gives no rows; other columns pass through ``attach`` untouched.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import Batches, stored

SPANS = "array<struct<kind:int,start:int,end:int>>"
LEDGER = f"blob string, rules string, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts when ``group`` of it has at least ``least`` characters."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


# The three base rules.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
VERSION = "base-1"


def finder(rules: Iterable[Rule]) -> Callable[[str], list[tuple[int, int, int]]]:
    """(rule number, start, end) of every match that counts, by start, then rule number."""
    compiled = []
    for number, rule in enumerate(rules):
        pattern = rule.compiled()
        # A run that has to be long can be looked for as such: greedy runs are maximal either way.
        if rule.pattern == r"[0-9a-f]+":
            pattern = re.compile("[0-9a-f]{%d,}" % rule.least, re.ASCII)
        compiled.append((number, rule, pattern))

    def find(text: str) -> list[tuple[int, int, int]]:
        out = []
        for number, rule, pattern in compiled:
            for m in pattern.finditer(text):
                start, end = m.span(rule.group)
                if end - start >= rule.least:
                    out.append((m.start(), number, m.end()))
        out.sort()
        return [(number, start, end) for start, number, end in out]

    return find


def address(text: Column) -> Column:
    """The content address of a version."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def unseen(versions: DataFrame, ledger: DataFrame | None, text: str, rules: str) -> DataFrame:
    """(blob, text): each distinct content that the ledger has not under this rule version."""
    blobs = versions.select(address(F.col(text)).alias("blob"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    blobs = blobs.dropDuplicates(["blob"])
    if ledger is None:
        return blobs
    return blobs.join(ledger.filter(F.col("rules") == rules).select("blob"), "blob", "left_anti")


def scan(blobs: DataFrame, rules: Iterable[Rule] = BASE, version: str = VERSION) -> DataFrame:
    """New ledger rows for the blobs: one each, with an empty list when nothing is found."""
    chosen = tuple(rules)

    def run(batches: Batches) -> Batches:
        find = finder(chosen)
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t.as_py())] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("blob"), pa.array([version] * batch.num_rows), pa.array(spans, kind)], names=["blob", "rules", "spans"]
            )

    return blobs.select("blob", "text").mapInArrow(run, LEDGER)


def update(versions: DataFrame, ledger: DataFrame | None = None, text: str = "text", rules: Iterable[Rule] = BASE, version: str = VERSION) -> DataFrame:
    """The ledger after these versions: what it held and one row for each pair not seen before, stored."""
    fresh = scan(unseen(versions, ledger, text, version), rules, version)
    return stored(fresh if ledger is None else ledger.select("blob", "rules", "spans").union(fresh), "ledger")


def attach(versions: DataFrame, ledger: DataFrame, text: str = "text", version: str = VERSION) -> DataFrame:
    """(row, spans): every version, its columns in one struct, with its content's findings (null: not scanned)."""
    left = versions.select(F.struct("*").alias("row"), address(F.col(text)).alias("blob"))
    found = ledger.filter((F.col("rules") == version) & (F.size("spans") > 0)).select(F.col("blob").alias("found_blob"), "spans")
    joined = left.join(found, F.col("blob") == F.col("found_blob"), "left")
    return joined.select("row", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def spelled(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digest(docs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the base spans, and all spans, for every document."""
    kinds = [r.kind for r in BASE]
    rows = attach(docs.select("doc_id", "text"), ledger)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(kinds)]
    base = spelled(F.filter("spans", lambda s: s["kind"] < len(kinds)), kinds)
    return rows.select(F.col("row.doc_id").alias("doc_id"), *counts, F.sha2(base, 256).alias("base_sha256"), spelled(F.col("spans"), kinds).alias("spans"))


def redact(docs: DataFrame, ledger: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with every finding replaced by a mark; n_chars follows; all rows stay."""
    rows = attach(docs, ledger)
    text, spans = F.col("row.text"), F.col("spans")
    # Kept pieces lie between the running end of the findings and the next start.
    steps = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.struct(
            F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    cleaned = F.when(F.size(spans) == 0, text).otherwise(steps)
    fields = docs.columns
    out = [
        cleaned.alias(c) if c == "text" else F.when(F.size(spans) == 0, F.col("row.n_chars")).otherwise(F.length(cleaned)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c)
        for c in fields
    ]
    return rows.select(*out)
