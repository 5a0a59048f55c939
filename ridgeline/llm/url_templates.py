"""URL filters: rules by host and path, and a path-template tree for what no rule decides.

Paths are split into segments and form a tree per host.  Below each branch the tree counts the shapes
of what follows (end, number, number with extension, word, mixed) and the labels.  A branch whose
counts do not differ from those of all its siblings together, by a chi-square test of homogeneity, is
statistically the same branch: it is merged into the wildcard.  Branches that do differ stay literal.
Segments that vary by nature (numbers, long mixed strings) are wildcards from the start.  A url's
template is its host and its generalised segments; labels are counted per template, their blocked
share is smoothed towards the share of all labelled urls, and templates above the limit are rejected.

Only DataFrame operations are used.  Counting is by distinct (host, path) first, so a host with a third
of all rows meets in one task only as partial counts, and joins back are skew-splittable equi-joins.

Defined results: a null url, or one without ``://``, has an empty host and path, follows no rule, and
is allowed; repeated rows and null ids are judged each on its own; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import same, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the contract.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)
#: Critical values of chi-square at 0.001 for 1 to 6 degrees of freedom (fixed values).
CRITICAL = (10.828, 13.816, 16.266, 18.467, 20.515, 22.458)
SHAPES = ("end", "number", "page", "word", "mixed")
STRENGTH = 4.0
LIMIT = 0.5


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, host, path) of every url."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract("rest", r"^[^/?#]*", 0)
    return (
        pages.select("page_id", F.coalesce(rest, F.lit("")).alias("rest"))
        .select("page_id", host.alias("raw"), F.expr("substring(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1)").alias("tail"))
        .select("page_id", F.translate("raw", UPPER, LOWER).alias("host"), F.regexp_extract("tail", r"^[^?#]*", 0).alias("path"))
    )


def ruled(urls: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds rule (its text) and by_rule (its verdict) of the longest rule that fits, else null.

    The rules are expressions of the plan: a list that an operator writes, not one that grows with the data.
    """
    def fits(r: Rule) -> Column:
        at_host = (F.col("host") == r.host) | F.endswith(F.col("host"), F.lit("." + r.host))
        return at_host & F.startswith(F.col("path"), F.lit(r.path))

    longest = sorted(rules, key=lambda r: -len(r.text))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(longest):
        rule, verdict = F.when(fits(r), r.text).otherwise(rule), F.when(fits(r), r.verdict).otherwise(verdict)
    return urls.withColumn("rule", rule).withColumn("by_rule", verdict)


def shape(segment: Column) -> Column:
    """A segment's kind; null stands for the end of the path."""
    return (
        F.when(segment.isNull() | (segment == ""), "end")
        .when(segment.rlike("^[0-9]+$"), "number")
        .when(segment.rlike("^[0-9]+[.][A-Za-z]+$"), "page")
        .when(segment.rlike("^[^0-9]{1,24}$"), "word")
        .otherwise("mixed")
    )


def segments(paths: DataFrame) -> DataFrame:
    """One row per segment of each distinct (host, path): position, text, shape, the shapes before it and the next one."""
    split = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = paths.withColumn("parts", split).select(
        "host", "path", "n", "blocked", "allowed", F.transform("parts", shape).alias("shapes"), F.posexplode("parts").alias("at", "segment")
    )
    return rows.select(
        "host", "path", "n", "blocked", "allowed", "at", "segment",
        F.element_at("shapes", F.col("at") + 1).alias("shape"),
        F.array_join(F.slice("shapes", F.lit(1), F.col("at")), "/").alias("above"),
        F.coalesce(F.get("shapes", F.col("at") + 1), F.lit("end")).alias("next"),
    )


def literal_branches(rows: DataFrame) -> DataFrame:
    """(host, at, above, segment) of word branches that differ from their siblings taken together.

    The cells are the shapes of what follows and the labels (blocked, allowed, neither).  With O a
    branch's count in a cell and E its share of the siblings' total, the branch differs when the sum
    of (O - E)^2 / E exceeds the critical value for the cells in use.
    """
    keys, branch = ["host", "at", "above"], ["host", "at", "above", "segment"]
    names = [f"next_{s}" for s in SHAPES] + ["blocked", "allowed", "open"]
    cells = [F.sum(F.when(F.col("next") == s, F.col("n")).otherwise(0)).alias(f"next_{s}") for s in SHAPES]
    labels = [F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"), F.sum(F.col("n") - F.col("blocked") - F.col("allowed")).alias("open")]
    counts = rows.filter(F.col("shape") == "word").groupBy(*branch).agg(F.sum("n").alias("n"), *cells, *labels)
    pooled = counts.groupBy(*[F.col(k).alias(f"p_{k}") for k in keys]).agg(
        F.sum("n").alias("p_n"), F.count(F.lit(1)).alias("siblings"), *[F.sum(c).alias(f"p_{c}") for c in names]
    )
    both = counts.join(pooled, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"p_{k}") for k in keys]))

    def distance(group: list[str]) -> Column:
        expected = {c: F.col(f"p_{c}") * F.col("n") / F.col("p_n") for c in group}
        x2 = reduce(lambda a, b: a + b, [F.when(expected[c] > 0, (F.col(c) - expected[c]) ** 2 / expected[c]).otherwise(0.0) for c in group])
        used = reduce(lambda a, b: a + b, [F.when(F.col(f"p_{c}") > 0, 1).otherwise(0) for c in group])
        limit = F.element_at(F.array(*[F.lit(c) for c in CRITICAL]), F.greatest(used - 1, F.lit(1)))
        return x2 > limit

    differs = distance(names[: len(SHAPES)]) | distance(names[len(SHAPES) :])
    return both.filter((F.col("siblings") == 1) | differs).select(*[F.col(c).alias(f"b_{c}") for c in branch])


def templates(paths: DataFrame) -> DataFrame:
    """(host, path, template, n, blocked, allowed) for each distinct (host, path); paths: stored."""
    rows = segments(paths)
    branch = ["host", "at", "above", "segment"]
    literal = literal_branches(rows)
    match = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"b_{c}") for c in branch])
    piece = F.when(F.col("b_segment").isNotNull(), F.concat(F.lit("="), F.col("segment"))).otherwise(F.concat(F.lit("*"), F.col("shape")))
    named = rows.join(literal, match, "left").select("host", "path", "at", piece.alias("piece"))
    joined = named.groupBy(F.col("host").alias("t_host"), F.col("path").alias("t_path")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "/").alias("template")
    )
    # A path without segments has the empty template.
    return paths.join(joined, (F.col("host") == F.col("t_host")) & (F.col("path") == F.col("t_path")), "left").select(
        "host", "path", F.coalesce("template", F.lit("")).alias("template"), "n", "blocked", "allowed"
    )


def purity(rated: DataFrame, strength: float = STRENGTH, limit: float = LIMIT) -> DataFrame:
    """(host, template, blocked_share, rejected): the smoothed share of blocked labels of each template.

    The share leans towards that of all labels with the weight of ``strength`` labels; a template
    without labels is not rejected, as nothing speaks against it.
    """
    base = rated.agg(((F.sum("blocked") + 0.5) / (F.sum(F.col("blocked") + F.col("allowed")) + 1.0)).alias("base"))
    sums = rated.groupBy(F.col("host").alias("p_host"), F.col("template").alias("p_template")).agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"))
    share = (F.col("b") + strength * F.coalesce(base.scalar(), F.lit(0.5))) / (F.col("b") + F.col("a") + strength)
    return sums.select("p_host", "p_template", share.alias("blocked_share"), ((F.col("b") + F.col("a") > 0) & (share > limit)).alias("rejected"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the template behind a verdict without rule.

    The urls that rules decide are the labelled ones; the templates carry their labels to the others.
    """
    urls = stored(ruled(parsed(pages), rules), "urls")
    one = lambda v: F.sum(F.when(F.col("by_rule") == v, 1).otherwise(0))
    paths = stored(urls.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), one("block").alias("blocked"), one("allow").alias("allowed")), "paths")
    rated = stored(templates(paths), "templates")
    bad = purity(rated)
    of_path = rated.join(bad, (F.col("host") == F.col("p_host")) & (F.col("template") == F.col("p_template"))).select(
        F.col("host").alias("r_host"), F.col("path").alias("r_path"), "template", "blocked_share", "rejected"
    )
    method = F.when(F.col("rejected") & (F.col("host") != ""), "block").otherwise("allow")
    return urls.join(of_path, same(F.col("host"), F.col("r_host")) & same(F.col("path"), F.col("r_path")), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", method).alias("verdict"), "template", "blocked_share"
    )
