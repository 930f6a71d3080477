"""URL filters as a sort-merge range join over reversed-host keys.

A rule (host, path) fits an url whose host is the rule's or a subdomain of it and whose path starts
with the rule's. A key is the host's labels in reverse order followed by the path, so the urls that a
rule fits under one host suffix are the interval of keys that start with the rule's key. Intervals of
prefixes are nested or apart. In key order, a sweep over rules and urls carries the stack of rules that
were open at the last rule's start; the innermost of them that still contains the url's key decides.

Every url has one key for each of its host suffixes with as many labels as some rule's host has.
The sweep runs in blocks of consecutive rules; each block's urls are dealt by a hash to several
copies of the block, so one hot host is spread over many tasks. Rules are never broadcast.

Cases: a null url, or one without ``://``, has an empty host and path and no rule. Empty rule tables
leave every url to the default verdict. Rules that repeat count once; for rules that differ only in
their verdict, block wins. Equal urls have equal verdicts. Only the named columns are read. The
driver gets the distinct lengths of the rules' keys and a drawn key for about every 250 rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to / ? # or the end, A-Z lowered; then up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    rules_per_block: int = 50_000,
    rows_per_copy: int = 20_000,
) -> DataFrame:
    """(id, host, path, rule, verdict) for each row of pages; rules has host, path and verdict.

    The longest rule (host and path together) that fits wins; of equally long ones, that with the
    longer host. ``default`` is the verdict where no rule fits.
    """
    host, path = url_parts(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))

    # One row per rule, keyed; block < allow is not the order of text, so state it.
    keyed = (
        rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .where(F.col("host").isNotNull() & (F.col("host") != ""))
        .groupBy("host", "path")
        .agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), F.col("verdict").alias("v")))["v"].alias("verdict"))
        .withColumn("key", F.concat(reversed_host(F.col("host")), F.lit("\x00"), F.col("path")))
    )
    lengths = sorted(r[0] for r in keyed.select(F.length("key")).distinct().collect())
    labels = sorted(r[0] for r in keyed.select(F.size(F.split("host", r"\."))).distinct().collect())
    if not lengths:
        return parsed.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    # The stack at a rule's start: the rules whose key is a prefix of its own, outermost first.
    prefix = keyed.select(F.col("key").alias("inner"), F.explode(F.filter(F.lit(lengths), lambda n: n <= F.length("key"))).alias("n"))
    prefix = prefix.select("inner", F.substr("inner", F.lit(1), "n").alias("key"))
    stacks = (
        prefix.join(keyed, "key")
        .groupBy("inner")
        .agg(F.array_sort(F.collect_list(F.struct(F.length("key").alias("n"), "key", "host", "path", "verdict"))).alias("stack"))
    )

    # Blocks of consecutive rules; a block also gets the stack that is open where it begins.
    n_rules = keyed.count()
    cuts: list[str] = []
    if n_rules > rules_per_block:
        share = min(1.0, 200 * math.ceil(n_rules / rules_per_block) / n_rules)
        drawn = sorted(r[0] for r in keyed.where(F.pmod(F.xxhash64("key"), F.lit(2**30)) < int(share * 2**30)).select("key").collect())
        cuts = drawn[:: max(1, len(drawn) // math.ceil(n_rules / rules_per_block))][1:]
    block = (lambda k: F.size(F.filter(F.lit(cuts), lambda c: c <= k))) if cuts else (lambda k: F.lit(0))
    starts = stacks.withColumn("block", block(F.col("inner")))
    if cuts:
        last = starts.groupBy("block").agg(F.max_by("stack", "inner").alias("stack"))
        carried = last.where(F.col("block") < len(cuts)).select((F.col("block") + 1).alias("block"), F.lit("").alias("inner"), "stack")
        starts = starts.select("block", "inner", "stack").unionByName(carried)

    # The urls' keys, one for each host suffix that some rule's host can equal.
    parts = F.split(F.col("host"), r"\.")
    suffix = lambda n: F.concat(F.array_join(F.reverse(F.slice(parts, F.size(parts) - n + 1, n)), "."), F.lit("\x00"), F.col("path"))
    keys = F.transform(F.filter(F.lit(labels), lambda n: n <= F.size(parts)), suffix)
    urls = parsed.where(F.col("host") != "").select("host", "path").distinct()
    probes = urls.select("host", "path", F.explode(keys).alias("key")).withColumn("block", block(F.col("key")))

    # As many copies of a block as its urls need; a copy has as many urls as rules, or more, so rules aren't most of the rows.
    if cuts:
        sizes = {r["block"]: r["n"] for r in probes.groupBy("block").agg(F.count("*").alias("n")).collect()}
    else:
        sizes = {0: pages.count() * len(labels)}
    per_copy = max(rows_per_copy, math.ceil(n_rules / (len(cuts) + 1)))
    copies = [max(1, math.ceil(sizes.get(b, 0) / per_copy)) for b in range(len(cuts) + 1)]
    n_copies = F.element_at(F.lit(copies), F.col("block") + 1)
    probes = probes.withColumn("copy", F.pmod(F.xxhash64("host", "path"), n_copies).cast("int"))
    opened = starts.select("block", F.explode(F.sequence(F.lit(0), n_copies - 1)).alias("copy"), F.col("inner").alias("key"), "stack")
    none = F.lit(None).cast(stacks.schema["stack"].dataType)
    events = opened.select("block", "copy", "key", "stack", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path")).unionByName(
        probes.select("block", "copy", "key", none.alias("stack"), "host", "path")
    )
    sweep = Window.partitionBy("block", "copy").orderBy("key", F.col("host").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where(F.col("host").isNotNull())
    found = swept.withColumn("hit", F.try_element_at(F.filter("open", lambda r: F.startswith(F.col("key"), r["key"])), F.lit(-1))).where("hit is not null")
    size = F.length("hit.host") + F.length("hit.path")
    best = found.groupBy("host", "path").agg(F.max(F.struct(size.alias("n"), F.length("hit.host").alias("h"), F.concat("hit.host", "hit.path").alias("rule"), F.col("hit.verdict").alias("verdict"))).alias("best"))
    return parsed.join(best, ["host", "path"], "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
