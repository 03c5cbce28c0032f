"""URL filters: fixed host and path rules, then mined association rules (DataFrame functions only).

URLs of labelled pages become sets of tokens with their label. FP-growth mines frequent
combinations, and combinations that imply a bad label often enough become rules. Tokens that occur
in the same labelled URLs are one item while it mines, so a template of many tokens costs no more
than one of them. Rules are found by an inverted index from their rarest item, and checked against
the whole token set of a URL.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequela.llm.text import lower_ascii
from sequela.sources.stages import stage

#: Host, path beginning and verdict of each rule; the longest that fits decides.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

MIN_SUPPORT = 0.0005  # share of the labelled URLs that a rule's tokens and label must occur in
MIN_COUNT = 2  # labelled URLs that a rule's tokens and label must occur in, however few there are
MIN_CONFIDENCE = 0.8  # share of bad labels among the URLs that a rule matches
BAD, GOOD = "label=bad", "label=good"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def tokens(url: Column) -> Column:
    """Sorted distinct tokens of a URL: host labels, path segments, query names, and fragment.

    Numbers are left out, and endings are cut off: they name single pages.
    """
    labels = F.transform(F.split(host(url), r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path(url), "/"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"\.[a-z]+$", "")))
    ending = F.array(F.concat(F.lit("e:"), F.regexp_extract(path(url), r"\.([a-z]+)$", 1)))
    query = F.transform(
        F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1), "&"),
        lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)),
    )
    every = F.concat(labels, segments, ending, query)
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: ~x.rlike(r"^[hpeq]:\d*$"))))


def page_number(url: Column) -> Column:
    """The whole number that names the page: the path's last segment, an ending aside; else null."""
    return F.nullif(F.regexp_extract(path(url), r"/(\d{1,18})(?:\.[a-z]+)?/?$", 1), F.lit("")).cast("long")


def token_classes(sets: DataFrame) -> DataFrame:
    """A row per class of tokens that occur in the same baskets: name (its first token), members.

    ``sets``: basket (a number), tokens. Equal sets of baskets are told by their size and the sum of two hashes.
    """
    hashes = [F.sum(F.pmod(F.xxhash64("basket", F.lit(k)), F.lit(1 << 40))).alias(f"h{k}") for k in (1, 2)]
    by_token = sets.select("basket", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), *hashes)
    grouped = by_token.groupBy("n", "h1", "h2").agg(F.array_sort(F.collect_list("token")).alias("members"))
    return grouped.select(F.element_at("members", 1).alias("name"), "members", "n")


def mine(
    urls: DataFrame,
    labels: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_count: int = MIN_COUNT,
) -> DataFrame:
    """Rules (rule, confidence, support) that imply a bad label.

    ``urls``: url; ``labels``: number, bad. ``rule`` is an array of items, each an array of tokens of
    which a URL must have one: those of an item occur in the same labelled URLs. A rule that holds all
    items of another one with at least its confidence says nothing more, and is left out. So is a rule
    of fewer than ``min_count`` URLs. Without labelled URLs there are none.
    """
    spark = urls.sparkSession
    known = labels.filter("number is not null and bad is not null").groupBy("number").agg(F.max("bad").alias("bad"))
    sets = urls.select(tokens(F.col("url")).alias("tokens"), page_number(F.col("url")).alias("number"))
    labelled = sets.filter(F.size("tokens") > 0).join(known, "number")
    labelled = stage(labelled.select(F.monotonically_increasing_id().alias("basket"), "tokens", "bad"), "labelled")
    total = labelled.count()
    none = spark.range(0).select(
        F.array(F.array(F.col("id").cast("string"))).alias("rule"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support")
    )
    if not total:
        return none
    support = max(min_support, min_count / total)
    if support > 1:
        return none
    # a token in too few baskets is in no frequent set
    classes = stage(token_classes(labelled).filter(F.col("n") >= support * total - 1e-6), "classes")
    # one token of a class stands in a basket for all of them
    few = classes.select(F.col("name").alias("token"))
    items = labelled.select("basket", "bad", F.explode("tokens").alias("token")).join(few, "token")
    label = F.when(F.col("bad"), F.lit(BAD)).otherwise(F.lit(GOOD))
    rest = labelled.select("basket", "bad").groupBy("basket", "bad").agg(F.lit(None).cast("string").alias("token"))
    whole = items.select("basket", "bad", "token").unionByName(rest).groupBy("basket", "bad").agg(F.collect_set("token").alias("items"))
    baskets = stage(whole.select(F.concat("items", F.array(label)).alias("items")), "baskets")
    # the share is rounded down a little, so that a count that equals the bound is not lost
    model = FPGrowth(itemsCol="items", minSupport=support * (1 - 1e-9), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter(
        (F.element_at("consequent", 1) == BAD) & ~F.array_contains("antecedent", GOOD)
    ).select(F.array_sort("antecedent").alias("rule"), "confidence", "support")
    rules = stage(rules, "rules")
    # a rule's proper subsets are found by leaving out one item at a time: subsets of a frequent
    # set are frequent, so a better one, if any, is reached step by step
    fewer = rules.select(
        F.explode(F.transform("rule", lambda x: F.array_remove("rule", x))).alias("part"),
        "rule",
        F.col("confidence").alias("own"),
    )
    beaten = fewer.join(rules.select(F.col("rule").alias("part"), "confidence"), "part").filter("confidence >= own")
    kept = rules.join(beaten.select("rule").distinct(), "rule", "left_anti")
    members = kept.select("rule", "confidence", "support", F.explode("rule").alias("name")).join(classes, "name")
    return members.groupBy("rule", "confidence", "support").agg(F.array_sort(F.collect_list("members")).alias("items")).select(
        F.col("items").alias("rule"), "confidence", "support"
    )


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The token sets (column tokens) that some rule matches, once each."""
    by_item = rules.select("rule", F.explode("rule").alias("item"))
    rarity = by_item.groupBy("item").agg(F.count("*").alias("n"))
    index = by_item.join(rarity, "item").groupBy("rule").agg(F.min(F.struct("n", "item")).alias("k"))
    listed = index.select("rule", F.explode("k.item").alias("token"))
    return (
        sets.select("tokens", F.explode("tokens").alias("token"))
        .join(listed, "token")
        .filter(F.forall("rule", lambda item: F.arrays_overlap(item, "tokens")))
        .select("tokens")
        .distinct()
    )


def ruled(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits columns host and path; null where none does."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")

    def fits(rule_host: str, rule_path: str) -> Column:
        own = (F.col("host") == rule_host) | F.col("host").endswith("." + rule_host)
        return own & F.col("path").startswith(rule_path)

    def chain(pick: int) -> Column:
        values = [(fits(h, p), (h + p, v)[pick]) for h, p, v in ordered]
        first = F.when(values[0][0], F.lit(values[0][1]))
        return reduce(lambda c, x: c.when(x[0], F.lit(x[1])), values[1:], first)

    return (chain(0), chain(1)) if ordered else (name, verdict)


def judge(
    pages: DataFrame,
    mined: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    keep: Sequence[str] = ("page_id",),
) -> DataFrame:
    """The columns ``keep`` of ``pages`` with host, path, rule and verdict (allow or block).

    A fixed rule decides alone; else a URL that a mined rule matches is blocked and others are
    allowed. Null and malformed URLs have an empty host and path and are allowed. Rows with equal
    ids are judged one by one; an empty table gives an empty result. Mined rules meet the distinct
    token sets, so a host that holds a third of the pages is matched once per set.
    """
    own = [F.col(f"`{c}`").alias(f"_own{i}") for i, c in enumerate(keep)]
    name, verdict = ruled(rules)
    judged = (
        pages.select(*own, host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), tokens(F.col("url")).alias("tokens"))
        .withColumns({"rule": name, "fixed": verdict})
    )
    hit = match(judged.filter("fixed is null").select("tokens").distinct(), mined).withColumn("hit", F.lit(True))
    method = F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow"))
    return (
        judged.join(hit, "tokens", "left")
        .select(*[f"_own{i}" for i in range(len(keep))], "host", "path", "rule", F.coalesce("fixed", method).alias("verdict"))
        .toDF(*keep, "host", "path", "rule", "verdict")
    )
