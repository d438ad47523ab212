"""URL filters (4): listed host and path rules, then association rules mined from labelled URLs.

Spark's FP-growth mines combinations of URL tokens that go with bad labels. Rules pruned by support and confidence are
held as an inverted index from token to rule; each distinct set of indexed tokens is matched once and joined back.

Results in odd cases: a null url, or one without ``://``, has empty host and path; a url without a host has no tokens and fits no rule;
without labels, or without a rule above the limits, everything not listed is allowed; repeated pages repeat in the result.

Mining sees all tokens of every labelled URL that a rule can need. Tokens in too few bad URLs are in no rule; a token that is in
all labelled URLs lets every rule as it is, and has none of its own; and tokens that occur in the very same labelled URLs are mined
as one item, because each of them and all of them give the same support and confidence. None of these steps loses a rule or changes
its confidence. The tokens of mined rules number at most ``1 / MIN_SUPPORT`` times the mean number of tokens of a labelled URL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import ascii_lower, stage

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.6
#: A rule holds for so many labelled URLs at least, however few there are.
LEAST_ROWS = 25
BAD = "!bad"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where there is none."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def listed(rules: Sequence[tuple[str, str]]) -> Column:
    """The longest listed rule that fits columns host and path, as a struct (verdict, rule); null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    out = F.lit(None).cast("struct<verdict: string, rule: string>")
    for verdict, rule in reversed(ordered):
        host, slash, path = rule.partition("/")
        on_host = (F.col("host") == host.lower()) | F.col("host").endswith("." + host.lower())
        fits = on_host & F.col("path").startswith(slash + path)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def tokens() -> Column:
    """Distinct tokens of columns host, path and url: host labels, path words, names of query parameters; none without a host.

    Parameters stand between the first ``?`` after the host and ``#`` or the end, parted by ``&``.
    """
    query = "regexp_extract(substring(url, instr(url, '://') + 3), '^[^?#]*[?]([^#]*)', 1)"
    return F.expr(
        "IF(host = '', CAST(array() AS array<string>), array_distinct(concat("
        "transform(filter(split(host, '[.]'), x -> x <> ''), x -> 'h:' || x),"
        "transform(filter(split(lower(path), '[^a-z0-9]+'), x -> x <> ''), x -> 'p:' || x),"
        f"transform(regexp_extract_all('&' || {query}, '&([^=&]+)', 1), x -> 'q:' || x))))"
    )


def alike(rows: DataFrame, total: int, least: float) -> DataFrame:
    """Items (item, tokens) of rows (id, bad, token): the tokens in ``least`` bad rows or more, but not in all, by equal rows.

    Rows are told apart by two sums of 64-bit hashes.
    """
    ids = [F.sum(F.xxhash64(F.lit(k), "id").cast("decimal(38, 0)")).alias(f"_rows{k}") for k in (1, 2)]
    counted = rows.groupBy("token").agg(F.count(F.lit(1)).alias("_n"), F.count_if("bad").alias("_bad"), *ids)
    kept = counted.where((F.col("_bad") >= least) & (F.col("_n") < total))
    return kept.groupBy("_n", "_rows1", "_rows2").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens")).select("item", "tokens")


def mine(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (rule_id, antecedent, confidence) from pages (page_id, tokens) and labels (doc_id, quality, toxic).

    A URL fits a rule if it has one token at least of each array in ``antecedent``.
    """
    bad = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))).alias("bad")
    )
    labelled = pages.join(bad, pages["page_id"] == bad["doc_id"]).where("size(tokens) > 0 OR bad").select(F.expr("uuid()").alias("id"), "bad", "tokens")
    rows = stage(labelled, "url-labelled")
    total = max(1, rows.count())
    support = max(min_support, min(1.0, LEAST_ROWS / total))
    long = rows.select("id", "bad", F.explode("tokens").alias("token"))
    items = stage(alike(long, total, support * total * (1 - 1e-9)), "url-items")
    named = long.join(items.select("item", F.col("item").alias("token")), "token").groupBy("id").agg(F.collect_list("item").alias("_items"))
    flag = F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))
    baskets = rows.join(named, "id", "left").select(F.concat(F.coalesce("_items", F.array().cast("array<string>")), flag).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(stage(baskets, "url-baskets"))
    rules = model.associationRules.where(F.array_contains("consequent", BAD) & (F.col("lift") > 1))
    keyed = rules.select(F.xxhash64(F.array_sort("antecedent")).alias("rule_id"), F.explode("antecedent").alias("item"), "confidence")
    return keyed.join(items, "item").groupBy("rule_id", "confidence").agg(F.collect_list("tokens").alias("antecedent"))


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Token sets (column pattern) that fit a rule, with the best confidence, by the inverted index."""
    index = rules.select(F.posexplode("antecedent").alias("_item", "_tokens"), "rule_id", F.size("antecedent").alias("_size"), "confidence")
    index = index.select(F.explode("_tokens").alias("token"), "_item", "rule_id", "_size", "confidence")
    hits = sets.select("pattern", F.explode("pattern").alias("token")).join(index, "token")
    full = hits.groupBy("pattern", "rule_id", "_size", "confidence").agg(F.count_distinct("_item").alias("_n")).where("_n = _size")
    return full.groupBy("pattern").agg(F.max("confidence").alias("confidence"))


def judge(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES,
    min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """page_id, host, path, rule, verdict and confidence (of the best mined rule, null if none fits)."""
    only = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = split_url(F.col("url"))
    parsed = only.withColumns({"host": host, "path": path}).withColumns({"_rule": listed(rules), "tokens": tokens()})
    mined = stage(mine(parsed.where("host <> ''"), labels, min_support, min_confidence), "url-rules")
    known = [r[0] for r in mined.select(F.explode(F.flatten("antecedent"))).distinct().orderBy("col").collect()]
    if not known:
        out = parsed.withColumn("confidence", F.lit(None).cast("double"))
    else:
        vocabulary = F.array(*[F.lit(t) for t in known])
        keyed = parsed.withColumn("pattern", F.array_sort(F.array_intersect("tokens", vocabulary)))
        best = match(keyed.select("pattern").distinct(), mined)
        out = keyed.join(best, "pattern", "left")
    method = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return out.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), method).alias("verdict"), "confidence"
    )
