"""URL filters from association rules.

Labelled URLs are transactions of tokens; Spark's FP-growth mines token combinations that occur with a label, rules below the
confidence or support bounds are pruned, and the rest is laid out as an inverted index from a rule's rarest token to the rule.  URLs
meet only the rules of their own tokens and check the other tokens of each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windrow.llm.common import stored

LABEL = "verdict="


@dataclass(frozen=True)
class ListRule:
    """A rule of a block list: fits its host and all subdomains where the path starts with the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: fixed values: the rules in force
LISTED = (ListRule("block", "net", "/"), ListRule("allow", "example.net", "/en/"), ListRule("block", "example.com", "/de/"), ListRule("allow", "org", "/fr/"))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where no ``://`` stands."""
    inside = F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.split_part(F.split_part(inside, F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    host = F.split_part(rest, F.lit("/"), F.lit(1))
    return (F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")),
            F.coalesce(F.substring(rest, F.length(host) + 1, F.length(rest)), F.lit("")))


def listed_rule(host: Column, path: Column, rules: Sequence[ListRule] = LISTED) -> tuple[Column, Column]:
    """Text and verdict of the longest list rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def url_tokens(host: Column, path: Column, url: Column) -> Column:
    """Sorted distinct tokens: host labels with their place from the right, words of hyphenated labels, path segments, query keys."""
    labels = F.filter(F.split(host, "[.]"), lambda x: x != "")
    reverse = F.transform(F.reverse(labels), lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit("="), x))
    words = F.transform(F.filter(F.flatten(F.transform(F.filter(labels, lambda x: F.contains(x, F.lit("-"))), lambda x: F.split(x, "-"))), lambda x: x != ""), lambda x: F.concat(F.lit("w="), x))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    shaped = F.transform(segments, lambda x: F.concat(F.lit("p="), F.regexp_replace(F.lower(x), "[0-9]+", "0")))
    query = F.split_part(F.split_part(F.coalesce(url, F.lit("")), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(2))
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q="), F.split_part(x, F.lit("="), F.lit(1))))
    return F.array_sort(F.array_distinct(F.concat(reverse, words, shaped, keys)))


def mine_rules(labelled: DataFrame, tokens: str, verdict: str, min_support: float = 0.002, min_confidence: float = 0.9) -> DataFrame:
    """Pruned rules (rule, tokens, anchor, verdict, confidence, support) with a label on the right-hand side only.

    Only tokens that reach ``min_support`` on their own go into the transactions; at most the mean count of tokens over
    ``min_support`` can, whatever the size of the input, so their list may come to the driver.  A rule is pruned if a part of it
    gives the same verdict with no less confidence.  ``anchor`` is the rule's rarest token, ties to the smaller text.
    """
    rows = stored(labelled.where(F.col(verdict).isNotNull()).select(F.col(tokens).alias("tokens"), F.col(verdict).alias("verdict")), "labelled-urls")
    total = rows.count()
    if total == 0:
        return rows.sparkSession.createDataFrame([], "rule long, tokens array<string>, anchor string, verdict string, confidence double, support double")
    frequent = stored(rows.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= min_support * total), "frequent-tokens")
    names = [r.token for r in frequent.select("token").collect()]
    items = rows.select(F.concat(F.filter("tokens", lambda x: x.isin(names)), F.array(F.concat(F.lit(LABEL), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    found = model.associationRules.where(F.col("consequent")[0].startswith(LABEL) & ~F.exists("antecedent", lambda x: x.startswith(LABEL))).select(
        F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], len(LABEL) + 1, 1000).alias("verdict"), "confidence", "support")
    rules = stored(found.withColumn("rule", F.xxhash64("tokens", "verdict")), "url-rules")
    # general rules first: a rule is superfluous beside one of its parts that is as confident
    one = rules.select("rule", "verdict", "confidence", "tokens", F.explode("tokens").alias("token"))
    part = rules.select(F.col("rule").alias("r"), F.col("verdict").alias("v"), F.col("confidence").alias("c"), F.col("tokens").alias("t"), F.col("tokens")[0].alias("token"))
    covered = one.join(part, "token").where((F.size("t") < F.size("tokens")) & (F.col("v") == F.col("verdict")) & (F.col("c") >= F.col("confidence")) & (
        F.size(F.array_except("t", "tokens")) == 0)).select("rule").distinct()
    kept = rules.join(covered, "rule", "left_anti")
    anchors = kept.select("rule", F.explode("tokens").alias("token")).join(frequent, "token").groupBy("rule").agg(F.min(F.struct("count", "token")).alias("a")).select(
        "rule", F.col("a.token").alias("anchor"))
    return stored(kept.join(anchors, "rule").select("rule", "tokens", "anchor", "verdict", "confidence", "support"), "url-rule-index")


def apply_rules(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, verdict, confidence) for the distinct token sets that a rule fits; the most confident rule wins, then the one
    of larger support, then block before allow, then the smaller rule number."""
    posting = token_sets.select("tokens", F.explode("tokens").alias("anchor"))
    own = rules.select("rule", F.col("tokens").alias("wanted"), "anchor", "verdict", "confidence", "support")
    fits = posting.join(own, "anchor").where(F.size(F.array_except("wanted", "tokens")) == 0)
    first = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), (F.col("verdict") != "block").alias("a"), F.col("rule"), F.col("verdict").alias("v")))
    return fits.groupBy("tokens").agg(first.alias("b")).select("tokens", F.col("b.v").alias("mined"), (-F.col("b.c")).alias("confidence"))


def judge_urls(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", listed: Sequence[ListRule] = LISTED, min_support: float = 0.002,
               min_confidence: float = 0.9, otherwise: str = "allow") -> DataFrame:
    """Per row: the id, url, host, path, rule (the list rule, else null), verdict and confidence (of a mined rule, else null).

    URLs that the list decides are the labels the rules are mined from; they carry the list's verdict over to URLs of like
    tokens.  A URL that neither decides gets ``otherwise``.  Null urls, and urls without ``://``, have an empty host and path and
    get ``otherwise``.  Repeated rows give repeated results; other columns are not read.
    """
    url = F.col(url_column)
    host, path = url_parts(url)
    split = pages.select(F.col(id_column).alias("id"), url.alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    parts = stored(split.select("id", "url", "host", "path", rule.alias("rule"), verdict.alias("given"), url_tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens")), "url-tokens")
    rules = mine_rules(parts, "tokens", "given", min_support, min_confidence)
    # stored, so that a token set of many urls meets it in a join whose large partitions Spark splits
    mined = stored(apply_rules(parts.where("given IS NULL").select("tokens").distinct(), rules), "mined-verdicts")
    return parts.join(mined, "tokens", "left").select(
        F.col("id").alias(id_column), F.col("url").alias(url_column), "host", "path", "rule", F.coalesce("given", "mined", F.lit(otherwise)).alias("verdict"), F.when(F.col("given").isNull(), F.col("confidence")).alias("confidence"))
