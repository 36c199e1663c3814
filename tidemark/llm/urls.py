"""URL filter by association rules (operator 1).

A short list of host and path rules judges what it fits. The rest is judged by rules that Spark's FP-growth mines
from labelled URLs: a URL is the set of its tokens with its label as one more item; itemsets below the least
support never arise, rules below the least confidence are pruned, and of the rules that remain those with a label
as consequent are kept. Tokens that are in exactly the same labelled URLs (all segments of a repeated address) are one
class and one item, without which every subset of them would be an itemset of its own; a URL has a class if it has
any of its tokens. That changes no verdict: of all rules on subsets of a class the ones on a single token match most
and are as confident and as frequent. Matching uses an inverted index: each mined rule stands under the class that is
rarest among the pages, a set of classes looks up its classes there, and a candidate rule must be contained in the
set. Equal token sets are matched once, and sets that hold a common class stay where they are.

Defined results: a null URL or one without `://` has an empty host and path, fits no rule and is judged by the
mined rules on no tokens, hence allowed; if several mined rules fit, the highest confidence, then support, then a
block decides; none: allowed. Rows keep their number and repeat if repeated; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, join_hot, stored

MIN_SUPPORT = 0.01
MIN_CONFIDENCE = 0.6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host and path start). Fixed values of the contract.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits a host or its parent domain and the path's start; else null."""
    rule = verdict = F.lit(None).cast("string")
    for word, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: each domain suffix label, the first host label, path segments, an extension and query keys;
    digits are masked, so that pages of one kind share tokens."""
    mask = lambda c: F.regexp_replace(c, r"\d+", "0")
    labels, steps = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda s: s != "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    parts = F.concat(
        F.transform(F.filter(labels, lambda s: s != ""), lambda s: F.concat(F.lit("h:"), mask(s))),
        F.transform(steps, lambda s: F.concat(F.lit("p:"), mask(s))),
        F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("q:"), mask(F.substring_index(s, "=", 1)))),
    )
    return F.array_sort(F.array_distinct(F.coalesce(parts, F.array().cast("array<string>"))))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """rule_id, tokens, verdict, confidence, support of the rules from (tokens, label) rows."""
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("="), "label"))).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items).associationRules
    consequent = F.col("consequent")[0]
    useful = found.where(consequent.startswith("=") & ~F.exists("antecedent", lambda t: t.startswith("=")))
    tokens = F.array_sort("antecedent")
    return useful.select(F.xxhash64(tokens, consequent).alias("rule_id"), tokens.alias("tokens"), F.substring(consequent, 2, 1000).alias("verdict"), "confidence", "support")


def classes(labelled: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """token, class: the tokens of enough labelled rows (tokens, label) to stand in a rule, at most 1 / min_support times
    the tokens of a mean row, each with the least of those that are in exactly the same rows."""
    whole = F.col("tokens").cast("string")
    each = labelled.select(F.explode("tokens").alias("token"), *[F.xxhash64(F.lit(seed), whole).cast("decimal(20,0)").alias(f"h{seed}") for seed in (1, 2)])
    held = each.groupBy("token").agg(F.count("*").alias("n"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2")).where(F.col("n") >= min_support * labelled.count())
    held = stored(held)
    return held.join(held.groupBy("n", "h1", "h2").agg(F.min("token").alias("class")), ["n", "h1", "h2"]).select("token", "class")


def classed(sets: DataFrame, known: DataFrame) -> DataFrame:
    """tokens, classes of distinct token sets: the classes that they have a token of."""
    each = sets.select("tokens", F.explode("tokens").alias("token")).join(F.broadcast(known), "token")
    return each.groupBy("tokens").agg(F.array_sort(F.collect_set("class")).alias("classes"))


def inverted(rules: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, rules: each mined rule under its token that the fewest sets (classes) have; the same tokens' numbers of
    sets)."""
    each = rules.select("*", F.explode("tokens").alias("token"))
    common = stored(sets.select(F.explode("classes").alias("token")).groupBy("token").agg(F.count("*").alias("n")))
    anchor = each.join(common, "token", "left").groupBy("rule_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("a")).select("rule_id", F.col("a.token").alias("token"))
    index = rules.withColumnRenamed("tokens", "needed").join(anchor, "rule_id")
    return index.groupBy("token").agg(F.collect_list(F.struct("needed", "confidence", "support", "verdict")).alias("rules")), common


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence (of the mined rule that decided)."""
    url = F.col(url_col).cast("string")
    plain = pages.select(F.col(id_col).alias("page_id"), url.alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    parsed = plain.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("label"), tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    labelled = parsed.where("label is not null and size(tokens) > 0").select("label", "tokens")
    known = stored(classes(labelled))
    shown = stored(labelled.groupBy("tokens").agg(F.count("*").alias("pages")))
    lessons = join_hot(labelled, stored(classed(shown, known)), ["tokens"], hot_keys(shown, ["tokens"], "pages"), "left")
    rules = stored(mine(lessons.select("label", F.coalesce("classes", F.array().cast("array<string>")).alias("tokens"))))
    # equal token sets are matched once, and hold no page
    sets = stored(parsed.where("rule is null").groupBy("tokens").agg(F.count("*").alias("pages")))
    asked = stored(classed(sets, known))
    index, common = inverted(rules, asked)
    each = asked.select("tokens", "classes", F.explode("classes").alias("token"))
    met = join_hot(each, stored(index), ["token"], hot_keys(common, ["token"]))
    tried = met.select("tokens", "classes", F.inline("rules")).where(F.size(F.array_except("needed", "classes")) == 0)
    best = tried.groupBy("tokens").agg(F.max(F.struct("confidence", "support", "verdict")).alias("best"))
    # pages of a common token set stay where they are
    out = join_hot(parsed, best, ["tokens"], hot_keys(sets, ["tokens"], "pages"), "left")
    mined = F.when(F.col("rule").isNull(), F.col("best.confidence"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("label", "best.verdict", F.lit("allow")).alias("verdict"), mined.alias("confidence"))
