"""URL filters: fixed host rules first, association rules mined by FP-growth for the rest.

All of it is DataFrame work and Spark ML's FPGrowth, which runs in the JVM.
"""

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

BLOCK = "label:block"


def host_of(url: Column) -> Column:
    """Host of a url: from the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased;
    empty for null or without `://`."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty for null or without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a url: `h:` labels of the host, `p:` parts of the path with digits
    as `#`, `q:` query keys, `f:` the fragment."""
    lower, host, path = F.lower(F.coalesce(url, F.lit(""))), host_of(url), F.lower(path_of(url))
    query = F.regexp_extract(lower, r"\?([^#]*)", 1)
    some = lambda xs, tag: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))
    parts = F.transform(F.split(path, r"[/.]+"), lambda x: F.regexp_replace(x, "[0-9]+", "#"))
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_distinct(F.concat(some(F.split(host, r"\."), "h:"), some(parts, "p:"), some(keys, "q:"), some(F.array(F.regexp_extract(lower, "#(.+)", 1)), "f:")))


def fixed_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest of `rules` (host, path, verdict) that fits each row of `urls` (url, host,
    path; url unique): url, rule (host and path), fixed. A rule fits its host and all
    subdomains, if the url's path starts with the rule's. Host suffixes look the rules up by
    equality, so the work doesn't depend on how many rules there are."""
    labels = F.split("host", r"\.")
    suffixes = urls.select("url", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("suffix"))
    r = rules.select(F.col("host").alias("suffix"), F.col("path").alias("_p"), F.concat("host", "path").alias("rule"), "verdict")
    hits = suffixes.join(r, "suffix").where(F.col("path").startswith(F.col("_p")))
    best = F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict"))
    return hits.groupBy("url").agg(best.alias("b")).select("url", "b.rule", F.col("b.verdict").alias("fixed"))


def mine(labelled: DataFrame, min_support: float, min_rows: int, min_confidence: float, min_lift: float) -> DataFrame:
    """Association rules of `labelled` (tokens, bad): rule_id, antecedent, confidence,
    support, lift. FP-growth over the tokens with the label as one more item; kept are rules
    whose consequent is the block label, at or above the limits (in support both `min_support`
    of the rows and `min_rows` of them: fewer are chance), and none of whose proper
    parts is a kept rule of at least its confidence. Fewer than `min_rows` labelled rows give no rules."""
    baskets = labelled.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BLOCK))).otherwise(F.col("tokens")).alias("items"))
    n = baskets.count()
    if n < min_rows:
        return labelled.sparkSession.createDataFrame([], "rule_id long, antecedent array<string>, confidence double, support double, lift double")
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min_rows / n), minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCK) & (F.col("lift") >= min_lift))
    found = stored(found.select(F.xxhash64(F.array_sort("antecedent")).alias("rule_id"), F.array_sort("antecedent").alias("antecedent"), "confidence", "support", "lift"), "rules")
    # A more general rule contains one of the other's tokens: meet on tokens, not all pairs.
    posting = found.select("rule_id", "confidence", F.size("antecedent").alias("n"), F.explode("antecedent").alias("token"))
    met = posting.toDF("a", "ac", "an", "token").join(posting.toDF("b", "bc", "bn", "token"), "token").where("an < bn and ac >= bc")
    beaten = met.groupBy("a", "an", "b").count().where("count = an").select(F.col("b").alias("rule_id")).distinct()
    return found.join(beaten, "rule_id", "left_anti")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Urls (url, tokens; url unique) that some mined rule fits: url, rule_id, confidence of
    the most confident. An inverted index: tokens meet the rules that name them, and a rule
    fits where as many of its tokens were met as it has."""
    posting = rules.select("rule_id", "confidence", F.size("antecedent").alias("need"), F.explode("antecedent").alias("token"))
    met = urls.select("url", F.explode("tokens").alias("token")).join(posting, "token")
    full = met.groupBy("url", "rule_id").agg(F.count("*").alias("n"), F.first("need").alias("need"), F.first("confidence").alias("confidence")).where("n = need")
    return full.groupBy("url").agg(F.max_by("rule_id", F.struct("confidence", "rule_id")).alias("rule_id"), F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, rules: DataFrame, labels: DataFrame, min_support: float = 0.005, min_rows: int = 20, min_confidence: float = 0.6, min_lift: float = 1.5) -> DataFrame:
    """A verdict for each row of `pages` (page_id, url): page_id, host, path, rule, verdict,
    mined_rule, confidence.

    `rules` (host, path, verdict) decide where one fits. Elsewhere the method does: `labels`
    (page_id, bad; null: not bad) name bad pages among some of `pages`, FP-growth mines which
    token combinations go with them, and a url that a kept rule fits is blocked, any other
    allowed. Work is done once for each distinct url, so a url with a third of all rows costs
    as one; null urls have empty host and path. Rows with repeated ids are judged each."""
    urls = pages.select(F.coalesce("url", F.lit("")).alias("url")).distinct().withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).withColumn("tokens", url_tokens(F.col("url")))
    marked = pages.select("page_id", "url").join(labels.groupBy("page_id").agg(F.max(F.coalesce("bad", F.lit(False))).alias("bad")), "page_id")
    rows = mine(marked.select(url_tokens(F.col("url")).alias("tokens"), "bad"), min_support, min_rows, min_confidence, min_lift)
    fixed, found = fixed_rule(urls, rules), match(urls, rows)
    judged = urls.join(fixed, "url", "left").join(found, "url", "left")
    verdict = F.coalesce("fixed", F.when(F.col("rule_id").isNotNull(), "block").otherwise("allow"))
    judged = judged.select(F.col("url").alias("_url"), "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("rule_id")).alias("mined_rule"), F.when(F.col("rule").isNull(), F.col("confidence")).alias("confidence"))
    return pages.select("page_id", F.coalesce("url", F.lit("")).alias("_url")).join(judged, "_url").drop("_url")
