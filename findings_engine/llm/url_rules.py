"""Operator 4: URL filters by association rules. DataFrame and Spark ML operations only.

Fixed rules of host suffix and path prefix come first, the longest that fits. Other URLs are judged by rules
that FP-growth mines from labelled URLs: a URL's items are tokens of its host, path and query, and its label.

- Tokens that the very same labelled rows have count as one, the longest of them (all suffixes of one host, say).
- A token that decides alone without exception is a rule and enters no combination: none could be surer.
- A row's other frequent tokens all enter the combinations. Rows of many tokens that many others have too, yet no two the same, cost
  much; a caller may give ``items``, and then a row's so many rarest enter. What FP-growth finds is counted over all rows.
- Rules whose consequent is the label are kept from MIN_CONFIDENCE and MIN_SUPPORT on, but for those that a rule of fewer of
  their tokens makes superfluous (the same verdict, as sure or surer).

They match by an inverted index: each rule is listed under its rarest token, URLs are looked up by token, and the rest of a
listed rule's tokens is verified. The surest fitting rule decides (confidence, support, length, then block); without one it is allow.

URLs are judged once for each distinct set of tokens, known by its digest. The verdicts of sets that a thousandth of the rows or more
have, a thousand at most, are broadcast, so that no hot set of tokens is shuffled; the others are joined.
A null URL, or one without ``://``, has an empty host and path and no tokens. URLs may be of any length. Repeated rows give
repeated rows, an empty table none; without labelled rows there are no mined rules. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

MIN_CONFIDENCE, MIN_SUPPORT, MIN_ROWS = 0.8, 0.002, 20
#: Rows up to which a table of tokens or rules is broadcast, and else how often it is laid out.
BROADCAST, SALTS = 50_000, 32
#: A set of tokens is hot from this share of the rows on, so that there are at most as many hot sets.
HOT = 1000
BLOCK, ALLOW = "label=block", "label=allow"
#: host, path prefix, verdict
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


@dataclass(frozen=True)
class Parts:
    host: Column
    path: Column
    query: Column


def parts(url: Column) -> Parts:
    after = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)).otherwise("")
    after = F.coalesce(after, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(after, "^[^/?#]*", 0), upper, lower)
    path = F.regexp_extract(F.regexp_replace(after, "^[^/?#]*", ""), "^[^?#]*", 0)
    return Parts(host, path, F.regexp_extract(after, r"(?s)^[^?#]*\?([^#]*)", 1))


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as ``host`` + ``path`` and its verdict; both null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is tested first
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def tokens(p: Parts) -> Column:
    """Sorted distinct tokens: host suffixes, words of the host, path segments, their words and ending, query keys and values.

    A run of digits counts as one 0; what is nothing but digits is no token.
    """
    digits = lambda x: F.regexp_replace(x, "[0-9]+", "0")
    named = lambda name, items: F.transform(items, lambda x: F.concat(F.lit(f"{name}="), x))
    some = lambda items: F.filter(items, lambda x: (x != "") & (x != "0"))
    labels = F.filter(F.split(p.host, r"\."), lambda x: x != "")
    n = F.size(labels)
    suffixes = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, n), ".")))).otherwise(F.array().cast("array<string>"))
    words = named("word", F.filter(F.split(p.host, "[^a-z]+"), lambda x: F.length(x) > 2))
    path = F.lower(p.path)
    segments = named("path", some(F.transform(F.split(path, "/"), digits)))
    parts = named("part", F.filter(F.split(path, "[^a-z]+"), lambda x: F.length(x) > 2))
    ending = named("ending", F.filter(F.array(F.regexp_extract(path, r"\.([a-z]{1,5})$", 1)), lambda x: x != ""))
    pairs = F.filter(F.split(F.lower(p.query), "&"), lambda x: x != "")
    keys = named("query", F.transform(pairs, lambda x: F.substring_index(x, "=", 1)))
    values = named("query", F.transform(F.filter(pairs, lambda x: F.rlike(x, F.lit("=.*[^0-9]"))), digits))
    return F.array_sort(F.array_distinct(F.concat(suffixes, words, segments, parts, ending, keys, values)))


def _by_token(big: DataFrame, small: DataFrame) -> DataFrame:
    """Both joined on ``token``: the smaller table, which is written, is broadcast if its rows are few, and else laid out SALTS times."""
    if small.count() <= BROADCAST:
        return big.join(F.broadcast(small), "token")
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", (F.monotonically_increasing_id() % SALTS).cast("int")).join(salted, ["token", "_salt"]).drop("_salt")


def items_of(labelled: DataFrame, least: float) -> DataFrame:
    """token, n, blocked of each token that stands for those that the same rows have; ``labelled``: row (unique), tokens, block."""
    each = labelled.select(F.explode("tokens").alias("token"), "block", *(F.pmod(F.xxhash64("row", F.lit(k)), F.lit(2**40)).alias(f"h{k}") for k in (1, 2)))
    counts = each.groupBy("token").agg(F.count("*").alias("n"), F.count_if("block").alias("blocked"), F.sum("h1").alias("h1"), F.sum("h2").alias("h2")).filter(F.col("n") >= least)
    return counts.groupBy("n", "blocked", "h1", "h2").agg(F.max_by("token", F.struct(F.length("token"), "token")).alias("token")).select("token", "n", "blocked")


def mine(labelled: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS, items: int | None = None) -> DataFrame | None:
    """Rules (antecedent, verdict, confidence, support) from ``tokens`` and ``block`` (boolean); None without rows."""
    rows = written(labelled.filter("block is not null").select(F.monotonically_increasing_id().alias("row"), "tokens", "block"), "url-labels")
    n = rows.count()
    if not n:
        return None
    least = max(min_support * n, min_rows)
    known = written(items_of(rows, least), "url-items")
    share = F.greatest("blocked", F.col("n") - F.col("blocked")) / F.col("n")
    verdict = F.when(2 * F.col("blocked") >= F.col("n"), "block").otherwise("allow")
    alone = known.filter(share >= min_confidence).select(F.array("token").alias("antecedent"), verdict.alias("verdict"), share.alias("confidence"), (share * F.col("n") / n).alias("support"))
    open_items = written(known.filter(share < 1).select("token", "n"), "url-open-items")
    held = _by_token(rows.select("row", "block", F.explode("tokens").alias("token")), open_items)
    own = F.sort_array(F.collect_list(F.struct("n", "token")))
    own = F.transform(own if items is None else F.slice(own, 1, items), lambda x: x["token"])
    baskets = held.groupBy("row").agg(own.alias("items"), F.first("block").alias("block")).filter(F.size("items") > 1)
    baskets = baskets.select(F.concat("items", F.array(F.when(F.col("block"), BLOCK).otherwise(ALLOW))).alias("items"))
    baskets = written(baskets, "url-baskets")
    if not (m := baskets.count()):
        return alone
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least * min_confidence / m), minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.filter(F.col("consequent")[0].isin(BLOCK, ALLOW) & (F.size("antecedent") > 1))
    found = counted(rows, written(found.select(F.array_sort("antecedent").alias("antecedent")).distinct(), "url-antecedents"))
    share = F.greatest("blocked", F.col("n") - F.col("blocked")) / F.col("n")
    found = found.filter((F.col("n") >= least) & (share >= min_confidence)).select("antecedent", verdict.alias("verdict"), share.alias("confidence"), (share * F.col("n") / n).alias("support"))
    return needed(written(alone.unionByName(found), "url-rules"))


def counted(rows: DataFrame, antecedents: DataFrame) -> DataFrame:
    """antecedent, n, blocked: over all rows that hold it, not only those whose baskets do."""
    index = written(_listed(antecedents), "url-index")
    sets = rows.groupBy(F.md5(F.array_join("tokens", "\n")).alias("shape")).agg(F.first("tokens").alias("tokens"), F.count("*").alias("n"), F.count_if("block").alias("blocked"))
    fits = _by_token(sets.withColumn("token", F.explode("tokens")), index).filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    return fits.groupBy("rule").agg(F.first("antecedent").alias("antecedent"), F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))


def _listed(rules: DataFrame) -> DataFrame:
    """The rules, a table that gives the same rows each time, with a number and the ``token`` that they are listed under, their rarest among rules."""
    rules = rules.withColumn("rule", F.monotonically_increasing_id())
    how_often = rules.select(F.explode("antecedent").alias("token")).groupBy("token").count()
    each = rules.select("rule", F.explode("antecedent").alias("token")).join(how_often, "token")
    least = each.groupBy("rule").agg(F.min(F.struct("count", "token"))["token"].alias("token"))
    return rules.join(least, "rule")


def needed(rules: DataFrame) -> DataFrame:
    """The rules, a written table, without those that a rule of fewer of their tokens makes superfluous."""
    index = written(_listed(rules), "url-index")
    wide = index.select("rule", F.col("antecedent").alias("_all"), F.col("verdict").alias("_verdict"), F.col("confidence").alias("_sure")).withColumn("token", F.explode("_all"))
    fewer = _by_token(wide, index.drop("rule", "support")).filter((F.size("antecedent") < F.size("_all")) & (F.col("verdict") == F.col("_verdict")) & (F.col("confidence") >= F.col("_sure")) & (F.size(F.array_except("antecedent", "_all")) == 0))
    return index.join(fewer.select("rule").distinct(), "rule", "left_anti").select("antecedent", "verdict", "confidence", "support")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(shape, mined): the verdict of the surest rule that fits each row of ``sets`` (shape, tokens)."""
    listed = sets.select("shape", "tokens", F.explode("tokens").alias("token"))
    fits = _by_token(listed, written(_listed(rules), "url-index")).filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", F.size("antecedent").alias("n"), "verdict"))["verdict"]
    return fits.groupBy("shape").agg(best.alias("mined"))


def judge(df: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, **thresholds) -> DataFrame:
    """id, host, path, rule, verdict. ``labels``: id and ``block`` (boolean), one row for an id at most."""
    p = parts(F.col(url_col))
    rule, verdict = fixed_rule(p.host, p.path, rules)
    found = tokens(p)
    seen = df.select(F.col(id_col).alias("_id"), p.host.alias("host"), p.path.alias("path"), rule.alias("rule"), verdict.alias("fixed"), found.alias("tokens"))
    seen = seen.withColumn("shape", F.md5(F.array_join("tokens", "\n")))
    mined = mine(seen.select("_id", "tokens").join(labels.select(F.col(id_col).alias("_id"), "block"), "_id"), **thresholds)
    final = lambda rows, decided: rows.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("fixed", *decided, F.lit("allow")).alias("verdict"))
    if mined is None or not (mined := written(mined, "url-rules")).count():
        return final(seen, ())
    sets = written(seen.filter("fixed is null").groupBy("shape").agg(F.first("tokens").alias("tokens"), F.count("*").alias("n")), "url-sets")
    judged = written(sets.select("shape", "n").join(match(sets, mined), "shape", "left"), "url-verdicts")
    total = judged.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") * HOT >= total
    hot = judged.filter(is_hot).select(F.col("shape").alias("_hot"), F.col("mined").alias("known"))
    rows = seen.join(F.broadcast(hot), F.col("shape") == F.col("_hot"), "left")  # HOT rows at most
    # rows that are decided meet nothing in the join, and go anywhere
    rows = rows.withColumn("shape", F.when(F.col("fixed").isNotNull() | F.col("_hot").isNotNull(), F.concat(F.lit("-"), F.monotonically_increasing_id())).otherwise(F.col("shape")))
    rest = judged.filter(~is_hot & F.col("mined").isNotNull()).select(F.col("shape").alias("_rest"), "mined")
    return final(rows.join(rest, F.col("shape") == F.col("_rest"), "left"), ("known", "mined"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the id it shares with ``labels``: block if of low quality or toxic."""
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block"))
    return judge(table(spark, sf_dir, "pages"), labels)
