"""URL rules: fixed host rules first, then token combinations mined from labels.

FP-growth (Spark ML) mines the combinations of URL tokens that go with a blocked label. A combination
becomes a rule if enough blocked URLs have it (``least`` of them, and ``support`` of all blocked ones) and the lower
bound of its confidence reaches ``confidence``, so that a few chance hits make no rule. Tokens that the same labelled URLs
have are mined as one, as their subsets say nothing more; a rule asks for all of them. A rule is filed under its
rarest token; a URL looks its tokens up there and a rule applies if the URL has all its tokens. So a URL meets only
rules of its own tokens, never all.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule and no
tokens, and is allowed; repeated rows are each judged alike; of fixed rules of equal length the first
listed wins; without labels, or without any of one kind, nothing is mined; a null label counts as none; empty tables
give empty results. Only the id and the URL are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Action, host and path of the fixed rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, else nulls."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, h + p).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def tokens(url: Column) -> Column:
    """What a URL is made of: scheme, host labels with their places, registered name, all path parts
    (digits as 0), file ending, names and values of query fields, a fragment."""
    h, p = host(url), path(url)
    labels = F.split(h, r"\.")
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    shape = lambda x: F.regexp_replace(x, "[0-9]+", "0")
    fields = F.filter(F.split(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), "&"), lambda x: x != "")
    found = F.concat(
        F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))), F.concat(F.lit("name="), F.array_join(F.slice(F.reverse(labels), 1, 2), "."))),
        F.transform(F.reverse(labels), lambda x, i: F.concat(F.lit("label"), i.cast("string"), F.lit("="), x)),
        F.transform(parts, lambda x: F.concat(F.lit("part="), shape(x))),
        F.transform(fields, lambda x: F.concat(F.lit("field="), F.substring_index(x, "=", 1))),
        F.transform(F.filter(fields, lambda x: F.contains(x, F.lit("="))), lambda x: F.concat(F.lit("value="), shape(x))),
        F.when(p.rlike(r"\.[A-Za-z0-9]{1,5}$"), F.array(F.concat(F.lit("ending="), F.regexp_extract(p, r"\.([A-Za-z0-9]{1,5})$", 1)))).otherwise(F.array().cast("array<string>")),
        F.when(F.contains(url, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(url.isNotNull() & F.contains(url, F.lit("://")), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def surely(right: Column, of: Column, z: float) -> Column:
    """The lower bound of Wilson's interval around ``right`` / ``of``."""
    share = right / of
    return (share + z * z / (2 * of) - z * F.sqrt(share * (1 - share) / of + z * z / (4 * of * of))) / (1 + z * z / of)


def mine(labelled: DataFrame, least: int = 20, support: float = 0.002, confidence: float = 0.6, z: float = 2.58) -> DataFrame:
    """(antecedent, key, confidence, blocked) from ``labelled`` (tokens, blocked): combinations of tokens that at least
    ``least`` blocked URLs, and ``support`` of them, have and of whose URLs surely at least ``confidence`` are
    blocked; key is the rarest token."""
    from pyspark.ml.fpm import FPGrowth

    rows = common.cut(labelled.where("blocked is not null").withColumn("r", F.monotonically_increasing_id()))
    n, bad = rows.agg(F.count("*"), F.count_if("blocked")).first()
    most = max(least, int(support * bad))
    empty = labelled.sparkSession.createDataFrame([], "antecedent array<string>, key string, confidence double, blocked long")
    if bad < most:
        return empty
    # a token of few blocked URLs is in no rule; those of the same URLs are one item
    own = rows.select("r", "blocked", F.explode("tokens").alias("token"))
    per = own.groupBy("token").agg(F.count("*").alias("n"), F.count_if("blocked").alias("bad"), F.bit_xor(F.xxhash64("r")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "r")).alias("y"))
    items = common.cut(per.where(F.col("bad") >= most).groupBy("n", "x", "y").agg(F.sort_array(F.collect_list("token")).alias("all")).select("n", "all", F.col("all")[0].alias("item")))
    lists = own.join(items.select(F.col("item").alias("token")), "token").groupBy("r").agg(F.collect_list("token").alias("items"), F.first("blocked").alias("blocked"))
    lists = lists.select(F.when(F.col("blocked"), F.array_append("items", F.lit("label=blocked"))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=most / n, minConfidence=confidence).fit(lists)
    got = model.associationRules.where(F.col("consequent") == F.array(F.lit("label=blocked")))
    hits = F.round(F.col("support") * lists.count()).cast("long")
    rules = common.cut(got.select(F.array_sort("antecedent").alias("items"), "confidence", hits.alias("blocked")).where(surely(F.col("blocked"), F.col("blocked") / F.col("confidence"), z) >= confidence))
    each = rules.select("items", "confidence", "blocked", F.explode("items").alias("item")).join(items, "item")
    rare = F.min(F.struct("n", "item"))["item"].alias("key")
    return each.groupBy("items").agg(F.array_sort(F.flatten(F.collect_list("all"))).alias("antecedent"), rare, F.first("confidence").alias("confidence"), F.first("blocked").alias("blocked")).drop("items")


def judge(pages: DataFrame, labelled: DataFrame, id: str = "page_id", url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, **how) -> DataFrame:
    """One row per page: id, host, path, rule, verdict. ``labelled`` has url and blocked; ``how`` goes to :func:`mine`."""
    mined = common.cut(mine(labelled.select(tokens(F.col("url")).alias("tokens"), "blocked"), **how))
    own = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.coalesce(url, F.lit("")).alias("u"))
    each = own.groupBy("u").agg(F.count("*").alias("rows"))
    looked = each.select("u", tokens(F.col("u")).alias("tokens")).withColumn("key", F.explode("tokens"))
    blocked = looked.join(mined, "key").where(F.size(F.array_except("antecedent", "tokens")) == 0).select("u").distinct().withColumn("mined", F.lit(True))
    each = common.cut(each.join(blocked, "u", "left"))
    judged = common.hot_join(own, each, "u", "rows", each.agg(F.sum("rows")).first()[0] or 0).withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rule, action = fixed_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("mined"), "block").otherwise("allow")
    return judged.select(F.col("id").alias(id), "host", "path", rule.alias("rule"), F.coalesce(action, method).alias("verdict"))


def letters(text: Column) -> Column:
    """A digest of a text's letters and digits."""
    return F.unhex(F.md5(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}]+", "")))


def article(html: Column) -> Column:
    """The text of a page's article without its heading."""
    inner = F.regexp_replace(F.regexp_extract(html, r"(?s)<article>(.*?)</article>", 1), r"(?s)^<h1>.*?</h1>", "")
    return F.regexp_replace(inner, r"<[^>]*>|&(?:[a-z]+|#[0-9]+|#x[0-9a-fA-F]+);", "")


def labels_of_pages(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, blocked) of pages whose article is a labelled document's text, letter by letter. A document of low
    quality or a toxic one makes a page blocked; of documents with equal texts any."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    known = labels.where(bad.isNotNull()).groupBy("doc_id").agg(F.max(bad).alias("blocked"))
    known = docs.select("doc_id", letters(F.col("text")).alias("k")).join(known, "doc_id").groupBy("k").agg(F.max("blocked").alias("blocked"))
    own = common.cut(pages.where("html is not null").select("url", letters(article(F.col("html"))).alias("k")))
    known = common.cut(own.groupBy("k").agg(F.count("*").alias("rows")).join(known, "k"))
    return common.hot_join(own, known, "k", "rows", own.count()).select("url", "blocked")
