"""URL filter (operator 9): a character language-model ratio, with DataFrame functions only.

URLs that a rule judges teach two Markov models, one of accepted and one of rejected URLs. Each model's order varies: the
probability of a character after its context of ORDER characters is smoothed towards that after the next shorter
context, down to the uniform distribution (a Dirichlet prior of weight PRIOR at each length). A URL's score is the mean
over its characters of the difference of the two log-probabilities; it is accepted if the score is at least a threshold
that lies midway between the mean scores of the accepted and the rejected URLs.

Characters are folded to an alphabet of 32: letters, 0 for any digit, five marks. So there are at most 32 ** (ORDER + 1)
contexts with a next character, about a million; that is the proven bound of the table that is broadcast.

A null URL, or one without "://", has an empty host and path and fits no rule. Its folded text (empty for null) is scored
like others; an empty one has score 0. Without URLs of both kinds to learn from, what no rule judges is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acutance.session import materialise

#: Verdict, host and path of each rule.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
ORDER, PRIOR, SYMBOLS = 3, 4.0, 32


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of verdict and rule, or null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def folded(url: Column) -> Column:
    """The URL in the small alphabet."""
    text = F.lower(F.coalesce(url, F.lit("")))
    text = F.regexp_replace(text, "[0-9]", "0")
    return F.regexp_replace(text, "[^a-z0./:-]", "_")


def grams(urls: DataFrame) -> DataFrame:
    """urls(text, ...) exploded to gram: ORDER characters and the next one, the start padded."""
    padded = F.concat(F.lit("^" * ORDER), F.col("text"))
    at = F.sequence(F.lit(1), F.length("text"))
    return urls.where(F.length("text") > 0).withColumn("padded", padded).withColumn("i", F.explode(at)).withColumn("gram", F.expr(f"substring(padded, i, {ORDER + 1})")).drop("padded", "i")


def ratio_table(counts: DataFrame) -> DataFrame:
    """(gram, ratio) from counts (gram, accept, reject): log10 of the two models' probabilities of the gram's last character."""
    full = counts
    for n in range(ORDER + 1):  # n characters of context
        part = F.substring("gram", ORDER + 1 - n, n + 1)
        sums = counts.groupBy(part.alias(f"g{n}")).agg(F.sum("accept").alias(f"a{n}"), F.sum("reject").alias(f"r{n}"))
        whole = sums.groupBy(F.expr(f"substring(g{n}, 1, {n})").alias(f"c{n}")).agg(F.sum(f"a{n}").alias(f"ca{n}"), F.sum(f"r{n}").alias(f"cr{n}"))
        full = full.withColumn(f"g{n}", part).join(sums, f"g{n}").withColumn(f"c{n}", F.expr(f"substring(g{n}, 1, {n})")).join(whole, f"c{n}")
    pa, pr = F.lit(1.0 / SYMBOLS), F.lit(1.0 / SYMBOLS)
    for n in range(ORDER + 1):
        pa = (F.col(f"a{n}") + PRIOR * pa) / (F.col(f"ca{n}") + PRIOR)
        pr = (F.col(f"r{n}") + PRIOR * pr) / (F.col(f"cr{n}") + PRIOR)
    return full.select("gram", (F.log10(pa) - F.log10(pr)).alias("ratio"))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """(key, host, path, rule, verdict, score) for every row of pages."""
    rows = pages.select(F.col(key), F.col(url).alias("_url")).withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("text", folded(F.col("_url")))
    # One row for each distinct folded URL: how many accepted and rejected ones it stands for.
    texts = rows.groupBy("text").agg(F.count_if(F.col("_rule.verdict") == "allow").alias("accept"), F.count_if(F.col("_rule.verdict") == "block").alias("reject"))
    pieces = grams(texts)
    counts = pieces.groupBy("gram").agg(F.sum("accept").alias("accept"), F.sum("reject").alias("reject"))
    table = ratio_table(counts)
    scored = materialise(pieces.join(F.broadcast(table), "gram").groupBy("text").agg(F.avg("ratio").alias("score"), F.first("accept").alias("accept"), F.first("reject").alias("reject")), "url-scores")
    mean = lambda kind: F.sum(F.col("score") * F.col(kind)) / F.nullif(F.sum(kind), F.lit(0))
    threshold = scored.agg((mean("accept") + mean("reject")) / 2).first()[0]
    found = rows.join(scored.select("text", "score"), "text", "left")
    passes = F.lit(True) if threshold is None else F.round(F.coalesce("score", F.lit(0.0)), 9) >= F.round(F.lit(threshold), 9)
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(passes, "allow").otherwise("block"))
    return found.select(key, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("score", F.lit(0.0)).alias("score"))


def accepted(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """The rows of pages that are allowed."""
    keep = judge(pages, key, url).where("verdict = 'allow'").select(key).distinct()
    return pages.join(keep, pages[key].eqNullSafe(keep[key]), "left_semi")
