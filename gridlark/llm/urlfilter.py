"""URL filters: rules of host and path, and a ratio of character language models.

Everything here is DataFrame expressions; there is no Python on the executors.

Canonical form: the url without its scheme, lower-cased; digits are `0`, the 26
letters and `. - /` stand for themselves, all else is `_`. That alphabet has 31
symbols and a start mark, so there are at most 32**4 grams of four symbols: that
bounds the model and what is broadcast, whatever the number of urls.

Models: for accepted and rejected urls each, a Markov model of variable order,
up to three symbols of context, smoothed by Witten-Bell interpolation down to a
uniform distribution. A url's score is the difference of its log-likelihoods,
divided by its number of symbols. Each gram's difference is rounded to a whole
number of 1e-6, so that sums don't depend on the order of addition.

Calibration: labelled urls of a fold of their own, by the first digit of the MD5 of
their symbols (3 of 16), train nothing; equal urls are in one fold. Their scores are
counted in bins of 0.01 (4001 of them); the threshold is the edge with the fewest wrong sides, both labels
weighing the same, ties to the lowest edge; where bins below the edge are empty,
it is in their middle. At or above it a url is accepted.

Nulls: a null url, or one without `://`, has an empty host and an empty path,
fits no rule and, being empty, scores 0. Without accepted or without rejected
urls in the fold there is no threshold, and what no rule fits is accepted. Equal urls count
each for the models and the threshold, and are scored once. Rows keep null ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlark.llm.common import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CONTEXT = 3
SYMBOLS = 31
SCALE = 1_000_000
BIN = SCALE // 100
EDGE_BINS = 2000
#: First hexadecimal digits of the urls that calibrate.
FOLD = ("0", "1", "2")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict. A rule is a host and, from its first slash on, the start of a path."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        own, slash, start = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + start)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, rules[rule]).otherwise(verdict)
    return name, verdict


def canonical(url: Column) -> Column:
    """The symbols of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    plain = F.regexp_replace(F.translate(rest, UPPER, LOWER), "[0-9]", "0")
    return F.coalesce(F.regexp_replace(plain, r"[^a-z0./-]", "_"), F.lit(""))


def calibrates(symbols: Column) -> Column:
    """True for urls of the calibration fold."""
    return F.substring(F.md5(symbols), 1, 1).isin(*FOLD)


def grams_of(rows: DataFrame, symbols: str, keep: list[str]) -> DataFrame:
    """One row per symbol: the gram of the symbol and the three before it."""
    padded = F.concat(F.lit("^" * CONTEXT), F.col(symbols))
    n = F.length(symbols)
    return rows.where(n > 0).withColumn("padded", padded).withColumn("at", F.explode(F.sequence(F.lit(1), n))).select(*keep, F.substring("padded", F.col("at"), F.lit(CONTEXT + 1)).alias("gram"))


def train(urls: DataFrame, symbols: str = "symbols", label: str = "label") -> DataFrame:
    """gram and ratio (whole number of 1e-6) of every gram that occurs in urls; label is allow, block or null."""
    # Read many times below, and no larger than the number of possible grams.
    counted = staged(grams_of(urls, symbols, [label]).groupBy("gram").agg(*(F.sum(F.when(F.col(label) == v, 1).otherwise(0)).alias(v) for v in ("allow", "block"))), "url-grams")
    model = counted
    for kind in ("allow", "block"):
        known = counted.where(F.col(kind) > 0)
        chance: Column = F.lit(1.0 / SYMBOLS)
        for order in range(CONTEXT + 1):
            # counts of the last order + 1 symbols, and of their context
            tail = F.substring("gram", CONTEXT + 1 - order, order + 1)
            types = known.groupBy(tail.alias("tail")).agg(F.sum(kind).alias("n"))
            contexts = types.groupBy(F.substring("tail", 1, order).alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
            t, c = f"{kind}_n{order}", f"{kind}_c{order}"
            model = model.join(F.broadcast(types.select(F.col("tail").alias(f"{t}_k"), F.col("n").alias(t))), F.substring("gram", CONTEXT + 1 - order, order + 1) == F.col(f"{t}_k"), "left")
            model = model.join(F.broadcast(contexts.select(F.col("context").alias(f"{c}_k"), F.col("total").alias(c), F.col("types").alias(f"{c}_t"))), F.substring("gram", CONTEXT + 1 - order, order) == F.col(f"{c}_k"), "left")
            chance = F.when(F.col(c).isNull(), chance).otherwise((F.coalesce(F.col(t), F.lit(0)).cast("double") + F.col(f"{c}_t").cast("double") * chance) / (F.col(c).cast("double") + F.col(f"{c}_t").cast("double")))
            model = model.withColumn(f"{kind}_p{order}", chance)
            chance = F.col(f"{kind}_p{order}")
    ratio = F.round(F.lit(float(SCALE)) * (F.log(f"allow_p{CONTEXT}") - F.log(f"block_p{CONTEXT}"))).cast("long")
    return model.select("gram", ratio.alias("ratio"))


def score(urls: DataFrame, model: DataFrame, key: str, symbols: str = "symbols") -> DataFrame:
    """key and score (whole number of 1e-6, per symbol) of every url that has symbols; the model is broadcast."""
    rows = grams_of(urls, symbols, [key])
    found = rows.join(F.broadcast(model), "gram")
    per_symbol = F.floor(F.sum("ratio").cast("double") / F.count(F.lit(1)).cast("double"))
    return found.groupBy(key).agg(per_symbol.cast("long").alias("score"))


def calibrate(scored: DataFrame, label: str = "label") -> DataFrame:
    """One row: the threshold."""
    bins = F.least(F.greatest(F.floor(F.col("score") / BIN).cast("long"), F.lit(-EDGE_BINS)), F.lit(EDGE_BINS))
    counted = scored.where(F.col(label).isin("allow", "block")).groupBy(bins.alias("bin")).agg(
        F.sum(F.when(F.col(label) == "allow", 1).otherwise(0)).alias("allow"), F.sum(F.when(F.col(label) == "block", 1).otherwise(0)).alias("block"),
    )
    # At most 4001 rows.
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("bin").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    wrong = F.coalesce(F.sum("allow").over(before), F.lit(0)) * F.sum("block").over(whole) + F.sum("block").over(after) * F.sum("allow").over(whole)
    # Halfway between an edge and the bin below it that has labelled urls.
    below = F.coalesce(F.lag("bin").over(Window.orderBy("bin")) + 1, F.col("bin"))
    edges = counted.select(F.floor((F.col("bin") + below) * BIN / F.lit(2.0)).cast("long").alias("edge"), wrong.alias("wrong"), (F.sum("allow").over(whole) * F.sum("block").over(whole)).alias("both"))
    return edges.where("both > 0").agg(F.min(F.struct("wrong", "edge")).alias("best")).select(F.col("best.edge").alias("threshold"))


def judge(pages: DataFrame, rules: dict[str, str], key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule, verdict, score and threshold of every row."""
    host, path = url_parts(F.col(url))
    rows = pages.select(F.col(key), host.alias("host"), path.alias("path"), canonical(F.col(url)).alias("symbols"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), verdict.alias("label"))
    rows = rows.withColumn("calibrates", calibrates(F.col("symbols")))
    # Equal urls are scored once; each counts for the models.
    model = train(rows.withColumn("taught", F.when(~F.col("calibrates"), F.col("label"))), label="taught")
    distinct = rows.groupBy("symbols").agg(F.count(F.lit(1)).alias("n")).select("symbols")
    # Written before it is joined, so that Spark can split a url that many rows have.
    scored = staged(score(distinct.withColumn("own", F.col("symbols")), model, "own").withColumnRenamed("own", "own_symbols"), "url-scores")
    rows = rows.join(scored, rows["symbols"] == scored["own_symbols"], "left").withColumn("score", F.coalesce("score", F.lit(0).cast("long")))
    limit = calibrate(rows.where("calibrates"))
    judged = rows.join(F.broadcast(limit.agg(F.max("threshold").alias("threshold"))), F.lit(True), "left")
    by_model = F.when(F.col("threshold").isNull() | (F.col("score") >= F.col("threshold")), "allow").otherwise("block")
    return judged.select(key, "host", "path", "rule", F.coalesce("label", by_model).alias("verdict"), "score", "threshold")
