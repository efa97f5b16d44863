"""URL filter: host and path rules, and for other urls a ratio of two character language models.

Urls that a rule allows train one smoothed variable-order Markov model, urls that a rule blocks another. A url
without a rule is blocked where the difference of the two log-likelihoods, divided by the url's length, falls short
of a threshold that held-out ruled urls calibrate. DataFrame functions only.

Characters map to 64 symbols, so a context of up to five symbols and the next one fit in one long. Every context and
continuation that training urls have is part of the model. The log-ratio of the longest known context is written as a
sum over orders of what each order adds, so no search for the longest context is needed, and the sum is made once for
each distinct window of six symbols. The model and the sums of windows are broadcast if they have at most
``BROADCAST_ROWS`` rows; beyond that they are joined by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import let
from .store import cut

#: Host and path of each rule with its verdict.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols 1 to 62; 0 is any other character, 63 the start.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789:/.?#=&-_%+~,;@!$'()*[]|^ {"
ORDERS, START = 6, 63
BROADCAST_ROWS = 500_000
#: Bins of scores that the threshold is chosen from.
BINS = 4000
#: Every so many-th ruled url (by crc32) calibrates the threshold and trains nothing.
FOLDS = 5


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the url is null or has no ``://``."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. Of rules equally long, the first wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, what in sorted(reversed(rules), key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, f"{name}{start}").otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _windows(url: Column) -> Column:
    """For each character a long of six symbols, 6 bits each: the five before it and itself."""
    symbols = F.transform(F.split(F.translate(url, UPPER, LOWER), ""), lambda c: F.instr(F.lit(ALPHABET), c) % 63)
    padded = F.concat(F.array_repeat(F.lit(START), ORDERS - 1), symbols)

    def windows(p: Column) -> Column:
        def window(i: Column) -> Column:
            out = F.element_at(p, i + (ORDERS - 1)).cast("long")
            for j in range(ORDERS - 1):
                out = out.bitwiseOR(F.shiftleft(F.element_at(p, i + j).cast("long"), 6 * (ORDERS - 1 - j)))
            return out

        return F.transform(F.sequence(F.lit(1), F.size(p) - (ORDERS - 1)), window)

    return F.when(F.length(url) > 0, let(padded, windows)).otherwise(F.array().cast("array<bigint>"))


def _gram(w: Column, k: int) -> Column:
    """The context of k symbols and the symbol after it, marked with k."""
    return w.bitwiseAND((1 << 6 * (k + 1)) - 1).bitwiseOR(F.lit(k << 40))


def _context(w: Column, k: int) -> Column:
    return F.shiftright(w, 6).bitwiseAND((1 << 6 * k) - 1).bitwiseOR(F.lit(k << 40))


def train(urls: DataFrame) -> DataFrame:
    """Model (key, gram, delta) from (url, good): what each context or gram adds to the log-ratio.

    Witten-Bell smoothing: p_k = (count + types * p_(k-1)) / (total + types), down to 1/64 for every symbol.
    A row with ``gram`` false is what a context adds for a symbol never seen after it.
    """
    w = urls.select("good", F.explode(_windows(F.col("url"))).alias("w")).groupBy("w").agg(
        F.sum(F.when(F.col("good"), 1).otherwise(0)).alias("ca"), F.sum(F.when(F.col("good"), 0).otherwise(1)).alias("cb")
    )
    each = w.select("ca", "cb", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _gram(F.col("w"), k).alias("g"), _context(F.col("w"), k).alias("c")) for k in range(ORDERS)])).alias("x"))
    grams = cut(each.groupBy("x.k", "x.g", "x.c").agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb")), "url-grams")
    types = lambda c: F.sum(F.when(F.col(c) > 0, 1).otherwise(0))
    contexts = grams.groupBy("k", "c").agg(F.sum("ca").alias("na"), F.sum("cb").alias("nb"), types("ca").alias("ta"), types("cb").alias("tb"))
    grams = grams.join(contexts, ["k", "c"])
    out, lower = [], None
    share = lambda c, n, t, p: (F.col(c) + F.col(t) * p) / F.nullif(F.col(n) + F.col(t), F.lit(0))
    for k in range(ORDERS):
        g = grams.where(F.col("k") == k)
        if lower is None:
            g = g.withColumn("pa0", F.lit(1 / 64)).withColumn("pb0", F.lit(1 / 64))
        else:
            mask = (1 << 6 * k) - 1
            below = F.col("g").bitwiseAND(mask).bitwiseOR(F.lit((k - 1) << 40))
            g = g.withColumn("below", below).join(lower.select(F.col("g").alias("below"), F.col("pa").alias("pa0"), F.col("pb").alias("pb0")), "below")
        g = g.withColumn("pa", F.coalesce(share("ca", "na", "ta", F.col("pa0")), "pa0")).withColumn("pb", F.coalesce(share("cb", "nb", "tb", F.col("pb0")), "pb0"))
        lower = cut(g.select("g", "pa", "pb", (F.log(F.col("pa") / F.col("pb")) - F.log(F.col("pa0") / F.col("pb0"))).alias("delta")), f"url-order{k}")
        out.append(lower.select(F.col("g").alias("key"), F.lit(True).alias("gram"), "delta"))
    left = lambda n, t: F.coalesce(F.col(t) / F.nullif(F.col(n) + F.col(t), F.lit(0)), F.lit(1.0))
    model = contexts.select(F.col("c").alias("key"), F.lit(False).alias("gram"), F.log(left("na", "ta") / left("nb", "tb")).alias("delta"))
    for x in out:
        model = model.unionByName(x)
    return model


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def scored(urls: DataFrame, model: DataFrame) -> DataFrame:
    """Distinct ``urls`` (url) with the log-ratio over the length; none for an empty url."""
    model = cut(model, "url-model")
    grams = _small(model.where("gram").select(F.col("key").alias("g"), F.col("delta").alias("dg")))
    contexts = _small(model.where("not gram").select(F.col("key").alias("c"), F.col("delta").alias("dc")))
    places = urls.select("url").distinct().select("url", F.explode(_windows(F.col("url"))).alias("w"))
    each = places.select("w").distinct().select("w", F.explode(F.array(*[F.struct(_gram(F.col("w"), k).alias("g"), _context(F.col("w"), k).alias("c")) for k in range(ORDERS)])).alias("x")).select("w", "x.g", "x.c")
    sums = cut(each.join(grams, "g", "left").join(contexts, "c", "left").groupBy("w").agg(F.sum(F.coalesce("dg", "dc", F.lit(0.0))).alias("d")), "url-windows")
    return places.join(_small(sums), "w").groupBy("url").agg(F.avg("d").alias("llr"))


def _threshold(held: DataFrame) -> float:
    """The cut of scores that best separates held-out allowed from blocked urls; 0 where one kind is missing.

    Scores are counted in bins between the least and the greatest, so what reaches the driver is bounded.
    """
    held = held.where("llr is not null")
    lo, hi = held.agg(F.min("llr"), F.max("llr")).first()
    if lo is None:
        return 0.0
    step = (hi - lo) / BINS or 1.0
    bins = held.groupBy(F.floor((F.col("llr") - lo) / step).alias("bin")).agg(
        F.sum(F.when(F.col("good"), 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("good"), 0).otherwise(1)).alias("b")
    ).orderBy("bin").collect()
    na, nb = sum(r.a for r in bins), sum(r.b for r in bins)
    if not na or not nb:
        return 0.0
    best, at, below_a, below_b, last = -1.0, 0.0, 0, 0, bins[0].bin - 1
    for r in bins:  # in the middle between the bins below and this one
        if (gain := below_b / nb - below_a / na) > best:
            best, at = gain, lo + (last + 1 + r.bin) / 2 * step
        below_a, below_b, last = below_a + r.a, below_b + r.b, r.bin
    return at


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row for each input row: id, host, path, rule, verdict, and llr, the score behind a verdict without a rule.

    A null or empty url has no rule and no score and is allowed, as is every url if rules give no url of one kind
    to learn from. Repeated rows are all returned. An empty table gives an empty result.
    """
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, by_rule = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("by_rule", by_rule)
    taught = rows.where("rule is not null").select("url", (F.col("by_rule") == "allow").alias("good"), (F.crc32(F.col("url").cast("binary")) % FOLDS).alias("fold"))
    scores = cut(scored(rows.where("url <> ''"), train(taught.where("fold > 0"))), "url-scores")
    held = taught.where("fold = 0").join(scores, "url")
    two = {r[0] for r in taught.where("fold > 0").select("good").distinct().collect()}
    at = _threshold(held) if len(two) == 2 else float("-inf")
    out = rows.join(scores, "url", "left")
    verdict = F.coalesce("by_rule", F.when(F.col("llr") < at, "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "llr")
