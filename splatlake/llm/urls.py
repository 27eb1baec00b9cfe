r"""URL filter: a ratio of smoothed variable-order Markov models of accepted and rejected URLs, in DataFrame operations.

Rules (host suffix plus path prefix; the longest wins) settle some URLs and are the training labels.  URLs become symbol
strings over a fixed alphabet (letters, one digit for a run of digits, ``- . / ? = & _ : #``, start and end marks,
``~`` for the rest).  For each class, Witten-Bell smoothing mixes the orders 0 to ``order``: a context that was seen often
counts for much, a rare one leaves the say to shorter contexts.  The score of a URL is the mean log-likelihood difference
(rejected minus accepted) over its symbols; it is calibrated by the two classes' means and common variance to a
log-odds, and a URL with no rule is blocked where that exceeds 0.

The model has at most len(alphabet)^(order+1) rows: 40^3 = 64,000 by default, which is the proven bound for the
broadcast; with a larger order it is joined without a hint.  Null or schemeless URLs have empty host and path; a schemeless
one is scored as the string that it is, a null or empty one by the end mark alone.  Without URLs of both classes the score
is null and the verdict is allow.  Repeated rows give equal results.  URLs of any length are read whole; an empty table
gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verdict and rule (host/path prefix).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ALPHABET = "abcdefghijklmnopqrstuvwxyz0-./?=&_:#~^$"
ORDER = 2


def host(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(raw, upper, upper.lower())


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for _, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):
        domain, _, start = r.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + start)
        out = F.when(fits, F.lit(r)).otherwise(out)
    return out


def _symbols(url: Column, order: int) -> Column:
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^.*?://", "")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.regexp_replace(F.translate(rest, upper, upper.lower()), "[0-9]+", "0")
    plain = F.regexp_replace(plain, r"(?s)[^a-z0\-./?=&_:#]", "~")
    return F.concat(F.lit("^" * order), plain, F.lit("$"))


def _explode(df: DataFrame, order: int, keep: list[str]) -> DataFrame:
    grams = F.transform(F.sequence(F.lit(1), F.length("__s") - order), lambda i: F.col("__s").substr(i, F.lit(order + 1)))
    return df.select(*keep, F.explode(grams).alias("gram"))


def model(labelled: DataFrame, order: int = ORDER, keep=lambda df: df) -> DataFrame:
    """gram -> delta (log rejected - log accepted) for every gram that the URLs have; labelled: __s, block (1, 0 or null).

    keep() writes the counts, which are used several times.
    """
    counts = keep(_explode(labelled, order, ["block"]).groupBy("gram").agg(F.count_if(F.col("block") == 0).alias("n0"), F.count_if(F.col("block") == 1).alias("n1")))
    total = counts.agg(F.sum("n0").alias("s0"), F.sum("n1").alias("s1")).first()
    # Order 0: add-one over the alphabet; then each longer context by Witten-Bell.
    size = float(len(ALPHABET))
    by_gram = counts.groupBy(F.substring("gram", order + 1, 1).alias("t")).agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"))
    out = counts.select("gram", F.substring("gram", order + 1, 1).alias("t")).join(by_gram, "t")
    out = out.select("gram", *[((F.col(f"c{c}") + 1.0) / (F.lit(float(total[f"s{c}"] or 0)) + size)).alias(f"p{c}") for c in "01"])
    for k in range(1, order + 1):
        by_gram = counts.groupBy(F.substring("gram", order + 1 - k, k + 1).alias("t")).agg(F.sum("n0").alias("c0"), F.sum("n1").alias("c1"))
        by_context = by_gram.groupBy(F.substring("t", 1, k).alias("x")).agg(*[e for c in "01" for e in (F.sum(f"c{c}").alias(f"s{c}"), F.count_if(F.col(f"c{c}") > 0).alias(f"d{c}"))])
        out = out.withColumn("t", F.substring("gram", order + 1 - k, k + 1)).withColumn("x", F.substring("gram", order + 1 - k, k)).join(by_gram, "t").join(by_context, "x")
        mixed = []
        for c in "01":
            seen = F.col(f"s{c}") + F.col(f"d{c}")
            mixed.append(F.when(seen > 0, (F.col(f"c{c}") + F.col(f"d{c}") * F.col(f"p{c}")) / seen).otherwise(F.col(f"p{c}")).alias(f"p{c}"))
        out = out.select("gram", *mixed)
    return out.select("gram", (F.log("p1") - F.log("p0")).alias("delta"))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, order: int = ORDER, max_broadcast_rows: int = 100_000) -> DataFrame:
    """A row per page: host, path, rule, verdict, score (mean difference), log_odds."""
    from .storage import Workspace

    url = F.col(f"`{url_col}`").cast("string")
    base = pages.select(F.col(f"`{id_col}`").alias(id_col), host(url).alias("host"), path(url).alias("path"), _symbols(url, order).alias("__s"))
    base = base.withColumn("rule", rule(F.col("host"), F.col("path"), rules))
    settled = F.lit(None).cast("string")
    for verdict, r in rules:
        settled = F.when(F.col("rule") == r, F.lit(verdict)).otherwise(settled)
    base = base.withColumn("__settled", settled).withColumn("block", (F.col("__settled") == "block").cast("int"))
    work = Workspace(pages.sparkSession, "urls")
    table = work.keep(model(base, order, work.keep))
    small = len(ALPHABET) ** (order + 1) <= max_broadcast_rows
    # A row's number in its partition keeps repeated pages apart; the sum needs no other key, and map tasks add up.
    rows = base.withColumn("__row", F.monotonically_increasing_id())
    keep = ["__row", id_col, "host", "path", "rule", "__settled", "block"]
    joined = _explode(rows, order, keep).join(F.broadcast(table) if small else table, "gram", "left")
    scored = work.keep(joined.groupBy(*keep).agg((F.sum("delta") / F.count(F.lit(1))).alias("score")))
    fitted = scored.agg(*[f(F.when(F.col("block") == c, F.col("score"))).alias(f"{n}{c}") for c in (0, 1) for n, f in (("m", F.avg), ("v", F.var_pop), ("n", F.count))]).first()
    if fitted.n0 and fitted.n1:
        variance = max((fitted.v0 * fitted.n0 + fitted.v1 * fitted.n1) / (fitted.n0 + fitted.n1), 1e-12)
        slope = (fitted.m1 - fitted.m0) / variance
        odds = F.lit(slope) * (F.col("score") - F.lit((fitted.m0 + fitted.m1) / 2))
    else:
        odds = F.lit(None).cast("double")
    out = scored.withColumn("log_odds", odds)
    verdict = F.coalesce(F.col("__settled"), F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    return out.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "score", "log_odds")
