"""URL filter: explicit rules first, then the ratio of two character language models.

Accepted and rejected URLs each get a smoothed variable-order Markov model: the next character is predicted from the
longest context seen in training, up to ``ORDER`` characters, blended with all shorter ones by Witten-Bell weights down to
a uniform floor. A URL scores the difference of its two log-likelihoods per character; the cut between accepting
and rejecting is calibrated on labelled URLs kept out of the counts.

Labels come from the rules themselves: URLs that an allow rule decides are accepted, those of a block rule rejected. The
models count every distinct labelled URL but the quarter that calibrates the cut, all of which does. They stay tables: each gram of
the corpus is rated once and URLs meet the values in a join, so nothing of the models goes through the driver. Rules read host and path; the models are fitted on and score all that follows ``://``,
query and fragment included, with the host in lower case.

Edge cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and, with nothing to score, is
allowed with a null score; without labels of both kinds everything undecided is allowed; repeats are judged alike.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_audit.session import materialize

ORDER = 5
CELL = 1 / 4096  # width of the cells that scores are counted in for the cut
KINDS = ("allow", "block")
ALPHABET = 1024  # characters a context may be followed by, for the uniform floor
#: (verdict, rule): host with all its subdomains, then the start of the path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_REST = r"(?s)^.*?://[^/?#]*(.*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def address_of(url: Column) -> Column:
    """Host, path, query and fragment."""
    return F.concat(host_of(url), F.coalesce(F.regexp_extract(url, _REST, 1), F.lit("")))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


class Markov:
    """Variable-order character model: context -> (uses, different next characters, counts of each)."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.contexts = {c: (sum(n.values()), len(n), n) for c, n in counts.items()}

    def log_likelihood(self, text: str) -> float:
        total = 0.0
        for i, ch in enumerate(text):
            p = 1.0 / ALPHABET
            for k in range(min(i, ORDER) + 1):
                seen = self.contexts.get(text[i - k:i])
                if seen is None:
                    break
                uses, kinds, counts = seen
                p = (counts.get(ch, 0) + kinds * p) / (uses + kinds)
            total += math.log(p)
        return total


def _met(rows: DataFrame, more: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """The join by sort and merge. A stage's files are far smaller than its rows are in memory, the more so once addresses are
    spelled out, so their size must not make the driver collect and broadcast them."""
    return rows.join(more.hint("merge"), on, how)


def _spots(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per character of an address: it with the at most ``ORDER`` characters before, as ``gram``."""
    at = F.explode(F.sequence(F.lit(1), F.length("address"))).alias("i")
    begin = F.greatest(F.lit(1), F.col("i") - ORDER)
    return rows.where("address <> ''").select(*dict.fromkeys((*keep, "address")), at).select(*keep, F.substring("address", begin, F.col("i") - begin + 1).alias("gram"))


def gram_values(addresses: DataFrame) -> DataFrame:
    """(gram, allow, block, value) of every gram of (address, verdict or null, calibrate), one row an address.

    ``value`` is the character's log-likelihood under the accepted model less that under the rejected one. Counts are
    those of labelled addresses that do not calibrate. The counts of a shorter context are sums over the longer
    ones, so the addresses are expanded once; probabilities are blended from the shortest context up, one join a length.
    """
    trains = F.col("verdict").isNotNull() & ~F.col("calibrate")
    spots = _spots(addresses.select("address", *[(trains & (F.col("verdict") == v)).cast("long").alias(v) for v in KINDS]), *KINDS)
    grams = materialize(spots.groupBy("gram").agg(*[F.sum(v).alias(v) for v in KINDS]), "url-grams")
    known = None
    for k in range(ORDER + 1):
        # the gram's last k + 1 characters; a shorter gram begins its address and has no longer context
        part = grams.where(F.length("gram") > k).select(F.expr(f"right(gram, {k + 1})").alias("part"), *KINDS).groupBy("part").agg(*[F.sum(v).alias(v) for v in KINDS])
        part = part.withColumn("context", F.expr(f"left(part, {k})"))
        uses = part.groupBy("context").agg(*[x for v in KINDS for x in (F.sum(v).alias(f"uses_{v}"), F.count_if(F.col(v) > 0).alias(f"kinds_{v}"))])
        here = _met(part, uses, "context") if k else part.withColumn("_u", uses.select(F.struct(*uses.columns[1:])).scalar()).select("*", "_u.*")
        if known is None:
            here = here.withColumns({f"p_{v}": F.lit(1.0 / ALPHABET) for v in KINDS})
        else:
            here = _met(here.withColumn("_less", F.expr(f"right(part, {k})")), known.withColumnRenamed("part", "_less"), "_less")
        # a context that was never used leaves the probability as it is
        known = materialize(here.select("part", *[F.when(F.col(f"uses_{v}") > 0, (F.col(v) + F.col(f"kinds_{v}") * F.col(f"p_{v}")) / (F.col(f"uses_{v}") + F.col(f"kinds_{v}")))
                                                  .otherwise(F.col(f"p_{v}")).alias(f"p_{v}") for v in KINDS]), f"url-blend-{k}")
        last = known.select(F.col("part").alias("gram"), (F.ln(f"p_{KINDS[0]}") - F.ln(f"p_{KINDS[1]}")).alias("value"))
        # blending ends with a gram's own length
        ends = _met(last, grams.where(F.length("gram") == k + 1), "gram")
        out = ends if not k else out.unionByName(ends)
    return out.select("gram", *KINDS, "value")


def cut_of(scored: DataFrame) -> float:
    """The cut of ``calibrated`` over all (score, good): scores are folded into cells of ``CELL``, with their range and both counts."""
    cells = scored.groupBy(F.floor(F.col("score") / CELL).alias("cell")).agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"), F.min("score").alias("low"), F.max("score").alias("high"))
    rows = sorted(cells.collect(), key=lambda r: r["cell"])  # no more cells than the range of scores has
    good, bad = sum(r["good"] for r in rows), sum(r["bad"] for r in rows)
    if not good or not bad:
        return 0.0
    best, cut, below = -1.0, 0.0, 0.0
    for k, r in enumerate(rows):
        if below + 1.0 > best:
            best, cut = below + 1.0, ((rows[k - 1]["high"] if k else r["low"]) + r["low"]) / 2
        below += r["bad"] / bad - r["good"] / good
    return cut


def calibrated(scored: list[tuple[float, bool]]) -> float:
    """The cut that best separates the kept-out labels, both kinds weighted alike; midway within a gap."""
    good, bad = sum(ok for _, ok in scored), sum(not ok for _, ok in scored)
    if not good or not bad:
        return 0.0
    scored = sorted(scored)
    best, cut, below = -1.0, 0.0, 0.0
    for k, (s, ok) in enumerate(scored):
        here = below + 1.0  # share of bad below, plus share of good at or above
        low = scored[k - 1][0] if k else s
        if here > best and (not k or low < s):
            best, cut = here, (low + s) / 2
        below += -1.0 / good if ok else 1.0 / bad
    return cut


def judge_urls(pages: DataFrame, url: str = "url", rules: Sequence[tuple[str, str]] = RULES, keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """(row, host, path, rule, verdict, score) of every page."""
    own = pages.select(F.struct(*keep).alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), address_of(F.col(url)).alias("address"))
    ruled = own.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    # an address is one piece of evidence, however many pages repeat it; host and path follow from it, and so its rule
    told = ruled.where("address <> ''").groupBy("address").agg(F.min("r.verdict").alias("verdict"))
    told = materialize(told.withColumns({"calibrate": F.pmod(F.xxhash64(F.lit(3), "address"), F.lit(4)) == 0, "id": F.monotonically_increasing_id()}), "addresses")
    have = {r["verdict"] for r in told.where("verdict IS NOT NULL AND NOT calibrate").select("verdict").distinct().collect()}
    if have != set(KINDS):
        return ruled.select("row", "host", "path", "r.rule", F.coalesce("r.verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    values = materialize(gram_values(told).select("gram", "value"), "url-values")
    rated = _met(_spots(told, "id"), values, "gram").groupBy("id").agg((F.sum("value") / F.count(F.lit(1))).alias("score"))
    scores = materialize(_met(told, rated, "id").drop("id"), "url-scores")
    cut = cut_of(scores.where("calibrate AND verdict IS NOT NULL").select("score", (F.col("verdict") == "allow").alias("good")))
    scored = _met(ruled, scores.select("address", "score"), "address", "left")
    learned = F.when(F.col("score") < F.lit(cut), F.lit("block")).otherwise("allow")
    return scored.select("row", "host", "path", "r.rule", F.coalesce("r.verdict", learned).alias("verdict"), "score")
