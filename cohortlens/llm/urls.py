"""URL filter: rules first, then a character language-model ratio. DataFrame functions only.

A rule names a host and a path. It fits the host and its subdomains if the URL's
path starts with the rule's; the longest rule that fits decides.

URLs that no rule fits are judged by two Markov models of variable order over the
characters of host and path: one of URLs that rules accept, one of those they
reject. A character's probability after its longest context is mixed with that
after the next shorter one (Witten-Bell), down to the uniform. The difference of
both log-likelihoods per character is compared with a threshold. A fifth of the
ruled URLs, set aside by hash, is not learned from; the threshold is the one that
separates accepted from rejected among them best (balanced error, on a fixed grid).

Each different URL counts once, so a URL with very many copies weighs like any
other and is scored once. Models are tables of different five-character grams,
far smaller than the URLs; every step is a grouped sum or a join.

Defined cases: a missing URL or one without ``://`` has an empty host and path and
is judged by the models like others; letters other than A-Z keep their case; rows
stay as they are, repeated ones with equal results; with no accepted or no rejected
URL, all that no rule fits are allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.session import materialize

#: fixed rules: (pattern, verdict)
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
ORDER = 4
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: stands for the beginning and the end of a URL; characters below it are taken for it
_EDGE = "\x02"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z made small) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)
    return F.translate(host, _CAPITALS, _CAPITALS.lower()), path


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting pattern and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = pattern.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, pattern).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _grams(urls: DataFrame) -> DataFrame:
    """One row per character (and one for the end) with the ``ORDER`` characters before it."""
    line = F.concat(F.lit(_EDGE * ORDER), "host", "path", F.lit(_EDGE))
    spots = F.sequence(F.lit(1), F.length("host") + F.length("path") + 1)
    return urls.withColumn("line", line).withColumn("at", F.explode(spots)).withColumn(
        "gram", F.col("line").substr(F.col("at"), F.lit(ORDER + 1))).drop("line", "at")


def _right(n: int) -> Column:
    return F.substring("gram", ORDER + 2 - n, n)


def gram_ratios(grams: DataFrame) -> DataFrame:
    """``gram``, ``ratio``: log-probability of a gram's last character as accepted less that as rejected.

    ``grams`` holds each gram once with counts ``yes`` and ``no``; grams not learned from have zeros.
    """
    sides = ("yes", "no")
    letters = F.greatest(F.lit(2.0), grams.select(_right(1).alias("c")).distinct().agg(F.count(F.lit(1)).cast("double")).scalar())
    shorter: DataFrame | None = None
    for n in range(1, ORDER + 2):
        level = grams.groupBy(_right(n).alias("key")).agg(*(F.sum(s).alias(s) for s in sides))
        context = F.col("key").substr(F.lit(1), F.lit(n - 1)) if n > 1 else F.lit("")
        level = level.withColumn("context", context)
        totals = level.groupBy("context").agg(
            *(F.sum(s).alias(f"n_{s}") for s in sides), *(F.sum((F.col(s) > 0).cast("long")).alias(f"kinds_{s}") for s in sides))
        level = level.join(totals, "context")
        if shorter is None:
            level = level.select("*", *((1 / letters).alias(f"p_{s}") for s in sides))
        else:
            level = level.withColumn("tail", F.col("key").substr(F.lit(2), F.lit(n - 1))).join(shorter, "tail")
        p = [F.when(F.col(f"n_{s}") > 0, (F.col(s) + F.col(f"kinds_{s}") * F.col(f"p_{s}")) / (F.col(f"n_{s}") + F.col(f"kinds_{s}")))
             .otherwise(F.col(f"p_{s}")).alias(f"p_{s}") for s in sides]
        shorter = level.select(F.col("key").alias("tail"), *p)
    return shorter.select(F.col("tail").alias("gram"), (F.log("p_yes") - F.log("p_no")).alias("ratio"))


def score_urls(urls: DataFrame, ruled: Column) -> DataFrame:
    """``host``, ``path``, ``score`` of each row of ``urls`` (different hosts and paths with a ``verdict`` or null)."""
    spread = _grams(urls)
    learned = ruled & ~_set_aside()
    counts = materialize(spread.groupBy("gram").agg(
        F.sum(F.when(learned & (F.col("verdict") == "allow"), 1).otherwise(0)).alias("yes"),
        F.sum(F.when(learned & (F.col("verdict") == "block"), 1).otherwise(0)).alias("no")), "grams")
    ratios = materialize(gram_ratios(counts), "gram-ratios")
    return spread.select("host", "path", "gram").join(ratios, "gram").groupBy("host", "path").agg(F.avg("ratio").alias("score"))


def _set_aside() -> Column:
    digest = F.md5(F.concat("host", F.lit("\n"), "path").cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 5 == 0


def best_threshold(scored: DataFrame, cells: int = 800, reach: float = 4.0) -> float:
    """Threshold with the least balanced error among ruled URLs that were set aside; 0 without both kinds.

    Scores are counted on a grid of ``cells`` between -``reach`` and ``reach``: no more rows come to the driver.
    """
    cell = F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor((F.col("score") + reach) / (2 * reach) * cells)))
    rows = scored.groupBy(cell.alias("cell")).agg(
        F.sum((F.col("verdict") == "allow").cast("long")).alias("yes"), F.sum((F.col("verdict") == "block").cast("long")).alias("no")).collect()
    yes, no = sum(r["yes"] for r in rows), sum(r["no"] for r in rows)
    if not yes or not no:
        return 0.0
    # below the threshold is rejected: accepted URLs below it and rejected ones above it are wrong
    wrong_yes, wrong_no = 0, no
    best = [(wrong_yes / yes + wrong_no / no, -reach)]
    for r in sorted(rows, key=lambda r: r["cell"]):
        wrong_yes += r["yes"]
        wrong_no -= r["no"]
        best.append((wrong_yes / yes + wrong_no / no, (r["cell"] + 1) / cells * 2 * reach - reach))
    least = min(b[0] for b in best)
    at = [t for w, t in best if w == least]
    return min(at, key=abs)


def judge_urls(pages: DataFrame, *, url: str = "url", id_column: str = "page_id",
               rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """Per row: id, ``host``, ``path``, ``rule``, ``verdict`` and the models' ``score``."""
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(id_column), host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    urls = materialize(rows.select("host", "path").distinct().select("host", "path", rule.alias("rule"), verdict.alias("verdict")), "urls")
    scored = materialize(urls.join(score_urls(urls, F.col("rule").isNotNull()), ["host", "path"]), "url-scores")
    threshold = best_threshold(scored.where(F.col("rule").isNotNull() & _set_aside()))
    both = scored.agg(F.countDistinct("verdict").alias("n")).first()["n"] == 2
    said = F.when(F.lit(both) & (F.col("score") < threshold), "block").otherwise("allow")
    judged = scored.select("host", "path", "rule", F.coalesce("verdict", said).alias("verdict"), "score")
    return rows.join(judged, ["host", "path"]).select(id_column, "host", "path", "rule", "verdict", "score")
