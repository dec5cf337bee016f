"""URL filtering by rules and by a character language-model ratio, in Spark expressions only.

Rules name hosts and path prefixes.  URLs that a rule judges train two smoothed variable-order
Markov models of characters, one of accepted and one of rejected URLs.  Any other URL is
judged by the difference of its log-likelihoods per character against a threshold calibrated
on judged URLs that the models did not see.

The models are a table of all runs of characters seen, as long as the URLs make it.  Every
different run of a URL to be judged looks up its longest end in that table once, by joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pin

#: Longest run of characters counted, and strength of the shorter context.
ORDER, STRENGTH = 4, 4.0
#: One in so many judged URLs is kept for calibration; thresholds are tried in steps of this size up to this size.
HELD_OUT, STEP, WIDEST = 4, 0.02, 4.0

ADDED = ("host", "path", "rule", "score", "verdict")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters in lower case) and path; both empty for a null URL or one without ``://``."""
    rest = F.substring(url, F.instr(url, "://") + 3, 2**31 - 1)
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; of two of one length, the one listed first.  Null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: len(r[0])):
        of_host, _, of_path = name.partition("/")
        fits = ((host == of_host) | host.endswith(f".{of_host}")) & path.startswith(f"/{of_path}")
        rule, verdict = F.when(fits, name).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def shown(host: Column, path: Column) -> Column:
    """What the models read: host and path between marks, digits as one sign."""
    return F.concat(F.lit("^"), F.regexp_replace(F.concat(host, path), "[0-9]+", "0"), F.lit("$"))


def gram(line: Column, at: Column, size: int) -> Column:
    """The run of up to ``size`` characters that ends at a place."""
    start = F.greatest(at - size + 1, F.lit(1))
    return F.substring(line, start, at - start + 1)


def train(judged: DataFrame) -> DataFrame:
    """(gram, ratio): log ratio of the probabilities of a run's last character, for every run of characters seen.

    ``judged`` has ``line``, ``bad`` and ``n``, the number of such URLs.  The probability of a
    character after a context is its share there, smoothed by ``STRENGTH`` times that after
    the context without its first character, down to an even one.
    """
    ends = judged.select("line", "bad", "n", F.explode(F.sequence(F.lit(2), F.greatest(F.length("line"), F.lit(2)))).alias("at"))
    each = ends.select("bad", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("size"), gram(F.col("line"), F.col("at"), k).alias("gram")) for k in range(1, ORDER + 1)])).alias("g")).select("bad", "n", "g.*")
    seen = each.where(F.length("gram") == F.col("size")).groupBy("size", "gram").agg(*both_kinds())
    seen = pin(seen.withColumn("context", F.left("gram", F.col("size") - 1)))
    done, levels = None, []
    for k in range(1, ORDER + 1):
        own = seen.where(F.col("size") == k)
        totals = own.groupBy("context").agg(F.sum("bad").alias("all_bad"), F.sum("good").alias("all_good"))
        rows = own.join(totals, "context")
        if done is None:
            rows = rows.withColumns({"low_bad": F.lit(1 / 256), "low_good": F.lit(1 / 256)})
        else:
            rows = rows.withColumn("_low", F.right("gram", F.lit(k - 1))).join(done.select(F.col("gram").alias("_low"), F.col("p_bad").alias("low_bad"), F.col("p_good").alias("low_good")), "_low")
        smooth = lambda c: (F.col(c) + STRENGTH * F.col(f"low_{c}")) / (F.col(f"all_{c}") + STRENGTH)  # noqa: E731, B023
        done = rows.select("gram", smooth("bad").alias("p_bad"), smooth("good").alias("p_good"))
        levels.append(done)
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every.select("gram", F.log(F.col("p_good") / F.col("p_bad")).alias("ratio"))


def both_kinds() -> list[Column]:
    return [F.coalesce(F.sum(F.when(kind, F.col("n"))), F.lit(0)).alias(name) for name, kind in (("bad", F.col("bad")), ("good", ~F.col("bad")))]


def score(lines: DataFrame, model: DataFrame) -> DataFrame:
    """(line, score) of different lines: mean over the characters of the ratio of the longest run seen that ends there.

    Runs that no line end of the model fits count 0.
    """
    named = lines.select("line", F.md5(F.col("line").cast("binary")).alias("id"))
    ends = named.select("id", F.explode(F.sequence(F.lit(2), F.greatest(F.length("line"), F.lit(2)))).alias("at"), "line")
    runs = ends.select("id", gram(F.col("line"), F.col("at"), ORDER).alias("run")).groupBy("id", "run").agg(F.count("*").alias("n"))
    tails = runs.select("run").distinct().select("run", F.explode(F.sequence(F.lit(1), F.greatest(F.length("run"), F.lit(1)))).alias("size"))
    fits = tails.select("run", "size", F.right("run", F.col("size")).alias("gram")).join(model, "gram")
    longest = fits.groupBy("run").agg(F.max(F.struct("size", "ratio")).alias("b")).select("run", "b.ratio")
    each = runs.join(longest, "run", "left").groupBy("id").agg((F.sum(F.col("n") * F.coalesce("ratio", F.lit(0.0))) / F.sum("n")).alias("score"))
    return named.join(each, "id").select("line", F.round("score", 9).alias("score"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", keeps: list[str] | None = None) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``score`` and ``verdict`` (allow or block) to every row.

    The rule decides where one fits, else the score: allow from the calibrated threshold on.
    Null and odd URLs have an empty host and path and are judged by score like any other.
    With judged URLs of one kind only, or none, scores are 0 and everything else is allowed.
    Rows are judged alone, so ties and repeated rows need no rule.
    """
    host, path = host_path(F.col(url))
    kept = [c for c in (pages.columns if keeps is None else keeps) if c not in ADDED]
    # the given columns stand apart in a struct, so that no name of theirs meets one made here
    parts = pages.select(F.struct(*kept).alias("row"), host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    lined = parts.withColumns({"rule": rule, "_says": says, "_line": shown(F.col("host"), F.col("path"))})
    said = lined.where("_says is not null").groupBy(F.col("_line").alias("line"), (F.col("_says") == "block").alias("bad")).agg(F.count("*").alias("n"))
    judged = pin(said.withColumn("held", F.pmod(F.xxhash64("line"), F.lit(HELD_OUT)) == 0))
    learn, held = judged.where("not held"), judged.where("held")
    both = learn.agg(*both_kinds()).first()
    usable = bool(both["bad"] and both["good"])
    rest = lined.where("_says is null").select(F.col("_line").alias("line"))
    if usable:
        scores = pin(score(rest.union(held.select("line")).distinct(), pin(train(learn))))
        cut = threshold(held.join(scores, "line"))
    else:
        scores, cut = rest.distinct().withColumn("score", F.lit(0.0)), -float("inf")
    ruled = lined.where("_says is not null").withColumn("score", F.lit(None).cast("double"))
    found = lined.where("_says is null").join(scores.withColumnRenamed("line", "_line"), "_line").select(*ruled.columns)
    verdict = F.coalesce("_says", F.when(F.col("score") >= cut, "allow").otherwise("block"))
    return ruled.unionByName(found).withColumn("verdict", verdict).select("row.*", *ADDED)


def threshold(held: DataFrame) -> float:
    """The score from which URLs are allowed: fewest errors on held-out URLs, nearest to 0 among equals.

    Scores are counted in bins, so only as many rows as bins come to the driver.
    """
    bins = int(WIDEST / STEP)
    at = F.least(F.greatest(F.floor(F.col("score") / STEP), F.lit(-bins)), F.lit(bins)).cast("int")
    counts = {r["at"]: (r["bad"], r["good"]) for r in held.groupBy(at.alias("at")).agg(*both_kinds()).collect()}
    errors = {cut: sum(good if b < cut else bad for b, (bad, good) in counts.items()) for cut in range(-bins, bins + 2)}
    return STEP * min(errors, key=lambda cut: (errors[cut], abs(cut), cut))
