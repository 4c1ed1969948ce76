"""URL filter with DataFrame functions only: rules first, then logistic regression on hashed character n-grams.

The model is trained on a small labelled table of URLs, given or the one made below; its size is bounded by
TRAINING_URLS. Scoring is one sum over a coefficient array inside each row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import LOWER_ASCII, UPPER_ASCII, plain_names, table

#: Fixed: rules of host and path beginning with their verdicts.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Words that a labeller would know hosts to block by, and words of ordinary hosts; the labelled table pairs them.
BLOCKED_WORDS = """ads adult airdrop bets bonus bookie bulk cams casino cheap clicks crack craps credit dating debt diet discount doubler escort fake
followers gamble giveaway hookup jackpot keygen kush loans lottery meds mlm nude payday pharma pills poker popup porn prize replica roulette serial
slim slots spam steroid streamz torrent tracker traffic vegas viagra wager warez winner xxx""".split()
ALLOWED_WORDS = """academy archive atlas bakery bird book bridge choir city clinic coast college council craft daily farm forum gallery garden guide
harbour health heritage hill history hotel journal kitchen law library maths museum music nature news north notes orchard park physics
poetry press recipe research review river school science street theatre town trails trains travel valley village weather wood""".split()
#: Made-up names of consonants and vowels, as of firms and people, to be allowed too.
CONSONANTS, VOWELS = "bcdfghjklmnprstvwz", "aeiou"
PATHS = ["/", "/en/12", "/de/404.html", "/fr/index", "/es/7?page=2", "/about", "/article/2021/05/notes", "/en/2210#top"]
BLOCKED_PATHS = ["/bonus/claim", "/buy-now", "/order?promo=99", "/go/signup"]
SUBDOMAINS, TOPS, JOINTS = ["", "www.", "m.", "blog.", "shop."], ["com", "org", "net", "info", "example.com", "example.org", "example.net"], ["-", "", "-", "."]
GRAMS, FEATURES, TRAINING_URLS = (3, 4), 1 << 12, 1_200


def labelled_urls(blocked: int = 500, allowed: int = 700, blocked_words: list[str] = BLOCKED_WORDS, allowed_words: list[str] = ALLOWED_WORDS) -> list[tuple[str, int]]:
    """The labelled table: a URL for each of so many distinct hosts; (url, 1 to block, 0 to allow)."""
    rows = []
    for label, words, count, paths in ((1, blocked_words, blocked, PATHS + BLOCKED_PATHS), (0, allowed_words, allowed * 5 // 7, PATHS)):
        n = len(words)
        rows += [(f"{words[k % n]}{JOINTS[(k + k // n) % 4]}{words[(k + 1 + k // n) % n]}", label, k, paths) for k in range(count)]
    for k in range(allowed - allowed * 5 // 7):
        name = "".join((CONSONANTS, VOWELS)[(i + k) % 2][(7 * k + 5 * i + k // 9 * i) % (len(CONSONANTS), len(VOWELS))[(i + k) % 2]] for i in range(5 + k % 5))
        rows.append((name, 0, k, PATHS))
    return [(f"https://{SUBDOMAINS[k % 5]}{host}.{TOPS[k % 7]}{paths[k % len(paths)]}", label) for host, label, k, paths in rows]


def fixed_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_urls(), "url string, blocked int")


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, with A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER_ASCII, LOWER_ASCII)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _grams() -> Column:
    """Slots of the character n-grams of the columns host and path, each with its mark."""
    parts = []
    for name in ("host", "path"):
        marked = F.concat(F.lit("^"), F.col(name), F.lit("$"))
        for n in GRAMS:
            last = F.length(name) + 2 - n + 1
            at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
            parts.append(F.transform(at, _slot(marked, name, n)))
    return F.concat(*parts)


def _slot(marked: Column, name: str, n: int):
    return lambda i: F.pmod(F.xxhash64(F.lit(name), F.substring(marked, i, F.lit(n))), F.lit(FEATURES)).cast("int")


def train(labelled: DataFrame, steps: int = 12, ridge: float = 0.002) -> np.ndarray:
    """Coefficients by slot, the intercept last. Rows without a url or label are left out.

    The slots come from the same DataFrame expression as in scoring; at most TRAINING_URLS rows, those with the
    smallest hashes, are fitted on the driver.
    """
    rows = labelled.where("url is not null and blocked is not null").select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "blocked", F.xxhash64("url").alias("h"))
    rows = rows.orderBy("h").limit(TRAINING_URLS).select(F.explode(F.array(_grams())).alias("slots"), "blocked").collect()
    if not rows:
        return np.zeros(FEATURES + 1)
    slots = np.concatenate([np.array(r.slots, int) for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r.slots) for r in rows])
    used, column = np.unique(slots, return_inverse=True)
    x = np.zeros((len(rows), len(used)))
    np.add.at(x, (owner, column), 1.0)
    x /= np.maximum(x.sum(1, keepdims=True), 1)
    y = np.array([float(r.blocked != 0) for r in rows])
    # Newton's method in the space of the rows: w = x' a.
    kernel, a, bias = x @ x.T, np.zeros(len(rows)), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(kernel @ a + bias, -30, 30)))
        hold = np.maximum(p * (1 - p), 1e-6)
        left = np.block([[kernel + np.diag(ridge / hold), np.ones((len(rows), 1))], [np.ones((1, len(rows))), np.zeros((1, 1))]])
        target = kernel @ a + bias + (y - p) / hold
        new = np.linalg.solve(left, np.append(target, 0.0))
        moved = np.abs(new[:-1] - a).max()
        a, bias = new[:-1], new[-1]
        if moved < 1e-6:
            break
    w = np.zeros(FEATURES + 1)
    w[used], w[-1] = x.T @ a, bias
    return w


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """pages with host, path, rule, score and verdict: the longest rule that fits, else blocked from 0.5 on.

    A null url, or one without ://, has an empty host and path, fits no rule and is scored as it is. Repeated rows
    stay; columns of pages named like a new one are replaced.
    """
    new = ("host", "path", "rule", "score", "verdict")
    pages, back = plain_names(pages, ("url",), new)
    kept, fit, slots, ruled = pages.columns, "fit", "slots", "ruled"
    rows = pages.select(*kept, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r)):
        host, _, path = rule.partition("/")
        same = (F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))
        fits.append(F.when(same & F.startswith(F.col("path"), F.lit("/" + path)), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    weights = train(labelled)
    coefficients = F.lit(np.round(weights[:-1], 9))
    rows = rows.select(*kept, "host", "path", F.coalesce(*fits, F.lit(None)).alias(fit) if fits else F.lit(None).cast("struct<rule: string, verdict: string>").alias(fit), F.explode(F.array(_grams())).alias(slots))
    total = F.aggregate(slots, F.lit(0.0), lambda s, i: s + F.element_at(coefficients, i + 1))
    score = 1 / (1 + F.exp(-(total / F.greatest(F.size(slots), F.lit(1)) + F.lit(float(weights[-1])))))
    rows = rows.select(*kept, "host", "path", F.col(fit)["rule"].alias("rule"), F.col(fit)["verdict"].alias(ruled), score.alias("score"))
    return back(rows.withColumn("verdict", F.coalesce(ruled, F.when(F.col("score") >= 0.5, "block").otherwise("allow"))))


def held_out_words(spark: SparkSession, folds: int = 5) -> tuple[float, float]:
    """As held_out(), but no word of a judged host is in the table that its model learnt from: what n-grams alone carry over."""
    caught = left = bad = good = 0
    for fold in range(folds):
        known, other = ([[w for i, w in enumerate(words) if (i % folds == fold) == mine] for words in (BLOCKED_WORDS, ALLOWED_WORDS)] for mine in (False, True))
        learn = spark.createDataFrame(labelled_urls(500, 700, *known), "url string, blocked int")
        rest = labelled_urls(100, 140, *other)
        a, b = judge(spark.createDataFrame(rest, "url string, blocked int"), learn, []).agg(F.expr("count_if(blocked = 1 and verdict = 'block')"), F.expr("count_if(blocked = 0 and verdict = 'allow')")).first()
        caught, left, bad, good = caught + a, left + b, bad + sum(x for _, x in rest), good + sum(1 - x for _, x in rest)
    return caught / bad, left / good


def held_out(spark: SparkSession, labelled: list[tuple[str, int]], folds: int = 5) -> tuple[float, float]:
    """Share of blocked hosts caught and of allowed hosts left alone, each host judged by a model that never saw it."""
    caught = left = 0
    for fold in range(folds):
        learn = spark.createDataFrame([r for k, r in enumerate(labelled) if k % folds != fold], "url string, blocked int")
        rest = spark.createDataFrame([r for k, r in enumerate(labelled) if k % folds == fold], "url string, blocked int")
        a, b = judge(rest, learn, []).agg(F.expr("count_if(blocked = 1 and verdict = 'block')"), F.expr("count_if(blocked = 0 and verdict = 'allow')")).first()
        caught, left = caught + a, left + b
    bad = sum(x for _, x in labelled)
    return caught / bad, left / (len(labelled) - bad)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, fixed_labels(spark)).select("page_id", "host", "path", "rule", "verdict", "score")
