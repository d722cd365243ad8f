"""URL verdicts with DataFrame functions alone: domain and path rules, then logistic regression.

The regression reads hashed character n-grams of host and path (which of DIM buckets they fall into) and is fitted on a
small labelled table (LABELLED, or one of the same shape) by stochastic gradient steps inside one SQL expression;
its DIM weights come to the driver and go into the scoring expression as constants. No Python runs on executors.

A null url, or one without ``://``, has an empty host and path, no rule, and the verdict that the regression gives
an empty text. Urls of any length are read whole. Repeated rows are judged alike; extra columns are ignored; an empty
table gives no rows. No two rules that fit one url can be equally long unless they are equal; of those the last wins.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIM, GRAM, EPOCHS, RATE = 4096, 4, 15, 0.5

#: The rules of the query contract.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

#: Words of the default labelled table: hosts to allow, hosts to block, and what either may bear beside them.
_GOOD = [
    "news", "docs", "wiki", "blog", "library", "science", "journal", "museum", "school", "archive", "weather", "recipes",
    "garden", "history", "music", "travel", "health", "university", "research", "kitchen", "planet", "village", "theatre", "forum",
    "cycling", "mountain", "harbour", "painting", "chemistry", "physics", "letters", "council", "railway", "orchard", "teaching", "software",
    "market", "studio", "nature", "language", "maison", "jardin", "musique", "ecole", "voyage", "zeitung", "garten", "schule", "reise", "buch",
]
_BAD = [
    "casino", "viagra", "poker", "xxx", "adult", "warez", "torrent", "betting", "pills", "spam", "clickbait", "porn",
    "gambling", "roulette", "jackpot", "slots", "bingo", "lottery", "escort", "nude", "sexcam", "cialis", "keygen", "cracks", "replica",
    "payday", "malware", "phishing", "adserver", "adtracker", "popunder", "linkfarm",
]
_BESIDE = ["", "-online", "best", "-24", "city", "my-", "the", "-club", "world", "new-"]
_PLACES = ["https://www.{}.example.net/en/{}", "http://{}.example.com/articles/{}", "https://m.{}.example.org/fr/{}.html", "http://{}.example/de/{}?page=2", "https://blog.{}.example.com/{}"]
#: Urls a word stands in, the same for both labels, so that nothing but the words tells them apart.
_URLS = 5


def labelled() -> list[tuple[str, int]]:
    """The default labelled table, 1 for block: each word alone and with what may stand beside it, in places that go round."""
    out = []
    for y, words in ((0, _GOOD), (1, _BAD)):
        for i, word in enumerate(words):
            for j in range(_URLS):
                beside = _BESIDE[(3 * i + j) % len(_BESIDE)] if j else ""
                host = word + beside if beside.startswith("-") else beside + word
                out.append((_PLACES[(i + j) % len(_PLACES)].format(host, 7919 * (i * _URLS + j + 1) % 4093), y))
    return out


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def _features(host: Column, path: Column) -> Column:
    """Buckets of the n-grams of ``^host$path^``, each once."""
    text = F.concat(F.lit("^"), host, F.lit("$"), path, F.lit("^"))
    last = F.greatest(F.char_length(text) - (GRAM - 1), F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.pmod(F.xxhash64(F.substr(text, i, F.lit(GRAM))), F.lit(DIM)).cast("int")))


def _sum(w: Column, f: Column) -> Column:
    """Weights of the buckets, over a norm, and the constant."""
    return F.aggregate(f, F.lit(0.0), lambda s, i: s + F.get(w, i)) / F.sqrt(F.size(f).cast("double")) + F.get(w, F.lit(DIM))


FIT_ROWS = 5000


def fit(spark: SparkSession, table: DataFrame | None = None, fit_rows: int = FIT_ROWS) -> list[float]:
    """DIM + 1 weights, the last for the constant. table: url string, label int (1 for block); rows with nulls don't count.

    At most ``fit_rows`` rows are gathered, in order of a hash: one task holds them.
    """
    table = table if table is not None else spark.createDataFrame(labelled(), "url string, label int")
    host, path = parts(F.col("url"))
    rows = table.where("url IS NOT NULL AND label IS NOT NULL").select("label", _features(host, path).alias("f"))
    one = F.collect_list(F.struct(F.xxhash64("f").alias("o"), F.col("label").cast("double").alias("y"), "f"))
    data = rows.orderBy(F.xxhash64("f"), "label").limit(fit_rows).agg(F.array_sort(one).alias("d"))
    places = F.sequence(F.lit(0), F.lit(DIM))
    dense = lambda f: F.transform(places, lambda i: F.when(i == DIM, F.lit(1.0)).when(F.array_contains(f, i), 1 / F.sqrt(F.size(f).cast("double"))).otherwise(F.lit(0.0)))
    data = data.select(F.transform("d", lambda r: F.struct(r["y"].alias("y"), r["f"].alias("f"), dense(r["f"]).alias("x"))).alias("d"))

    def step(w: Column, r: Column) -> Column:
        moves = F.transform(F.array(F.lit(RATE) * (r["y"] - 1 / (1 + F.exp(-_sum(w, r["f"]))))), lambda g: F.zip_with(w, r["x"], lambda a, b: a + g * b))
        return F.element_at(moves, 1)

    weights = F.aggregate(F.flatten(F.array_repeat("d", EPOCHS)), F.array_repeat(F.lit(0.0), DIM + 1), step)
    got = data.select(weights.alias("w")).first()["w"]
    return [float(x) for x in got] if got else [0.0] * (DIM + 1)


def score(host: Column, path: Column, weights: list[float]) -> Column:
    """Probability of block."""
    w = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # one constant for the optimizer to fold
    total = _sum(w, _features(host, path))
    return 1 / (1 + F.exp(-total))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and kind of the longest rule that fits."""
    name = kind = F.lit(None).cast("string")
    for k, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, kind = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(k)).otherwise(kind)
    return name, kind


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, table: DataFrame | None = None, most: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) of every page."""
    weights = fit(pages.sparkSession, table)
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, kind = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    rows = rows.select("*", name.alias("rule"), kind.alias("kind"), score(F.col("host"), F.col("path"), weights).alias("block_score"))
    verdict = F.coalesce("kind", F.when(F.col("block_score") > most, F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")
