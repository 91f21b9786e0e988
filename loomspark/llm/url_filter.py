"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

All of it is SQL: parsing, n-gram hashing, gradient descent (a fold over iterations on one row
that holds the small labelled table) and scoring. Only the weights, `BUCKETS` numbers, come to the driver.

Defined results
---------------
- null url or no `://`: host and path are empty, no rule, the method's verdict on empty strings;
- the longest fitting rule wins, first by host, then by path; repeated rows each get their row;
- very long urls: whole, each distinct n-gram counts once; a host of an unseen script has n-grams like any other;
- an empty labelled table gives weights 0: probability 0.5, verdict allow (block needs more than half);
- other columns of the input are ignored.
"""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 2048
GRAMS = (3, 4, 5)
STEPS, RATE, DECAY = 300, 16.0, 0.0001
#: Rows of the labelled table that are used, at most (the smallest by url).
MAX_LABELLED = 5000

#: The rules of the contract: (host, path, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

# Common words of hosts that are to be blocked, and of hosts that are not.
BAD_WORDS = (
    "spam", "casino", "poker", "slots", "jackpot", "bet", "gambling", "pill", "pharma", "viagra", "meds", "adult", "xxx", "porn", "cams", "dating", "loan",
    "payday", "credit", "cheap", "free", "win", "prize", "bonus", "click", "tracker", "ads", "banner", "seo", "replica",
)
GOOD_WORDS = (
    "news", "garden", "weather", "library", "museum", "university", "recipe", "travel", "history", "science", "music", "docs", "health", "kitchen", "theory",
    "thought", "outdoor", "author", "school", "city", "archive", "forum", "journal", "market", "nature", "paper", "radio", "sport", "theatre", "water",
)
# The most frequent pairs of letters in English words.
PAIRS = ("th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt")
ZONES = ("example.com", "example.org", "example.net")
PREFIXES = ("", "www.", "blog.", "m.")
PATHS = ("en/{}", "de/{}.html", "fr/{}/", "es/{}#top", "{}?page=2", "view/{}")
#: Stems whose crc32 has this remainder modulo HELD_OUT are never trained on.
HELD_OUT, HELD = 4, 1


def stems(words: tuple[str, ...]) -> list[str]:
    """A word by itself, with the third and the eleventh after it, and run into the seventh after it."""
    n = len(words)
    return [s for i, w in enumerate(words) for s in (w, f"{w}-{words[(i + 3) % n]}", f"{w}-{words[(i + 11) % n]}", w + words[(i + 7) % n])]


def neutral() -> list[str]:
    """Stems that mean nothing: of two to four frequent pairs of letters."""
    n = len(PAIRS)
    return ["".join(PAIRS[(i + 3 * k + j * (2 * k + i % 7 + 1)) % n] for j in range(2 + k % 3)) for k in range(12) for i in range(n)]


def labelled(held_out: bool = False) -> list[tuple[str, int]]:
    """The small labelled table, by rule from the words: (url, label), 1 is to be blocked. `held_out`: that of the stems left out of it."""
    out = []
    for found, label in ((stems(BAD_WORDS), 1), (stems(GOOD_WORDS), 0), (neutral(), 0)):
        for i, stem in enumerate(dict.fromkeys(found)):
            if (crc32(stem.encode()) % HELD_OUT == HELD) == held_out:
                path = PATHS[i % len(PATHS)].format(i * 37 % 1000)
                out.append((f"https://{PREFIXES[i % len(PREFIXES)]}{stem}.{ZONES[i % len(ZONES)]}/{path}", label))
    return out


LABELLED = tuple(labelled())


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first `://`: up to `/`, `?`, `#` or the end, A-Z lower-cased; then up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _rule(host: Column, path: Column, rules) -> Column:
    """struct(name, verdict) of the longest rule that fits, or null."""
    fits = [
        F.when((F.concat(F.lit("."), host).endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("name"), F.lit(v).alias("verdict")))
        for h, p, v in sorted(rules, key=lambda r: (-len(r[0]), -len(r[1]), r[0], r[1]))
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<name:string,verdict:string>")


def _hashed(chars: Column, side: str, n: int) -> Column:
    at = F.sequence(F.lit(1), F.greatest(F.size(chars) - n + 1, F.lit(1)))
    return F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(f"{side}{n}"), F.array_join(F.slice(chars, i, F.lit(n)), "")), F.lit(BUCKETS)).cast("int"))


def buckets(host: Column, path: Column) -> Column:
    """The distinct buckets of the n-grams of host and path, their ends marked."""
    marked = [("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.lit("^"), path, F.lit("$")))]
    # characters are cut once, by a lambda's variable: each n-gram takes n of them, however long the text is
    grams = lambda side: lambda chars: F.concat(*[_hashed(chars, side, n) for n in GRAMS])
    each = [F.transform(F.array(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))), grams(side)) for side, text in marked]
    return F.array_distinct(F.concat(*[F.get(x, F.lit(0)) for x in each]))


def weights(spark: SparkSession, labelled=LABELLED) -> list[float]:
    """Bias and one weight for each bucket: full-batch gradient descent on the logistic loss, in which either label weighs as much."""
    table = labelled if isinstance(labelled, DataFrame) else spark.createDataFrame(list(labelled), "url string, label int")
    rows = table.where("url is not null and label is not null").select("url", "label").distinct().orderBy("url", "label").limit(MAX_LABELLED)
    host, path = host_and_path(F.col("url"))
    rows = rows.select(buckets(host, path).alias("x"), F.col("label").cast("double").alias("y"))
    # bounded by MAX_LABELLED; as literals of one row, each is evaluated once in the fold
    known = sorted((sorted(r.x), r.y) for r in rows.collect())
    if not known:
        return [0.0] * (BUCKETS + 1)
    x = [[0] + [b + 1 for b in buckets_] for buckets_, _ in known]  # 0 is the bias
    has: list[list[int]] = [[] for _ in range(BUCKETS + 1)]
    for i, row in enumerate(x):
        for j in row:
            has[j].append(i)
    bad = sum(y for _, y in known)
    part = [len(x) / 2 / max(1, bad if y else len(x) - bad) for _, y in known]  # either label weighs as much
    one = spark.createDataFrame([(x, [y for _, y in known], part, has, len(x))], "x array<array<int>>, y array<double>, part array<double>, has array<array<int>>, n int")
    # one step: first each row's residual over the square root of its features, then each weight's gradient
    residual = "transform(sequence(0, n - 1), i -> part[i] * (y[i] - 1 / (1 + exp(-aggregate(x[i], 0D, (s, j) -> s + w[j]) / sqrt(size(x[i]))))) / sqrt(size(x[i])))"
    gradient = f"transform(w, (v, j) -> v + {RATE}D * (aggregate(has[j], 0D, (s, i) -> s + r[i]) / n - {DECAY}D * v))"
    step = f"transform(array({residual}), r -> {gradient})[0]"
    fitted = one.select(F.expr(f"aggregate(sequence(1, {STEPS}), array_repeat(0D, {BUCKETS + 1}), (w, k) -> {step})").alias("w"))
    return [float(v) for v in fitted.first().w]


def probability(host: Column, path: Column, w: list[float]) -> Column:
    """The method's probability that a url is to be blocked."""
    x = buckets(host, path)
    table = F.array(*[F.lit(v) for v in w[1:]])
    total = F.aggregate(x, F.lit(w[0]), lambda s, b: s + F.get(table, b))
    return 1 / (1 + F.exp(-total / F.sqrt(F.size(x) + 1)))


def judge(pages: DataFrame, rules=RULES, labelled=LABELLED, block_above: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, probability of every row of `pages` (page_id, url)."""
    w = weights(pages.sparkSession, labelled)
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fits", _rule(F.col("host"), F.col("path"), rules))
    p = probability(F.col("host"), F.col("path"), w)
    rows = rows.withColumn("probability", p)
    return rows.select(
        F.col("page_id").cast("long").alias("page_id"), "host", "path", F.col("fits.name").alias("rule"),
        F.coalesce("fits.verdict", F.when(F.col("probability") > block_above, "block").otherwise("allow")).alias("verdict"), "probability",
    )
