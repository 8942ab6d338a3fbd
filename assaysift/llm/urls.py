"""URL filter: rules by host and path, and logistic regression on hashed character n-grams for all other addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rules, each a host with a path.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
# The labelled table: every host is listed with every path of its kind, label 1 for unwanted.
_WANTED = (
    "www.daily-news.example.com blog.travel.example.org docs.python-guide.example.com m.weather.example.com"
    " wiki.history.example.org www.university.example.com shop.books.example.com museum.example.org library.example.com"
    " recipes.kitchen.example.com forum.gardening.example.org science.example.com news.local.example.org maps.example.com"
    " health.clinic.example.org music.school.example.com www.thedand.example.com blog.thersh.example.org"
    " m.therth.example.com thtion.example.org www.theonnd.example.org theand.example.com"
).split()
_UNWANTED = (
    "www.casino-win.example.com best-casino.example.org free-bets.example.com sports-bets.example.org poker-bonus.example.com"
    " spam-farm.example.com link-farm.example.org win-money-now.example.com cheap-pills.example.org xxx-videos.example.com"
    " adult-cams.example.org payday-loan.example.com free-slots.example.com jackpot-slots.example.org seo-spam.example.com"
    " replica-watches.example.com crypto-doubler.example.org lottery-win.example.com hot-dating.example.org"
    " torrent-crack.example.com keygen-warez.example.org click-farm.example.com"
).split()
_PATHS = ("/", "/en/4033.html", "/de/17?page=2", "/fr/5462/", "/es/981")
_BAD_PATHS = ("/", "/en/4033.html", "/de/17?page=2", "/bonus/win-now", "/free/casino")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """Return the labelled table (url, label), in one partition so that fitting is repeatable."""
    rows = [(f"https://{h}{p}", 0.0) for h in _WANTED for p in _PATHS] + [(f"http://{h}{p}", 1.0) for h in _UNWANTED for p in _BAD_PATHS]
    return spark.createDataFrame([*rows, ("", 0.0)], "url string, label double").coalesce(1)


def lower_ascii(text: Column) -> Column:
    """Return a text with A-Z lower-cased and nothing else changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Return host (lower-cased) and path of an address, both empty where it is null or lacks ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return lower_ascii(host), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """Return the longest rule that fits: its host is the address's or a parent domain, its path begins the address's."""

    def fits(rule: str) -> Column:
        name, slash, start = rule.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)

    order = sorted(rules, key=len, reverse=True)
    return reduce(lambda found, rule: F.when(fits(rule), F.lit(rule)).otherwise(found), reversed(order), F.lit(None).cast("string"))


def _ngrams(characters: Column, mark: str, n: int) -> Column:
    """Return the n-grams of a list of characters, which is indexed, so a long address takes time in proportion."""
    size = F.size(characters)
    places = F.when(size >= n, F.sequence(F.lit(1), size - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.lit(mark), *[F.element_at(characters, i + k) for k in range(n)]))


def _with_terms(urls: DataFrame, url: Column) -> DataFrame:
    host, path = host_and_path(url)

    def characters(text: Column) -> Column:
        # Marks at both ends let n-grams tell where a name begins and ends.
        return F.split(F.concat(F.lit("^"), text, F.lit("$")), "")

    listed = urls.withColumn("_host", characters(host)).withColumn("_path", characters(path))
    terms = [*[_ngrams(F.col("_host"), "h", n) for n in (3, 4, 5)], *[_ngrams(F.col("_path"), "p", n) for n in (3, 4)]]
    return listed.withColumn("_terms", F.concat(*terms)).drop("_host", "_path")


def train(labelled: DataFrame, features: int = 1 << 14) -> PipelineModel:
    """Fit logistic regression on hashed n-grams of host and path of ``labelled`` (url, label)."""
    hashing = HashingTF(inputCol="_terms", outputCol="_features", numFeatures=features, binary=True)
    table = hashing.transform(_with_terms(labelled, F.col("url")))
    fitted = LogisticRegression(
        featuresCol="_features", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction", regParam=0.01, maxIter=30
    ).fit(table)
    return PipelineModel([hashing, fitted])


def judge(
    pages: DataFrame, model: PipelineModel, rules: dict[str, str] | None = None, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """Return (page_id, host, path, rule, verdict, score) for every row of ``pages``.

    The verdict is that of the longest rule that fits, else block where the model's score is 0.5 or more. A null address or
    one without ``://`` has an empty host and path, fits no rule and is judged as such by the model. Ids may be null or
    repeat; further columns are ignored.
    """
    rules = RULES if rules is None else rules
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    scored = model.transform(_with_terms(rows, F.col("url")))
    host, path = host_and_path(F.col("url"))
    parts = scored.select("page_id", host.alias("host"), path.alias("path"), vector_to_array("_probability")[1].alias("score"))
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    verdicts = F.create_map(*[F.lit(x) for item in rules.items() for x in item])
    ruled = parts.withColumn("rule", rule)
    learnt = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", "rule", F.coalesce(verdicts[F.col("rule")], learnt).alias("verdict"), "score")
