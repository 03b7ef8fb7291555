"""URL filters: allow and block rules, and behind them a logistic regression on hashed character n-grams.

The model is fitted on a small labelled table of URLs (bounded by ``MAX_LABELLED`` rows), scoring and
rule matching are column expressions, so judging a URL table is one scan without any shuffle.
"""

from __future__ import annotations

import random
from collections.abc import Iterable

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.common import materialize, picked
from leafmill.sources.scratch import new_path, shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: So many rules become literals of the plan at most; more are a table that is joined.
MAX_RULES = 200
MAX_LABELLED = 10_000
#: Part of a kept model's name: to be raised when fitting changes.
MODEL_VERSION = 1

#: (verdict, rule): a rule is host/path-prefix.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

#: The labelled table of the registered query, written by hand from common English words.  Bad and clean hosts differ in their
#: words and, in every other row, in endings and paths, as they do on the web; the others have neutral ones, so that words count
#: by themselves.  Made-up names stand for brands, whose words tell nothing: most of them are clean.
BLOCKED_WORDS = """
    spam spammer pills pharma meds cialis casino slots roulette blackjack jackpot gambling bookmaker betting bets wager lottery lotto sweepstake
    adult porn xxx sex nude camgirl escort hookup hentai erotic fetish milf ads adserver adclick popup banner-ads click tracker tracking pixel
    crack cracked keygen serial warez nulled pirate pirated torrents leech phish phishing verify-account login-alert secure-signin password-reset bank-alert
    wallet-unlock malicious trojan ransom spyware exploit botnet stealer hacked replica fake counterfeit knockoff loan loans payday cash-advance quick-cash
    get-rich easy-money earn-fast make-money crypto-doubler forex-signals pyramid giveaway free-iphone free-gift prize winner win-big spins bonus
    bingo keno craps tipster parlay xanax tramadol ambien valium hydrocodone oxycodone steroids rootkit backdoor dropper scam scammer hoax fraud carding
    stolen dumps cvv escorts strippers hotties kinky lingerie-cam singles-chat dating-hot upskirt bdsm swinger voyeur booter stresser cheats aimbot
    pokies gamble gambler drugs sexcam pornhd camshow livecams hotgirl chatroulette botting torrentz crackme phisher spambots cashback-pro
    weight-loss diet-pills slimming steroid backlinks link-farm seo-links doorway followers-buy cheap cheapest rx no-prescription
""".split()
ALLOWED_WORDS = """
    news weather library museum docs wiki forum science garden city travel health music school books archive times data coast north south river
    mountain village history theatre cinema gallery painting poetry novel writer author journal magazine radio press gazette herald tribune chronicle
    kitchen recipes baking bread coffee tea farm farmer orchard flowers forest nature birds fishing hiking camping cycling running football tennis hockey
    chess sailing railway station airport bridge transport bicycle motor engine repair tools timber stone brick building architect design studio
    pottery knitting fashion shoes jewel antique furniture house home family children parent nursery teacher student college university institute research
    physics chemistry biology geology astronomy mathematics statistics software python linux database network computer hardware electronics robotics
    hospital clinic doctor dentist nurse pharmacy medicine therapy wellness fitness yoga church temple charity volunteer council government parliament
    justice law court police fire energy solar water climate ocean harbour island beach valley bakery brewery winery restaurant hotel hostel
    market bank insurance finance economy business trade export craft photo camera video film animation language grammar dictionary translation
""".split()
TAILS = ("shop", "online", "world", "hub", "room", "blog", "tips", "zone", "best", "info", "direct", "center")
#: Bad and clean hosts that share words: what is said about a thing is not the thing.
BLOCKED_HOSTS = ("adult-tube", "euro-lottery", "lottery-tickets-now", "play-lottery", "adult-cams", "adults-only-video", "young-adult-chat-room", "free-casino", "music-warez", "school-porn", "bank-phish", "news-adclick", "weather-spam", "movie-torrents", "pharmacy-rx", "win-prize", "city-escort", "software-crack", "book-loans-payday")
ALLOWED_HOSTS = (
    "anti-spam-research", "casino-history-museum", "adult-education", "adult-learning", "track-and-field", "race-track", "click-chemistry", "win-win-design", "free-software", "free-library",
    "student-loan-advice", "interlibrary-loans", "sex-education", "gambling-help", "betting-law", "lottery-fund", "pirate-history", "password-manager-docs", "malware-research", "torrent-river-walks",
    "cheap-flights", "cheap-eats", "login-docs", "bonus-track-radio", "crack-climbing", "serial-novel", "escort-ship-history", "pills-and-pharmacy-law", "free-press", "farm-shop",
)
#: By label (0 clean, 1 bad) and for neutral rows (2): endings and paths.
ENDINGS = (
    ("edu", "gov", "ac.uk", "museum", "int", "edu.au", "eu", "ch", "nhs.uk"),
    ("xyz", "top", "click", "win", "loan", "bid", "icu", "tk", "biz", "vip", "gq", "buzz"),
    ("com", "net", "org", "co.uk", "de", "fr", "es", "info", "io", "example.com", "example.net", "example.org"),
)
PATHS = (
    ("/about", "/articles/2021/05/", "/docs/index.html", "/wiki/Main_Page", "/research/papers/12.pdf", "/news/2020/03/14/", "/contact", "/library/catalogue", "/faq", "/people/staff.html", "/events/2019/", "/history"),
    ("/go.php", "/click/77", "/aff/301", "/track/9", "/promo/bonus", "/buy-now", "/redirect", "/dl/setup.exe", "/login/verify.php", "/offer/12", "/cheap/order-now", "/hot/videos"),
    ("/", "/index.html", "/en/1", "/p/123", "/de/27.html", "/es/305/", "/fr/4411", "/en/2087.html", "/page/2"),
)
SUBDOMAINS = ("", "www.", "m.", "blog.")
#: Rows of a host: every other is neutral.
ROWS_OF_HOST = 6
#: Made-up names: how many, of two or three syllables of these letters.
NAMES, OPENING, VOWELS, CLOSING = 400, "bcdfghklmnprstvz", "aeiou", ("", "", "n", "r", "l", "s", "x")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or an url without ``://``."""
    url, pattern = F.coalesce(url, F.lit("")), r"://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def matching_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        rule_host, _, rest = rule.partition("/")
        own = (host == rule_host) | host.endswith("." + rule_host)
        fits.append(F.when(own & path.startswith("/" + rest), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def joined_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (with host and path) and the same struct as ``_rule``, from a table of rules (verdict, rule) of any size.

    Each host and path there is goes with its domains to the rules of that domain; only those are shuffled, once each.
    """
    lists = rules.select("verdict", "rule", F.substring_index("rule", "/", 1).alias("_domain"))
    lists = lists.withColumn("_prefix", F.expr("substring(rule, length(_domain) + 1)"))
    places = materialize(rows.select("host", "path").distinct(), "places")
    domains = places.select("host", "path", F.explode(F.sequence(F.lit(1), F.size(F.split("host", r"\.")))).alias("_k"))
    met = domains.withColumn("_domain", F.expr("substring_index(host, '.', -_k)")).join(lists, "_domain").where(F.col("path").startswith(F.col("_prefix")))
    # by verdict last, so that a rule listed twice has one of them
    best = met.groupBy("host", "path").agg(F.min_by(F.struct("rule", "verdict"), F.struct((-F.length("rule")).alias("_n"), "rule", "verdict")).alias("_rule"))
    return rows.join(materialize(best, "rules"), ["host", "path"], "left")


def ngrams(host: Column, path: Column, sizes: Iterable[int] = (3, 4, 5)) -> Column:
    """Character n-grams of ``^host$`` and ``^path$``, marked h and p so that the two never share a feature.

    They are zipped from the letters' array, in time that grows with an url's length; a text shorter than n has itself.
    """

    def of(mark: str, n: int, text: Column) -> Column:
        padded = F.concat(F.lit("^"), text, F.lit("$"))
        letters = F.split(padded, "")
        long = F.greatest(F.length(padded) - (n - 1), F.lit(1))
        grams = F.slice(letters, F.lit(1), long)
        for k in range(1, n):
            grams = F.zip_with(grams, F.slice(letters, F.lit(k + 1), long), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return F.transform(grams, lambda g: F.concat(F.lit(f"{mark}{n}:"), g))

    return F.concat(*[of(mark, n, text) for mark, text in (("h", host), ("p", path)) for n in sizes])


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "block", features: int = 1 << 16) -> PipelineModel:
    """Fit on a labelled URL table of at most ``MAX_LABELLED`` rows (checked), null labels left out."""
    labelled = labelled.where(F.col(label_col).isNotNull())
    rows, blocked = labelled.limit(MAX_LABELLED + 1).agg(F.count("*"), F.count_if(F.col(label_col) > 0)).first()
    if rows > MAX_LABELLED:
        raise ValueError(f"the labelled table has over {MAX_LABELLED} rows")
    host, path = host_and_path(F.col(url_col))
    # both labels weigh the same in all, however many rows each has
    weight = F.when(F.col(label_col) > 0, rows / 2 / max(1, blocked)).otherwise(rows / 2 / max(1, rows - blocked))
    data = labelled.select(ngrams(host, path).alias("_grams"), F.col(label_col).cast("double").alias("_label"), weight.alias("_weight"))
    hashing = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=features, binary=True)
    # one partition: the sums of the gradient then always add up in the same order
    regression = LogisticRegression(
        featuresCol="_features", labelCol="_label", weightCol="_weight", rawPredictionCol="_raw", probabilityCol="_probability", predictionCol="_prediction",
        regParam=0.002, maxIter=100, standardization=False,
    )
    return PipelineModel([hashing, regression.fit(hashing.transform(data.coalesce(1)))])


def fit_once(labelled: DataFrame, url_col: str = "url", label_col: str = "block", features: int = 1 << 16) -> PipelineModel:
    """``fit``, kept in the shared folder under a sum of the labelled table's hashes, so that a table is fitted once.

    Runs at the same time may fit it each; the first that is written is kept, and all are equal.
    """
    spark = labelled.sparkSession
    own = F.xxhash64(F.col(url_col), F.col(label_col), F.lit(features), F.lit(MODEL_VERSION))
    rows, total = labelled.agg(F.count("*"), F.coalesce(F.sum(own.cast("decimal(38,0)")), F.lit(0))).first()
    path = f"{shared_dir(spark)}/leafmill-url-model-{rows}-{total}"
    fresh = new_path(spark, "url-model")
    kept, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, fresh))
    files = kept.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(kept):
        fit(labelled, url_col, label_col, features).save(fresh)
        if not files.exists(kept):
            files.rename(new, kept)
    return PipelineModel.load(path)


def judge_urls(
    pages: DataFrame,
    model: PipelineModel,
    rules: Iterable[tuple[str, str]] | DataFrame = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    threshold: float = 0.5,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, block_probability.

    A rule decides where one fits (the longest wins, of equally long ones the first in alphabetical order), else the
    model: block from ``threshold`` on.  Rules are (verdict, host/path prefix); many may come as a table.
    A null url, or one without ``://``, has empty host and path and is judged by the model like any other;
    repeated rows give repeated results, null ids stay null; an empty table gives an empty one.  Urls are judged whole, of any length.
    """
    host, path = host_and_path(F.col("_url"))
    rows = picked(pages, page_id=id_col, _url=url_col).select("page_id", F.col("_url").cast("string").alias("_url")).select("page_id", host.alias("host"), path.alias("path"))
    if not isinstance(rules, DataFrame):
        rules = list(rules)
        if len(rules) > MAX_RULES:
            rules = pages.sparkSession.createDataFrame(rules, "verdict string, rule string")
    if isinstance(rules, DataFrame):
        rows = joined_rules(rows, rules)
    else:
        rows = rows.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    scored = model.transform(rows.withColumn("_grams", ngrams(F.col("host"), F.col("path"))))
    rule = F.col("_rule")
    probability = vector_to_array("_probability")[1]
    return scored.select(
        "page_id",
        "host",
        "path",
        rule["rule"].alias("rule"),
        F.coalesce(rule["verdict"], F.when(probability >= threshold, "block").otherwise("allow")).alias("verdict"),
        probability.alias("block_probability"),
    )


def labelled_hosts(words: Iterable[str], hosts: Iterable[str]) -> list[str]:
    """The hosts, and each word alone and with two tails."""
    n = len(TAILS)
    return [*hosts, *(host for i, w in enumerate(words) for host in (w, f"{w}-{TAILS[i % n]}", f"{TAILS[(i + 5) % n]}-{w}"))]


def made_up_names(n: int = NAMES, seed: int = 5) -> list[str]:
    rng = random.Random(seed)
    syllable = lambda: rng.choice(OPENING) + rng.choice(VOWELS) + rng.choice(CLOSING)
    return ["".join(syllable() for _ in range(rng.choice((2, 2, 3)))) for _ in range(n)]


def labelled_rows() -> list[tuple[int, str]]:
    """(block, url), the same at every site."""
    rows, rng = [], random.Random(7)
    for block, hosts in ((1, labelled_hosts(BLOCKED_WORDS, BLOCKED_HOSTS)), (0, labelled_hosts(ALLOWED_WORDS, ALLOWED_HOSTS)), (0, made_up_names())):
        for host in hosts:
            for k in range(ROWS_OF_HOST):
                style = block if k % 2 else 2
                rows.append((block, f"https://{rng.choice(SUBDOMAINS)}{host}.{rng.choice(ENDINGS[style])}{rng.choice(PATHS[style])}"))
    return rows


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), "block int, url string")
