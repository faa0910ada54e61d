"""URL filters: host and path rules, and a logistic regression on hashed character n-grams."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hash buckets, n-gram lengths, and labelled rows used at most (smallest hashes of their urls).
BUCKETS, NGRAMS, LABELLED_ROWS = 1 << 16, (3, 4), 20_000
#: Weight of a url to allow against one to block: hosts to allow are more, and more unlike one another.
GOOD_WEIGHT = 2.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules of the registered query: (verdict, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: A small table to start from: names of hosts to block and to allow, made up; none is a host of the test tables.
BLOCKED = """
cheap-meds discount-pills pills-online buy-viagra pharmacy-deals diet-pills pill-outlet generic-cialis canada-pharmacy
cheap-drugs no-prescription meds24 pillstore cheapest-watches replica-bags cheap-loans payday-cash fast-loans
cheap-insurance-quotes outlet-sale royal-casino casino-bonus vegas-casino lucky-slots slots-jackpot jackpot-winner
poker-bonus online-roulette winbig you-win-prize win-iphone lottery-winner casinos-online spin-and-win sports-bets
bet-bonus best-bets betting-odds bets-today free-spins free-gifts free-iphone free-money get-it-free free-movies-hd
freedownload free-ringtones earn-cash work-from-home-cash bitcoin-doubler seo-links linkfarm link-farms farm-of-links
spam-links spamblog buy-backlinks article-spam spam-network content-farm farmville-cheats hack-coins keygen-crack
crack-download flash-update-virus malware-setup codec-install phishing-login verify-account secure-paypal-login
ads-server adserver banner-ads popup-ads ads-network click-tracker track-pixel pixel-track adclick tracking-cdn
xxx-videos adult-dating adult-cams adult-tube porn-clips sexchat hot-adult nude-cams x-rated escorts-adult
""".split()
ALLOWED = """
library museum weather history garden recipes mountain river theatre orchestra school university science physics travel
kitchen council station archive gallery heritage county railway harbor lighthouse village parish market bakery carpenter
potter weaver daily-letter old-town north-lake river-stones open-harvest stone-bridge third-page tiny-observatory
plain-reader county-clinic ring-road wood-turners tide-tables bird-watch sheep-wool hand-clay thin-ice leading-edge
common-ground blue-hour nation lantern thorn anthem heather leather feather weather-station gather wander thunder theory
thistle other-shore whistle wheel wheat white-cliff whale-song orchard corner order harbor-lights forest fortune forum
for-teachers reading rereading return restoration resin reed-bed heron here-there herring hearth handwork hanover
hall-and-stairs erosion errand estuary eastern sting-ray sterling stone stones-and-shells ribbon table noble-houses
able-seaman cable-cars blessing tonal-music onion only-reading lyric lynx anderson andante sand-and-sea land-records
ending index inland inland-waters intaglio nettle entropy entry-hall parents-evening outing our-streets house-of-letters
hourglass sheriff shed shoreline atlas attic nature translation motion notions fiction lotion-makers station-master
tionesta education relation patience ratio tide tidal-pool edition
""".split()
#: Words that make further names to block, one of each with one of the other.
FIRSTS = "cheap discount free best online buy fast hot lucky royal mega live sports ads banner popup click track spam link seo content adult xxx".split()
SECONDS = "pills meds pharmacy viagra casino slots poker jackpot bets betting odds win bonus prize loans cash ads tracker pixel server links farm spam network cams videos dating x".split()
#: Names of either kind stand in the same frames, so that frames tell nothing about the kind.
FRONTS, DOMAINS, PATHS = ("", "www.", "blog.", "m."), ("example.com", "example.net", "example.org"), ("/en/%d", "/fr/%d.html", "/de/%d/", "/es/%d?page=2", "/")
PER_NAME = 2


def seed_names() -> tuple[list[str], list[str]]:
    """Names to block: those above, and every third pair of words; as many to allow: those above, and pairs of them."""
    bad = BLOCKED + [f"{a}-{b}" for i, a in enumerate(FIRSTS) for j, b in enumerate(SECONDS) if (i + j) % 3 == 2 and a != b]
    n = len(ALLOWED)
    pairs = ((ALLOWED[i], ALLOWED[(i * 7 + k * 31) % n]) for k in (1, 2) for i in range(n))
    good = ALLOWED + [f"{a}-{b}" for a, b in pairs if "-" not in a + b and a != b]
    return list(dict.fromkeys(bad)), list(dict.fromkeys(good))


def seed_table(spark: SparkSession) -> DataFrame:
    """``url, label`` (1: block): each name in PER_NAME frames, dealt in turn."""
    rows = []
    for label, names in zip((1.0, 0.0), seed_names()):
        for n, name in enumerate(names):
            for k in range(n, n + 7 * PER_NAME, 7):
                path = PATHS[k % 5]
                rows.append((f"http://{FRONTS[k % 4]}{name}.{DOMAINS[k % 3]}{path % (7 * k) if '%' in path else path}", label))
    return spark.createDataFrame(rows, "url string, label double")


def host_of(url: F.Column) -> F.Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: F.Column) -> F.Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: F.Column, path: F.Column, rules: list[tuple[str, str, str]]) -> F.Column:
    """Struct ``verdict, rule`` of the longest rule that fits, or null.

    A rule fits its host and all subdomains if the path starts with the rule's. The rule list is a
    parameter that travels with the query, not a table: a few hundred entries at most.
    """
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(found)
    return found


def ngrams(text: F.Column, mark: str, sizes: tuple[int, ...] = NGRAMS) -> F.Column:
    """All character n-grams of ``^text$``, each marked with the part of the url that it is from; in time linear in the text.

    The text is parted once; characters that stand n places on are joined by place.
    """
    chars = F.filter(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: c != "")

    def of(n: int) -> F.Column:
        shifted = [F.slice(chars, k + 1, F.greatest(F.size(chars) - (n - 1), F.lit(0))) for k in range(n)]
        return F.transform(F.arrays_zip(*[c.alias(f"c{k}") for k, c in enumerate(shifted)]), lambda z: F.concat(F.lit(mark), *[z[f"c{k}"] for k in range(n)]))

    return F.concat(*[of(n) for n in sizes])


def _grams(df: DataFrame, url: str) -> DataFrame:
    # digits say nothing about a url but its number
    plain = F.regexp_replace(F.concat(host_of(F.col(url)), F.lit("\t"), path_of(F.col(url))), "[0-9]+", "0")
    return df.withColumn("_grams", F.concat(ngrams(F.substring_index(plain, "\t", 1), "h"), ngrams(F.substring_index(plain, "\t", -1), "p")))


class UrlModel:
    """Hashed n-grams under a logistic regression, trained on Spark."""

    def __init__(self, labelled: DataFrame, buckets: int = BUCKETS, rows: int = LABELLED_ROWS):
        known = labelled.where("url is not null and label is not null").select("url", F.col("label").cast("double").alias("label"))
        known = known.withColumn("_w", F.when(F.col("label") > 0, 1.0).otherwise(F.lit(GOOD_WEIGHT)))
        drawn = _grams(known.orderBy(F.xxhash64("url"), "url").limit(rows), "url")
        self.tf = HashingTF(numFeatures=buckets, inputCol="_grams", outputCol="_tf", binary=True)
        self.model: LogisticRegressionModel = LogisticRegression(featuresCol="_tf", labelCol="label", weightCol="_w", predictionCol="_p", probabilityCol="_prob", rawPredictionCol="_raw", regParam=0.004, maxIter=80).fit(self.tf.transform(drawn))

    def score(self, df: DataFrame, url: str) -> DataFrame:
        """Adds ``_p``: 1.0 for urls to block."""
        return self.model.transform(self.tf.transform(_grams(df, url)))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id, host, path, rule, verdict`` of every row; no shuffle of ``pages``.

    The longest fitting rule decides, else the model. A null url, or one without ``://``, has empty
    host and path, fits no rule, and has no n-gram: as nothing speaks against it, it is allowed.
    Without rules the model judges all. Null and repeated ids keep their rows; an empty table stays
    empty; a url is used whole, however long.
    """
    model = UrlModel(seed_table(pages.sparkSession) if labelled is None else labelled)
    rows = pages.select(F.col(id_col).alias("_id"), F.coalesce(F.col(url_col), F.lit("")).alias("_url"))
    rows = rows.withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url")))
    rows = rows.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    return model.score(rows, "_url").select(
        F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when((F.col("_p") > 0.5) & (F.length("host") > 0), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )
