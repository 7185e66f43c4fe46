"""URL filters: rules by host and path, then logistic regression on character n-grams.

DataFrame functions only.  A rule fits its host, all subdomains and the paths
that begin with its path; the longest rule wins.  URLs without a rule are
judged by a logistic regression over hashed n-grams of host and path.  The
model is trained by full-batch gradient descent from a small labelled URL
table, in one SQL expression over that table's one aggregated row; its weights,
``DIMENSIONS`` numbers at any size of the corpus, come to the driver and go
into the scoring expression as a literal.  Scoring is a projection: no shuffle.

Defined results: null URLs and those without ``://`` have an empty host and
path, no rule, and are scored on the empty string (the model's bias);
repeated rows give repeated results; long URLs are scored whole; an empty table
gives no rows.  Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIMENSIONS = 1024
GRAMS = (3, 4, 5)
SCALE = 20.0
EPOCHS = 60
RATE = 2.0
MAX_LABELLED = 1000
MAX_RULES = 500

#: (action, host and path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

#: Names of hosts in the labelled table.  None of them is taken from a table that is judged.
_WANTED = (
    "city-news open-library garden-blog art-museum python-docs weather-report home-recipes history-wiki school-physics river-books travel-notes daily-science stadt-zeitung kinder-buch "
    "musik-schule garten-haus wetter-heute reise-bericht jardin-fleurs cuisine-maison livre-ouvert journal-ville histoire-art noticias-hoy cocina-casa libros-rio musica-viva viaje-mundo"
).split()
_UNWANTED = (
    "royal-casino grand-casino casino-online casinos-club poker-palace slots-jackpot jackpot-city bet-now best-bets sports-betting bets-online lucky-bets spam-mail spam-blast seo-spam link-farm content-farm "
    "farm-links discount-pills pills-shop diet-pills pharma-pills cheap-meds cheap-loans cheap-viagra ad-server ads-click popup-ads tracker-ads pixel-track click-track track-me adult-cams adult-chat adult-video "
    "xxx-adult win-prizes win-big free-money free-spins free-porn"
).split()
_SYLLABLES = "ba be di do fa fi ga go ke ki la lo ma mi na no pe po ra ri sa so ta te va vu wi ze".split()


def _made_up(n: int) -> list[str]:
    """Names without meaning, which are wanted: two to four syllables each."""
    k = len(_SYLLABLES)
    return ["".join(_SYLLABLES[(5 * i + 11 * j + i * j) % k] for j in range(2 + i % 3)) for i in range(n)]


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: (url, 1 if unwanted)."""
    rows = []
    zones = (("com", "en"), ("net", "de"), ("org", "fr"))
    for label, names in ((0, _WANTED + _made_up(42)), (1, _UNWANTED)):
        for i, name in enumerate(names):
            for j in range(2 + label):
                zone, lang = zones[(i + j) % 3]
                rows.append((f"http{'s' * (i % 2)}://{('', 'www.', 'm.', 'blog.')[(i + 2 * j) % 4]}{name}.example.{zone}/{lang}/{37 * (i + 1) * (j + 1)}{('', '/', '.html')[(i + j) % 3]}", label))
    return rows


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 2), F.lit(""))


def indices(host: Column, path: Column) -> Column:
    """The hashed n-grams of ``^host path$``, from 0."""
    text = F.concat(F.lit("^"), host, path, F.lit("$"))

    def grams(chars: Column, n: int) -> Column:
        last = F.size(chars) - n
        places = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
        return F.when(last >= 0, F.transform(places, lambda i: F.concat(*[F.get(chars, i + j) for j in range(n)]))).otherwise(F.array().cast("array<string>"))

    # The characters are cut once and bound to a name, so that long URLs take linear time.
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    every = F.flatten(F.transform(F.array(chars), lambda c: F.concat(*[grams(c, n) for n in GRAMS])))
    return F.transform(every, lambda g: F.conv(F.substring(F.md5(g.cast("binary")), 1, 4), 16, 10).cast("int") % DIMENSIONS)


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", epochs: int = EPOCHS, rate: float = RATE) -> list[float]:
    """Weights by n-gram index, the bias last.

    The table may have ``MAX_LABELLED`` rows at most; a larger one is an error
    rather than a sample.  Rows without a label are left out.
    """
    url = F.col(url_col)
    hot = labelled.select(indices(F.coalesce(host_of(url), F.lit("")), path_of(url)).alias("ix"), F.col(label_col).cast("double").alias("y")).where(F.col("y").isNotNull())
    if hot.limit(MAX_LABELLED + 1).count() > MAX_LABELLED:
        raise ValueError(f"the labelled table has over {MAX_LABELLED} rows")
    share = f"transform(sequence(0, {DIMENSIONS}), j -> IF(j = {DIMENSIONS}, 1D, {SCALE}D * size(filter(ix, i -> i = j)) / greatest(size(ix), 1)))"
    rows = hot.selectExpr("y", f"{share} AS x").agg(F.array_sort(F.collect_list(F.struct("y", "x"))).alias("rows"))
    zeros = f"array_repeat(0D, {DIMENSIONS + 1})"
    odds = "aggregate(zip_with(w, r.x, (a, b) -> a * b), 0D, (s, v) -> s + v)"
    residuals = f"transform(rows, r -> named_struct('x', r.x, 'd', 1D / (1D + exp(-{odds})) - r.y))"
    gradient = f"aggregate({residuals}, {zeros}, (s, r) -> zip_with(s, r.x, (a, b) -> a + r.d * b))"
    descent = f"aggregate(sequence(1, {epochs}), {zeros}, (w, t) -> zip_with(w, {gradient}, (a, g) -> a - {rate}D * g / size(rows)))"
    return list(rows.selectExpr(f"{descent} AS w").first()["w"])


def score(host: Column, path: Column, weights: Sequence[float]) -> Column:
    """Probability that a URL is unwanted."""
    w = F.split(F.lit(",".join(map(repr, weights[:DIMENSIONS]))), ",").cast("array<double>")
    ix = indices(host, path)
    total = F.aggregate(ix, F.lit(0.0), lambda s, i: s + F.get(w, i))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(weights[DIMENSIONS]) + SCALE * total / F.greatest(F.size(ix), F.lit(1)))))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """Host with path of the longest rule that fits, and its action; null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"over {MAX_RULES} rules")
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: len(r[1])):
        at = text.index("/") if "/" in text else len(text)
        own, start = text[:at], text[at:]
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and score of every URL."""
    spark: SparkSession = pages.sparkSession
    weights = train(spark.createDataFrame(labelled_urls(), "url string, label int") if labelled is None else labelled)
    named = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, action = matched_rule(F.col("host"), F.col("path"), rules)
    scored = named.select("page_id", "host", "path", rule.alias("rule"), action.alias("action"), score(F.col("host"), F.col("path"), weights).alias("score"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("action", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")


def oracle_weights(labelled: Sequence[tuple[str, int]], epochs: int = EPOCHS, rate: float = RATE) -> list[float]:
    """The same model, trained anew in plain Python for comparison."""
    import hashlib
    import re
    from collections import Counter

    rows = []
    for url, label in sorted(labelled):
        m = re.search(r"://([^/?#]*)([^?#]*)", url)
        t = "^" + (m[1].lower() + m[2] if m else "") + "$"
        ix = [int(hashlib.md5(t[i : i + n].encode()).hexdigest()[:4], 16) % DIMENSIONS for n in GRAMS for i in range(len(t) - n + 1)]
        rows.append(({k: SCALE * c / len(ix) for k, c in Counter(ix).items()}, label))
    w = [0.0] * (DIMENSIONS + 1)
    for _ in range(epochs):
        g = [0.0] * (DIMENSIONS + 1)
        for x, y in rows:
            d = 1 / (1 + math.exp(-(w[DIMENSIONS] + sum(w[k] * v for k, v in x.items())))) - y
            g[DIMENSIONS] += d
            for k, v in x.items():
                g[k] += d * v
        w = [a - rate * b / len(rows) for a, b in zip(w, g, strict=True)]
    return w


def oracle_sql() -> str:
    """DuckDB SQL of ``judge`` over ``pages``, with ``oracle_weights`` as constants."""
    w = oracle_weights(labelled_urls())
    case = lambda out: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{act if out else f'{h}/{p}'}'" for act, h, p in ((a, *r.split("/", 1)) for a, r in sorted(RULES, key=lambda r: -len(r[1])))) + " END"
    grams = " UNION ALL ".join(f"SELECT t, unnest(list_transform(range(1, length(t) - {n - 1} + 1), lambda i: substr(t, i, {n}))) AS g FROM (SELECT DISTINCT t FROM u)" for n in GRAMS)
    return f"""
WITH w AS (SELECT unnest(range(0, {DIMENSIONS})) AS k, unnest([{', '.join(map(repr, w[:DIMENSIONS]))}]::DOUBLE[]) AS v),
u AS (SELECT page_id, host, path, '^' || host || path || '$' AS t FROM (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages)),
grams AS ({grams}),
odds AS (SELECT t, {w[DIMENSIONS]!r} + {SCALE} * SUM(v) / COUNT(*) AS z FROM (
  SELECT t, CAST('0x' || substr(md5(g), 1, 4) AS BIGINT) % {DIMENSIONS} AS k FROM grams) JOIN w USING (k) GROUP BY t)
SELECT u.page_id, host, path, {case(0)} AS rule,
       coalesce({case(1)}, CASE WHEN coalesce(z, {w[DIMENSIONS]!r}) >= 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN odds ON u.t = odds.t
"""
