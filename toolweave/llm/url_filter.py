"""URL filters: rules first, then empirical-Bayes host reputation.

Labelled outcomes of pages (bad or not) are counted by host, registered domain and suffix. Each level's rate of bad
pages is shrunk towards the level above by a beta-binomial prior whose strength is fitted to the spread of that level's
rates (method of moments). A page no rule covers is blocked when even the lower posterior bound of its host's rate, a
quantile of its beta distribution, lies above a limit. Hosts without outcomes inherit their domain's or suffix's posterior.
User part and port don't count for a host's reputation; a registered domain is one label more than its suffix, which has
two labels for the suffixes of a table; numeric addresses are domains of their own under one suffix.

Everything is a grouped count (pre-aggregated) and equi-joins of narrow rows; only a few sums per level, never hosts,
reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toolweave.llm.common import lower_ascii, table, without

# (verdict, rule): a rule is a host and the start of a path.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
LIMIT = 0.5
BOUND_SHARE = 0.05  # the bound is the quantile below which this share of the posterior lies
BOUND_STEPS = 512
# Suffixes of two labels under which names are registered; a fuller table is a parameter.
SECOND_LEVEL = ("ac.jp", "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn",
                "com.hk", "com.mx", "com.sg", "com.tr", "com.tw", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
NUMERIC = r"^([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+|\[.*\])$"
NUMERIC_SUFFIX = "#"
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0
OUTPUTS = ("host", "path", "rule", "verdict", "bad_rate", "bad_bound")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end; A-Z lower-cased; empty without ://."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """A host without user part, port and closing dot."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r"\.?(:[0-9]*)?$", "")


def suffix_of(name: Column, second_level=SECOND_LEVEL) -> Column:
    """The last label of a name, or the last two where these are in second_level; one suffix for all numeric addresses."""
    two = F.regexp_extract(name, r"([^.]+\.[^.]+)$", 1)
    return (F.when(name.rlike(NUMERIC), NUMERIC_SUFFIX).when(two.isin(*second_level) if second_level else F.lit(False), two)
            .otherwise(F.regexp_extract(name, r"([^.]*)$", 1)))


def domain_of(name: Column, second_level=SECOND_LEVEL) -> Column:
    """The suffix and the label before it; numeric addresses whole."""
    short, long = F.substring_index(name, ".", -2), F.substring_index(name, ".", -3)
    return F.when(name.rlike(NUMERIC), name).when(suffix_of(name, second_level).contains("."), long).otherwise(short)


def beta_lower(a, b, share: float = BOUND_SHARE, steps: int = BOUND_STEPS):
    """The quantile of Beta(a, b) below which the share lies, for numpy arrays of positive a and b.

    The density is integrated by trapezoids over the log odds, where it is smooth, eight deviations about its mode; what
    lies further down falls off as exp(a * log odds) and is added in closed form, likewise above.
    """
    import numpy as np

    a, b = np.asarray(a, float)[:, None], np.asarray(b, float)[:, None]
    mode, width = np.log(a / b), 8 * np.sqrt(1 / a + 1 / b)
    odds = mode + width * np.linspace(-1, 1, steps + 1)
    log = lambda u: a * u - (a + b) * np.logaddexp(0, u)
    density = np.exp(log(odds) - log(mode))
    step = 2 * width[:, 0] / steps
    low, high = density[:, 0] / a[:, 0], density[:, -1] / b[:, 0]
    below = low[:, None] + np.concatenate([np.zeros((len(a), 1)), np.cumsum((density[:, 1:] + density[:, :-1]) / 2 * step[:, None], axis=1)], axis=1)
    sought = share * (below[:, -1] + high)
    at = np.clip((below <= sought[:, None]).sum(axis=1) - 1, 0, steps - 1)
    row = np.arange(len(a))
    part = (sought - below[row, at]) / (below[row, at + 1] - below[row, at])
    found = odds[row, at] + np.clip(part, 0, 1) * step
    found = np.where(sought < low, odds[:, 0] + np.log(np.maximum(sought, 1e-300) / np.maximum(low, 1e-300)) / a[:, 0], found)
    return np.exp(-np.logaddexp(0, -found))


@F.arrow_udf(T.DoubleType())
def _bound(a, b):
    import pyarrow as pa

    return pa.array(beta_lower(a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False)))


def rule_and_verdict(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (of equal ones a blocking one, then by name), and its verdict; null if none fits."""
    rule = verdict = None
    for kind, text in sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if rule is None else (rule, verdict)


def _strength(counts: DataFrame) -> float:
    """The prior's weight in pages, from the spread of rates beyond what counting alone gives."""
    n, k = F.col("n"), F.col("k")
    r = counts.where(n > 0).agg(F.sum(n).alias("n"), F.sum(k).alias("k"), F.count("*").alias("m"), F.sum(k * k / n).alias("kk")).first()
    if not r["n"] or r["m"] < 2:
        return LEAST_STRENGTH
    rate = r["k"] / r["n"]
    noise = rate * (1 - rate)
    spread = (float(r["kk"]) - r["n"] * rate * rate - (r["m"] - 1) * noise) / max(1.0, r["n"] - r["m"])
    return MOST_STRENGTH if spread <= 0 else min(MOST_STRENGTH, max(LEAST_STRENGTH, noise / spread - 1))


def reputations(hosts: DataFrame, outcomes: DataFrame, second_level=SECOND_LEVEL) -> DataFrame:
    """hosts: distinct (host). outcomes: (host, bad boolean). Returns host, bad_rate and bad_bound.

    Joins are by name, domain and suffix with counts of one row a key; a key that most hosts share (com) is split by the
    session's adaptive skew handling, or met by broadcast where the counts are small.
    """
    levels = lambda df: df.withColumn("name", name_of(F.col("host"))).withColumns(
        {"domain": domain_of(F.col("name"), second_level), "suffix": suffix_of(F.col("name"), second_level)})
    by_host = outcomes.groupBy("host").agg(F.count("*").cast("double").alias("n"), F.count(F.when(F.col("bad"), 1)).cast("double").alias("k"))
    keyed = levels(by_host)
    counts = {key: keyed.groupBy(key).agg(F.sum("n").alias("n"), F.sum("k").alias("k")) for key in ("suffix", "domain", "name")}
    every = keyed.agg(F.sum("n"), F.sum("k")).first()
    n, k = float(every[0] or 0), float(every[1] or 0)
    prior = F.lit((k + 1) / (n + 2))
    rows = levels(hosts.select("host"))
    for key, seen in counts.items():
        strength = _strength(seen)
        rows = rows.join(seen.select(key, F.col("n").alias(f"n_{key}"), F.col("k").alias(f"k_{key}")), key, "left")
        a = F.coalesce(f"k_{key}", F.lit(0.0)) + strength * prior
        size = F.coalesce(f"n_{key}", F.lit(0.0)) + strength
        prior = a / size
    return rows.select("host", F.round(prior, 6).alias("bad_rate"), F.round(_bound(a, size - a), 6).alias("bad_bound"))


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, limit: float = LIMIT,
          second_level=SECOND_LEVEL) -> DataFrame:
    """pages with host, path, rule, verdict, bad_rate and bad_bound. outcomes: (id, bad), one or more for a page.

    A null url, or one without ://, has an empty host and path; such pages share one reputation. Outcomes of unknown
    pages or of null ids count nowhere; a repeated page counts once for each of its rows. Columns named like an output
    are replaced.
    """
    pages = without(pages, *(n for n in OUTPUTS if n != url_col))
    names = pages.columns
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    placed = pages.withColumns({"__host": host, "__path": path})
    seen = placed.select(F.col(id_col).cast("long").alias("id"), F.col("__host").alias("host"))
    known = seen.join(outcomes.select(F.col("id").cast("long").alias("id"), "bad").where("bad is not null"), "id")
    rated = reputations(seen.select("host").distinct(), known, second_level)
    met = placed.join(rated, placed["__host"] == rated["host"], "left")
    rule, verdict = rule_and_verdict(F.col("__host"), F.col("__path"), rules)
    method = F.when(F.col("bad_bound") > limit, "block").otherwise("allow")
    return met.select(
        *[placed[f"`{c}`"] for c in names], F.col("__host").alias("host"), F.col("__path").alias("path"),
        rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "bad_rate", "bad_bound",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), labels).select("page_id", "host", "path", "rule", "verdict")


def _level_sql(key: str, above: str) -> str:
    """SQL of one level: its counts, its strength and its posterior p over the keys of all hosts."""
    return f"""
{key}_counts AS (SELECT {key}, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k FROM counted GROUP BY {key}),
{key}_sums AS (SELECT sum(n) AS n, sum(k) AS k, count(*) AS m, sum(k * k / n) AS kk FROM {key}_counts),
{key}_fit AS (
  SELECT CASE WHEN n IS NULL OR n = 0 OR m < 2 THEN 1.0 WHEN spread <= 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0, noise / spread - 1)) END AS s
  FROM (SELECT n, m, k / n * (1 - k / n) AS noise, (kk - n * (k / n) * (k / n) - (m - 1) * (k / n) * (1 - k / n)) / greatest(1.0, n - m) AS spread FROM {key}_sums)),
{key}_level AS (
  SELECT h.*, (coalesce(c.k, 0) + f.s * {above}) / (coalesce(c.n, 0) + f.s) AS p_{key}, coalesce(c.n, 0) + f.s AS size_{key}
  FROM {"hosts" if key == "suffix" else "suffix_level" if key == "domain" else "domain_level"} h LEFT JOIN {key}_counts c USING ({key}) CROSS JOIN {key}_fit f)"""


ORACLE_SQL = rf"""
WITH placed AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
split AS (
  SELECT *, string_split(name, '.') AS parts, regexp_full_match(name, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+|\[.*\]') AS numeric
  FROM (SELECT *, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), '\.?(:[0-9]*)?$', '') AS name FROM placed)),
named AS (
  SELECT page_id, host, path, name, CASE WHEN numeric THEN name WHEN two THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain,
    CASE WHEN numeric THEN '#' WHEN two THEN array_to_string(parts[-2:], '.') ELSE parts[-1] END AS suffix
  FROM (SELECT *, array_to_string(parts[-2:], '.') IN {SECOND_LEVEL} AS two FROM split)),
hosts AS (SELECT DISTINCT host, name, domain, suffix FROM named),
counted AS (
  SELECT name, domain, suffix, count(*)::DOUBLE AS n, count(*) FILTER (WHERE quality = 0 OR toxic = 1)::DOUBLE AS k
  FROM named JOIN labels ON doc_id = page_id WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY ALL),
every AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS prior FROM counted),{_level_sql("suffix", "(SELECT prior FROM every)")},{_level_sql("domain", "h.p_suffix")},{_level_sql("name", "h.p_domain")},
shapes AS (
  SELECT a, b, abs(ln(a / b)) + 12 * sqrt(1 / a + 1 / b) + 30 / least(a, b) AS wide
  FROM (SELECT DISTINCT p_name * size_name AS a, (1 - p_name) * size_name AS b FROM name_level)),
points AS (SELECT a, b, i, wide * i / 8000 AS u FROM shapes, (SELECT unnest(range(-8000, 8001)) AS i)),
masses AS (
  SELECT a, b, i, exp(a * u - (a + b) * (greatest(u, 0) + ln(1 + exp(-abs(u)))) - a * ln(a / (a + b)) - b * ln(b / (a + b))) AS f FROM points),
below_half AS (SELECT a, b, sum(f * CASE WHEN i < 0 THEN 1 WHEN i = 0 THEN 0.5 ELSE 0 END) / sum(f) AS share FROM masses GROUP BY a, b),
bounds AS (SELECT host, share FROM name_level JOIN below_half ON a = p_name * size_name AND b = (1 - p_name) * size_name),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM placed)
SELECT page_id, r.host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN share < 0.05 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled r JOIN bounds USING (host)
"""
