"""URL filter by empirical-Bayes host reputation, in DataFrame functions only.

Labelled page outcomes (1 good, 0 bad) are counted by host. Rates are shrunk down a tree: the
suffix towards the whole, the registered domain towards its suffix, the host towards its
domain, each through a beta-binomial prior. A prior's mean is the parent's shrunk rate; its weight
comes from the children's spread by the method of moments (within PRIOR_WEIGHT). A host's posterior is a beta
distribution, and its pages are blocked if the CONFIDENCE quantile of that is under LEAST_GOOD times the rate of all labelled pages:
if the host is that much worse than the web at large, beyond doubt. A host without labels has its domain's prior, so it is
judged by its domain, suffix or the whole.

The quantile comes from the beta density on a fixed grid of 2 * GRID log odds around its mode, which reaches beyond all but e-20 of either
tail; sums of the density give the distribution function, and the quantile is interpolated. It is taken once for each distinct
posterior, of which hosts without labels have few.

Only (host, good, n) rows move: pages are pre-aggregated by host before the shuffle. The hosts' verdicts are joined
back with a plain equi-join, of which AQE broadcasts a small side by its measured size or
splits a hot host.

A registered domain is one label more than its public suffix, and a suffix is two labels where a generic label stands
before a country code or the name is a known hosting one, else one. User names, ports and a last dot don't count; an IP address is a
domain of its own under one suffix of all addresses.

Results in special cases: a null url or one without ``://`` has an empty host and path and is judged as the empty
host; null ids and null labels carry no evidence; several labels of one page all count; repeated pages each get
their row; without any label every verdict is the rules' or allow; columns other than those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (rule, host, path, verdict)
RULES = [("net/", "net", "/", "block"), ("example.net/en/", "example.net", "/en/", "allow"), ("example.com/de/", "example.com", "/de/", "block"), ("org/fr/", "org", "/fr/", "allow")]

#: Labels that make a suffix of two with a country code behind them, and names under which hosts are given away.
GENERIC = ["ac", "co", "com", "ed", "edu", "go", "gob", "gouv", "gov", "govt", "gv", "id", "info", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch"]
HOSTING = ["appspot.com", "blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "vercel.app", "web.app", "wordpress.com"]
ADDRESS = "(address)"

CONFIDENCE = 0.95
LEAST_GOOD = 0.75
#: Least and greatest weight of a prior, in pages.
PRIOR_WEIGHT = (2.0, 1000.0)
#: Points of the quantile's grid on either side of the mode.
GRID = 200

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BARE = r"^[^@]*@|:[0-9]*$"
_IS_ADDRESS = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$|^\["
_TWO = rf"(^|\.)({'|'.join(GENERIC)})\.[a-z]{{2}}$|(^|\.)({'|'.join(h.replace('.', '[.]') for h in HOSTING)})$"


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``."""
    part = lambda k: F.coalesce(F.regexp_extract(F.col(url_col), r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return pages.withColumn("host", F.translate(part(1), UPPER, LOWER)).withColumn("path", part(2))


def rule_column(rules: list[tuple[str, str, str, str]], answer: int):
    """The longest fitting rule's field ``answer``, else null."""
    out = None
    for rule in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        fits = ((F.col("host") == rule[1]) | F.col("host").endswith("." + rule[1])) & F.col("path").startswith(rule[2])
        out = F.when(fits, F.lit(rule[answer])) if out is None else out.when(fits, F.lit(rule[answer]))
    return F.lit(None).cast("string") if out is None else out


def bare(host: Column) -> Column:
    """A host without user name, port and last dot."""
    return F.regexp_replace(F.regexp_replace(host, _BARE, ""), r"\.$", "")


def suffix_of(host: Column) -> Column:
    """The public suffix of a bare host."""
    two = F.substring_index(host, ".", -2)
    return F.when(host.rlike(_IS_ADDRESS), F.lit(ADDRESS)).when(two.rlike(_TWO), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    """The registered domain of a bare host."""
    two = F.substring_index(host, ".", -2)
    return F.when(host.rlike(_IS_ADDRESS), host).when(two.rlike(_TWO), F.substring_index(host, ".", -3)).otherwise(two)


def weight(good: str, n: str, of: str, pages: str, children: str):
    """A prior's weight by the method of moments, from sums over the children: good, n, good^2/n, n^2, and their count."""
    some = F.nullif(F.col(n), F.lit(0.0))  # null without labels, and then the greatest weight
    p = F.col(good) / some
    spread = F.col(of) - some * p * p
    noise = p * (1 - p)
    less = some - F.col(pages) / some - (F.col(children) - 1)
    rho = F.when((noise > 0) & (less > 0), (spread - noise * (F.col(children) - 1)) / (noise * less))
    low, high = PRIOR_WEIGHT
    return F.when(rho > 0, F.greatest(F.lit(low), F.least(F.lit(high), 1 / rho - 1))).otherwise(F.lit(high))


def shrunk(good: str, n: str, mean, weight_):
    return (mean * weight_ + F.coalesce(F.col(good), F.lit(0))) / (weight_ + F.coalesce(F.col(n), F.lit(0)))


def beta_quantile(posteriors: DataFrame, q: float = CONFIDENCE) -> DataFrame:
    """Per row with ``a`` and ``b`` over 0: also ``quantile``, the ``q`` quantile of the beta distribution.

    In log odds t the density is e^(at) / (1 + e^t)^(a + b), with its mode at log(a / b). The grid goes
    down by 20 / a and up by 20 / b, where the tails fall as e^(at) and e^(-bt), and by six deviations more.
    """
    a, b = F.col("a"), F.col("b")
    sd = F.sqrt(1 / a + 1 / b)
    steps = posteriors.withColumn("mode_", F.log(a / b)).withColumn("down_", (6 * sd + 20 / a) / GRID).withColumn("up_", (6 * sd + 20 / b) / GRID)
    place = F.transform(F.sequence(F.lit(-GRID), F.lit(GRID)), lambda i: F.col("mode_") + i * F.when(i < 0, F.col("down_")).otherwise(F.col("up_")))
    level = lambda t: a * t - (a + b) * (F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t))))
    top = level(F.col("mode_"))
    points = steps.withColumn("t_", place).withColumn("f_", F.transform("t_", lambda t: F.exp(level(t) - top)))
    # the trapezoids between neighbouring points, and their running sum from the left
    cells = F.transform(F.sequence(F.lit(1), F.lit(2 * GRID)), lambda i: (F.get("f_", i - 1) + F.get("f_", i)) / 2 * F.when(i <= GRID, F.col("down_")).otherwise(F.col("up_")))
    summed = points.withColumn("cell_", cells).withColumn("all_", F.aggregate("cell_", F.lit(0.0), lambda s, x: s + x))
    # walking along: the sum so far, and the place where it passes q
    state = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("t"))
    wanted = q * F.col("all_")

    def walk(z: Column, x: Column) -> Column:
        i = z["i"] + 1
        left = F.get("t_", z["i"])
        here = left + (F.get("t_", i) - left) * (wanted - z["s"]) / x
        return F.struct(i.alias("i"), (z["s"] + x).alias("s"), F.coalesce(z["t"], F.when(z["s"] + x >= wanted, here)).alias("t"))

    at = F.aggregate("cell_", state, walk, lambda z: F.coalesce(z["t"], F.get("t_", F.lit(2 * GRID))))
    return summed.withColumn("quantile", 1 / (1 + F.exp(-at))).select(*posteriors.columns, "quantile")


def reputation(outcomes: DataFrame) -> DataFrame:
    """Per host of ``outcomes`` (host, good, n): ``posterior_mean``, ``posterior_upper`` (the CONFIDENCE quantile) and ``base_rate``, that of all labelled pages."""

    def sums(by: list[str], child: DataFrame) -> DataFrame:
        moment = lambda x: F.sum(F.when(F.col("n") > 0, x))
        out = child.groupBy(*by) if by else child.groupBy()
        return out.agg(F.sum("good").alias("good"), F.sum("n").alias("n"), moment(F.col("good") * F.col("good") / F.col("n")).alias("gg"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count(F.when(F.col("n") > 0, 1)).alias("k"))

    own = bare(F.col("host"))
    hosts = outcomes.select("host", domain_of(own).alias("domain"), suffix_of(own).alias("suffix"), "good", "n")
    domains = sums(["domain", "suffix"], hosts)
    suffixes = sums(["suffix"], domains.select("domain", "suffix", "good", "n"))
    # half a page of either outcome keeps the whole's rate within (0, 1); without labels it is high
    whole = sums([], suffixes.select("suffix", "good", "n")).select(
        F.when(F.col("n") > 0, (F.col("good") + 0.5) / (F.col("n") + 1)).otherwise(F.lit(0.99)).alias("base_rate"), F.coalesce(weight("good", "n", "gg", "nn", "k"), F.lit(PRIOR_WEIGHT[1])).alias("whole_weight")
    )
    # each level: its own shrunk rate, and the weight of the prior that it is for its children
    level = lambda name: [F.coalesce(weight("good", "n", "gg", "nn", "k"), F.lit(PRIOR_WEIGHT[1])).alias(f"{name}_weight")]
    suffixes = suffixes.join(F.broadcast(whole)).select("suffix", "base_rate", shrunk("good", "n", F.col("base_rate"), F.col("whole_weight")).alias("suffix_mean"), *level("suffix"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", "base_rate", shrunk("good", "n", F.col("suffix_mean"), F.col("suffix_weight")).alias("domain_mean"), *level("domain"))
    mean, weight_ = F.col("domain_mean"), F.col("domain_weight")
    judged = hosts.join(domains, ["domain", "suffix"]).select("host", "base_rate", (mean * weight_ + F.col("good")).alias("a"), ((1 - mean) * weight_ + F.col("n") - F.col("good")).alias("b"))
    bounds = beta_quantile(judged.select("a", "b").distinct())
    return judged.join(bounds, ["a", "b"]).select("host", (F.col("a") / (F.col("a") + F.col("b"))).alias("posterior_mean"), F.col("quantile").alias("posterior_upper"), "base_rate")


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list = RULES) -> DataFrame:
    """Per page: the id, ``host``, ``path``, ``rule``, ``verdict`` (allow or block), ``posterior_mean`` and ``posterior_upper`` of its host.

    ``outcomes`` has (id, ``good``): labelled pages, 1 good and 0 bad.
    """
    parts = with_parts(pages.select(id_col, url_col), url_col)
    known = outcomes.where(F.col("good").isNotNull()).groupBy(F.col(id_col).alias("labelled")).agg(F.sum("good").cast("double").alias("good"), F.count(F.lit(1)).cast("double").alias("n"))
    labelled = parts.join(known, F.col(id_col) == F.col("labelled"), "left")
    by_host = labelled.groupBy("host").agg(F.coalesce(F.sum("good"), F.lit(0.0)).alias("good"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"))
    verdicts = reputation(by_host)
    return (
        parts.select(id_col, "host", "path", rule_column(rules, 0).alias("rule"), rule_column(rules, 3).alias("ruled"))
        .join(verdicts, "host", "left")
        .select(
            id_col, "host", "path", "rule",
            F.coalesce("ruled", F.when(F.col("posterior_upper") < LEAST_GOOD * F.col("base_rate"), "block").otherwise("allow")).alias("verdict"),
            F.round("posterior_mean", 6).alias("posterior_mean"), F.round("posterior_upper", 6).alias("posterior_upper"),
        )
    )


def oracle(rules: list = RULES) -> str:
    """DuckDB SQL for the rows of ``judge`` over ``pages``, with ``labels.quality`` of the same number as the outcome."""
    whens = lambda k: " ".join(f"WHEN (host = '{r[1]}' OR host LIKE '%.{r[1]}') AND starts_with(path, '{r[2]}') THEN '{r[k]}'" for r in sorted(rules, key=lambda r: (-len(r[0]), r[0])))
    last = lambda n: f"array_to_string(list_slice(string_split(bare, '.'), -{n}, -1), '.')"
    address, two = f"regexp_matches(bare, '{_IS_ADDRESS}')", f"regexp_matches({last(2)}, '{_TWO}')"
    low, high = PRIOR_WEIGHT
    moments = "sum(good) AS good, sum(n) AS n, sum(CASE WHEN n > 0 THEN good * good / n END) AS gg, sum(n * n) AS nn, count(CASE WHEN n > 0 THEN 1 END) AS k"
    less, noise = "(n - nn / n - (k - 1))", "((good / n) * (1 - good / n))"
    rho = f"((gg - n * (good / n) * (good / n) - {noise} * (k - 1)) / ({noise} * {less}))"
    weight_ = f"(CASE WHEN n > 0 AND {noise} > 0 AND {less} > 0 AND {rho} > 0 THEN greatest({low}, least({high}, 1 / {rho} - 1)) ELSE {high} END)"
    level = "({a} * {t} - ({a} + {b}) * (greatest({t}, 0) + ln(1 + exp(-abs({t})))))"
    level, top = (level.format(a="a", b="b", t=t) for t in ("t", "mode"))
    return f"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
known AS (SELECT doc_id, sum(quality)::DOUBLE AS good, count(*)::DOUBLE AS n FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
counted AS (SELECT host, regexp_replace(regexp_replace(host, '{_BARE}', '', 'g'), '\\.$', '') AS bare, coalesce(sum(good), 0) AS good, coalesce(sum(n), 0) AS n FROM parts LEFT JOIN known ON page_id = doc_id GROUP BY host),
hosts AS (
  SELECT host, CASE WHEN {address} THEN bare WHEN {two} THEN {last(3)} ELSE {last(2)} END AS domain,
    CASE WHEN {address} THEN '{ADDRESS}' WHEN {two} THEN {last(2)} ELSE {last(1)} END AS suffix, good, n FROM counted),
d0 AS (SELECT domain, suffix, {moments} FROM hosts GROUP BY domain, suffix),
s0 AS (SELECT suffix, {moments} FROM d0 GROUP BY suffix),
w0 AS (SELECT {moments} FROM s0),
w AS (SELECT CASE WHEN n > 0 THEN (good + 0.5) / (n + 1) ELSE 0.99 END AS wm, {weight_} AS ww FROM w0),
s AS (SELECT suffix, (wm * ww + good) / (ww + n) AS sm, {weight_} AS sw FROM s0, w),
d AS (SELECT domain, suffix, (sm * sw + good) / (sw + n) AS dm, {weight_} AS dw FROM d0 JOIN s USING (suffix)),
h AS (SELECT host, dm * dw + good AS a, (1 - dm) * dw + n - good AS b FROM hosts JOIN d USING (domain, suffix)),
grid AS (SELECT DISTINCT a, b, i, ln(a / b) AS mode, ln(a / b) + i * (6 * sqrt(1 / a + 1 / b) + 20 / (CASE WHEN i < 0 THEN a ELSE b END)) / {GRID} AS t FROM h, range(-{GRID}, {GRID + 1}) r(i)),
density AS (SELECT a, b, i, t, exp({level} - {top}) AS f FROM grid),
cells AS (SELECT *, (f + lead(f) OVER o) / 2 * (lead(t) OVER o - t) AS x, lead(t) OVER o AS t2 FROM density WINDOW o AS (PARTITION BY a, b ORDER BY i)),
summed AS (SELECT *, sum(x) OVER (PARTITION BY a, b ORDER BY i) AS upto, sum(x) OVER (PARTITION BY a, b) AS total FROM cells WHERE x IS NOT NULL),
bound AS (SELECT a, b, 1 / (1 + exp(-arg_min(t + (t2 - t) * ({CONFIDENCE} * total - (upto - x)) / x, i))) AS u FROM summed WHERE upto >= {CONFIDENCE} * total GROUP BY a, b),
r AS (SELECT host, a / (a + b) AS m, u, wm FROM h JOIN bound USING (a, b), w)
SELECT page_id, host, path, CASE {whens(0)} END AS rule,
  coalesce(CASE {whens(3)} END, CASE WHEN u < {LEAST_GOOD} * wm THEN 'block' ELSE 'allow' END) AS verdict,
  round(m, 6) AS posterior_mean, round(u, 6) AS posterior_upper
FROM parts LEFT JOIN r USING (host)"""
