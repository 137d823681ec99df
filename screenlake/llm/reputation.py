"""URL filters: empirical-Bayes reputation of hosts from labelled pages.

Outcomes of labelled pages (1 good, 0 bad) are binomial within a host. The good rate of a host has a beta prior around
that of its registered domain, a domain's around that of its public suffix, a suffix's around that of all pages. How
closely the units of a level follow their parents (the beta-binomial intra-class correlation ``rho``, of which the
prior's strength is ``1 / rho - 1`` pages) is estimated by moments over all units of the level, and is the largest where no unit has two
labelled pages. So a host of many
labelled pages is judged by these, one of few by its domain, and one of none wholly by it. A page is rejected if even
the upper posterior bound of its host, mean plus ``z`` posterior standard deviations, is under ``least``.

Everything but the URL patterns is sums by host, domain and suffix: pages are combined before they are shuffled, and
what comes back to each page is one row for its host.

Defined results: a null URL, or one without a host, is kept, with nulls for all else; an outcome other than 0 and 1, or
of an unknown page, doesn't count; a page with several outcome rows is good if all of them say so; rows that repeat a
page each count and each get a row; addresses in digits are their own domain under the suffix ``''``; without any
outcomes all rates are one half and everything is kept; ids are of any type, and a page without one has no outcome; a very
long URL is one like any other; other columns, whatever they are called, are ignored by ``score`` and kept by ``keep``; an
empty table gives no rows. Public suffixes are those of ``rules``, for which a newer or fuller list can be given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenlake.llm.ids import named
from screenlake.llm.storage import staged

LEAST, Z = 0.75, 1.645
RHO_MIN, RHO_MAX = 0.001, 0.9
#: Public suffixes in the notation of the public list: ``*`` stands for any one label, ``!`` excepts a domain. A suffix that no
#: rule names is the last label.
RULES = """
co.uk org.uk ac.uk gov.uk me.uk ltd.uk plc.uk net.uk sch.uk nhs.uk police.uk com.au net.au org.au edu.au gov.au asn.au id.au co.nz org.nz net.nz ac.nz
govt.nz school.nz geek.nz co.jp or.jp ne.jp ac.jp ad.jp ed.jp go.jp gr.jp lg.jp co.kr or.kr ne.kr re.kr pe.kr go.kr ac.kr com.br org.br net.br gov.br
edu.br com.mx org.mx net.mx gob.mx edu.mx com.ar org.ar net.ar gob.ar edu.ar com.tr org.tr net.tr gov.tr edu.tr com.cn net.cn org.cn gov.cn edu.cn ac.cn
com.tw org.tw net.tw gov.tw edu.tw idv.tw com.hk org.hk net.hk gov.hk edu.hk idv.hk com.sg org.sg net.sg gov.sg edu.sg co.in org.in net.in gov.in ac.in
edu.in res.in gen.in firm.in ind.in nic.in co.za org.za net.za gov.za ac.za web.za co.il org.il net.il gov.il ac.il muni.il com.ua org.ua net.ua gov.ua
edu.ua kiev.ua com.pl org.pl net.pl gov.pl edu.pl info.pl co.th or.th in.th go.th ac.th net.th com.my org.my net.my gov.my edu.my com.ph org.ph net.ph
gov.ph edu.ph com.vn org.vn net.vn gov.vn edu.vn co.id or.id go.id ac.id web.id sch.id com.pk org.pk net.pk gov.pk edu.pk com.bd org.bd net.bd com.sa
org.sa gov.sa edu.sa co.ae org.ae gov.ae ac.ae com.eg org.eg gov.eg edu.eg com.ng org.ng gov.ng edu.ng co.ke or.ke go.ke ac.ke com.gh org.gh co.tz co.ug
com.co org.co net.co gov.co edu.co com.pe org.pe gob.pe edu.pe com.ve org.ve gob.ve com.ec org.ec gob.ec com.uy org.uy gub.uy com.py com.bo com.gt com.do
co.cr or.cr com.pa com.cu com.es org.es nom.es gob.es edu.es com.pt org.pt gov.pt edu.pt com.gr org.gr gov.gr edu.gr com.ro org.ro co.at or.at ac.at gv.at
co.hu org.hu com.ru org.ru net.ru msk.ru spb.ru com.by com.kz org.kz com.ge co.rs org.rs ac.rs gov.rs com.hr com.mt org.mt com.cy ac.be gouv.fr asso.fr
com.fr tm.fr gov.it edu.it co.it github.io gitlab.io blogspot.com herokuapp.com netlify.app vercel.app pages.dev web.app firebaseapp.com appspot.com
wordpress.com azurewebsites.net cloudfront.net s3.amazonaws.com
*.ck !www.ck *.er *.fk *.jm *.kh *.mm *.np *.pg *.bn *.kawasaki.jp !city.kawasaki.jp *.kobe.jp !city.kobe.jp *.nagoya.jp !city.nagoya.jp *.sapporo.jp
!city.sapporo.jp *.sendai.jp !city.sendai.jp *.yokohama.jp !city.yokohama.jp *.kitakyushu.jp !city.kitakyushu.jp *.compute.amazonaws.com
"""
_HOST = r"(?i)^\s*(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#\s]*)"
_ADDRESS = r"^(\[.*|[0-9]+(\.[0-9]+){3})$"


def host_of(url: Column) -> Column:
    """The host in lower case without user, port and final dot; null where there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.+$", "")
    return F.when(host != "", host)


def split_rules(rules: str) -> tuple[list[str], list[str], list[str]]:
    """(suffixes, what a wildcard stands before, excepted domains) of rules; ``//`` begins a comment."""
    words = [w.lower() for line in rules.splitlines() for w in line.split("//")[0].split()]
    return [w for w in words if w[0] not in "*!"], [w[2:] for w in words if w[:2] == "*."], [w[1:] for w in words if w[0] == "!"]


def suffix_of(host: Column, rules: str = RULES) -> Column:
    """The longest public suffix that a rule names, the last label if none does; an exception ends one label after its first."""
    plain, wild, but = split_rules(rules)
    depth = max(map(lambda w: w.count(".") + 2, [*plain, *wild, *but]), default=1)
    last = lambda n: F.substring_index(host, ".", -n)
    labels = F.size(F.split(host, r"\."))
    out = F.when(host.rlike(_ADDRESS), "")
    for n in range(depth, 1, -1):
        out = out.when((labels >= n) & last(n).isin(but), last(n - 1))
    for n in range(depth, 1, -1):
        out = out.when((labels >= n) & (last(n).isin(plain) | last(n - 1).isin(wild)), last(n))
    return out.otherwise(last(1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The registered domain: one label more than the suffix; a host that is a suffix is its own."""
    parts = F.size(F.split(suffix, r"\."))
    return F.when(host.rlike(_ADDRESS), host).otherwise(F.array_join(F.slice(F.split(host, r"\."), F.greatest(F.lit(1), F.size(F.split(host, r"\.")) - parts), parts + 1), "."))


def _level(units: DataFrame, name: str, prior: str) -> DataFrame:
    """``units`` (n, good, the prior mean) with the posterior mean and its variance as ``mean_<name>`` and ``var_<name>``."""
    n, good, mean = F.col("n"), F.col("good"), F.col(prior)
    spread = F.pow(good - n * mean, F.lit(2.0)) - n * mean * (1 - mean)
    pairs = n * (n - 1) * mean * (1 - mean)
    rho = units.agg((F.sum(spread) / F.when(F.sum(pairs) > 0, F.sum(pairs))).alias("r")).select(F.greatest(F.lit(RHO_MIN), F.least(F.lit(RHO_MAX), F.round(F.coalesce("r", F.lit(RHO_MAX)), 9))).alias("r"))
    m = 1 / F.col("r") - 1
    a, b = m * mean + good, m * (1 - mean) + n - good
    units = units.withColumn("r", rho.scalar())
    return units.withColumn(f"mean_{name}", a / (a + b)).withColumn(f"var_{name}", a * b / ((a + b) * (a + b) * (a + b + 1))).drop("r")


def hosts(pages: DataFrame, outcomes: DataFrame, rules: str = RULES) -> DataFrame:
    """(host, domain, suffix, n, good, mean, deviation) of every host of ``pages``. ``outcomes``: (page_id, good)."""
    told = outcomes.where("page_id IS NOT NULL AND good IN (0, 1)").groupBy("page_id").agg(F.min(F.col("good").cast("int")).alias("good"))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host")).where("host IS NOT NULL")
    told = rows.join(told, "page_id").groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    own = rows.select("host").distinct().withColumn("suffix", suffix_of(F.col("host"), rules)).join(told, "host", "left").select("host", domain_of(F.col("host"), F.col("suffix")).alias("domain"), "suffix", F.coalesce("n", F.lit(0)).cast("double").alias("n"), F.coalesce("good", F.lit(0)).cast("double").alias("good"))
    own = staged(own, "hosts")  # the levels above read it again and again
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains = own.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    every = suffixes.agg(((F.coalesce(F.sum("good"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 2)).alias("mean_all"))
    suffixes = _level(suffixes.withColumn("mean_all", every.scalar()), "suffix", "mean_all")
    domains = staged(_level(domains.join(suffixes.select("suffix", "mean_suffix"), "suffix"), "domain", "mean_suffix").select("domain", "mean_domain"), "domains")
    got = _level(own.join(domains, "domain"), "host", "mean_domain")
    return got.select("host", "domain", "suffix", F.col("n").cast("long").alias("n"), F.col("good").cast("long").alias("good"), F.col("mean_host").alias("mean"), F.sqrt("var_host").alias("deviation"))


def score(pages: DataFrame, outcomes: DataFrame, *, least: float = LEAST, z: float = Z, rules: str = RULES) -> DataFrame:
    """(page_id, host, domain, suffix, n, good, mean, bound, keep) for every row of ``pages``."""
    bound = F.least(F.lit(1.0), F.round(F.col("mean") + z * F.col("deviation"), 6))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host")).join(hosts(pages, outcomes, rules), "host", "left")
    return rows.select("page_id", "host", "domain", "suffix", "n", "good", F.round("mean", 6).alias("mean"), bound.alias("bound"), F.coalesce(bound >= least, F.lit(True)).alias("keep"))


def keep(pages: DataFrame, outcomes: DataFrame, *, least: float = LEAST, z: float = Z, rules: str = RULES) -> DataFrame:
    """``pages`` without those of rejected hosts, all columns as they were."""
    names = [f"__{i}" for i in range(len(pages.columns))]  # whatever the columns are called
    bad = hosts(pages, outcomes, rules).where(F.round(F.col("mean") + z * F.col("deviation"), 6) < least).select(F.col("host").alias("__host"))
    rows = pages.select(*(named(c).alias(n) for c, n in zip(pages.columns, names)))
    kept = rows.join(bad, host_of(F.col(names[pages.columns.index("url")])) == F.col("__host"), "left_anti")
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names, pages.columns)))


ORACLE_SQL = rf"""
WITH told AS (SELECT doc_id AS page_id, min(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY 1),
named AS (SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#\s]*)', 1)), '\.+$', ''), '') AS host FROM pages),
hosts AS (SELECT host, count(good) AS n, coalesce(sum(good), 0) AS good, string_split(host, '.') AS parts
          FROM named LEFT JOIN told USING (page_id) WHERE host IS NOT NULL GROUP BY host),
rules AS (SELECT unnest(regexp_split_to_array(trim('{" ".join(RULES.split())}'), ' +')) AS rule),
cand AS (SELECT host, parts, n, unnest(range(1, len(parts) + 1)) AS k FROM hosts),
hit AS (SELECT host, max(CASE WHEN rule[1] = '!' THEN 1000 + k - 1 ELSE k END) AS best
        FROM cand JOIN rules ON rule = array_to_string(parts[-k:], '.') OR rule = '!' || array_to_string(parts[-k:], '.')
                             OR (k > 1 AND rule = '*.' || array_to_string(parts[-(k - 1):], '.')) GROUP BY host),
sized AS (SELECT hosts.*, CASE WHEN best >= 1000 THEN best - 1000 ELSE coalesce(best, 1) END AS k FROM hosts LEFT JOIN hit USING (host)),
own AS (SELECT host, n, good,
          CASE WHEN regexp_matches(host, '{_ADDRESS}') THEN host ELSE array_to_string(parts[-(k + 1):], '.') END AS domain,
          CASE WHEN regexp_matches(host, '{_ADDRESS}') THEN '' ELSE array_to_string(parts[-k:], '.') END AS suffix FROM sized),
d0 AS (SELECT domain, suffix, sum(n)::DOUBLE AS n, sum(good)::DOUBLE AS good FROM own GROUP BY ALL),
s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d0 GROUP BY ALL),
s1 AS (SELECT *, (SELECT (sum(good) + 1) / (sum(n) + 2) FROM s0) AS p FROM s0),
sr AS (SELECT greatest({RHO_MIN}, least({RHO_MAX}, round(coalesce(sum((good - n * p) ** 2 - n * p * (1 - p)) / nullif(sum(n * (n - 1) * p * (1 - p)), 0), {RHO_MAX}), 9))) AS r FROM s1),
s2 AS (SELECT suffix, ((1 / r - 1) * p + good) / ((1 / r - 1) + n) AS p FROM s1, sr),
d1 AS (SELECT d0.*, p FROM d0 JOIN s2 USING (suffix)),
dr AS (SELECT greatest({RHO_MIN}, least({RHO_MAX}, round(coalesce(sum((good - n * p) ** 2 - n * p * (1 - p)) / nullif(sum(n * (n - 1) * p * (1 - p)), 0), {RHO_MAX}), 9))) AS r FROM d1),
d2 AS (SELECT domain, ((1 / r - 1) * p + good) / ((1 / r - 1) + n) AS p FROM d1, dr),
h1 AS (SELECT own.*, p FROM own JOIN d2 USING (domain)),
hr AS (SELECT greatest({RHO_MIN}, least({RHO_MAX}, round(coalesce(sum((good - n * p) ** 2 - n * p * (1 - p)) / nullif(sum(n * (n - 1) * p * (1 - p)), 0), {RHO_MAX}), 9))) AS r FROM h1),
h2 AS (SELECT *, (1 / r - 1) * p + good AS a, (1 / r - 1) * (1 - p) + n - good AS b FROM h1, hr),
h3 AS (SELECT *, a / (a + b) AS mean, sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS deviation FROM h2)
SELECT page_id, host, domain, suffix, n::BIGINT AS n, good::BIGINT AS good, round(mean, 6) AS mean,
       CASE WHEN mean IS NOT NULL THEN least(1.0, round(mean + {Z} * deviation, 6)) END AS bound,
       coalesce(round(mean + {Z} * deviation, 6) >= {LEAST}, true) AS keep
FROM named LEFT JOIN h3 USING (host)
"""
