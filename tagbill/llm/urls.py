"""URL filters: host and path rules, and gradient-boosted trees for what no rule fits.

Labelled URLs are those that a rule decides. Spark's own gradient-boosted trees learn
from lexical features of a bounded sample of them: lengths, depth, digit and punctuation
ratios, character entropy, parameter counts, and statistics of the host's suffix and of
the first path segment (pages seen, share blocked among labelled ones). Suffix
statistics cover all pages; they are hashed to ``buckets`` cells, so the table that
comes back is of fixed size whatever the hosts. Everything is a DataFrame expression.

A rule names a host, which stands for its subdomains too, and the beginning of a path.
The longest rule that fits wins.

Defined results. Null url or one without '://': empty host and path, no rule, the
model's verdict on them. Without labelled URLs of both kinds the model gives the only
kind there is, or allow. Repeated rows are judged alike. A null page_id stays null.
Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagbill.llm.common import bounded_sample, cut, prepare


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the contract.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


@dataclass(frozen=True)
class Params:
    #: Bound of the labelled URLs the trees learn from.
    max_examples: int = 50_000
    buckets: int = 256
    trees: int = 20
    depth: int = 4


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty without '://'."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, "(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    # A-Z only
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, or nulls."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):             # the longest is looked at first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, F.lit(r.name)).otherwise(name)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def _count(text: Column, piece: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))) / F.lit(len(piece))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _entropy(text: Column) -> Column:
    """Bits a character over letters, digits and the marks of host names; others count as one."""
    n = F.length(text)
    known = [_count(text, c) for c in string.ascii_lowercase + string.digits + "-._"]
    total = known[0]
    for c in known[1:]:
        total = total + c
    h = F.lit(0.0)
    for c in [*known, n - total]:
        share = _ratio(c, n)
        h = h - F.when(share > 0, share * F.log2(share)).otherwise(F.lit(0.0))
    return h


LEXICAL = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio",
           "hyphens", "entropy", "parameters", "query_length", "has_fragment", "secure")


def lexical(url: Column, host: Column, path: Column) -> list[Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    query = F.regexp_extract(url, "(?s)\\?([^#]*)", 1)
    digits = lambda t: F.length(t) - F.length(F.regexp_replace(t, "[0-9]", ""))
    columns = (F.length(url), F.length(host), F.length(path), _count(path, "/"), _count(host, "."),
               _ratio(digits(url), F.length(url)), _ratio(digits(host), F.length(host)), _count(host, "-"),
               _entropy(host), F.when(query == "", F.lit(0)).otherwise(_count(query, "&") + 1), F.length(query),
               F.contains(url, F.lit("#")).cast("int"), F.startswith(F.lower(url), F.lit("https:")).cast("int"))
    return [c.cast("double").alias(n) for n, c in zip(LEXICAL, columns)]


def _bucket(text: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(buckets)).cast("int")


def _statistics(rows: DataFrame, bucket: str, buckets: int) -> tuple[Column, Column]:
    """(log of pages seen, smoothed share blocked) of a row's bucket, over all pages."""
    seen = rows.groupBy(bucket).agg(F.count("*").alias("n"), F.count("y").alias("labelled"),
                                    F.coalesce(F.sum("y"), F.lit(0)).alias("blocked")).collect()   # at most `buckets` rows
    blocked, labelled = sum(r.blocked for r in seen), sum(r.labelled for r in seen)
    prior = blocked / labelled if labelled else 0.5
    pages, share = [0.0] * buckets, [prior] * buckets
    for r in seen:
        pages[r[bucket]] = float(r.n)
        share[r[bucket]] = (r.blocked + 10 * prior) / (r.labelled + 10)
    array = lambda v: F.array(*[F.lit(float(x)) for x in v])
    return F.log1p(F.get(array(pages), F.col(bucket))), F.get(array(share), F.col(bucket))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, p: Params = Params()) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) for every row of ``pages``."""
    prepare(pages.sparkSession)
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"),
                       *lexical(F.col("url"), F.col("host"), F.col("path")),
                       _bucket(F.substring_index("host", ".", -1), p.buckets).alias("suffix"),
                       _bucket(F.get(F.split("path", "/"), F.lit(1)), p.buckets).alias("head"))
    rows = cut(rows.withColumn("row", F.xxhash64("page_id", "host", "path")).withColumn("y", F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("double"))))
    stats = [*_statistics(rows, "suffix", p.buckets), *_statistics(rows, "head", p.buckets)]
    extra = ["suffix_pages", "suffix_blocked", "head_pages", "head_blocked"]
    full = rows.select("*", *[c.alias(n) for n, c in zip(extra, stats)])
    ready = VectorAssembler(inputCols=[*LEXICAL, *extra], outputCol="features").transform(full)
    labelled = rows.filter("y is not null")
    kinds = sorted(r.y for r in labelled.select("y").distinct().collect())
    if len(kinds) < 2:
        scored = rows.withColumn("block_score", F.lit(kinds[0] if kinds else 0.0))
    else:
        sample = bounded_sample(ready.filter("y is not null"), "row", p.max_examples, 7)
        model = GBTClassifier(labelCol="y", featuresCol="features", maxIter=p.trees, maxDepth=p.depth, seed=17,
                              stepSize=0.3).fit(sample)
        scored = model.transform(ready).withColumn("block_score", vector_to_array("probability")[1])
    by_model = F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "block_score")
