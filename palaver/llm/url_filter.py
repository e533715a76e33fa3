"""URL filters: listed rules first, gradient-boosted trees on lexical features for the rest.

DataFrame functions and the tree learner of Spark's own ML library only.  The
trees learn from the URLs that a rule decides.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palaver.plans.scale import checked_broadcast

TRAIN_ROWS = 20_000  # labelled URLs of least hash that the trees are fitted on
TREES, DEPTH, SEED = 10, 4, 7
PRIOR = 20.0  # labelled URLs that the overall rate counts for in a suffix's rate

C, L = F.col, F.lit


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# fixed values
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host up to the first /, ? or # after ://, lower case; path from there up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(_ascii_lower(host), L("")), F.coalesce(path, L(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule], value: str) -> Column:
    """``value`` (name or verdict) of the longest rule that fits; null if none does."""
    found = L(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        own = (host == rule.host) | F.endswith(host, L("." + rule.host))
        found = F.when(own & F.startswith(path, L(rule.path)), getattr(rule, value)).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.split(text, "")
    n = F.size(chars).cast("double")
    count = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), L(0.0), lambda s, c: s - count(c) * F.log2(count(c)))


FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digits", "digit_ratio", "hyphens", "parameters", "fragment", "secure", "bits", "host_bits", "suffix_seen", "suffix_rate")


def _lexical(rows: DataFrame) -> DataFrame:
    url = F.coalesce(C("url"), L(""))
    count = lambda text, pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    digits = count(url, "[0-9]")
    columns = {
        "length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"), "depth": count(C("path"), "/"),
        "labels": count(C("host"), "[.]"), "digits": digits, "digit_ratio": digits / F.greatest(F.length(url), L(1)), "hyphens": count(url, "[-_]"),
        "parameters": count(url, "[?&]"), "fragment": count(url, "#"), "secure": F.startswith(url, L("https:")).cast("int"), "bits": entropy(url), "host_bits": entropy(C("host")),
    }
    return rows.withColumns({f"f_{k}": v.cast("double") for k, v in columns.items()})


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score.

    score is the trees' probability of block, null where a rule decides.

    Defined cases: a null URL or one without :// has an empty host and path and
    is judged by the trees; equal rows are judged each; if the rules decide no
    URL all others are allowed, and if they know one verdict only, that is
    everyone's; an empty table gives no rows; other columns are ignored.
    """
    url = C("url").cast("string")
    host, path = host_and_path(url)
    rows = pages.select(C("page_id").cast("long").alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumns({x: matching_rule(C("host"), C("path"), rules, y) for x, y in (("rule", "name"), ("listed", "verdict"))})
    rows = rows.withColumn("suffix", F.substring_index("host", ".", -1))
    labelled = rows.where("rule IS NOT NULL").withColumn("block", (C("listed") == "block").cast("double"))
    totals = labelled.agg(F.count("*").alias("n"), F.sum("block").alias("blocked")).first()
    n, blocked = totals["n"], totals["blocked"] or 0.0
    columns = ["page_id", "host", "path", "rule"]
    if not n or blocked in (0.0, float(n)):
        other = "block" if n and blocked else "allow"
        return rows.select(*columns, F.coalesce("listed", L(other)).alias("verdict"), L(None).cast("double").alias("score"))
    rate = (F.sum("block") + PRIOR * blocked / n) / (F.count("*") + PRIOR)
    suffixes = labelled.groupBy("suffix").agg(F.log1p(F.count("*")).alias("f_suffix_seen"), rate.alias("f_suffix_rate"))
    suffixes = checked_broadcast(suffixes)

    def featured(df: DataFrame) -> DataFrame:
        known = _lexical(df).join(suffixes, "suffix", "left").fillna({"f_suffix_seen": 0.0, "f_suffix_rate": blocked / n})
        return VectorAssembler(inputCols=[f"f_{x}" for x in FEATURES], outputCol="features").transform(known)

    sample = labelled.orderBy(F.xxhash64("page_id", "url"), "page_id", "url").limit(TRAIN_ROWS)
    trees = GBTClassifier(labelCol="block", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, seed=SEED)
    model = trees.fit(featured(sample).select("features", "block"))
    # rules decide in place; only the other URLs pass the trees
    open_ = model.transform(featured(rows.where("rule IS NULL")))
    probability = F.element_at(_vector(C("probability")), 2)
    scored = open_.select(*columns, F.when(C("prediction") == 1.0, "block").otherwise("allow").alias("verdict"), probability.alias("score"))
    return rows.where("rule IS NOT NULL").select(*columns, C("listed").alias("verdict"), L(None).cast("double").alias("score")).unionByName(scored)


def _vector(column: Column) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(column)
