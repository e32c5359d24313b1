"""URL verdicts: host and path rules first, else a logistic regression on hashed character n-grams.

Built-in functions and the DataFrame-based ML library only. Rules and labelled
URLs are small tables that their owner writes; the pages may be many, and each
is judged in one pass without a shuffle.

A null URL, or one without ``://``, has an empty host and path; the model judges
those as well. Repeated rows stay. A URL of any length is read whole. An empty
table gives an empty table. Other columns stay, except those that are named like
an output column, which is replaced.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets that n-grams are hashed into.
FEATURES = 1 << 14
#: Lengths of the n-grams.
GRAMS = (3, 4, 5)
#: Rules that a list may hold; they are part of the plan.
MAX_RULES = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OUT = ["host", "path", "rule", "verdict"]

Rule = tuple[str, str, str]


def parse_rule(verdict: str, rule: str) -> Rule:
    """``(verdict, host, path)`` of a rule such as ``example.net/en/``."""
    if verdict not in ("allow", "block"):
        raise ValueError(f"a rule allows or blocks, not {verdict!r}")
    host, slash, path = rule.partition("/")
    return verdict, host.lower(), slash + path


def with_host_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Append ``host`` (A-Z in lower case) and ``path``; neither holds the query or the fragment."""
    whole = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("host", "path")]
    return df.select(*kept, host.alias("host"), path.alias("path"))


def best_rule(rules: list[Rule]) -> Column:
    """``(verdict, rule)`` of the longest rule that fits ``host`` and ``path``, or null.

    A rule fits its host and the subdomains, under paths that begin with its
    own. Of equally long rules the one that sorts first wins.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; more than {MAX_RULES} belong into a table that is joined")
    if not rules:
        return F.lit(None).cast("struct<verdict:string,rule:string>")
    ordered = sorted(set(rules), key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0]))
    listed = F.array(*[F.struct(*(F.lit(v).alias(n) for v, n in zip(r, ("verdict", "host", "path")))) for r in ordered])
    host, path = F.col("host"), F.col("path")
    fits = F.filter(
        listed,
        lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]),
    )
    first = F.get(fits, F.lit(0))
    found = F.struct(first["verdict"].alias("verdict"), F.concat(first["host"], first["path"]).alias("rule"))
    return F.when(F.size(fits) > 0, found)


def grams(host: str = "host", path: str = "path") -> Column:
    """The character n-grams of host and path, each marked with where it stands; ends are marked by ``^`` and ``$``."""

    def of(column: str, mark: str, n: int) -> Column:
        bounded = F.concat(F.lit("^"), F.col(column), F.lit("$"))
        places = F.sequence(F.lit(1), F.greatest(F.length(bounded) - n + 1, F.lit(1)))
        return F.transform(places, lambda i: F.concat(F.lit(f"{mark}{n}"), F.substring(bounded, i, F.lit(n))))

    return F.concat(*[of(c, m, n) for c, m in ((host, "h"), (path, "p")) for n in GRAMS])


def _featured(df: DataFrame) -> DataFrame:
    return HashingTF(inputCol="__grams", outputCol="__features", numFeatures=FEATURES, binary=True).transform(df.withColumn("__grams", grams()))


def fit_urls(labelled: DataFrame, url: str = "url", label: str = "label", penalty: float = 0.01) -> LogisticRegressionModel:
    """Learn from ``labelled(url, label)``, 1 for URLs to block; rows without a label are left out."""
    rows = with_host_path(labelled.select(F.col(f"`{url}`").alias("url"), F.col(f"`{label}`").cast("double").alias("label")).dropna(subset=["label"]))
    learner = LogisticRegression(
        featuresCol="__features", labelCol="label", predictionCol="__blocked", probabilityCol="__p", rawPredictionCol="__raw", regParam=penalty
    )
    return learner.fit(_featured(rows))


def judge_urls(pages: DataFrame, rules: list[Rule], model: LogisticRegressionModel, url: str = "url") -> DataFrame:
    """Append ``host``, ``path``, ``rule`` and ``verdict``: the rule's, else ``block`` where the model expects a bad URL."""
    passed = [c for c in pages.columns if c not in _OUT]
    parsed = with_host_path(pages, url).withColumn("__rule", best_rule(rules))
    judged = model.transform(_featured(parsed))
    by_model = F.when(F.col("__blocked") == 1, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        *[F.col(f"`{c}`") for c in passed], "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce("__rule.verdict", by_model).alias("verdict")
    )


#: Beginnings and ends of hosts, and paths, that say nothing about a URL; names of both labels get all ends alike.
_STARTS = ("", "www.", "m.", "blog.", "shop.")
_TOPS = ("com", "net", "org", "info", "co.uk", "de", "fr", "eu")
_PLAIN_PATHS = ("", "/", "/index.html", "/page/2", "/2019/05/12/", "/p?id=40", "/home#top")


def labelled_urls(
    spark: SparkSession,
    bad: tuple[str, ...] = (),
    good: tuple[str, ...] = (),
    bad_paths: tuple[str, ...] = (),
    good_paths: tuple[str, ...] = (),
) -> DataFrame:
    """A small table ``(url, label)``: every given name as a host, under each of some top domains, with plain paths and one of its label."""
    rows = []
    for names, paths, label in ((bad, bad_paths, 1), (good, good_paths, 0)):
        for i, name in enumerate(names):
            hosts = [f"https://{_STARTS[(i + k) % len(_STARTS)]}{name}.{top}" for k, top in enumerate(_TOPS)]
            rows += [(host + _PLAIN_PATHS[(i + k) % len(_PLAIN_PATHS)], label) for k, host in enumerate(hosts)]
            if paths:
                rows.append((hosts[i % len(hosts)] + paths[i % len(paths)], label))
    rows.append(("", 0))
    # One literal: thousands of literals are slow to plan.
    listed = F.from_json(F.lit(json.dumps([{"url": u, "label": y} for u, y in rows])), "array<struct<url:string,label:int>>")
    return spark.range(1, numPartitions=1).select(F.inline(listed))
