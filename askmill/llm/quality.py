"""Quality rules for documents and for the hosts they come from, in built-in functions only.

Rules of a document count over its whole text. The failures are summed by host,
and each host's failure rate is shrunk towards the rate of all hosts by a beta
prior that is fitted to the hosts' rates (method of moments). A host whose shrunk
rate is above the limit loses all its documents.

A null text has no words and fails. A document without a host is judged by its
own rules alone. Repeated rows count as often as they occur. An empty table
gives an empty table. A row's other columns stay, except those that are named
like an output column, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askmill.operators.dimensions import broadcast_if_small
from askmill.session import materialise

#: Characters that separate words.
BLANKS = " \t\n\x0b\f\r"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words of a repeated window.
WINDOW = 8
#: A document with fewer words fails.
MIN_WORDS = 20
#: A document with a larger percentage of words in repeated windows fails.
MAX_REPEAT_PERCENT = 30
#: A host with a higher shrunk failure rate loses its documents.
MAX_HOST_RATE = 0.5

RULE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The runs of characters other than :data:`BLANKS`."""
    return F.filter(F.split(text, f"[{BLANKS}]+"), lambda w: w != "")


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words stand in windows that occur twice or more, overlapping ones included."""

    def covered(windows: Column) -> Column:
        """From ``(hash, place)`` in order of hash: equal neighbours are repeats."""
        pairs = F.zip_with(
            F.slice(windows, 1, F.size(windows) - 1),
            F.slice(windows, 2, F.size(windows) - 1),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])).otherwise(F.array().cast("array<int>")),
        )
        return let(F.array_sort(F.array_distinct(F.flatten(pairs))), span)

    def span(places: Column) -> Column:
        """Words under windows that begin at the places, counted once."""
        steps = F.zip_with(
            F.slice(places, 1, F.size(places) - 1),
            F.slice(places, 2, F.size(places) - 1),
            lambda a, b: F.least(F.lit(window), b - a),
        )
        return F.aggregate(steps, F.lit(window), lambda total, step: total + step)

    def count(words: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(words) - window + 1), lambda p: F.xxhash64(F.slice(words, p, window)))
        return F.when(F.size(words) <= window, F.lit(0)).otherwise(let(hashes, repeats))

    def repeats(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed, covered))

    return let(words, count).cast("bigint")


def with_rules(
    docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT
) -> DataFrame:
    """Append the counts of a document's rules and ``base_failed``."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: F.length(F.translate(line, BLANKS, "")) > 0)
    both = let(
        words_of(body),
        lambda words: F.struct(F.size(words).cast("bigint").alias("n"), repeated_words(words).alias("repeated")),
    )
    counted = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in RULE_COLUMNS],
        both.alias("__words"),
        _without(body, BLANKS).cast("bigint").alias("word_chars"),
        (F.length(body) - _without(body, SYMBOLS)).cast("bigint").alias("n_symbols"),
        let(lines, lambda kept: F.size(kept) - F.size(F.array_distinct(kept))).cast("bigint").alias("n_dup_lines"),
    )
    n, repeated = F.col("__words.n"), F.col("__words.repeated")
    return counted.select(
        *[c for c in docs.columns if c not in RULE_COLUMNS],
        n.alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        repeated.alias("n_repeat_words"),
        ((n < min_words) | (repeated * 100 > n * max_repeat_percent)).alias("base_failed"),
    )


def host_verdicts(judged: DataFrame, host: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``(host, n, n_failed, rate, host_kept)`` from documents with ``base_failed``.

    With hosts whose rates differ no more than chance explains, the prior is
    firm (the weight of all documents of a typical host a thousandfold), and
    every host gets the common rate.
    """
    sums = (
        judged.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("bigint")).alias("n_failed"))
    )
    share = F.col("n_failed") / F.col("n")
    # Moments of the rates, each host weighted by its documents.
    prior = sums.agg(
        F.sum("n_failed").alias("all_failed"),
        F.sum("n").alias("all_n"),
        F.count("*").alias("hosts"),
        F.sum(F.col("n") * share * share).alias("squares"),
        F.sum(F.col("n") * F.col("n")).alias("n_squares"),
    )
    mean = F.col("all_failed") / F.col("all_n")
    between = F.col("squares") - F.col("all_n") * mean * mean
    chance = (F.col("hosts") - 1) * mean * (1 - mean)
    room = F.col("all_n") - F.col("n_squares") / F.col("all_n")
    variance = F.when(room > 0, F.greatest((between - chance) / room, F.lit(0.0))).otherwise(F.lit(0.0))
    typical = F.col("all_n") / F.col("hosts")
    most = typical * 1000
    firm = F.when(variance > 0, F.least(F.greatest(mean * (1 - mean) / variance - 1, F.lit(0.0)), most)).otherwise(most)
    # Two numbers for all hosts; without hosts there are none, and no rows either.
    found = prior.select(mean.alias("mean"), firm.alias("weight")).first()
    common, weight = F.lit(found["mean"] or 0.0), F.lit(found["weight"] or 0.0)
    rate = (F.col("n_failed") + common * weight) / (F.col("n") + weight)
    return sums.select("host", "n", "n_failed", rate.alias("rate"), (rate <= max_rate).alias("host_kept"))


def judge_documents(
    docs: DataFrame, host: str = "source", text: str = "text", max_host_rate: float = MAX_HOST_RATE, keep_text: bool = True
) -> DataFrame:
    """``docs`` with the rule columns, ``host_rate`` and ``kept``; without the text if it is not to be kept.

    The rules are computed once: what they found is stored with the rows, and
    the sums by host and the join of their verdicts read that.
    """
    names = {"host_rate", "kept"}
    source = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    ruled = with_rules(source, text)
    judged = materialise(ruled if keep_text else ruled.drop(text), "rules")
    verdicts = host_verdicts(judged, host, max_host_rate).select(
        F.col("host").alias("__host"), F.col("rate").alias("host_rate"), "host_kept"
    )
    # Few hosts are sent to all tasks; many are joined, and a hot host is split by the adaptive join.
    joined = judged.join(broadcast_if_small(verdicts, rows=100_000), F.col(host) == F.col("__host"), "left")
    kept = ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))
    return joined.withColumn("kept", kept).drop("__host", "host_kept")
