"""Quality rules per document and per host, in DataFrame operations alone.

A document fails by rules of its own. Failures are counted by host; a host's failure rate is shrunk towards the rate of
all hosts with a beta prior whose two parameters come from the spread of the rates between hosts. Hosts whose shrunk
rate stays high with a margin are rejected, and the verdict is joined back to their documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from flowsift.llm.common import WORD_SPACE, fresh, text_of, words_of
from flowsift.session import materialise

SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class HostRules:
    """Limits of the rules.

    ``reject_rate``: a host is rejected when its shrunk failure rate, less ``margin`` posterior standard deviations,
    exceeds this share of its documents. A host is judged by what most of its documents are, so the
    clean documents of an ordinary host with a few bad ones are never touched.
    ``prior_limit``: the prior counts as many documents at most, so hosts with that many speak for themselves.
    """

    min_words: int = 10
    max_repeat_percent: int = 20
    max_symbol_percent: int = 10
    max_dup_line_percent: int = 30
    reject_rate: float = 0.5
    margin: float = 2.0
    prior_limit: float = 1000.0


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of five words found twice or more in the text, the first one included.

    Windows are compared by 64-bit hashes within one text. Only texts with a repeated window sort them.
    """
    last = F.size(words) - WINDOW_WORDS + 1
    windows = lambda hashed: F.transform(
        F.sequence(F.lit(0), F.size(hashed) - WINDOW_WORDS), lambda i: F.xxhash64(*[F.get(hashed, i + k) for k in range(WINDOW_WORDS)])
    )
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(last < 2, F.lit(0)).otherwise(_bound(_bound(hashed, windows), _covered))


def _covered(windows: Column) -> Column:
    """Words covered by the windows that share their hash with another one."""
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_sorted_cover(windows))


def _sorted_cover(windows: Column) -> Column:
    """As ``_covered``, by sorting (hash, place): equal neighbours are repeats, and each adds what no earlier one covers."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(at: Column) -> Column:
        same = lambda k, other: F.get(at, k)["h"] == F.get(at, other)["h"]
        kept = F.filter(F.sequence(F.lit(0), F.size(at) - 1), lambda k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
        return F.array_sort(F.transform(kept, lambda k: F.get(at, k)["i"]))

    def cover(starts: Column) -> Column:
        gap = lambda start, k: F.least(F.lit(WINDOW_WORDS), start - F.coalesce(F.get(starts, k - 1), F.lit(-WINDOW_WORDS)))
        return F.aggregate(F.transform(starts, gap), F.lit(0), lambda total, words: total + words)

    return _bound(_bound(placed, places), cover)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: higher-order functions evaluate a column each time it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def measures(text: Column) -> dict[str, Column]:
    """The measures of a text; all zero for a null text. Texts without a word have only symbols and no words."""
    words = words_of(text)
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, WORD_SPACE, "")) > 0)
    counted = {
        "n_words": F.size(words),
        "word_chars": F.length(F.translate(text, WORD_SPACE, "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_dup_lines": _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": _bound(words, repeated_words),
    }
    return {name: counted[name].cast("long") for name in MEASURES}


def base_failed(rules: HostRules, found: dict[str, Column]) -> Column:
    """Too few words, or too many of them repeated."""
    repeats = 100 * found["n_repeat_words"] > rules.max_repeat_percent * found["n_words"]
    return (found["n_words"] < rules.min_words) | repeats


def rule_failed(rules: HostRules, found: dict[str, Column]) -> Column:
    """Any rule broken, with those that count against the host only: symbols and repeated lines."""
    symbols = 100 * found["n_symbols"] > rules.max_symbol_percent * found["word_chars"]
    lines = 100 * WINDOW_WORDS * found["n_dup_lines"] > rules.max_dup_line_percent * found["n_words"]
    return base_failed(rules, found) | symbols | lines


def named(prefix: str = "") -> dict[str, Column]:
    """The measures as columns of a table."""
    return {name: F.col(f"{prefix}{name}") for name in MEASURES}


def host_verdicts(checked: DataFrame, host: str, failed: str, rules: HostRules) -> DataFrame:
    """Per host: documents, failures, shrunk rate and whether it is rejected.

    The beta prior is fitted by moments to the hosts' rates, weighted by their documents. The variance
    between hosts is what exceeds the binomial one; without any, all hosts share the pooled rate as far as
    ``prior_limit`` documents go. Counting is combined per task, so a host with a third of all rows is a row per task.
    """
    hosts = checked.groupBy(host).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("bad"))
    total = F.sum("n").cast("double")
    pooled = hosts.agg(
        total.alias("docs"),
        (F.sum("bad") / total).alias("rate"),
        F.count("*").alias("hosts"),
        F.sum(F.col("n") * F.col("n")).cast("double").alias("squares"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("weighted"),
    )
    spread = F.col("weighted") - F.col("docs") * F.col("rate") * F.col("rate")
    chance = F.col("rate") * (1 - F.col("rate"))
    excess = (spread - (F.col("hosts") - 1) * chance) / F.nullif(F.col("docs") - F.col("squares") / F.col("docs"), F.lit(0.0))
    size = F.when(excess > 0, F.least(F.greatest(chance / excess - 1, F.lit(1.0)), F.lit(rules.prior_limit)))
    prior = pooled.select("rate", F.coalesce(size, F.lit(rules.prior_limit)).alias("strength"))
    only = prior.select(F.struct("rate", "strength").alias("prior")).scalar()
    a = F.col("bad") + only["rate"] * only["strength"]
    n = F.col("n") + only["strength"]
    shrunk = a / n
    deviation = F.sqrt(shrunk * (1 - shrunk) / (n + 1))
    return hosts.select(
        host,
        F.col("n").alias("host_docs"),
        F.col("bad").alias("host_failures"),
        shrunk.alias("host_rate"),
        (shrunk - rules.margin * deviation > rules.reject_rate).alias("host_rejected"),
    )


def _host_key(host: Column) -> Column:
    """The host as a value that joins: a null host is a host like any other."""
    return F.coalesce(F.concat(F.lit("="), host), F.lit(""))


def quality_report(docs: DataFrame, rules: HostRules = HostRules(), host: str = "source") -> DataFrame:
    """doc_id, the measures, base_failed and kept (passed by itself, and not of a rejected host), one row per document.

    The text is read once; its measures are stored, counted by host, and joined to the rejected hosts. No size is
    promised for those, so the join is left to Spark, which broadcasts them if they turn out small and splits a
    hot host's rows otherwise. A null or empty text fails for want of words. Repeated rows are judged alike; an
    empty table gives no rows.
    """
    slim = docs.select("doc_id", _host_key(F.col(host).cast("string")).alias("host"), text_of().alias("text"))
    stored = materialise(slim.select("doc_id", "host", *[c.alias(n) for n, c in measures(F.col("text")).items()]))
    checked = stored.withColumn("failed", rule_failed(rules, named()))
    rejected = host_verdicts(checked, "host", "failed", rules).filter("host_rejected").select("host", "host_rejected")
    joined = stored.withColumn("base_failed", base_failed(rules, named())).join(rejected, "host", "left")
    kept = ~F.col("base_failed") & F.col("host_rejected").isNull()
    return joined.select("doc_id", *MEASURES, "base_failed", kept.alias("kept"))


def keep_good(docs: DataFrame, rules: HostRules = HostRules(), host: str = "source") -> DataFrame:
    """The documents that are kept, with all their columns and nothing added.

    Texts are measured once: rows are stored with their flags, those that fail by themselves without their text, and
    the others are read back when the rejected hosts are known. They are not shuffled unless the rejected hosts are too
    many to be sent to every task.
    """
    key, bad, counted = (fresh(docs, c) for c in ("_host", "_bad", "_counted"))
    place = {name: fresh(docs, f"_{name}") for name in MEASURES}
    found = {name: F.col(place[name]) for name in MEASURES}
    measured = docs.select("*", *[c.alias(place[n]) for n, c in measures(text_of()).items()])
    own = {c: F.col(f"`{c}`") for c in docs.columns}
    judged = measured.select(*own.values(), base_failed(rules, found).alias(bad), rule_failed(rules, found).alias(counted))
    slim = {c: F.when(~F.col(bad), v).alias(c) if c.lower() == "text" else v for c, v in own.items()}
    stored = materialise(judged.select(*slim.values(), _host_key(F.col(f"`{host}`").cast("string")).alias(key), bad, counted))
    rejected = host_verdicts(stored, key, counted, rules).filter("host_rejected").select(key)
    return stored.filter(~F.col(bad)).join(materialise(rejected), key, "left_anti").select(*own.values())
