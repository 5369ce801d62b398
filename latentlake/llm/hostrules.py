"""Quality rules judged at the level of hosts.

Every document is measured once with built-in functions. Rule failures are added up per host, failure rates are shrunk
towards the overall rate with a beta prior fitted to all hosts, and a host is rejected when even the low end of its
shrunk rate says that most of its documents fail. Documents fail by the base rules or by their host.

Nulls and edges: a null text has no words (and fails for shortness); null hosts form one host of their own; repeated rows
are judged one by one; an empty table gives an empty table. Columns are added under the names below, input columns of the
same names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentlake.llm.text import let, word_chars, words, written
from latentlake.plans.runtime import broadcast_if_small

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "#*$%&|<>"
LIMIT = 0.5    # share of failing documents above which a host is rejected
SIGMAS = 2.0   # that many standard deviations below the shrunk rate must still be above the limit

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rules() -> dict[str, Column]:
    """Rules whose failures are counted per host. The first two make a document fail by itself."""
    return {
        "short": F.col("n_words") < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "long_words": F.col("word_chars") > 40 * F.col("n_words"),
    }


def _repeat_words(w: Column) -> Column:
    """Words in windows that occur at least twice: windows sorted by hash, equal neighbours, lengths of the union."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))

    def positions(s):
        same = F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False))
                        | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)))
        return F.sort_array(F.transform(same, lambda e: e["i"]))

    def covered(p):
        reach = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)

    def counted(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, lambda s: let(positions(s), covered)))

    return F.when(F.size(w) <= WINDOW, F.lit(0).cast("long")).otherwise(let(windows, counted))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    kept = [c for c in docs.columns if c not in MEASURES]
    m = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    return docs.select(*kept, m.alias("__m"), word_chars(t).alias("word_chars"),
                       (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                       let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")) \
        .select(*kept, "__m.n_words", "word_chars", "n_symbols", "n_dup_lines", "__m.n_repeat_words")


def host_rates(measured: DataFrame, host: str) -> DataFrame:
    """One row per host: documents n and failures f_<rule>."""
    return measured.groupBy(F.col(host).alias("_host")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c.cast("long")).alias(f"f_{r}") for r, c in rules().items()])


def beta_prior(rates: DataFrame) -> dict[str, tuple[float, float]]:
    """(alpha, beta) per rule from the moments of all hosts: one row reaches the driver.

    The share of the variance between hosts that chance does not explain is the intra-class correlation rho; the prior
    then weighs 1 / rho - 1 documents.
    """
    n = F.col("n").cast("double")
    aggs = [F.sum(n).alias("N"), F.count(F.lit(1)).cast("double").alias("H")]
    for r in rules():
        f = F.col(f"f_{r}").cast("double")
        aggs += [F.sum(f).alias(f"F_{r}"), F.sum(f * f / n).alias(f"Q_{r}")]
    row, out = rates.agg(*aggs).first(), {}
    for r in rules():
        total, hosts = row["N"] or 0.0, row["H"] or 0.0
        m = row[f"F_{r}"] / total if total else 0.0
        chance = m * (1 - m)
        rho = 0.0
        if chance > 0 and total > hosts:
            between = (row[f"Q_{r}"] - row[f"F_{r}"] * m) / total
            by_chance = (hosts - 1) / total
            rho = (between - chance * by_chance) / (chance * (1 - by_chance))
        weight = 1 / min(max(rho, 1e-3), 0.9) - 1
        out[r] = (m * weight, (1 - m) * weight)
    return out


def rejected_hosts(rates: DataFrame, prior: dict[str, tuple[float, float]], limit: float = LIMIT, sigmas: float = SIGMAS) -> DataFrame:
    """(_host, broken: rules that reject it)"""
    n, broken = F.col("n").cast("double"), []
    for r, (a, b) in prior.items():
        w = n + a + b
        rate = (F.col(f"f_{r}") + a) / w
        broken.append(F.when(rate - sigmas * F.sqrt(rate * (1 - rate) / (w + 1)) > limit, F.lit(r)))
    return rates.select("_host", F.array_compact(F.array(*broken)).alias("broken")).where(F.size("broken") > 0)


def judge(docs: DataFrame, text: str = "text", host: str = "source", limit: float = LIMIT, keep_columns: list[str] | None = None,
          measure_again: bool = False) -> DataFrame:
    """docs (or ``keep_columns`` of it) with the measures, base_failed, host_broken (rules its host fails) and kept.

    The measured rows are written once and read twice. With ``measure_again`` nothing is written and every text is
    measured twice: better where texts are among the columns to keep.
    """
    columns = docs.columns if keep_columns is None else keep_columns
    columns = [c for c in columns if c not in (*MEASURES, "base_failed", "host_broken", "kept")]
    rows = measure(docs.withColumn("__host", F.col(host)), text).select(*columns, "__host", *MEASURES)
    if not measure_again:
        rows = written(rows, "measured")
    rates = written(host_rates(rows, "__host"), "rates")
    bad = rejected_hosts(rates, beta_prior(rates), limit).withColumnsRenamed({"_host": "__bad", "broken": "__broken"})
    bad = broadcast_if_small(bad, 1024)
    failed = rules()["short"] | rules()["repeats"]
    return rows.join(bad, F.col("__host").eqNullSafe(F.col("__bad")), "left").select(
        *columns, *MEASURES, failed.alias("base_failed"), F.col("__broken").alias("host_broken"),
        (~failed & F.col("__broken").isNull()).alias("kept"))
