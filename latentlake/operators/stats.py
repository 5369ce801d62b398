"""Run statistics, acceptance gates, two-sample and paired comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latentlake.functions.special import critical, p_value
from latentlake.functions.vec import c


def step_summary(runs: DataFrame, by: list[str], max_mean: float = 10.0, max_var: float = 2.0) -> DataFrame:
    """Mean and population spread of step counts, share converged, and whether both stay within their limits."""
    out = runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("steps").alias("mean_steps"), F.var_pop("steps").alias("var_steps"),
        F.stddev_pop("steps").alias("std_steps"), (F.avg(F.col("converged").cast("double")) * 100).alias("converged_pct"))
    return out.withColumns({"pass_mean": F.col("mean_steps") < max_mean, "pass_var": F.col("var_steps") < max_var})


def acceptance(runs: DataFrame, by: list[str], tol: float = 1e-3, max_unconverged_pct: float = 20.0,
               steps_a: str = "steps_a", steps_b: str = "steps_b") -> DataFrame:
    """Gates over a run table (converged, r0, r_final, r_adverse, steps of methods A and B)."""
    pct = lambda cond: F.avg(cond.cast("double")) * 100
    out = runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), pct(~F.col("converged")).alias("unconverged_pct"),
        pct(F.col("r_final") > tol).alias("drifted_pct"), pct(F.col(steps_a) < F.col(steps_b)).alias("win_pct"),
        F.avg("r_adverse").alias("_end"), F.avg("r0").alias("_start"))
    return out.withColumns({
        "pass_converged": F.col("unconverged_pct") <= max_unconverged_pct, "pass_drift": F.col("drifted_pct") == 0,
        "pass_wins": F.col("win_pct") > 50, "pass_adverse": F.col("_end") > F.col("_start")}).drop("_end", "_start")


def attempt_summary(attempts: DataFrame, group: str) -> DataFrame:
    """Per group of attempts (success, n_corrections, difficulty): counts, rates, means, abandoned."""
    return attempts.groupBy(group).agg(
        F.count(F.lit(1)).alias("count"), F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.avg("n_corrections").alias("mean_corrections"), F.sum("n_corrections").alias("total_corrections"),
        F.avg("difficulty").alias("mean_difficulty"), F.count_if(~F.col("success")).alias("abandoned"))


def load_ratio(attempts: DataFrame, group: str, above, below) -> DataFrame:
    """Mean corrections of one group over those of another, the divisor floored at 0.01."""
    mean = lambda key: F.coalesce(F.avg(F.when(F.col(group) == key, F.col("n_corrections"))), F.lit(0.0))
    return attempts.agg((mean(above) / F.greatest(mean(below), F.lit(0.01))).alias("ratio"))


def _sides(value: Column, side: Column) -> list[Column]:
    out = []
    for name, keep in (("a", side), ("b", ~side)):
        v = F.when(keep, value)
        out += [F.count(v).alias(f"n_{name}"), F.avg(v).alias(f"mean_{name}"), F.var_samp(v).alias(f"_s_{name}"),
                F.var_pop(v).alias(f"_p_{name}")]
    return out


def two_sample(df: DataFrame, value, side: Column, by: list[str] | None = None) -> DataFrame:
    """Pooled two-sample t of side against the rest; effect sizes with population and with sample variances.

    One pass of mergeable moments; nothing is sorted or collected.
    """
    out = df.groupBy(*(by or [])).agg(*_sides(c(value), side))
    na, nb = F.col("n_a"), F.col("n_b")
    pooled = ((na - 1) * F.col("_s_a") + (nb - 1) * F.col("_s_b")) / (na + nb - 2)
    diff = F.col("mean_a") - F.col("mean_b")
    sd_pop, sd_samp = F.sqrt((F.col("_p_a") + F.col("_p_b")) / 2), F.sqrt((F.col("_s_a") + F.col("_s_b")) / 2)
    return out.withColumns({
        "difference": diff, "t": diff / F.sqrt(pooled * (1 / na + 1 / nb)),
        "effect_pop": F.when(sd_pop > 0, -diff / sd_pop).otherwise(F.lit(0.0)),
        "effect_samp": F.when(sd_samp > 0, diff / sd_samp).otherwise(F.lit(0.0)),
        "std_error": F.sqrt(F.col("_s_a") / na + F.col("_s_b") / nb),
    }).drop("_s_a", "_s_b", "_p_a", "_p_b")


def paired(df: DataFrame, a, b, by: list[str] | None = None) -> DataFrame:
    """Paired t on the differences of two columns."""
    d = c(a) - c(b)
    out = df.groupBy(*(by or [])).agg(F.count(d).alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
                                      F.avg(d).alias("difference"), F.stddev_samp(d).alias("_sd"))
    return out.withColumns({
        "std_error": F.col("_sd") / F.sqrt("n"), "t": F.col("difference") / (F.col("_sd") / F.sqrt("n")),
        "effect": F.when(F.col("_sd") > 0, F.col("difference") / F.col("_sd")).otherwise(F.lit(0.0))}).drop("_sd")


def with_significance(result: DataFrame, freedom: Column, alpha: float = 0.05) -> DataFrame:
    """Add p value, confidence interval of the difference and the verdict to an aggregated comparison."""
    out = result.withColumns({"p_value": p_value(F.col("t"), freedom), "_c": critical(freedom, alpha)})
    return out.withColumns({
        "ci_lower": F.col("difference") - F.col("_c") * F.col("std_error"),
        "ci_upper": F.col("difference") + F.col("_c") * F.col("std_error"),
        "significant": F.col("p_value") < alpha}).drop("_c")
