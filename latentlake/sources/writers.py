"""Writing traces, nested and flat results, and validated logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latentlake.operators.quality import gate

# Moment types an event log may hold
MOMENT_TYPES = ("native", "translation", "friction", "flow")


def trace_records(df: DataFrame, label: str) -> DataFrame:
    """One record per trace: timestamp, label, steps, converged, drift_trace, final_drift."""
    final = F.when(F.size("drift_trace") > 0, F.element_at("drift_trace", -1))
    return df.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
                     F.col(label).cast("string").alias("label"), "steps", "converged", "drift_trace", final.alias("final_drift"))


def append_traces(df: DataFrame, label: str, path: str) -> None:
    trace_records(df, label).write.mode("append").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def flat_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]


def write_csv(df: DataFrame, path: str) -> None:
    """Flat columns only: nested fields have no place in a delimited file."""
    df.select(*flat_columns(df)).write.mode("overwrite").csv(path, header=True)


def append_validated(df: DataFrame, column: str, path: str, quarantine: str, allowed=MOMENT_TYPES) -> None:
    """Append allowed rows to the log and the others to the quarantine folder."""
    good, bad = gate(df, column, list(allowed))
    good.write.mode("append").json(path)
    bad.write.mode("append").json(quarantine)
