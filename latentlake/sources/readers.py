"""Reading vectors from delimited text and from JSON of several shapes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latentlake.functions.vec import c, doubles, let
from latentlake.plans.runtime import materialize

# Keys under which a JSON object may hold its rows, in order of preference
ROW_KEYS = ("data", "states", "points", "rows", "values")
QUOTE_AWARE_COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'
# Fixed value: what counts as a number in a text cell
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity|nan)$"


def cells(line) -> Column:
    """Cells of one delimited line, trimmed and without quotes."""
    line = c(line)
    quoted = F.transform(F.split(line, QUOTE_AWARE_COMMA), lambda v: F.trim(F.regexp_replace(F.trim(v), '^"|"$', "")))
    return F.when(line.contains('"'), quoted).otherwise(F.transform(F.split(line, ","), lambda v: F.trim(v)))


def number(cell: Column) -> Column:
    """A cell's value, null unless it is a number. Testing first is far cheaper than failing casts."""
    return F.when(cell.rlike(NUMBER), cell.try_cast("double"))


def vectors_from_cells(df: DataFrame, cell_column: str, mode: str = "compact", name: str = "x") -> DataFrame:
    """Rows of text cells to rows of numbers.

    compact: cells that are blank or not numeric are dropped (later cells move left), rows left empty disappear, short
    rows are filled with 0 up to the longest. strict: such cells become null, and ``ok`` is False for their rows.
    """
    if mode == "strict":
        out = df.withColumn(name, F.transform(F.col(cell_column), number))
        return out.withColumn("ok", ~F.exists(name, lambda v: v.isNull()))
    if mode != "compact":
        raise ValueError("mode is 'compact' or 'strict'")
    rows = materialize(_compacted(df, cell_column, name))  # parsed once, then the width is known
    width = rows.agg(F.max(F.size(name))).first()[0] or 0
    return rows.withColumn(name, pad(name, width))


def _compacted(df: DataFrame, cell_column: str, name: str) -> DataFrame:
    """Rows with the numbers among their cells, a batch's cells tested and converted together."""
    kept = [f for f in df.schema.fields if f.name != name]
    schema = T.StructType([*kept, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in batches:
            lists = b.column(cell_column)
            values = lists.flatten()
            good = pc.fill_null(pc.match_substring_regex(values, NUMBER), False)
            numbers = pc.replace_substring_regex(values.filter(good), r"^\+", "").cast(pa.float64())
            before = np.concatenate([[0], np.cumsum(good.to_numpy(zero_copy_only=False))])
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            offsets = before[ends]
            out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), numbers)
            some = pa.array(np.diff(offsets) > 0)
            yield pa.RecordBatch.from_arrays([*[b.column(f.name).filter(some) for f in kept], out.filter(some)], names=schema.names)

    return df.mapInArrow(run, schema)


def pad(x, width: int) -> Column:
    return F.concat(doubles(x), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(width) - F.size(c(x)))))


def read_csv_vectors(spark: SparkSession, path: str, header: bool = True, mode: str = "compact") -> DataFrame:
    """Vectors from delimited text files; the column count is the widest line's, not the first line's."""
    width = spark.read.text(path).agg(F.max(F.size(F.split("value", ",")))).first()[0] or 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    raw = spark.read.csv(path, schema=schema, header=header, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True,
                         enforceSchema=True)
    if mode == "strict":
        raw = raw.select(F.array(*raw.columns).alias("_cells"))
    else:
        raw = raw.select(F.filter(F.array(*raw.columns), lambda v: v.isNotNull()).alias("_cells"))
    return vectors_from_cells(raw, "_cells", mode).drop("_cells")


NUMBER_TYPES = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def _numbers(values: Column) -> Column:
    """Numeric members of an array of variants, in order. Booleans and strings are not numbers."""
    kept = F.filter(values, lambda v: F.schema_of_variant(v).rlike(NUMBER_TYPES))
    return F.transform(kept, lambda v: F.try_variant_get(v, "$", "double"))


def _list_rows(text: Column) -> Column:
    """Rows of a JSON list, by the kind of its first element."""
    def by_kind(members: Column) -> Column:
        kind = F.schema_of_variant(F.get(members, F.lit(0)))
        return (F.when(F.size(members) == 0, F.array().cast("array<array<double>>"))
                .when(kind.startswith("ARRAY"), F.transform(members, lambda m: _numbers(F.try_variant_get(m, "$", "array<variant>"))))
                .when(kind.startswith("OBJECT"), F.transform(F.from_json(text, "array<map<string,variant>>"),
                                                             lambda m: _numbers(F.map_values(m))))
                .otherwise(F.array(_numbers(members))))

    return let(F.from_json(text, "array<variant>"), by_kind)


def _object_row(text: Column) -> Column:
    return F.array(_numbers(F.map_values(F.from_json(text, "map<string,variant>"))))


def json_rows(text) -> Column:
    """One JSON document to its rows of numbers (array of arrays), by shape.

    List of numbers: one row. List of lists: one row each. List of objects: the numeric values of each in the order
    written. Object: what stands under the first of ROW_KEYS, else its values. Scalar: one row of one number.
    """
    def by_shape(t: Column) -> Column:
        return (F.when(t.startswith("["), _list_rows(t)).when(t.startswith("{"), _object_row(t))
                .otherwise(F.array(F.array(number(F.trim(t))))))

    def by_key(t: Column) -> Column:
        under = F.coalesce(*[F.get_json_object(t, f"$.{k}") for k in ROW_KEYS])
        return F.when(t.startswith("{"), let(under, lambda u: F.when(u.isNull(), _object_row(t)).otherwise(by_shape(F.ltrim(u))))) \
            .otherwise(by_shape(t))

    return let(F.ltrim(c(text)), by_key)


def vectors_from_json(df: DataFrame, text: str, doc: str, name: str = "x") -> DataFrame:
    """(doc, row, x): rows of every document, filled with 0 to the longest row of that document."""
    def filled(rows: Column) -> Column:
        width = F.array_max(F.transform(rows, lambda v: F.size(v)))
        return let(width, lambda w: F.transform(rows, lambda v: F.concat(v, F.array_repeat(F.lit(0.0), w - F.size(v)))))

    return df.select(doc, F.posexplode(let(json_rows(text), filled)).alias("row", name))


def read_json_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Vectors from JSON files, one document per file: (file, row, x)."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return vectors_from_json(docs, "value", "file")


def to_candidates(df: DataFrame, group: str, vec_id: str, x: str) -> DataFrame:
    """Any vector table as weighted candidates; a table that already has weights is returned as it is."""
    from latentlake.operators.weights import uniform

    out = df.withColumn(x, doubles(x))
    return out if "w" in df.columns else uniform(out.select(group, vec_id, x), group)
