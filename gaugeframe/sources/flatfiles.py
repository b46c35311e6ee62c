"""Reading and writing flat files (SRC-01, SNK-01)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.operators.cleaning import nan_to_null

# The column layout of the known weather file.
WEATHER = T.StructType([
    T.StructField("Date", T.DateType()),
    T.StructField("City", T.StringType()),
    T.StructField("Temperature", T.DoubleType()),
    T.StructField("Humidity", T.DoubleType()),
    T.StructField("Wind Speed", T.DoubleType()),
    T.StructField("Rainfall", T.LongType()),
])

# Words that stand for a missing value in a file.
MISSING = ("NA", "N/A", "n/a", "NaN", "nan", "NULL", "null", "None", "<NA>", "#N/A", "-nan", "-NaN")

_QUOTES = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    line_breaks: bool = False,
    missing: Sequence[str] = MISSING,
) -> DataFrame:
    """Header CSV as a DataFrame; empty fields, the ``missing`` words and NaN are read as missing.

    A doubled quote within quotes is a quote, white space around values is kept, and a quoted empty text is an empty
    text. Quoted line breaks need ``line_breaks``, with which a file is read by one task as a whole.

    Fields are read as text first, so that a missing word does not decide a column's type. Give a schema for known
    files: the header has to name its columns in order, and a value that doesn't fit its type stops the job. Without one
    the types are found by one pass over the file.
    """
    # An empty field is told from a quoted empty text by a null value that no file has.
    options = spark.read.options(header=True, multiLine=line_breaks, nullValue="\x00missing\x00", **_QUOTES)
    if schema is None:
        text = options.csv(path)
    else:
        # With enforceSchema off Spark checks header names, so a reordered file fails loudly.
        text = options.option("enforceSchema", False).schema(T.StructType([T.StructField(f.name, T.StringType()) for f in schema])).csv(path)
    known = text.select(*[F.when(~F.col(f"`{c}`").isin(*missing), F.col(f"`{c}`")).alias(c) for c in text.columns])
    types = {f.name: f.dataType for f in schema} if schema is not None else _types(known)
    return nan_to_null(known.select(*[_typed(c, types[c]) for c in known.columns]))


def read_csv_checked(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    line_breaks: bool = False,
    missing: Sequence[str] = MISSING,
    least: float = 0.95,
) -> tuple[DataFrame, DataFrame]:
    """Header CSV as (rows, quarantine); together they hold every record of the files, each once.

    ``rows`` are the records of which each field fits its column, read as :func:`read_csv` reads them. ``quarantine`` has ``file``,
    ``text`` and ``reason`` of all others: those with too many or too few fields, as they stand in the file, and those with a
    value that doesn't fit, their fields written as CSV again. A reason names each column that doesn't fit.

    Without a schema, a column has the narrowest type that ``least`` of the known values fit, found by one pass over the records
    with the right number of fields. A header that doesn't name the columns in order still stops the job.
    """
    names = schema.names if schema is not None else spark.read.options(header=True, multiLine=line_breaks, **_QUOTES).csv(path).columns
    broken, file = _free(names, "broken"), _free(names, "file")
    texts = T.StructType([T.StructField(c, T.StringType()) for c in [*names, broken]])
    # Without column pruning the number of fields is judged alike, whatever columns are read later.
    options = {"header": True, "multiLine": line_breaks, "nullValue": "\x00missing\x00", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken, "columnPruning": False}
    found = spark.read.options(enforceSchema=False, **options, **_QUOTES).schema(texts).csv(path)
    known = found.select(*[F.when(~F.col(f"`{c}`").isin(*missing), F.col(f"`{c}`")).alias(c) for c in names], broken, F.col("_metadata.file_path").alias(file))
    if schema is not None:
        types = {f.name: f.dataType for f in schema}
    else:
        types = _types(known.where(F.col(broken).isNull()).select(*[F.col(f"`{c}`") for c in names]), least)
    # Always true, but names a field: Spark rejects queries of nothing but the column of broken records.
    any_field = F.coalesce(F.length(F.col(f"`{names[0]}`")), F.lit(0)) >= 0
    reasons = [F.when(F.col(broken).isNotNull() & any_field, F.lit("wrong number of fields"))]
    for c in names:
        if not isinstance(types[c], T.StringType):
            value = F.trim(F.col(f"`{c}`"))
            unfit = F.col(broken).isNull() & (value != "") & value.try_cast(types[c]).isNull()
            reasons.append(F.when(unfit, F.lit(f"{c}: no {types[c].simpleString()}")))
    reason = F.concat_ws("; ", *reasons)
    fields = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in names]), {"nullValue": "", "emptyValue": '""', "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    rows = nan_to_null(known.where(reason == "").select(*[_typed(c, types[c], checked=True) for c in names]))
    return rows, known.where(reason != "").select(F.col(file).alias("file"), F.coalesce(F.col(broken), fields).alias("text"), reason.alias("reason"))


def _free(names: Sequence[str], name: str) -> str:
    taken = {c.lower() for c in names}
    while name in taken:
        name += "_"
    return name


def _typed(column: str, kind: T.DataType, checked: bool = False):
    value = F.col(f"`{column}`")
    if isinstance(kind, T.StringType):
        return value.alias(column)
    known = F.when(F.trim(value) != "", F.trim(value))
    return (known.try_cast(kind) if checked else known.cast(kind)).alias(column)


def _types(text: DataFrame, least: float = 1.0) -> dict[str, T.DataType]:
    """The narrowest of whole number, number, truth value, date and time stamp that fits all known values, or the share ``least`` of
    them, else text."""
    tries = [T.LongType(), T.DoubleType(), T.BooleanType(), T.DateType(), T.TimestampType()]
    counts = []
    for i, c in enumerate(text.columns):
        value = F.when(F.trim(F.col(f"`{c}`")) != "", F.trim(F.col(f"`{c}`")))
        counts += [F.count(value).alias(f"{i}")] + [F.count(value.try_cast(t)).alias(f"{i}_{j}") for j, t in enumerate(tries)]
    row = text.agg(*counts).first()  # one row
    found: dict[str, T.DataType] = {}
    for i, c in enumerate(text.columns):
        fits = [t for j, t in enumerate(tries) if row[f"{i}"] and row[f"{i}_{j}"] >= least * row[f"{i}"]]
        found[c] = fits[0] if fits else T.StringType()
    return found


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One Parquet table of a data directory, NaN read as missing."""
    return nan_to_null(spark.read.parquet(f"{directory}/{name}.parquet"))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header CSV without an index column; one file per partition, written by the executors.

    Missing values are empty fields, empty texts are quoted; quotes within a value are doubled.
    """
    df.write.mode(mode).options(header=True, **(_QUOTES | {"emptyValue": '""'})).csv(path)


def write_yearly(df: DataFrame, path: str, date_col: str, mode: str = "errorifexists") -> None:
    """Parquet partitioned by year, so that later date ranges prune whole folders.

    Rows are rebalanced by year: adaptive execution splits a large year over as many writers as its size asks for and
    lets one writer take several small ones.
    """
    df.withColumn("year", F.year(date_col)).hint("rebalance", F.col("year")).write.mode(mode).partitionBy("year").parquet(path)
