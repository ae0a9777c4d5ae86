"""Sources of documents: (source_id, text, source_sha256, coverage) from Parquet, delimited files and whole text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrubline.operators.report import COVERAGE, sha256

PARTIAL = "plain-text-partial"


def spread(df: DataFrame) -> DataFrame:
    """Deals out the rows of a table whose files give fewer partitions than there are cores.

    Scanning text is bound by CPU, so a small table of one row group would keep one core busy. Large
    tables come in many partitions and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def as_documents(df: DataFrame, id_col: str | Column, text_col: str, understood: Column | None = None) -> DataFrame:
    """``coverage`` tells whether all of a text was understood: null text and bytes that are no UTF-8 are not, nor what ``understood`` is false for, and hold an export back."""
    ident = F.col(id_col) if isinstance(id_col, str) else id_col
    text = F.col(text_col)
    valid = F.is_valid_utf8(text) if understood is None else F.is_valid_utf8(text) & understood
    coverage = F.when(F.coalesce(valid, F.lit(False)), COVERAGE).otherwise(PARTIAL)
    return df.select(ident.cast("string").alias("source_id"), text.alias("text"), sha256(text).alias("source_sha256"), coverage.alias("coverage"))


def read_parquet(spark: SparkSession, path: str, id_col: str, text_col: str) -> DataFrame:
    return as_documents(spark.read.parquet(path), id_col, text_col)


#: A record of more bytes than this is not put together: it is reported without its text, as partial.
MAX_RECORD = 256 << 20
#: Stands for a separator outside quotes while a record is cut; a record that holds it is partial.
_CUT = "\uffff"


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, record, closed, valid): the records of delimited files, whose quoted values may span lines.

    Files are read in byte ranges. Whether a line starts inside quotes is the parity of the quotes
    before it: a running sum within its range, and a prefix sum over the ranges of the file, of which
    there is one row each. A line that opens and closes all its quotes is a record as it stands; only
    the lines of others are brought together. ``first``: the file's first line; ``closed``: all quotes are
    closed; ``valid``: its bytes are UTF-8. A record of more than MAX_RECORD bytes has a null text. Blank lines between records are none.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")
    )
    lines = lines.withColumn("quotes", F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit(""))))
    here, files = Window.partitionBy("file", "block").orderBy("n"), Window.partitionBy("file").orderBy("block")
    earlier = (Window.unboundedPreceding, -1)
    ranges = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"))
    before = ranges.select("file", "block", F.coalesce(F.sum("quotes").over(files.rowsBetween(*earlier)), F.lit(0)).alias("before"))
    rows = lines.join(before, ["file", "block"])
    rows = rows.withColumn("inside", (F.col("before") + F.coalesce(F.sum("quotes").over(here.rowsBetween(*earlier)), F.lit(0))) % 2 == 1)
    rows = rows.withColumn("start", F.last(F.when(~F.col("inside"), F.col("n")), ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("first", (F.col("block") == 0) & (F.row_number().over(here) == 1))
    whole = ~F.col("inside") & (F.col("quotes") % 2 == 0)
    alone = rows.where(whole).select("file", "first", F.col("value").alias("record"), F.lit(True).alias("closed"))
    # a record's lines in later ranges do not know its start: it is the last one of the ranges before
    parts = rows.where(~whole)
    starts = rows.groupBy("file", "block").agg(F.max("start").alias("last"))
    starts = starts.select("file", "block", F.last("last", ignorenulls=True).over(files.rowsBetween(*earlier)).alias("carried"))
    parts = parts.join(starts, ["file", "block"]).withColumn("start", F.coalesce("start", "carried"))
    long = parts.groupBy("file", "start").agg(F.sum(F.octet_length("value") + 1).alias("size"), F.bool_or("first").alias("first")).where(F.col("size") > MAX_RECORD)
    lost = long.select("file", "first", F.lit(None).cast("string").alias("record"), F.lit(False).alias("closed"))
    short = parts.join(F.broadcast(long.select("file", "start")), ["file", "start"], "left_anti")
    held = short.groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("block", "n", "value"))).alias("lines"), F.sum("quotes").alias("quotes"), F.bool_or("first").alias("first"))
    joined = held.select("file", "first", F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("record"), (F.col("quotes") % 2 == 0).alias("closed"))
    out = alone.unionByName(joined).unionByName(lost)
    # asked first, since expressions that read characters put others in place of broken bytes
    out = out.withColumn("valid", F.is_valid_utf8("record"))
    bare = F.regexp_replace("record", "\r$", "")
    bare = F.when(F.col("first"), F.regexp_replace(bare, "^\ufeff", "")).otherwise(bare)
    return out.withColumn("record", bare).where(F.col("record").isNull() | (F.col("record") != ""))


def fields(record: Column, sep: str) -> Column:
    """A record as an array of (value, ok): quoted values are unquoted; a quote anywhere else is not ok."""
    pieces = F.split(record, '"', -1)
    # pieces of even number are outside quotes
    cut = F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 0, F.replace(x, F.lit(sep), F.lit(_CUT))).otherwise(x)), '"')
    quote = F.lit('"')

    def value(raw: Column) -> Column:
        inner = F.substring(raw, F.lit(2), F.length(raw) - 2)
        quoted = (F.length(raw) >= 2) & F.startswith(raw, quote) & F.endswith(raw, quote)
        fine = F.when(quoted, ~F.contains(F.replace(inner, F.lit('""'), F.lit("")), quote)).otherwise(~F.contains(raw, quote))
        return F.struct(F.when(quoted, F.replace(inner, F.lit('""'), quote)).otherwise(raw).alias("value"), fine.alias("ok"))

    return F.transform(F.split(cut, _CUT, -1), value)


def read_csv(spark: SparkSession, path: str, id_col: str, text_col: str, sep: str = ",", columns: list[str] | None = None) -> DataFrame:
    """Two columns of a CSV or TSV file, or of a folder of them; values may span lines.

    Every file starts with a line of column names, unless ``columns`` gives them. A record is complete
    if it is UTF-8, has as many fields as there are columns, all its quotes are closed, and quotes stand
    around values only; else it is partial, with the values that stand at the columns' places. An empty
    field is an empty text. A file that lacks a column gives null for it.
    """
    rows = records(spark, path)
    names = F.transform(fields(F.col("record"), sep), lambda x: x["value"])
    if columns is None:
        heads = rows.where("first").select("file", names.alias("names"))
        rows = rows.where("not first").join(heads, "file")
    else:
        rows = rows.withColumn("names", F.array(*[F.lit(c) for c in columns]))
    rows = rows.withColumn("fields", fields(F.col("record"), sep))
    at = lambda c: F.get(F.transform("fields", lambda x: x["value"]), (F.array_position("names", F.lit(c)) - 1).cast("int"))
    fine = F.col("closed") & F.col("valid") & ~F.contains("record", F.lit(_CUT)) & (F.size("fields") == F.size("names")) & F.forall("fields", lambda x: x["ok"])
    out = as_documents(rows.select(at(id_col).alias("id"), at(text_col).alias("text"), F.coalesce(fine, F.lit(False)).alias("fine")), "id", "text", F.col("fine"))
    return out


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One document per text or Markdown file, named by its path."""
    return as_documents(spark.read.text(path, wholetext=True), F.col("_metadata.file_path"), "value")
