"""Line formats: tab-separated, whitespace-separated, pixels, labelled text.

Each reader is ``spark.read.text`` plus a parser that also works on any table
of lines. Results are plain tables; write them with ``df.write.parquet``.

A line that doesn't fit stops the job. With ``bad``, the name of a further
column, such a line is kept there and its other columns are null; lines that
fit have null there.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def numbers(line: str, pattern: str) -> Column:
    """The line's fields as doubles, null where one is no number."""
    return F.transform(F.split(F.trim(line), pattern), lambda v: v.try_cast("double"))


def fitting(fits: Column, value: Column, line: str, bad: str, what: str) -> Column:
    """The value if the line fits; else null, or an error if bad lines have no column."""
    told = F.lit(None) if bad else F.raise_error(F.concat(F.lit(f"{what}: "), F.col(line)))
    return F.when(fits, value).otherwise(told)


def with_bad(line: str, bad: str, first: str) -> list:
    """The column of bad lines, if it is asked for."""
    return [F.when(F.col(first).isNull(), F.col(line)).alias(bad)] if bad else []


def parse_labeled_fields(lines: DataFrame, n_features: int, pattern: str, line: str = "value", keep: list = (), bad: str = None) -> DataFrame:
    """All fields as doubles: f0.., and the last one as label. A line of another width or with another field doesn't fit."""
    v = numbers(line, pattern)
    fits = (F.size(v) == n_features + 1) & F.forall(v, lambda x: x.isNotNull())
    rows = lines.filter(F.trim(line) != "").select(*keep, line, fitting(fits, v, line, bad, "wrong number of fields, or no number").alias("_v"))
    return rows.select(*keep, *[F.get("_v", F.lit(i)).alias(f"f{i}") for i in range(n_features)], F.get("_v", F.lit(n_features)).alias("label"),
                       *with_bad(line, bad, "_v"))


def parse_labeled_tsv(lines: DataFrame, n_features: int, **options) -> DataFrame:
    return parse_labeled_fields(lines, n_features, "\t", **options)


def read_labeled_tsv(spark: SparkSession, path: str, n_features: int, bad: str = None) -> DataFrame:
    return parse_labeled_tsv(spark.read.text(path), n_features, bad=bad)


def parse_labeled_ws(lines: DataFrame, n_features: int, **options) -> DataFrame:
    return parse_labeled_fields(lines, n_features, r"\s+", **options)


def read_labeled_ws(spark: SparkSession, path: str, n_features: int, bad: str = None) -> DataFrame:
    return parse_labeled_ws(spark.read.text(path), n_features, bad=bad)


def parse_labeled_pixels(lines: DataFrame, line: str = "value", keep: list = (), n_pixels: int = None, bad: str = None) -> DataFrame:
    """First field 0 gives label +1, any other -1; the rest are scaled from 0..255 to 0..1.

    A line fits if all fields are numbers, the pixels from 0 to 255, and if there are ``n_pixels`` of them.
    """
    v = numbers(line, ",")
    pixels = F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0)))
    fits = F.forall(v, lambda x: x.isNotNull()) & F.forall(pixels, lambda x: x.between(0, 255))
    if n_pixels is not None:
        fits = fits & (F.size(v) == n_pixels + 1)
    rows = lines.filter(F.trim(line) != "").select(*keep, line, fitting(fits, v, line, bad, "no line of pixels").alias("_v"))
    label = F.when(F.get("_v", F.lit(0)) == 0, F.lit(1)).when(F.col("_v").isNotNull(), F.lit(-1))
    return rows.select(*keep, label.alias("label"), F.transform(F.slice("_v", 2, F.size("_v") - 1), lambda p: p / 255.0).alias("pixels"), *with_bad(line, bad, "_v"))


def read_labeled_pixels(spark: SparkSession, path: str, n_pixels: int = None, bad: str = None) -> DataFrame:
    return parse_labeled_pixels(spark.read.text(path), n_pixels=n_pixels, bad=bad)


def parse_labeled_text(lines: DataFrame, line: str = "value", keep: list = (), yes_no: bool = False, bad: str = None) -> DataFrame:
    """First token carries the label, the rest is the text.

    The label is the token's last character, or with ``yes_no`` 1 for yes and 0 otherwise. Every line has a first token,
    so all fit unless ``bad`` is given; then one without text doesn't, and with ``yes_no`` one that starts with another word.
    """
    parts = F.split(F.trim(line), r"\s+", 2)
    head = F.get(parts, F.lit(0))
    label = F.when(head == "yes", F.lit("1")).otherwise(F.lit("0")) if yes_no else F.substring(head, -1, 1)
    fits = F.lit(True)
    if bad:
        fits = (F.size(parts) == 2) & (head.isin("yes", "no") if yes_no else F.lit(True))
    rows = lines.filter(F.trim(line) != "").select(*keep, line, F.when(fits, label).alias("_l"), F.when(fits, F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("_t"))
    return rows.select(*keep, F.col("_l").alias("label"), F.col("_t").alias("text"), *with_bad(line, bad, "_l"))


def read_labeled_text(spark: SparkSession, path: str, yes_no: bool = False, bad: str = None) -> DataFrame:
    return parse_labeled_text(spark.read.text(path), yes_no=yes_no, bad=bad)
