"""Sheets as cells: one row per cell, with its kind, so that untyped tables can be profiled as DataFrames.

``cells``: ``sheet string, row_ix long, col_ix int, s string, n double, fmt string``
- ``s`` is the text, ``n`` the number if the cell held one, ``fmt`` its number
format if known.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.amounts import number_or_null

SCHEMA = "sheet string, row_ix long, col_ix int, s string, n double, fmt string"
# How dates and numbers look as text, and day numbers that pass for dates.
DATE_SHAPES = (
    r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}$", r"^[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}$", r"^\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}$", r"^[A-Za-z]{3,9}\s+\d{4}$",
)
NUMBER_SHAPE = r"^\(?[-+]?[$£€¥]?\s?\d{1,3}(,\d{3})*(\.\d+)?%?\)?$"
FIRST_DAY_NUMBER, LAST_DAY_NUMBER = 32874, 49674

STRETCH = 1 << 16  #: Rows that are put in order together
HALO = 5  #: Rows below a header that are looked at
FOREMOST = 5  #: Values shown of each column


def from_grids(spark: SparkSession, grids: dict[str, Sequence[Sequence]], formats: dict[str, Sequence[Sequence[str]]] | None = None) -> DataFrame:
    """Cells of in-memory sheets. Numbers stay numbers; rows may be of different lengths."""
    rows = []
    for sheet, values in grids.items():
        for i, row in enumerate(values):
            for j, value in enumerate(row):
                fmt = None
                if formats and sheet in formats and i < len(formats[sheet]) and j < len(formats[sheet][i]):
                    fmt = formats[sheet][i][j]
                if value is not None and value != "":
                    number = float(value) if isinstance(value, int | float) and not isinstance(value, bool) else None
                    rows.append((sheet, i, j, str(value), number, fmt))
    return spark.createDataFrame(rows, SCHEMA)


def from_table(df: DataFrame, sheet: str, order: str) -> DataFrame:
    """Cells of a typed table: the header is row 0, data rows follow by their ``order`` column, a unique row number from 0."""
    names = [name for name in df.columns if name != order]
    numeric = {name for name, kind in df.dtypes if kind in ("int", "bigint", "double", "float", "smallint", "tinyint") or kind.startswith("decimal")}
    parts = [F.struct(F.lit(j).alias("col_ix"), F.col(name).cast("string").alias("s"), (F.col(name).cast("double") if name in numeric else F.lit(None).cast("double")).alias("n")) for j, name in enumerate(names)]
    cells = df.select((F.col(order) + 1).cast("long").alias("row_ix"), F.explode(F.array(*parts)).alias("c")).select(F.lit(sheet).alias("sheet"), "row_ix", "c.col_ix", "c.s", "c.n", F.lit(None).cast("string").alias("fmt"))
    header = df.sparkSession.createDataFrame([(sheet, 0, j, name, None, None) for j, name in enumerate(names)], SCHEMA)
    return header.unionByName(cells.filter("s is not null and s <> ''"))


def kind() -> Column:
    """``blank``, ``date``, ``numeric`` or ``text``. A number format goes before what the cell holds."""
    text = F.trim("s")
    fmt = F.regexp_replace(F.coalesce("fmt", F.lit("")), r"\[[^\]]*\]", "")
    digits = fmt.rlike("[#0]")
    as_date = ~F.lower(fmt).isin("general", "@") & fmt.rlike("(?i)[dmy]") & ~digits
    day_number = (F.coalesce("fmt", F.lit("")) == "") & F.col("n").between(FIRST_DAY_NUMBER, LAST_DAY_NUMBER)
    date_text = F.lit(False)
    for shape in DATE_SHAPES:
        date_text = date_text | text.rlike(shape)
    return (
        F.when(F.col("s").isNull() | (F.col("s") == ""), "blank")
        .when(as_date, "date")
        .when(digits, "numeric")
        .when(F.col("n").isNotNull(), F.when(day_number, "date").otherwise("numeric"))
        .when(text == "", "blank")
        .when(date_text, "date")
        .when(text.rlike(NUMBER_SHAPE), "numeric")
        .otherwise("text")
    )


def sheet_keys(cells: DataFrame) -> list[str]:
    """The columns that tell sheets apart: the name, and the workbook's path if there is one."""
    return [name for name in ("path", "sheet") if name in cells.columns]


def header_rows(cells: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``sheet, header_ix`` (and ``path``): the first row with two cells or more, 60 % of them text, and a cell in the five rows below; else -1.

    Rows are looked at in stretches, each with the first five rows of the one behind it.
    """
    keys = sheet_keys(cells)
    filled = cells.filter("s is not null and s <> ''")
    wordy = F.col("n").isNull() & F.trim("s").try_cast("double").isNull() & (F.trim("s") != "")
    rows = filled.groupBy(*keys, "row_ix").agg(F.count("*").alias("filled"), F.count_if(wordy).alias("wordy"))
    own = F.floor(F.col("row_ix") / stretch)
    also_before = F.when(F.pmod("row_ix", F.lit(stretch)) < HALO, F.array(own, own - 1)).otherwise(F.array(own))
    rows = rows.withColumn("stretch", F.explode(also_before))
    below = Window.partitionBy(*keys, "stretch").orderBy("row_ix").rangeBetween(1, HALO)
    found = rows.withColumn("below", F.count("*").over(below)).filter(own == F.col("stretch")).filter("filled >= 2 and wordy >= 0.6 * filled and below > 0")
    first = found.groupBy(*keys).agg(F.min("row_ix").alias("header_ix"))
    return cells.select(*keys).distinct().join(first, keys, "left").select(*keys, F.coalesce("header_ix", F.lit(-1)).alias("header_ix"))


def _runs(numbers: DataFrame, column: list[str]) -> DataFrame:
    """Counts of signs, and shares of numbers not below or not above the one before. Rows are put in order by stretches, which are then joined end to end."""
    stretch = F.floor(F.col("row_ix") / STRETCH)
    within = Window.partitionBy(*column, "stretch").orderBy("row_ix")
    number, before = F.col("number"), F.col("before")
    parts = (
        numbers.withColumn("stretch", stretch)
        .withColumn("before", F.lag("number").over(within))
        .groupBy(*column, "stretch")
        .agg(
            F.count("*").alias("n_numbers"), F.count_if(number > 0).alias("n_positive"), F.count_if(number < 0).alias("n_negative"),
            F.count_if(number >= before).alias("up"), F.count_if(number <= before).alias("down"), F.min_by("number", "row_ix").alias("head"), F.max_by("number", "row_ix").alias("tail"),
        )
        .withColumn("before", F.lag("tail").over(Window.partitionBy(*column).orderBy("stretch")))
    )
    steps = F.sum("n_numbers") - 1
    return parts.groupBy(*column).agg(
        *(F.sum(n).alias(n) for n in ("n_numbers", "n_positive", "n_negative")),
        F.try_divide(F.sum("up") + F.count_if(F.col("head") >= before), steps).alias("increasing"),
        F.try_divide(F.sum("down") + F.count_if(F.col("head") <= before), steps).alias("decreasing"),
    )


def profile(cells: DataFrame) -> DataFrame:
    """One row per sheet and column: counts of kinds, distinct values and signs, the five most frequent values, the first five values, and monotonic shares.

    A column is never put in order as a whole: rows are by stretches, and of its
    values each task gives its five foremost.
    """
    keys = sheet_keys(cells)
    column = [*keys, "col_ix"]
    joined = cells.join(header_rows(cells), keys)
    names = joined.filter("row_ix = header_ix").select(*column, F.col("s").alias("header"))
    data = joined.filter("row_ix > header_ix").withColumn("kind", kind())
    n_rows = data.groupBy(*keys).agg((F.max("row_ix") - F.first("header_ix")).alias("n_rows"))
    data = data.filter("kind <> 'blank'").withColumn("number", F.when(F.col("kind") == "numeric", F.coalesce("n", number_or_null(F.col("s")))))
    signs = _runs(data.filter("number is not null"), column)
    values = data.groupBy(*column, F.trim("s").alias("value")).agg(F.count("*").alias("n"), F.min("row_ix").alias("first_ix"), *(F.count_if(F.col("kind") == k).alias(k) for k in ("date", "numeric", "text")))
    orders = {"top_values": [F.desc("n"), F.col("first_ix")], "samples": [F.col("first_ix")]}

    def foremost(name: str) -> DataFrame:
        """The first values of each column. A task keeps ``FOREMOST`` of its own before the shuffle (``WindowGroupLimit`` in the plan), so no column is put in order as a whole."""
        place = F.row_number().over(Window.partitionBy(*column).orderBy(*orders[name]))
        best = values.withColumn("place", place).filter(F.col("place") <= FOREMOST)
        return best.groupBy(*column).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias(name))

    shape = values.groupBy(*column).agg(F.sum("n").alias("filled"), F.count("*").alias("n_distinct"), *(F.sum(k).alias(f"n_{k}") for k in ("date", "numeric", "text")))
    for name in orders:
        shape = shape.join(foremost(name), column, "left")
    out = names.join(shape, column, "full").join(signs, column, "left").join(n_rows, keys, "left")
    counts = ("filled", "n_distinct", "n_date", "n_numeric", "n_text", "n_numbers", "n_positive", "n_negative", "n_rows")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
