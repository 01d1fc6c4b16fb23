"""Missing values, type families, numbers and rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that count as missing when a delimited file is read.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity)$"


def quoted(name: str) -> str:
    """A column name as one identifier, whatever dots or backticks it holds."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def is_numeric(kind: T.DataType) -> bool:
    """Numbers proper: not booleans."""
    return isinstance(kind, T.NumericType)


def is_float(kind: T.DataType) -> bool:
    return isinstance(kind, T.FloatType | T.DoubleType)


def is_temporal(kind: T.DataType) -> bool:
    return isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType)


def is_nested(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType | T.MapType | T.StructType)


def family(kind: T.DataType) -> str:
    """Types whose values can be equal: a number never equals a text that looks like it."""
    if is_numeric(kind):
        return "number"
    if is_temporal(kind):
        return "time"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.StringType):
        return "text"
    return kind.simpleString()


def present(name: str, kind: T.DataType) -> Column:
    """The column with NaN as null: both are missing."""
    c = col(name)
    return F.when(~F.isnan(c), c) if is_float(kind) else c


def missing(name: str, kind: T.DataType) -> Column:
    c = col(name)
    return c.isNull() | F.isnan(c) if is_float(kind) else c.isNull()


def as_text(name: str, kind: T.DataType) -> Column:
    """A value as text for samples; nested values as JSON."""
    c = present(name, kind)
    if is_nested(kind):
        return F.to_json(c) if not isinstance(kind, T.ArrayType) or not is_nested(kind.elementType) else F.to_json(c)
    return c.cast("string")


def canonical(name: str, kind: T.DataType) -> Column:
    """A text that is equal for equal values of one family: 1 and 1.0 agree, 1 and '1' are of two families."""
    c = present(name, kind)
    if is_numeric(kind):
        number = c.cast("double")
        whole = (F.abs(number) < 9.0e15) & (number == F.floor(number))
        text = F.when(whole, number.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string") if not is_float(kind) else number.cast("string"))
        return text if is_float(kind) or isinstance(kind, T.DecimalType) else c.cast("decimal(38,0)").cast("string")
    if is_temporal(kind):
        return F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if is_nested(kind):
        return F.to_json(c)
    return c.cast("string")


def to_number(c: Column, kind: T.DataType) -> Column:
    """A double, or null where the value is not a number."""
    if is_float(kind):
        value = c.cast("double")
        return F.when(~F.isnan(value), value)
    if isinstance(kind, T.NumericType | T.BooleanType):
        return c.cast("double")
    if not isinstance(kind, T.StringType):
        return F.lit(None).cast("double")
    text = F.trim(c)
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def pandas_like(kind: T.DataType, nullable: bool = False) -> str:
    """The name that a data frame read from text would give the column's type."""
    if isinstance(kind, T.BooleanType):
        return "object" if nullable else "bool"
    if isinstance(kind, T.IntegralType):
        return "float64" if nullable else "int64"
    if is_numeric(kind):
        return "float64"
    if is_temporal(kind):
        return "datetime64[ns]"
    if isinstance(kind, T.DayTimeIntervalType):
        return "timedelta64[ns]"
    return "object"


def without_na_tokens(df: DataFrame, tokens: tuple[str, ...] = NA_TOKENS) -> DataFrame:
    """df with every text that stands for a missing value as null."""
    return df.select(*[F.when(~col(f.name).isin(*tokens), col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else col(f.name) for f in df.schema.fields])
