"""String expressions that several operators share."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that separates words: space and \t \n \v \f \r.
BLANK = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """The text's words in order; an empty array for null or blank text."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, BLANK_CLASS + "+"))


def hexadecimal(value: Column) -> Column:
    """A long as sixteen lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))
