"""Word sets, their similarity, and the quoting of rendered fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of the characters that part words (fixed values).
SPLIT = r"[ \n\r\t.,!?;:()\[\]{}\"'#*\-_/\\@<>]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_set(content: Column) -> Column:
    """Distinct words of more than three bytes, ASCII letters in lower case."""
    return F.array_distinct(F.filter(F.split(ascii_lower(content), SPLIT), lambda w: F.octet_length(w) > 3))


def jaccard(common: Column, a: Column, b: Column) -> Column:
    """In single precision, as scores and thresholds are compared; 0 if either set is empty."""
    score = (common.cast("float") / (a + b - common).cast("float")).cast("float")
    return F.when((a > 0) & (b > 0), score).otherwise(F.lit(0.0).cast("float"))


def csv_field(text: Column) -> Column:
    """Quoted if it holds a comma, a quote or a line feed; quotes inside are doubled."""
    return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_list(values: Column, always: bool = False) -> Column:
    """Nothing, one bare value, or several in quotes; with ``always``, quoted whatever there is."""
    quoted = F.concat(F.lit('"'), F.array_join(values, ","), F.lit('"'))
    return quoted if always else F.when(F.size(values) == 0, F.lit("")).when(F.size(values) == 1, values[0]).otherwise(quoted)
