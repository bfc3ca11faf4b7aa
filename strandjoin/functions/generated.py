"""Shape of the code that Spark generates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_own_method(frame: DataFrame) -> DataFrame:
    """The same rows through a generator, so that the code of what follows is a method of its own.

    Spark puts the code of a chain of operators into one method, and the JVM compiles none of more
    than 8,000 bytes: such a method is interpreted for every row, many times slower.
    """
    return frame.select(F.inline(F.array(F.struct(*frame.columns))))
