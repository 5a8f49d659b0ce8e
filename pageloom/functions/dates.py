"""Dates of documents and of their metadata packets, as timestamps without zone; what isn't a date is null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The layouts, by their shape.
DOCUMENT = ((r"^[0-9]{14}\z", "yyyyMMddHHmmss"), (r"^[0-9]{12}\z", "yyyyMMddHHmm"), (r"^[0-9]{10}\z", "yyyyMMddHH"), (r"^[0-9]{8}\z", "yyyyMMdd"))
XMP = (
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{1,2}:[0-9]{2}:[0-9]{2}\.[0-9]{6}\z", "yyyy-MM-dd'T'H:mm:ss.SSSSSS"),
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{1,2}:[0-9]{2}\z", "yyyy-MM-dd'T'H:mm"),
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z", "yyyy-MM-dd"),
    (r"^[0-9]{4}-[0-9]{2}\z", "yyyy-MM"),
    (r"^[0-9]{4}\z", "yyyy"),
)
#: Fixed value: a time with seconds may have a fraction, and, only then, a zone.
SECONDS = r"^(.*T[0-9]{1,2}:[0-9]{2}:[0-9]{2})(?:[.,]([0-9]+))?(?:Z|[+-][0-9]{2}:[0-9]{2})?\z"


def _read(text: Column, layouts) -> Column:
    return reduce(lambda out, x: out.when(text.rlike(x[0]), F.try_to_timestamp(F.when(text.rlike(x[0]), text), F.lit(x[1]))), layouts, F.when(F.lit(False), F.lit(None).cast("timestamp"))).cast("timestamp_ntz")


def document_date(text: Column) -> Column:
    """``D:`` and 14, 12, 10 or 8 digits; what follows the fourteenth place, a zone as a rule, is ignored."""
    return F.when(text.startswith("D:"), _read(F.substring(text, 3, 14), DOCUMENT))


def xmp_date(text: Column) -> Column:
    """A year, a month, a day, or a time of day to the minute or second. A time with seconds may have a fraction, of which
    microseconds are kept, and a zone, which is cut off, as the clock of the place is kept; one to the minute has none."""
    fraction = F.rpad(F.substring(F.regexp_extract(text, SECONDS, 2), 1, 6), 6, "0")
    return _read(F.when(text.rlike(SECONDS), F.concat(F.regexp_extract(text, SECONDS, 1), F.lit("."), fraction)).otherwise(text), XMP)
