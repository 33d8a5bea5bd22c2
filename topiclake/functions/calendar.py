"""Calendar parts of a timestamp, under the column names of the time dimension."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_minute(ts: Column | str) -> Column:
    return F.date_trunc("minute", ts).cast("timestamp")


def calendar_parts(ts: Column | str) -> list[Column]:
    return [
        F.month(ts).alias("MES"),
        F.dayofmonth(ts).alias("DIA"),
        F.hour(ts).alias("HORA"),
        F.minute(ts).alias("MINUTO"),
        F.date_format(ts, "EEEE").alias("DIA_SEMANA"),
    ]
