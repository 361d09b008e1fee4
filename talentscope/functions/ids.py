"""SCL-19: generated row ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_uuid(table: str, batch: Column | str, *key: Column) -> Column:
    """A name-based UUID (version 3) of the table, the batch and the row's key in it.

    A random id would change when a lost task is run again; this one depends on the
    row alone, so a retried write produces the same ids. NULL key parts count as
    empty text; the parts are joined by ``/``."""
    batch = F.lit(batch) if isinstance(batch, str) else batch
    parts = [F.coalesce(k.cast("string"), F.lit("")) for k in key]
    h = F.md5(F.concat_ws("/", F.lit(table), batch, *parts))

    def cut(start, n):
        return F.substring(h, start, n)
    variant = F.translate(cut(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-3"), cut(14, 3), F.lit("-"), variant,
                    cut(18, 3), F.lit("-"), cut(21, 12))
