"""Row blocks for the Arrow-side operators: bounded slices of texts, whole rows passed through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from talentscope.llm.common import named

#: Characters of text handled at once inside a task (a longer text is one slice).
SLICE_CHARS = 1 << 20


def slices(texts: list[str | None], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """(start, end) ranges of rows holding at most ``limit`` characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def map_texts(df: DataFrame, keys: list[str], text: str, schema: StructType,
              make: Callable[[], Callable[[list], dict]]) -> DataFrame:
    """``keys`` columns plus the columns of ``schema``, computed from ``text``.

    ``make()`` runs once per task and returns a function from a list of texts to
    {column name: list or Arrow array}. Texts reach it in bounded slices. The keys travel
    as one struct, whatever their names."""
    src = df.select(F.struct(*map(named, keys)).alias("row"), named(text).alias("text"))
    computed = [StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)]
    out = StructType([src.schema["row"], *computed])

    def run(batches):
        fn = make()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for s, e in slices(texts):
                cols = fn(texts[s:e])
                part = batch.slice(s, e - s)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0)] + [c if isinstance(c, pa.Array) else pa.array(c)
                                        for c in (cols[n] for n in schema.names)], names=out.names)
    return src.mapInArrow(run, out).select(
        *[F.col("row").getField(k).alias(k) for k in keys],
        *[F.col(c.name).alias(f.name) for c, f in zip(computed, schema.fields)])
