"""Files through a function of one's own: measures of the file, and items found in it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from textloom.ship import ship


def surveyed(files: DataFrame, survey: Callable[[list[str]], tuple[dict, list[dict]] | None], measures: T.StructType, items: T.StructType, key: str = "path", text: str = "content") -> DataFrame:
    """(key, measures, items): what ``survey`` makes of a file's lines; files for which it returns None go.

    ``survey`` runs in Python workers, a file at a time, in Arrow batches. A
    file that isn't opened (null) has no lines; measures and fields that it
    leaves out are null.
    """
    ship(files.sparkSession)
    schema = T.StructType([files.schema[key], T.StructField("measures", measures), T.StructField("items", T.ArrayType(items))])
    kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lines = (t or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")
                if lines[-1] == "":
                    lines.pop()
                made = survey(lines)
                if made is not None:
                    found.append((k, *made))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds)], names=schema.names)

    return files.select(key, text).mapInArrow(run, schema)
