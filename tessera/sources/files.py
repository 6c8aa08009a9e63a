"""Files as tables: numbering and ZIP listings."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def numbered(rows: DataFrame, parent: str, order: list[Column], name: str = "number") -> DataFrame:
    """Rows with their number within the parent, from 1."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(parent).orderBy(*order)))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            try:
                entries = zipfile.ZipFile(io.BytesIO(content or b"")).infolist()
            except zipfile.BadZipFile:
                yield pa.RecordBatch.from_pydict({"path": [path], "entry": [None], "size": [None], "packed": [None], "encrypted": [None]}, schema=_LISTING)
                continue
            rows = [(path, e.filename, e.file_size, e.compress_size, bool(e.flag_bits & 1)) for e in entries if not e.is_dir()]
            yield pa.RecordBatch.from_pydict(dict(zip(_LISTING.names, map(list, zip(*rows)))) if rows else {n: [] for n in _LISTING.names}, schema=_LISTING)


_LISTING = pa.schema([("path", pa.string()), ("entry", pa.string()), ("size", pa.int64()), ("packed", pa.int64()), ("encrypted", pa.bool_())])


def zip_entries(files: DataFrame, most_bytes: int = 512 << 20, most_ratio: int = 200) -> DataFrame:
    """files (path, content; as of the binaryFile source) as entries with the code that rejects each, or null."""
    rows = files.select("path", "content").mapInArrow(_listed, "path string, entry string, size long, packed long, encrypted boolean")
    e = F.col("entry")
    unsafe = (e == "") | e.startswith("/") | e.rlike(r"^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)|[\x00-\x1f]|[. ]([/\\]|$)")
    code = F.when(e.isNull(), "not_a_container").when(unsafe, "unsafe_path").when(F.col("encrypted"), "encrypted").when(F.col("size") > most_bytes, "too_large").when(F.col("size") > F.col("packed") * most_ratio, "ratio")
    return rows.withColumn("rejected", code)
