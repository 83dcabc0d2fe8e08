"""Spans found in texts: ordering, digests, and a partition-wise text scan."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, sliced

Span = tuple[str, int, int]  # kind, start, end: code points, end exclusive


def joined(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then in the order of kinds, joined by commas."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2])))


def digest(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(joined(spans, kinds).encode()).hexdigest()


def scan_texts(docs: DataFrame, id_col: str, text_col: str, setup: Callable[[], Callable[[str], tuple]], columns: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """Apply a text function, made once per task by ``setup``, to every whole text; null is the empty text.

    Rows go through in Arrow batches, cut again to parts of half a megabyte, so memory follows the longest text and not the partition.
    """
    slim = docs.select(col(id_col).cast("bigint").alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), *[(n, t) for n, t, _ in columns]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = setup()
        for part in sliced(batches, 1):
            rows = [f(t) for t in part.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, (_, t, _) in zip(cols, columns, strict=True)]], schema=schema)

    return slim.mapInArrow(run, ", ".join(["doc_id bigint", *[f"`{n}` {d}" for n, _, d in columns]]))
