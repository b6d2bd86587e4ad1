"""What the scans for secrets and personal data share: running a finder over whole texts, and digests of its spans."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

Span = tuple[str, int, int]
SPANS = "array<struct<kind:string,start:long,end:long>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_spans(
    docs: DataFrame, pattern: str, make_finder: Callable[[], Callable[[str], list[Span]]], id_column: str, text_column: str
) -> DataFrame:
    """(doc_id, spans) of all rows. Only texts that ``pattern`` (RE2) is found in are given to the finder, whole.

    A null text counts as empty. Spans are in code points, end exclusive, in the finder's order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = make_finder()
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            likely = pc.match_substring_regex(texts, pattern).to_pylist()
            found = [
                [dict(zip(("kind", "start", "end"), s, strict=True)) for s in finder(texts[k].as_py())] if hit else []
                for k, hit in enumerate(likely)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _ARROW)], ["doc_id", "spans"])

    columns = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return columns.mapInArrow(run, f"doc_id {dict(columns.dtypes)['doc_id']}, spans {SPANS}")


def in_order(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.sha2(joined(F.filter(spans, lambda s: s["kind"].isin(*kinds))), 256)
