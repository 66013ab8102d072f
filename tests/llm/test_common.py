"""Arrow batches that Python gets, and what a worker keeps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from graphspark.llm.common import ARROW_BYTES, id_text


def test_arrow_batches_are_bounded_by_bytes(make_docs):
    """Thousands of short texts make one batch, few long ones many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.num_rows], pa.int64()), pa.array([x.nbytes], pa.int64())], ["n", "size"])

    sizes = lambda texts: [(x.n, x.size) for x in id_text(make_docs(texts).coalesce(1)).mapInArrow(run, "n long, size long").collect()]
    long = sizes(["x" * 1_000_000] * 20)
    assert sum(n for n, _ in long) == 20 and max(size for _, size in long) < ARROW_BYTES + 2_000_000
    assert len(sizes(["some words"] * 5000)) == 1
