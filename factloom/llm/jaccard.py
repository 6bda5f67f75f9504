"""Links between sets at a Jaccard similarity, verified exactly and thinned to a spanning forest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def similar_links(sets: list[np.ndarray], side: np.ndarray | None, least: float) -> list[tuple[int, int]]:
    """Links at Jaccard ``least`` or more, thinned to a spanning forest; with ``side`` only links between two sides."""
    links: list[tuple[int, int]] = []
    size = np.array([len(s) for s in sets])
    left = np.arange(len(sets))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            maybe = (np.minimum(size[left], size[x]) >= least * np.maximum(size[left], size[x])) & (True if side is None else side[left] != side[x])
            try_ = left[maybe]
            if not len(try_):
                continue
            flat = np.concatenate([sets[y] for y in try_])
            common = np.add.reduceat(np.isin(flat, sets[x]).astype(np.int64), np.cumsum(size[try_]) - size[try_])
            near = try_[common >= least * (size[try_] + size[x] - common) - 1e-9]
            if len(near):
                links.extend((x, int(y)) for y in near)
                queue.extend(near.tolist())
                left = left[~np.isin(left, near)]
    return links


def verify_sets(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by band and pair of blocks; a group may span batches."""
        key, rows = None, []

        def links():
            if len(rows) < 2:
                return
            got = similar_links([r[2] for r in rows], None if key[1] == key[2] else np.array([r[0] for r in rows]), least)
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([rows[x][1] for x, _ in got], pa.int64()), pa.array([rows[y][1] for _, y in got], pa.int64())], ["a", "b"])

        for batch in batches:
            band, i, j, part, content = (batch.column(k).to_pylist() for k in range(5))
            flat, off = batch.column(5).values.to_numpy(zero_copy_only=False), batch.column(5).offsets.to_numpy()
            for n in range(batch.num_rows):
                if (band[n], i[n], j[n]) != key:
                    yield from links()
                    key, rows = (band[n], i[n], j[n]), []
                rows.append((part[n], content[n], flat[off[n] : off[n + 1]].copy()))
        yield from links()

    return run
