"""Packing documents into fixed token windows by Karmarkar-Karp multiway differencing.

Every document becomes its ids and an end id. Whole windows are cut off its front and stand alone; what is left is cut into
parts, and a group of parts is dealt to windows by differencing: every part begins as a partial partition of its own, and the
two partial partitions with the widest imbalance are merged, the largest sums of one meeting the smallest of the other, until
one is left. The windows are then nearly equal; if one exceeds the capacity, the window count rises and the group is dealt
again. Groups are made inside a task from the rows it reads, in order, so there is no shuffle and no group grows with the input.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import textkit as tk
from .tokens import Encoder

CAPACITY = 1024
PART = 256  #: tokens of a part at most
GROUP = 2048  #: parts dealt together
SLACK = 4  #: tokens that differing windows need, as a rule
END = 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, 0 to k - 1, of each part."""
    heap, nodes = [], [[i] for i in range(len(sizes))]
    for i, s in enumerate(sizes.tolist()):
        heap.append((-s, i, np.array([s]), np.array([i])))
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a, p = heapq.heappop(heap)  # sums in descending order; those beyond the last are 0
        _, _, b, q = heapq.heappop(heap)
        if len(a) < len(b):
            a, b, p, q = b, a, q, p
        over = len(a) + len(b) - k
        if over <= 0:
            sums, slots = np.concatenate([a, b]), np.concatenate([p, q])
        else:
            # the over smallest sums of a, from the smallest up, meet those of b from the largest down
            meet = np.arange(len(a) - over, len(a))[::-1]
            for x, y in zip(p[meet].tolist(), q[:over].tolist(), strict=True):
                nodes[x].extend(nodes[y])
            sums = np.concatenate([a, b[over:]])
            sums[meet] += b[:over]
            slots = np.concatenate([p, q[over:]])
        order = np.argsort(-sums, kind="stable")
        sums, slots = sums[order], slots[order]
        heapq.heappush(heap, (int((sums[-1] if len(sums) == k else 0) - sums[0]), tie, sums, slots))
        tie += 1
    out = np.empty(len(sizes), np.int64)
    for w, slot in enumerate(heap[0][3].tolist() if heap else []):
        out[nodes[slot]] = w
    return out


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each part; the window count rises from the least that leaves SLACK tokens each until none is over the capacity."""
    k = max(1, -(-int(sizes.sum()) // (capacity - SLACK)))
    while True:
        window = differencing(sizes, k)
        if np.bincount(window, sizes).max() <= capacity:
            return window
        k += max(1, k // 200)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, part: int = PART, group: int = GROUP) -> DataFrame:
    """One row per piece, see SCHEMA; sequence_id holds the task's number above its count of sequences.

    A null text is an empty one: its only id is the end id. Rows with the same id, and rows without one, are documents of
    their own. An empty table gives no pieces.
    """

    def packed(batches):
        encoder, ready, wait = Encoder.of(tokenizer), [], []
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33

        def deal() -> None:
            nonlocal sequence
            if wait:
                sizes = np.array([w[2] for w in wait])
                window = windows(sizes, capacity)
                order = np.argsort(window, kind="stable")
                ends = np.cumsum(sizes[order])
                first = np.flatnonzero(np.diff(window[order], prepend=-1))
                base = np.repeat((ends - sizes[order])[first], np.diff(np.append(first, len(order))))
                for i, at in zip(order.tolist(), (ends - sizes[order] - base).tolist(), strict=True):
                    ready.append((*wait[i], sequence + int(window[i]), at))
                sequence += int(window.max()) + 1
                wait.clear()

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*ready, strict=True) if ready else [[]] * 7)], [f.split()[0] for f in SCHEMA.split(", ")])
            ready.clear()
            return out

        for got in batches:
            ids = got.column("doc_id").to_pylist()
            for c in tk.chunks(got.column("text")):
                flat, offs = encoder.ids(c)
                flat = np.insert(flat, offs[1:], END).astype("<u4")
                offs = (offs + np.arange(len(offs))).tolist()
                for d in range(len(c)):
                    a, b = offs[d], offs[d + 1]
                    for s in range(a, b, capacity):
                        if b - s >= capacity:
                            ready.append((ids[c.row + d], s - a, capacity, zlib.crc32(flat[s : s + capacity]), b - a, sequence, 0))
                            sequence += 1
                            continue
                        for t in range(s, b, part):
                            wait.append((ids[c.row + d], t - a, min(part, b - t), zlib.crc32(flat[t : min(t + part, b)]), b - a))
                        if len(wait) >= group:
                            deal()
                if len(ready) >= 10_000:
                    yield batch()
        deal()
        yield batch()

    return docs.select("doc_id", "text").mapInArrow(packed, SCHEMA)


def op5(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
