"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are normalised: lower case, and every run of ASCII characters that aren't
letters or digits becomes one space. Items are cut into overlapping windows of ``span`` bytes. A
document leaks an item if it holds one of its windows with at most ``rate`` edits per byte.

Filter: a window of m bytes found with e edits shares at least m + 1 - q (e + 1) of its q-grams with
the document, on at most e + 1 neighbouring diagonals (document position minus item position). Shared
q-grams are first counted per item over overlapping stretches of the document, then, for what is
left, per window in overlapping diagonal bands; bands that meet the bound are verified by an
alignment inside the band. The bound is exact, so no leak is lost.

The benchmark is the query set: it is read in blocks of ``BLOCK_BYTES``, each block goes to every
task, and the documents are scanned once per block, whole and without a shuffle.

Defined results: null texts leak nothing; items with fewer than ``Q`` bytes after normalising, or a
null text, match nothing; an item shorter than ``span`` is one window; if the bound would be below one
gram, fewer edits are allowed to a short window; repeated items count once per id; repeated
documents are judged one by one; an empty table gives no rows or, for an empty benchmark, no leaks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Q = 8
SPAN = 100
RATE = 0.1
BLOCK_BYTES = 4_000_000
CHUNK_BYTES = 2_000_000
SLICE_BYTES = 1_000_000
STRETCH = 7  # stretches of 2 ** STRETCH bytes
SLOTS = 22
COUNTERS = 8_000_000

PLAIN = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def normalise(text: bytes | None) -> bytes:
    low = (text or b"").decode("utf-8", "replace").lower().encode()
    return b" ".join(low.translate(PLAIN).split())


def edit_budget(length: int, rate: float = RATE) -> int:
    """Edits allowed to a window, so that the lemma still asks for a shared gram."""
    return max(0, min(int(rate * length), length // Q - 1))


def windows(length: int, span: int = SPAN) -> list[int]:
    """Where the windows of an item start: every quarter span, and one that ends with the item.

    So a passage of one and a quarter spans, wherever it begins, holds a whole window.
    """
    if length <= span:
        return [0]
    return sorted({*range(0, length - span, span // 4), length - span})


@dataclass
class Benchmark:
    """The gram index and the windows of a block of items."""

    items: list[tuple[int | None, bytes]]
    rate: float = RATE
    span: int = SPAN

    def __post_init__(self):
        self.items = [(i, t) for i, t in self.items if len(t) >= Q]
        grams, places = [], []
        self.starts, self.widths = [], []
        least = []
        for number, (_, text) in enumerate(self.items):
            g = grams_of(np.frombuffer(text, np.uint8))
            grams.append(g)
            places.append(np.stack([np.full(len(g), number), np.arange(len(g))]))
            width = min(len(text), self.span)
            self.starts.append(windows(len(text), self.span))
            self.widths.append(width)
            least.append(width + 1 - Q * (edit_budget(width, self.rate) + 1))
        self.least = np.array(least, np.int64)
        if not self.items:
            return
        every = np.concatenate(grams)
        order = np.argsort(every, kind="stable")
        self.grams, first, counts = np.unique(every[order], return_index=True, return_counts=True)
        self.first, self.counts = first, counts
        self.item_of, self.pos_of = np.concatenate(places, axis=1)[:, order]
        # One bit per slot says whether any gram falls there.
        self.slots = np.zeros(1 << SLOTS, bool)
        self.slots[slot_of(self.grams)] = True


def grams_of(buf: np.ndarray) -> np.ndarray:
    """The q-grams of a buffer as 64-bit numbers (Q is 8)."""
    n = len(buf) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return np.ndarray((n,), np.uint64, buf.tobytes(), strides=(1,)).copy()


def slot_of(grams: np.ndarray) -> np.ndarray:
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)


def _shared(buf: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, item, item position) of shared grams in stretches with enough of an item's."""
    n_items = len(bench.items)
    size = max(4 << STRETCH, min(SLICE_BYTES, (COUNTERS // n_items) << STRETCH))
    overlap = 2 << STRETCH
    out = []
    for begin in range(0, max(1, len(buf) - overlap), size):
        part = grams_of(buf[begin:begin + size + overlap])
        at = np.flatnonzero(bench.slots[slot_of(part)])
        found = np.searchsorted(bench.grams, part[at])
        found[found == len(bench.grams)] = 0
        same = bench.grams[found] == part[at]
        at, found = at[same], found[same]
        many = bench.counts[found]
        pos = np.repeat(at, many)
        within = np.arange(len(pos)) - np.repeat(np.cumsum(many) - many, many)
        entry = np.repeat(bench.first[found], many) + within
        item = bench.item_of[entry]
        cells = (len(part) >> STRETCH) + 2
        cell = (pos >> STRETCH) * n_items + item
        counts = np.bincount(cell, minlength=cells * n_items).reshape(cells, n_items)
        two = counts.copy()
        two[:-1] += counts[1:]
        enough = two >= bench.least
        enough[1:] |= enough[:-1]
        keep = enough.reshape(-1)[cell]
        out.append((pos[keep] + begin, item[keep], bench.pos_of[entry[keep]]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _align(buf: np.ndarray, start: np.ndarray, pattern: np.ndarray, band: int) -> np.ndarray:
    """Fewest edits of each pattern (rows of equal length) inside its band of ``band`` diagonals."""
    steps = np.arange(band)
    best = np.zeros((len(start), band), np.int32)
    for i in range(pattern.shape[1]):
        at = start[:, None] + i + steps
        text = buf[np.clip(at, 0, len(buf) - 1)]
        text = np.where((at < 0) | (at >= len(buf)), 0, text)
        down = best + (text != pattern[:, i:i + 1])
        skip = np.full_like(best, 1 << 20)
        skip[:, :-1] = best[:, 1:] + 1
        best = np.minimum(down, skip)
        # Inserted document bytes move right along the band.
        best = np.minimum.accumulate(best - steps, axis=1) + steps
    return best.min(axis=1)


def find_leaks(buf: np.ndarray, bench: Benchmark) -> Iterator[tuple[int, int, int, int]]:
    """(position, item number, window start, edits) of verified windows."""
    pos, item, ipos = _shared(buf, bench)
    todo = defaultdict(list)
    for k in np.unique(item).tolist():
        mine = item == k
        p, ip, width = pos[mine], ipos[mine], bench.widths[k]
        budget = edit_budget(width, bench.rate)
        band = budget + 1
        for start in bench.starts[k]:
            inside = (ip >= start) & (ip + Q <= start + width)
            cell = (p[inside] - ip[inside] + len(buf)) // band
            cells, first, counts = np.unique(cell, return_index=True, return_counts=True)
            if not len(cells):
                continue
            nxt = np.zeros_like(counts)
            nxt[:-1] = np.where(cells[1:] == cells[:-1] + 1, counts[1:], 0)
            for c, one, both in zip(cells.tolist(), counts.tolist(), (counts + nxt).tolist()):
                if both >= bench.least[k]:
                    todo[width].append((c * band - len(buf), k, start, band, budget))
    for width, found in todo.items():
        budget, band = found[0][4], found[0][3]
        diag = np.array([x[0] for x in found], np.int64)
        pattern = np.stack([np.frombuffer(bench.items[x[1]][1], np.uint8)[x[2]:x[2] + width]
                            for x in found])
        begin = diag + np.array([x[2] for x in found]) - budget
        edits = _align(buf, begin, pattern, 2 * band + 2 * budget)
        for i in np.flatnonzero(edits <= budget).tolist():
            yield max(0, int(begin[i]) + budget), found[i][1], found[i][2], int(edits[i])


def leaks_of(texts: list[bytes], bench: Benchmark) -> list[dict[int, tuple[set[int], int]]]:
    """Per text: item number -> (window starts found, fewest edits)."""
    out: list[dict[int, tuple[set[int], int]]] = [{} for _ in texts]
    if not bench.items:
        return out
    gap = b"\0" * (int(bench.rate * bench.span) + 2)
    begin = 0
    while begin < len(texts):
        parts, ends, size = [], [], 0
        while begin + len(parts) < len(texts) and (not parts or size < CHUNK_BYTES):
            parts.append(normalise(texts[begin + len(parts)]))
            size += len(parts[-1]) + len(gap)
            ends.append(size)
        buf = np.frombuffer(gap.join([*parts, b""]), np.uint8)
        for at, item, start, edits in find_leaks(buf, bench):
            # The middle of the window, by its own width, lies in its text and not in the gap behind it.
            mid = at + bench.widths[item] // 2
            doc = begin + min(int(np.searchsorted(ends, mid, side="right")), len(parts) - 1)
            seen, least = out[doc].get(item, (set(), edits))
            out[doc][item] = (seen | {start}, min(least, edits))
        begin += len(parts)
    return out


LEAK = T.StructType([T.StructField(c, T.LongType()) for c in ("item_id", "windows", "found", "edits")])


def benchmark_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int = BLOCK_BYTES
                     ) -> Iterator[list[tuple[int | None, bytes]]]:
    """The distinct items, normalised, in blocks of bounded size."""
    block, size = [], 0
    rows = items.where(F.col(text).isNotNull()).select(
        F.col(item_id).cast("bigint").alias("i"), F.col(text).cast("binary").alias("t")).distinct()
    for r in rows.toLocalIterator():
        block.append((r["i"], normalise(bytes(r["t"]))))
        size += len(block[-1][1]) + 1
        if size >= block_bytes:
            yield block
            block, size = [], 0
    yield block


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
          item_text: str = "text", rate: float = RATE, span: int = SPAN) -> Column:
    """An array with (item_id, windows, found, edits) for every item that a document's text leaks."""
    out = []
    for block in benchmark_blocks(items, item_id, item_text):
        held = docs.sparkSession.sparkContext.broadcast(block)

        @F.arrow_udf(T.ArrayType(LEAK))
        def find(cols: Iterator[pa.Array]) -> Iterator[pa.Array]:
            bench = Benchmark(held.value, rate, span)
            for col in cols:
                found = leaks_of(col.to_pylist(), bench)
                yield pa.array([[
                    {"item_id": bench.items[k][0], "windows": len(bench.starts[k]),
                     "found": len(seen), "edits": edits} for k, (seen, edits) in sorted(d.items())]
                    for d in found], pa.list_(pa.struct([(f.name, pa.int64()) for f in LEAK])))

        out.append(find(F.col(text).cast("binary")))
    return F.concat(*out) if len(out) > 1 else out[0]


def drop_leaking(docs: DataFrame, items: DataFrame, text: str = "text", **kw) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    rows = docs.select(F.struct("*").alias("row"), leaks(docs, items, text, **kw).alias("leaks"))
    return rows.where(F.size("leaks") == 0).select("row.*")
