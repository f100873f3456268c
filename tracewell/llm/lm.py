"""Scoring texts with a weighted backoff automaton, learned and applied in blocks.

Model: n-grams up to ``order`` over lower-cased words, a start and an end, smoothed by a hierarchical
Dirichlet prior: p(w | h) = (c(hw) + k p(w | h')) / (c(h) + k), h' being h without its first word, and
p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)). As an automaton, every n-gram below ``order`` that was seen is
a state with an arc for each word seen after it, whose weight is log10 p(w | h), and a failure arc to
h' of weight log10(k / (c(h) + k)). A text is read once from left to right: while the state has no arc
for the word its failure arc is taken, then the arc, which leads to the next state.

The model grows with the corpus and is never in one place. Documents are dealt out in blocks of
bounded size. A block lists its distinct n-grams with their training counts and sends each list, cut by
hash, to buckets; a bucket adds up the counts of all blocks and answers each block with the totals, in
the order of its list. With these totals a block builds its part of the automaton, all states and
arcs that its texts can visit, and runs it. An n-gram goes over the network once per block, however
often it occurs there, and frequent n-grams are added up before they leave a block.

Defined results: a null text is empty and still has an end; a null id counts as empty text for the
choice of held-out documents; repeated rows are scored and learned one by one; without training
documents all counts are 0; an empty table gives no rows. N-grams are identified by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.words import lower_words

ORDER = 2
PRIOR = 20.0
BLOCK_BYTES = 4_000_000
START, END = b"\n^", b"\n$"  # no words, since they hold white space

def held_out(doc_id: Column) -> Column:
    """One document in ten, by the CRC-32 of its id as text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Block:
    """The n-grams of some texts: per order the distinct ones, in the order of their keys."""

    def __init__(self, texts: list[bytes | None], order: int):
        docs = [[START, *lower_words(t), END] for t in texts]
        lengths = np.array([len(d) for d in docs], np.int64)
        self.ends = np.cumsum(lengths)
        self.begins = self.ends - lengths
        number = dict.fromkeys(chain.from_iterable(docs))
        for i, w in enumerate(number):
            number[w] = i
        ids = np.fromiter(map(number.__getitem__, chain.from_iterable(docs)), np.int64, int(lengths.sum()))
        del docs
        place = np.arange(len(ids)) - np.repeat(self.begins, lengths)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number))
        # Per order: keys, gram number of the gram that ends at each token (-1: none), and of each gram
        # the numbers of its context (all but the last word) and its suffix (all but the first).
        self.keys, self.at, self.context, self.suffix = [], [], [], []
        word = ids
        for m in range(1, order + 1):
            if m == 1:
                keys, inverse, valid = hashes, ids, np.ones(len(ids), bool)
            else:
                before = np.concatenate([[-1], self.at[-1][:-1]])
                valid = (place >= m - 1) & (before >= 0)
                pair = before[valid] * len(hashes) + word[valid]
                distinct, inverse = np.unique(pair, return_inverse=True)
                left, right = distinct // len(hashes), distinct % len(hashes)
                keys = _mix(self.keys[-1][left], hashes[right])
            rank = np.empty(len(keys), np.int64)
            by_key = np.argsort(keys, kind="stable")
            rank[by_key] = np.arange(len(keys))
            at = np.full(len(ids), -1, np.int64)
            at[valid] = rank[inverse]
            self.keys.append(keys[by_key])
            self.at.append(at)
            if m == 1:
                self.context.append(None)
                self.suffix.append(None)
                word, hashes = at, keys[by_key]
            else:
                suffix = np.empty(len(keys), np.int64)
                suffix[at[valid]] = self.at[-2][valid]
                self.context.append(left[by_key])
                self.suffix.append(suffix)

    def counts(self, chosen: np.ndarray) -> list[np.ndarray]:
        """How often each gram ends in the chosen documents."""
        inside = np.repeat(chosen, self.ends - self.begins)
        return [np.bincount(a[inside & (a >= 0)], minlength=len(k)).astype(np.uint32)
                for a, k in zip(self.at, self.keys)]


class Automaton:
    """The part of the model that a block's texts can visit, from the training counts of its grams."""

    def __init__(self, block: Block, counts: list[np.ndarray], tokens: int, types: int, prior: float):
        self.block, self.counts = block, counts
        probability = (counts[0] + 0.1) / (tokens + 0.1 * (types + 1))
        self.arc, self.fail = [np.log10(probability)], [np.zeros(len(probability))]
        for m in range(1, len(counts)):
            seen_before = counts[m - 1][block.context[m]].astype(np.float64)
            back = prior / (seen_before + prior)
            probability = counts[m] / (seen_before + prior) + back * probability[block.suffix[m]]
            self.arc.append(np.log10(probability))
            self.fail.append(np.log10(back))
        # The last place answers for tokens at which no gram of the order ends (number -1).
        self.arc, self.fail = [[np.append(x, 0.0) for x in y] for y in (self.arc, self.fail)]
        self.seen = [np.append(c > 0, False) for c in counts]

    def score(self, doc: int) -> tuple[int, int, float, float]:
        """Tokens, known tokens, base score and score of a document, in one pass."""
        block, order = self.block, len(self.counts)
        span = slice(int(block.begins[doc]) + 1, int(block.ends[doc]))
        first = block.at[0][span]
        known = self.counts[0][first] > 0
        base = math.fsum(self.arc[0][first].tolist())
        seen, arc, fail = [], [], []
        for m in range(order):
            grams = block.at[m][span]
            seen.append(self.seen[m][grams].tolist())
            arc.append(self.arc[m][grams].tolist())
            fail.append(self.fail[m][grams].tolist())
        start = block.at[0][int(block.begins[doc])]
        depth = int(order > 1 and self.counts[0][start] > 0)  # words that the state remembers
        total = 0.0
        for i in range(len(first)):
            m = depth
            while m and not seen[m][i]:
                total += fail[m][i]
                m -= 1
            total += arc[m][i]
            depth = min(m + 1, order - 1) if seen[m][i] else 0
        return len(first), int(known.sum()), base, total


def _buckets(keys: np.ndarray, order: int, buckets: int) -> np.ndarray:
    return (keys % np.uint64(buckets)).astype(np.int64) + order * buckets


def _packed(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, so that the shuffle's compression sees runs of zeros."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _unpacked(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _packed_keys(keys: np.ndarray, buckets: int) -> bytes:
    """Ascending keys of one bucket: the steps between them, without the part that the bucket tells."""
    return _packed(np.diff(keys // np.uint64(buckets), prepend=np.uint64(0)))


def _unpacked_keys(data: bytes) -> np.ndarray:
    """The packed keys, alike for equal keys of a bucket."""
    return np.cumsum(_unpacked(data, np.uint64), dtype=np.uint64)


def _ask(order: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    """A block's grams and their training counts, one row per bucket that it needs."""
    def run(group: pa.Table) -> pa.Table:
        block = Block(group["text"].to_pylist(), order)
        counts = block.counts(~np.array(group["held_out"].to_pylist(), bool))
        rows = {"block": [], "bucket": [], "keys": [], "counts": []}
        for m in range(order):
            where = _buckets(block.keys[m], m, buckets)
            by = np.argsort(where, kind="stable")
            cuts = np.flatnonzero(np.diff(where[by])) + 1
            for part in np.split(by, cuts) if len(by) else []:
                rows["bucket"].append(int(where[part[0]]))
                rows["keys"].append(_packed_keys(block.keys[m][part], buckets))
                rows["counts"].append(_packed(counts[m][part]))
        rows["block"] = [group["block"][0].as_py()] * len(rows["bucket"])
        return pa.table(rows, schema=pa.schema([("block", pa.int64()), ("bucket", pa.int64()),
                                                ("keys", pa.binary()), ("counts", pa.binary())]))
    return run


def _add_up(group: pa.Table) -> pa.Table:
    """The totals of a bucket's grams, for each block in the order in which it asked."""
    lists = [_unpacked_keys(x) for x in group["keys"].to_pylist()]
    counts = np.concatenate([_unpacked(x, np.uint32) for x in group["counts"].to_pylist()])
    keys, inverse = np.unique(np.concatenate(lists), return_inverse=True)
    totals = np.bincount(inverse, weights=counts, minlength=len(keys))[inverse].astype(np.uint32)
    cuts = np.cumsum([len(x) for x in lists])[:-1]
    return pa.table({"block": group["block"], "bucket": group["bucket"],
                     "totals": pa.array([_packed(x) for x in np.split(totals, cuts)], pa.binary())})


def _answer(order: int, buckets: int, tokens: int, types: int, prior: float):
    def run(group: pa.Table, replies: pa.Table) -> pa.Table:
        block = Block(group["text"].to_pylist(), order)
        counts = [np.zeros(len(k), np.uint32) for k in block.keys]
        got = dict(zip(replies["bucket"].to_pylist(), replies["totals"].to_pylist()))
        for m in range(order):
            where = _buckets(block.keys[m], m, buckets)
            by = np.argsort(where, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(where[by])) + 1) if len(by) else []:
                counts[m][part] = _unpacked(got[int(where[part[0]])], np.uint32)
        automaton = Automaton(block, counts, tokens, types, prior)
        scores = [automaton.score(i) for i in range(group.num_rows)]
        kind = (("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()),
                ("score", pa.float64()))
        out = {"id": group["id"], "held_out": group["held_out"]}
        out.update({n: pa.array([s[i] for s in scores], t) for i, (n, t) in enumerate(kind)})
        return pa.table(out)
    return run


def _vocabulary(batches):
    """Training tokens, and distinct hashes of training words cut by bucket, per stretch of texts."""
    def rows(texts, buckets):
        docs = [lower_words(t) for t in texts]
        words = set(chain.from_iterable(docs)) | {END}
        keys = np.sort(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
        where = _buckets(keys, 0, buckets)
        by = np.argsort(where, kind="stable")
        parts = np.split(by, np.flatnonzero(np.diff(where[by])) + 1)
        n = sum(map(len, docs)) + len(docs)
        return pa.RecordBatch.from_pydict({
            "bucket": pa.array([int(where[p[0]]) for p in parts], pa.int64()),
            "keys": pa.array([_packed_keys(keys[p], buckets) for p in parts], pa.binary()),
            "tokens": pa.array([n, *[0] * (len(parts) - 1)], pa.int64())})

    held, size = [], 0
    for batch in batches:
        buckets = batch.column(1)[0].as_py() if batch.num_rows else 1
        for text in batch.column(0).to_pylist():
            held.append(text)
            size += len(text or b"")
            if size >= BLOCK_BYTES:
                yield rows(held, buckets)
                held, size = [], 0
    if held:
        yield rows(held, buckets)


def _distinct(group: pa.Table) -> pa.Table:
    keys = np.concatenate([_unpacked_keys(x) for x in group["keys"].to_pylist()])
    return pa.table({"types": pa.array([len(np.unique(keys))], pa.int64()),
                     "tokens": pa.array([sum(group["tokens"].to_pylist())], pa.int64())})


def training_size(train: DataFrame, text: str, buckets: int) -> tuple[int, int]:
    """Tokens and distinct tokens of the training texts, ends included."""
    lists = train.select(F.col(text).cast("binary"), F.lit(buckets).alias("n")).mapInArrow(
        _vocabulary, "bucket bigint, keys binary, tokens bigint")
    row = lists.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_distinct, "types bigint, tokens bigint").agg(
        F.sum("tokens"), F.sum("types")).first()
    return row[0] or 0, row[1] or 0


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER,
                prior: float = PRIOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    rows = docs.select(F.col(doc_id).alias("id"), held_out(F.col(doc_id)).alias("held_out"),
                       F.col(text).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")) + F.count(F.lit(1)) * 16).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    tokens, types = training_size(rows.where(~F.col("held_out")), "text", blocks)
    # The block depends on the row alone, so it comes out the same wherever a lost part is made anew.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))).repartition(
        blocks, "block")
    asked = dealt.groupBy("block").applyInArrow(
        _ask(order, blocks), "block bigint, bucket bigint, keys binary, counts binary")
    replies = asked.repartition(blocks, "bucket").groupBy("bucket").applyInArrow(
        _add_up, "block bigint, bucket bigint, totals binary").repartition(blocks, "block")
    id_type = dict(rows.dtypes)["id"]
    scored = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        _answer(order, blocks, tokens, types, prior),
        f"id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(tokens).cast("bigint"))
