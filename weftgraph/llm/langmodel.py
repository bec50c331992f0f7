"""Language-model scores by deleted interpolation (operator 3).

Counts are gathered over all training documents. One of their folds is deleted
from the maximum-likelihood estimates, and its counts teach the mixture weights
by expectation-maximisation; the finished model then counts both. The estimates
of order 1 to 3 are mixed recursively, each order with one weight per bucket of
its context's frequency (powers of two):

    P3(w | u v) = a P_ML(w | u v) + (1 - a) P2(w | v)
    P2(w | v)   = b P_ML(w | v) + (1 - b) P1(w)
    P1(w)       = m c(w) / N + (1 - m) / (V + 1)

All words and n-grams of all orders are counted exactly, at any input size, and
divided by the full counts of their contexts.

Texts are read once and dealt to blocks of about `FLUSH` tokens. A block asks for
the counts of its distinct n-grams, each of which stands once in the request, so
that no n-gram, however frequent, can fill a bucket. Requests are dealt by n-gram
to buckets in packed arrays, there summed, and the counts sent back to the blocks.
Blocks with counts are a written table, from which the weights are learnt order by
order, and then the rows are scored. N-grams are told apart by hashes of `KEY_BITS`
bits. Expectation-maximisation reads tokens of the deleted fold only by the ratio
of the two estimates; what reaches the driver is the number of tokens and the mean
ratio for each context bucket and 1/32 of a power of two of that ratio.

A context that was never seen has no weight, neither when weights are learnt nor when texts are scored.

Cases: a null or empty text is one end token; a row with a null doc_id is not
learnt from and not held out; repeated rows are learnt from and scored one by
one; without training rows N and V are 0; extra columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import BASE, by_size, column, mix, word_hashes
from weftgraph.plans.materialize import Scratch
from weftgraph.sources.tables import table

ORDERS = 3
FOLDS, HELD_OUT, DELETED = 5, 1, 0
#: Tokens of a block, and tokens a bucket gets on average.
FLUSH = 1_600_000
BATCH_BYTES = 2_000_000
KEY_BITS = 60
BINS = 32
START = np.uint64(0x14057B7EF767814F)
END = np.uint64(0x5851F42D4C957F2D)
EM_ROUNDS = 60
MOST_WEIGHT = 1 - 1e-6
BUCKETS = 64


def fold(doc_id) -> int:
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % FOLDS


def _bucket_of(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.log2(np.maximum(count, 1)).astype(np.int64), 0)


def _learn(bucket: np.ndarray, higher: np.ndarray, lower: np.ndarray, times: np.ndarray, events: np.ndarray) -> np.ndarray:
    """Weights per context bucket by expectation-maximisation.

    Rows are n-grams, seen `times` in the deleted fold, with both estimates;
    `events` are all tokens of the fold after a context of the bucket. A token
    whose n-gram is not among them can only come from the lower order.
    """
    weights = np.full(BUCKETS, 0.5)
    for _ in range(EM_ROUNDS):
        a = weights[bucket]
        share = np.divide(a * higher, a * higher + (1 - a) * lower, out=np.zeros(len(higher)), where=higher > 0)
        from_higher = np.bincount(bucket, times * share, BUCKETS)
        weights = np.clip(np.where(events > 0, from_higher / np.maximum(events, 1), 0.0), 0, MOST_WEIGHT)
    return weights


def _squeeze(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes, with their number."""
    planes = np.ascontiguousarray(values.astype(np.int64).view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b"")


def _loose(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(packed[8:], n * 8, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).reshape(-1).view(np.int64)


def _squeeze_keys(keys: np.ndarray) -> bytes:
    """Of sorted keys."""
    return _squeeze(np.diff(keys.astype(np.int64), prepend=0))


def _loose_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_loose(packed)).astype(np.uint64)


def _short(codes: np.ndarray) -> np.ndarray:
    return codes >> np.uint64(64 - KEY_BITS)


def _record(rows: list[tuple], schema: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(schema)], [name for name, _ in schema])


def _ddl(schema: list[tuple]) -> str:
    return ", ".join(f"{n} {'array<bigint>' if k == pa.list_(pa.int64()) else 'binary' if k == pa.binary() else 'double' if k == pa.float64() else 'boolean' if k == pa.bool_() else 'bigint'}" for n, k in schema)


#: Rows of documents in order: learnt tokens and documents without and within the deleted fold, ids, tokens per document, sorted words and how often each stands, each token's place in the words by frequency.
BLOCK = [*((n, pa.int64()) for n in ("block", "main", "deleted", "docs_main", "docs_deleted")), ("ids", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("sizes", "words", "times", "at"))]
REQUEST = [("block", pa.int64()), ("bucket", pa.int64()), ("k", pa.binary()), ("main", pa.binary()), ("deleted", pa.binary())]
#: Counts of what a request asked, beyond its own; in a row of block -1, how many different words were learnt.
REPLY = [("block", pa.int64()), ("bucket", pa.int64()), ("main", pa.binary()), ("deleted", pa.binary()), ("n_distinct", pa.int64())]
#: All counts of each token's word and n-grams; `m*`: those without the deleted fold, of its tokens.
COUNTED = [("block", pa.int64()), ("n_distinct", pa.int64()), ("ids", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("sizes", "c1", "c2", "c3", "m1", "m2", "m3"))]


def _by_frequency(times: np.ndarray) -> np.ndarray:
    return np.argsort(-times, kind="stable")


def _blocks(batches, block_tokens: int):
    """Texts as packed blocks."""
    place = TaskContext.get().partitionId() << 36
    ids: list = []
    codes: list[np.ndarray] = []
    held = 0

    def flush():
        nonlocal ids, codes, held, place
        sizes = np.array([len(c) for c in codes])
        words, at = np.unique(np.concatenate(codes), return_inverse=True)
        times = np.bincount(at)
        rank = np.empty(len(words), np.int64)
        rank[_by_frequency(times)] = np.arange(len(words))  # mostly small numbers, which compress well
        folds = np.array([fold(i) for i in ids])
        is_main, is_deleted = (folds >= 0) & (folds != HELD_OUT) & (folds != DELETED), folds == DELETED
        row = (place, int(sizes[is_main].sum()), int(sizes[is_deleted].sum()), int(is_main.sum()), int(is_deleted.sum()), ids, _squeeze(sizes), _squeeze_keys(words), _squeeze(times), _squeeze(rank[at]))
        place += 1
        ids, codes, held = [], [], 0
        return _record([row], BLOCK)

    for batch in by_size(batches, "text", BATCH_BYTES):
        for i, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
            ids.append(i)
            codes.append(_short(np.append(word_hashes(text), END)))
            held += len(codes[-1])
            if held >= block_tokens:
                yield flush()
    if ids:
        yield flush()


def _firsts(sizes: np.ndarray) -> np.ndarray:
    first = np.zeros(int(sizes.sum()), bool)
    first[np.cumsum(sizes) - sizes] = True
    return first


def _before(values: np.ndarray, first: np.ndarray, start) -> np.ndarray:
    """Of each token, the value of the token before it in its text."""
    return np.where(first, values.dtype.type(start), np.roll(values, 1))


def _grams(row: dict):
    """Per order, a block's sorted n-grams, their counts without and within the deleted fold, each token's place in them (-1: none)."""
    sizes, words = _loose(row["sizes"]), _loose_keys(row["words"])
    at = _by_frequency(_loose(row["times"]))[_loose(row["at"])]
    first = _firsts(sizes)
    folds = np.repeat(np.array([fold(i) for i in row["ids"]]), sizes)
    is_main, is_deleted = (folds >= 0) & (folds != HELD_OUT) & (folds != DELETED), folds == DELETED
    codes, has = words[at], np.ones(len(at), bool)
    keys, where, long = words, at, codes
    for order in range(1, ORDERS + 1):
        if order > 1:
            if order > 2:
                has = ~first
            long = mix(_before(long, first, START) * BASE + codes)
            keys, found = np.unique(_short(long)[has], return_inverse=True)
            where = np.full(len(at), -1, np.int64)
            where[has] = found
        yield keys, *(np.bincount(where[has & x], minlength=len(keys)) for x in (is_main, is_deleted)), where


def _ranges(keys: np.ndarray, buckets: int) -> list[tuple[int, slice]]:
    """The buckets of sorted keys and where each stands: a bucket is a range of keys. Only buckets with keys are looked at."""
    bucket = (keys >> np.uint64(KEY_BITS - 32)) * np.uint64(buckets) >> np.uint64(32)
    first = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
    return [(b, slice(x, y)) for b, x, y in zip(bucket[first].tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=len(keys) > 0)]


def _asker(buckets: int):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                for order, (keys, main, deleted, _) in enumerate(_grams(row)):
                    parts = _ranges(keys, buckets)
                    for at in range(0, len(parts), 4096):
                        yield _record([(row["block"], b * ORDERS + order, _squeeze_keys(keys[x]), _squeeze(main[x]), _squeeze(deleted[x])) for b, x in parts[at : at + 4096]], REQUEST)
        pa.default_memory_pool().release_unused()

    return run


def _answer(rows: pa.Table) -> pa.Table:
    """Of one bucket of one order: sums over all requests."""
    blocks, bucket = rows.column("block").to_pylist(), rows.column("bucket")[0].as_py()
    asked = [_loose_keys(x) for x in rows.column("k").to_pylist()]
    edges = np.cumsum([0, *map(len, asked)])
    keys, where = np.unique(np.concatenate(asked), return_inverse=True)
    del asked
    others, sums = [], []
    for name in ("main", "deleted"):
        own = np.concatenate([_loose(x) for x in rows.column(name).to_pylist()])
        total = np.bincount(where, own, len(keys)).astype(np.int64)
        sums.append(total)
        others.append(total[where] - own)
    out = [(b, bucket, *(_squeeze(x[edges[i] : edges[i + 1]]) for x in others), None) for i, b in enumerate(blocks)]
    if bucket % ORDERS == 0:
        out.append((-1, bucket, None, None, int((sums[0] + sums[1] > 0).sum())))
    return pa.Table.from_batches([_record(out, REPLY)])


def _collect(blocks: pa.Table, replies: pa.Table) -> pa.Table:
    """Of one block: the counts of its tokens."""
    if not blocks.num_rows:
        return pa.Table.from_batches([_record([(-1, sum(replies.column("n_distinct").to_pylist()), *[None] * 8)], COUNTED)])
    row = blocks.to_pylist()[0]
    sizes = _loose(row["sizes"])
    of_deleted = np.repeat(np.array([fold(i) == DELETED for i in row["ids"]], bool), sizes)
    got: list[dict] = [{} for _ in range(ORDERS)]
    for bucket, main, deleted in zip(*(replies.column(n).to_pylist() for n in ("bucket", "main", "deleted")), strict=True):
        got[bucket % ORDERS][bucket] = main, deleted
    counts, mains = [], []
    for parts, (keys, main, deleted, where) in zip(got, _grams(row), strict=True):
        if parts:
            main, deleted = (own + np.concatenate([_loose(parts[b][i]) for b in sorted(parts)]) for i, own in enumerate((main, deleted)))
        # A place of -1 takes the zero at the end.
        counts.append(_squeeze(np.append(main + deleted, 0)[where]))
        mains.append(_squeeze(np.append(main, 0)[where[of_deleted]]))
    return pa.Table.from_batches([_record([(row["block"], None, row["ids"], row["sizes"], *counts, *mains)], COUNTED)])


@dataclass
class Fit:
    """What the whole corpus gives: documents, tokens and words learnt from, and the weights once known."""

    starts: int
    total: int
    distinct: int
    unigram_weight: float = 0.5
    weights: list[np.ndarray] = field(default_factory=list)

    def orders(self, counts: list[np.ndarray], first: np.ndarray):
        """Per order: the estimate, the estimate of the order below, the context's count, and where there is a context."""
        m = self.unigram_weight
        flat = np.full(len(first), 1 / (self.distinct + 1))
        alone = counts[0] / max(self.total, 1)
        yield alone, flat, np.full(len(first), 1), np.ones(len(first), bool)
        p = m * alone + (1 - m) * flat
        for order in range(2, ORDERS + 1):
            context = _before(counts[order - 2], first, self.starts if order == 2 else 0)
            has = context > 0 if order == 2 else ~first & (context > 0)
            ratio = np.divide(counts[order - 1], context, out=np.zeros(len(first)), where=context > 0)
            yield ratio, p, context, has
            if len(self.weights) < order - 1:
                return
            a = np.where(has, self.weights[order - 2][_bucket_of(context)], 0.0)
            p = a * ratio + (1 - a) * p

    def probabilities(self, counts: list[np.ndarray], first: np.ndarray) -> np.ndarray:
        p = None
        for order, (ratio, below, context, has) in enumerate(self.orders(counts, first), 1):
            a = self.unigram_weight if order == 1 else np.where(has, self.weights[order - 2][_bucket_of(context)], 0.0)
            p = a * ratio + (1 - a) * (below if order == 1 else p)
        return p


HISTOGRAM = [("bucket", pa.int64()), ("bin", pa.int64()), ("n", pa.int64()), ("ratio", pa.float64())]
NOT_SEEN = 1 << 40


def _histogram(fit: Fit, order: int):
    """Tokens of the deleted fold by context bucket and by the ratio of the order's two estimates."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                sizes = _loose(row["sizes"])[[fold(i) == DELETED for i in row["ids"]]]
                for n, (higher, lower, context, has) in enumerate(fit.orders([_loose(row[f"m{i}"]) for i in range(1, ORDERS + 1)], _firsts(sizes)), 1):
                    if n < order:
                        continue
                    seen = higher > 0
                    ratio = np.divide(lower, higher, out=np.ones(len(higher)), where=seen)
                    bins = np.where(seen, np.round(np.log2(ratio) * BINS).astype(np.int64), NOT_SEEN)
                    pairs = np.stack((_bucket_of(context), bins), 1)[has]
                    key, where = np.unique(pairs[:, 0] << 48 | pairs[:, 1] + (1 << 46), return_inverse=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, kind) for x, (_, kind) in zip((key >> 48, (key & ((1 << 48) - 1)) - (1 << 46), np.bincount(where, minlength=len(key)), np.bincount(where, ratio[has], len(key)).astype(float)), HISTOGRAM, strict=True)],
                        [name for name, _ in HISTOGRAM])
                    break

    return run


def _weights(counted: DataFrame, fit: Fit, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights per context bucket, and how many tokens of the deleted fold each has."""
    rows = counted.mapInArrow(_histogram(fit, order), _ddl(HISTOGRAM)).groupBy("bucket", "bin").agg(F.sum("n").alias("n"), F.sum("ratio").alias("ratio")).toArrow()
    bucket, bins, n, ratio = (rows.column(c).to_numpy() for c, _ in HISTOGRAM)
    at = np.lexsort((bins, bucket))
    bucket, bins, n, ratio = bucket[at].astype(np.int64), bins[at], n[at].astype(float), ratio[at]
    events = np.bincount(bucket, n, BUCKETS)
    seen = bins != NOT_SEEN
    return _learn(bucket[seen], np.ones(int(seen.sum())), ratio[seen] / n[seen], n[seen], events), events


def _scorer(fit: Fit):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                sizes = _loose(row["sizes"])
                of = np.repeat(np.arange(len(sizes)), sizes)
                counts = [_loose(row[f"c{i}"]) for i in range(1, ORDERS + 1)]
                score = np.log10(fit.probabilities(counts, _firsts(sizes)))
                base = np.log10((counts[0] + 0.5) / (fit.total + 0.5 * (fit.distinct + 1)))
                known, base, score = (np.bincount(of, x, len(sizes)) for x in (counts[0] > 0, base, score))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array([fold(i) == HELD_OUT for i in row["ids"]], pa.bool_()), pa.array(sizes), pa.array(known.astype(np.int64)), pa.array(np.full(len(sizes), fit.total, np.int64)), pa.array(base), pa.array(score)],
                    [name for name, _ in SCORED])
        pa.default_memory_pool().release_unused()

    return run


SCORED = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _put_and_clean(scratch: Scratch, df: DataFrame, name: str) -> DataFrame:
    """A written table whose shuffle files, the largest of the operator, go as soon as it stands."""
    conf = scratch.spark.conf
    before = conf.get(CLEAN, None)
    conf.set(CLEAN, "true")
    try:
        return scratch.put(df, name)
    finally:
        conf.unset(CLEAN) if before is None else conf.set(CLEAN, before)


def score_documents(docs: DataFrame, block_tokens: int = FLUSH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    `block_tokens` are the tokens of a block, and of a bucket on average; results do not depend on them.
    """
    scratch = Scratch(docs.sparkSession, "langmodel")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    blocks = scratch.put(docs.mapInArrow(lambda batches: _blocks(batches, block_tokens), _ddl(BLOCK)), "blocks")
    whole = blocks.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("main", "deleted", "docs_main", "docs_deleted")), F.count_distinct(F.col("_metadata.file_name")).alias("files")).first()
    buckets = max(8, whole["files"], -(-(whole["main"] + whole["deleted"]) // block_tokens))
    replies = blocks.mapInArrow(_asker(buckets), _ddl(REQUEST)).groupBy("bucket").applyInArrow(_answer, _ddl(REPLY))
    replies = _put_and_clean(scratch, replies, "replies")
    counted = scratch.put(blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_collect, _ddl(COUNTED)), "counted")
    scratch.drop(blocks, replies)
    distinct = counted.where("block = -1").agg(F.coalesce(F.sum("n_distinct"), F.lit(0)).alias("n")).first()["n"]
    counted = counted.where("block >= 0")
    learnt = Fit(whole["docs_main"], whole["main"], distinct)
    for order in range(1, ORDERS + 1):
        weights, events = _weights(counted, learnt, order)
        if order > 1:
            learnt.weights.append(weights)
        elif events[0] and whole["main"]:
            learnt.unigram_weight = max(float(weights[0]), 1e-6)
    final = Fit(whole["docs_main"] + whole["docs_deleted"], whole["main"] + whole["deleted"], distinct, learnt.unigram_weight, learnt.weights)
    return counted.mapInArrow(_scorer(final), _ddl(SCORED))


def op3_langmodel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the whole table, learnt from its own training folds."""
    return score_documents(table(spark, sf_dir, "documents"))
