"""Benchmark decontamination by greedy string tiling (operator 10).

Tokens are runs of Unicode letters and digits, lower-cased; of scripts written without
spaces, single characters. A document is a
candidate for a benchmark item if both hold the same window of `min_match`
tokens. For each candidate, the longest matches between unmarked tokens are
marked again and again, found by running Karp-Rabin hashing at a shrinking
length, until no match of `min_match` tokens is left. The item counts as leaked
if the marked share of its tokens reaches `coverage`; as tiles may lie in any
order, a passage whose sentences were swapped is caught as well. An item of fewer than
`min_match` tokens leaks where all of them stand in one run, of which the first is its tile.

A benchmark of at most `BLOCK_BYTES` bytes of text, which are counted first, is broadcast
with its windows to one map-side pass. A larger one is joined by its windows: hashes of
the windows of both sides meet in an equi join, and the items found for a document are
dealt into parts of about `PART_BYTES` bytes, each of which is tiled with it apart. Of the documents' windows only those go into the join that a
bitmap of fixed size over the items' windows has. An item's most frequent windows are
left out of the join as far as a leak must hold one of the others: tiles that mark
`coverage` of n tokens hold at least coverage * n / min_match of its windows.

Cases: a null or empty text has no tokens and leaks nothing; a null doc_id is
reported with its null; repeated rows are reported once per row; an item that
is null or has no token matches nothing; repeated
items match alike, each under its own id; extra columns are not read; empty
tables give no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import by_size, column, mix, pieces, windows, word_hashes
from weftgraph.plans.materialize import Scratch
from weftgraph.sources.tables import table

MIN_MATCH = 4
COVERAGE = 0.5
#: Bytes of benchmark text that may be broadcast: with the index about 50 MB.
BLOCK_BYTES = 3_000_000
#: Bits of the bitmap over a larger benchmark's windows.
BITMAP = 1 << 27
#: Documents with candidates that may be broadcast to fetch their texts; beyond it, a shuffled join does.
BROADCAST_DOCS = 200_000
BATCH_BYTES = 4_000_000
#: Bytes of candidate items that are tiled with a document at once.
PART_BYTES = 1_000_000
# Thai, Lao, Myanmar, Khmer, the Tai scripts, kana and Han.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua9e0-\ua9ff\uaa60-\uaadf\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
TOKEN = re.compile(rf"[^\W_{UNSPACED}]+|(?!_)\w")
SCHEMA = "doc_id bigint, item_id bigint, matched_tokens int, item_tokens int, coverage double, tiles array<struct<doc_start:int, item_start:int, length:int>>"


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def _scan(doc: list[int], item: list[int], used_doc: bytearray, used_item: bytearray, length: int) -> list[tuple[int, int, int]]:
    """Maximal matches of at least `length` unmarked tokens, by a running hash over both sides."""
    modulus, base = (1 << 61) - 1, 1_000_003
    top = pow(base, length - 1, modulus)

    def rolling(codes: list[int], used: bytearray) -> Iterator[tuple[int, int]]:
        value, run = 0, 0
        for at, code in enumerate(codes):
            if used[at] or code < 0:
                value = run = 0
                continue
            if run >= length:
                value = (value - codes[at - length] * top) % modulus
            value = (value * base + code) % modulus
            run += 1
            if run >= length:
                yield value, at - length + 1

    where = defaultdict(list)
    for value, at in rolling(item, used_item):
        where[value].append(at)
    found = []
    for value, d in rolling(doc, used_doc):
        for i in where.get(value, ()):
            if d and i and doc[d - 1] == item[i - 1] and not used_doc[d - 1] and not used_item[i - 1]:
                continue  # the longer match that starts one token before has it
            size = 0
            while d + size < len(doc) and i + size < len(item) and doc[d + size] == item[i + size] and not used_doc[d + size] and not used_item[i + size]:
                size += 1
            if size >= length:  # else two windows only share a hash
                found.append((size, d, i))
    return found


def tile(doc: list[int], item: list[int], min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (doc start, item start, length). Codes below 0 match nothing.

    Longest first; ties go to the earlier place in the document, then in the item. A match
    that a tile has cut goes back into the queue with the lengths of its parts.
    """
    used_doc, used_item = bytearray(len(doc)), bytearray(len(item))
    out = []
    length = max(min_match, len(item))
    while True:
        queue = [(-size, d, i) for size, d, i in _scan(doc, item, used_doc, used_item, length)]
        heapify(queue)
        while queue:
            size, d, i = heappop(queue)
            size = -size
            free = [not (used_doc[d + k] or used_item[i + k]) for k in range(size)]
            if all(free):
                used_doc[d : d + size] = used_item[i : i + size] = b"\1" * size
                out.append((d, i, size))
                continue
            start = 0
            for is_free, part in groupby(free):
                n = len(list(part))
                if is_free and n >= length:
                    heappush(queue, (-n, d + start, i + start))
                start += n
        if length == min_match:
            return sorted(out)
        length = max(min_match, length // 2)


@dataclass
class Block:
    """One broadcast part of the benchmark, ready for lookups."""

    vocabulary: dict[str, int]
    items: list[tuple[int | None, list[int]]]
    seeds: np.ndarray
    owners: list[tuple[int, ...]]
    min_match: int
    #: By length: items of fewer than `min_match` tokens, by their window.
    short: dict[int, dict[int, list[int]]]

    @classmethod
    def build(cls, rows: list[tuple[int | None, list[str]]], min_match: int) -> Block:
        vocabulary: dict[str, int] = {}
        items = [(key, [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]) for key, words in rows]
        owners = defaultdict(set)
        for at, (_, codes) in enumerate(items):
            for seed in windows(np.array(codes, np.uint64), min_match).tolist():
                owners[seed].add(at)
        short: dict[int, dict[int, list[int]]] = {}
        for at, (_, codes) in enumerate(items):
            if 0 < len(codes) < min_match:
                seed = int(windows(np.array(codes, np.uint64), len(codes))[0])
                short.setdefault(len(codes), {}).setdefault(seed, []).append(at)
        order = sorted(owners)
        return cls(vocabulary, items, np.array(order, np.uint64), [tuple(sorted(owners[s])) for s in order], min_match, short)

    def leaks(self, text: str | None, coverage: float) -> list[tuple[int | None, int, int, list[tuple[int, int, int]]]]:
        """(item id, tokens matched, tokens of the item, tiles) of each item that the text leaks."""
        look = self.vocabulary.get
        codes = np.array([look(w, -1) for w in tokens(text)], np.int64)
        out = [*self._short_leaks(codes), *self._tiled_leaks(codes, coverage)]
        return sorted(out, key=lambda x: (x[0] is None, x[0]))

    def _short_leaks(self, codes: np.ndarray) -> Iterator[tuple[int | None, int, int, list[tuple[int, int, int]]]]:
        for length, owners in self.short.items():
            seeds, first = np.unique(windows(codes.view(np.uint64), length), return_index=True)
            wanted = np.array(list(owners), np.uint64)
            for place in sorted(first[np.isin(seeds, wanted)].tolist()):
                for item in owners[int(windows(codes[place : place + length].view(np.uint64), length)[0])]:
                    key, want = self.items[item]
                    if codes[place : place + length].tolist() == want:
                        yield key, length, length, [(place, 0, length)]

    def _tiled_leaks(self, codes: np.ndarray, coverage: float) -> list[tuple[int | None, int, int, list[tuple[int, int, int]]]]:
        seeds = windows(codes.view(np.uint64), self.min_match)
        if not len(self.seeds) or not len(seeds):
            return []
        at = np.searchsorted(self.seeds, seeds)
        at[at == len(self.seeds)] = 0
        near: dict[int, list[int]] = defaultdict(list)
        for place in np.flatnonzero(self.seeds[at] == seeds).tolist():
            for item in self.owners[at[place]]:
                near[item].append(place)
        out = []
        for item, places in near.items():
            key, want = self.items[item]
            keep = np.zeros(len(codes) + self.min_match, bool)
            for k in range(self.min_match):
                keep[np.array(places) + k] = True
            # Only tokens in some shared window can lie in a match: the rest is cut down to gaps.
            spots = np.flatnonzero(keep[: len(codes)])
            gap = np.flatnonzero(np.diff(spots) > 1) + 1
            doc = np.insert(codes[spots], gap, -1).tolist()
            real = np.insert(spots, gap, -1)
            tiles = tile(doc, want, self.min_match)
            matched = sum(size for _, _, size in tiles)
            if matched >= coverage * len(want):
                out.append((key, matched, len(want), [(int(real[d]), i, size) for d, i, size in tiles]))
        return out


def block_of(benchmark: DataFrame, min_match: int) -> Block | None:
    """The whole benchmark, if it is small enough to be broadcast."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    if size > BLOCK_BYTES:
        return None
    rows = [(r["item_id"], tokens(r["text"])) for r in benchmark.select("item_id", "text").where("length(text) > 0").collect()]
    return Block.build([(key, words) for key, words in rows if words], min_match)


NAMES = ["doc_id", "item_id", "matched_tokens", "item_tokens", "coverage", "tiles"]
KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("length", pa.int32())]))]


def _report(found: list[tuple]) -> pa.RecordBatch:
    """Rows of (doc_id, item_id, matched, size, tiles)."""
    out = [(doc_id, item_id, matched, size, matched / size, [dict(zip(("doc_start", "item_start", "length"), t, strict=True)) for t in tiles]) for doc_id, item_id, matched, size, tiles in found]
    cols = list(zip(*out, strict=True)) if out else [[]] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, KINDS, strict=True)], NAMES)


def _reporter(shared, coverage: float):
    def run(batches):
        block = shared.value
        for batch in pieces(batches):
            yield _report([(doc_id, *leak) for doc_id, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True) for leak in block.leaks(text, coverage)])

    return run


def _filter(shared, coverage: float):
    def run(batches):
        block = shared.value
        for batch in pieces(batches):
            keep = [not block.leaks(text, coverage) for text in column(batch, "text")]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def _seeds(codes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows of `width` tokens, apart from those of other widths."""
    return mix(windows(codes, width) ^ np.uint64(width)).view(np.int64)


def _codes(text: str | None) -> np.ndarray:
    return word_hashes(" ".join(tokens(text)))


def _item_seeds(min_match: int, coverage: float):
    """Each item's different windows: how often it has them, and how many places of windows may be left out of the join."""

    def run(batches):
        for batch in by_size(batches, "text", BATCH_BYTES):
            rows = []
            for n, text in zip(column(batch, "n"), column(batch, "text"), strict=True):
                codes = _codes(text)
                if not len(codes):
                    continue
                width = min(min_match, len(codes))
                spare = max(1, int(np.ceil(coverage * len(codes) / min_match - 1e-9))) - 1 if len(codes) >= min_match else 0
                rows += [(n, seed, places, spare, width) for seed, places in zip(*(x.tolist() for x in np.unique(_seeds(codes, width), return_counts=True)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], ["n", "seed", "places", "spare", "width"])

    return run


def _doc_seeds(shared, widths: list[int]):
    """Each document's different windows that the bitmap has."""

    def run(batches):
        bits = shared.value
        for batch in by_size(batches, "text", BATCH_BYTES):
            place, seeds = [], []
            for at, text in enumerate(column(batch, "text")):
                codes = _codes(text)
                own = np.unique(np.concatenate([_seeds(codes, w) for w in widths])) if widths else np.zeros(0, np.int64)
                slot = own % BITMAP
                seeds.append(own[(bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0])
                place.append(np.full(len(seeds[-1]), at))
            picked = batch.select(["d", "h"]).take(pa.array(np.concatenate(place) if place else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(np.concatenate(seeds) if seeds else [], pa.int64())], ["d", "h", "seed"])

    return run


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """BITMAP bits as bytes, put together from aggregated parts: its size does not depend on the seeds."""
    slot = (F.pmod("seed", F.lit(BITMAP)) + 1).alias("slot")
    parts = seeds.select(slot).groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    out = np.zeros(BITMAP // 8, np.uint8)
    for r in parts:
        part = np.frombuffer(r["bits"], np.uint8)
        start = (r["part"] - 1) * len(part)
        out[start : start + len(part)] = part
    return out


def _key() -> tuple[Column, Column]:
    """Two numbers that rows share only if they are equal in doc_id and text."""
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))), F.xxhash64(F.col("doc_id").isNull(), "text")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns(dict(zip("dh", _key(), strict=True)))


def _lister(coverage: float, min_match: int):
    """Documents with the items that share a window with them."""

    def run(batches):
        for batch in pieces(batches, 32):
            found = []
            for doc_id, text, items in zip(*(column(batch, c) for c in ("doc_id", "text", "items")), strict=True):
                block = Block.build([(i["item_id"], tokens(i["text"])) for i in items], min_match)
                found += [(doc_id, *leak) for leak in block.leaks(text, coverage)]
            yield _report(found)

    return run


def _leaking(coverage: float, min_match: int):
    """The documents of `_lister` that leak an item."""

    def run(batches):
        for batch in pieces(batches, 32):
            leaks = [
                bool(Block.build([(i["item_id"], tokens(i["text"])) for i in items], min_match).leaks(text, coverage))
                for text, items in zip(column(batch, "text"), column(batch, "items"), strict=True)
            ]
            yield batch.select(["doc_id", "text"]).filter(pa.array(leaks, pa.bool_()))

    return run


def joined_candidates(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, text and `items` (item_id, text) of each row that shares a window with an item that it may leak.

    A row with many such items stands once for each part of them.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = scratch.put(benchmark.select(F.monotonically_increasing_id().alias("n"), F.col("item_id").cast("bigint").alias("item_id"), "text", F.octet_length("text").alias("size")).where("length(text) > 0"), "items")
    seeds = scratch.put(items.mapInArrow(_item_seeds(min_match, coverage), "n bigint, seed bigint, places bigint, spare bigint, width bigint"), "seeds")
    widths = sorted(r["width"] for r in seeds.select("width").distinct().collect())  # `min_match` numbers at most
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(seeds))
    given = _keyed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    held = scratch.put(given.select("d", "h", "text").mapInArrow(_doc_seeds(shared, widths), "d bigint, h bigint, seed bigint"), "windows")
    often = seeds.join(held.groupBy("seed").agg(F.count("*").alias("docs")), "seed")
    so_far = F.sum("places").over(Window.partitionBy("n").orderBy(F.desc("docs"), "seed").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = often.withColumn("so_far", so_far).where("so_far > spare").select("n", "seed")
    pairs = scratch.put(held.join(kept, "seed").select("d", "h", "n").distinct().join(items.select("n", "size"), "n"), "pairs")
    # Parts are dealt by the items' hashes, so that a document's items are never in one place.
    parts = pairs.groupBy("d", "h").agg(F.ceil(F.sum("size") / part_bytes).alias("parts"))
    dealt = pairs.select("d", "h", "n").join(scratch.put(parts, "parts"), ["d", "h"]).withColumn("part", F.pmod(F.xxhash64("n"), "parts"))
    listed = scratch.put(dealt.join(items, "n").groupBy("d", "h", "part").agg(F.collect_list(F.struct("item_id", "text")).alias("items")), "listed")
    keys = listed.select("d", "h").distinct()
    few = keys.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS
    texts = given.join(F.broadcast(keys) if few else keys, ["d", "h"], "left_semi")
    return texts.join(listed, ["d", "h"]).select("doc_id", "text", "items")


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """A row for each document and each benchmark item that it leaks, with the tiles."""
    block = block_of(benchmark, min_match)
    if block is None:
        return joined_candidates(docs, benchmark, min_match, coverage).mapInArrow(_lister(coverage, min_match), SCHEMA)
    return docs.select("doc_id", "text").mapInArrow(_reporter(spark.sparkContext.broadcast(block), coverage), SCHEMA)


def drop_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """The documents that leak no item, all columns kept."""
    block = block_of(benchmark, min_match)
    if block is not None:
        return docs.mapInArrow(_filter(spark.sparkContext.broadcast(block), coverage), docs.schema)
    leaking = joined_candidates(docs, benchmark, min_match, coverage).mapInArrow(_leaking(coverage, min_match), "doc_id bigint, text string")
    gone = _keyed(leaking).select(F.col("d").alias("_weft_d"), F.col("h").alias("_weft_h")).distinct()
    gone = Scratch(spark, "decontaminate").put(gone, "gone")
    few = gone.limit(BROADCAST_DOCS + 1).count() <= BROADCAST_DOCS
    d, h = _key()
    return docs.join(F.broadcast(gone) if few else gone, (d == F.col("_weft_d")) & (h == F.col("_weft_h")), "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table against every benchmark item."""
    return find_leaks(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
