"""Media columns: TIFF (operator 5).

The reader walks the chain of image directories of a file in either byte order,
classic or with 64-bit offsets, decodes each strip or tile (none, PackBits, LZW,
deflate), undoes horizontal differencing, puts tiles in place and emits one row
per page. `encode` writes what the query stores: pages of 8-bit samples.

Cases: null or empty media gives no page; media that is no TIFF, is cut short
or names an unknown scheme gives one row with page 0, no samples and the reason
in `error`, and so does a page with empty, zero or mistyped tags, or one that claims
more samples than its strips can hold (known from their sizes before anything is
decoded; no strip is decoded beyond what the page takes from it) or than a binary value
can (`MOST_BYTES`); later pages of a chain that breaks are reported the same way; a
chain that returns to a directory ends there; repeated rows give their pages
once per row; extra columns are not read, and `explode_pages` refuses to carry one that is named like
a column of its own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import by_size, column, pieces
from weftgraph.sources.tables import table

# Tag numbers, compression schemes and field sizes of the public TIFF 6.0 text.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
FIELD = {1: ("B", 1), 2: ("c", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}

#: Samples in a row of the stored payload, and rows in a strip.
ROW = 64
STRIP_ROWS = 256
#: Bytes of a page's samples at most, what one binary value holds; bytes of media and of samples that a task works on at once.
MOST_BYTES = 2**31 - 64
BATCH_BYTES = 16_000_000
INTEGERS = {1, 3, 4, 6, 8, 9, 13, 16, 17, 18}
#: Samples' bytes that a byte of each scheme can stand for at most, from the public descriptions of the schemes.
MOST_GAIN = {NONE: 1, LZW: 4096, DEFLATE: 1032, OLD_DEFLATE: 1032, PACKBITS: 64}
PAGE_SCHEMA = "key bigint, page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, feature string, error string"
PAGE_COLUMNS = [field.split()[0] for field in PAGE_SCHEMA.split(", ")[1:]]


class BadTiff(ValueError):
    """The bytes break the format or use a part of it that is not read."""


def unpack_bits(raw: bytes, most: int = MOST_BYTES) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw) and len(out) < most:
        head = raw[at]
        at += 1
        if head < 128:
            out += raw[at : at + head + 1]
            at += head + 1
        elif head > 128:
            out += raw[at : at + 1] * (257 - head)
            at += 1
    return bytes(out)


def pack_bits(raw: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw):
        run = 1
        while run < 128 and at + run < len(raw) and raw[at + run] == raw[at]:
            run += 1
        if run > 1:
            out += bytes((257 - run, raw[at]))
            at += run
            continue
        end = at + 1
        while end < len(raw) and end - at < 128 and not (end + 1 < len(raw) and raw[end] == raw[end + 1]):
            end += 1
        out.append(end - at - 1)
        out += raw[at:end]
        at = end
    return bytes(out)


def unpack_lzw(raw: bytes, most: int = MOST_BYTES) -> bytes:
    """Most significant bit first; code widths grow one code early, as TIFF has it."""
    words = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, held, bits, width, last, size = [], 0, 0, 9, None, 0
    for byte in raw:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            del words[258:]
            width, last = 9, None
            continue
        if last is None:
            word = words[code] if code < 256 else None
        elif code < len(words):
            word = words[code]
            if len(words) < 4096:
                words.append(last + word[:1])
        elif code == len(words) < 4096:
            word = last + last[:1]
            words.append(word)
        else:
            word = None
        if word is None:
            raise BadTiff("LZW code out of range")
        out.append(word)
        size += len(word)
        if size >= most:
            break
        last = word
        width = min(12, max(9, (len(words) + 1).bit_length()))
    return b"".join(out)


def pack_lzw(raw: bytes) -> bytes:
    words = {bytes((i,)): i for i in range(256)}
    held, bits, width, free, out, now = 256, 9, 9, 258, bytearray(), b""

    def flush() -> None:
        nonlocal held, bits
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    def write(code: int) -> None:
        nonlocal held, bits
        held = held << width | code
        bits += width
        flush()

    flush()
    for i in range(len(raw)):
        longer = now + raw[i : i + 1]
        if longer in words:
            now = longer
            continue
        write(words[now])
        words[longer] = free
        free += 1
        width = max(9, free.bit_length())
        if free == 4094:
            write(256)
            words = {bytes((k,)): k for k in range(256)}
            width, free = 9, 258
        now = raw[i : i + 1]
    if now:
        write(words[now])
        free += 1
        width = min(12, max(9, free.bit_length()))
    write(257)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def _inflate(raw: bytes, most: int = MOST_BYTES) -> bytes:
    try:
        return zlib.decompressobj().decompress(raw, max(1, most))
    except zlib.error as e:
        raise BadTiff(f"deflate: {e}") from e


UNPACK = {NONE: lambda raw, most: raw[:most], LZW: unpack_lzw, DEFLATE: _inflate, OLD_DEFLATE: _inflate, PACKBITS: unpack_bits}
PACK = {NONE: bytes, LZW: pack_lzw, DEFLATE: lambda raw: zlib.compress(raw, 4), PACKBITS: pack_bits}


def _directories(raw: bytes):
    """Yields the tags of each page; the offset of the next directory is followed until it is 0 or seen."""
    if raw[:2] not in (b"II", b"MM"):
        raise BadTiff("no byte order mark")
    order = "<" if raw[:2] == b"II" else ">"

    def read(kind: str, at: int) -> tuple:
        if at + struct.calcsize(order + kind) > len(raw):
            raise BadTiff("cut short")
        return struct.unpack_from(order + kind, raw, at)

    (magic,) = read("H", 2)
    if magic not in (42, 43):
        raise BadTiff("no TIFF")
    big = magic == 43
    (at,) = read("Q", 8) if big else read("I", 4)
    seen = set()
    while at and at not in seen:
        seen.add(at)
        (count,) = read("Q" if big else "H", at)
        at += 8 if big else 2
        tags = {}
        for _ in range(count):
            tag, kind, n = read("HHQ" if big else "HHI", at)
            value_at, room = (at + 12, 8) if big else (at + 8, 4)
            at += 20 if big else 12
            if kind not in FIELD:
                continue
            form, width = FIELD[kind]
            if n * width > len(raw):
                raise BadTiff("cut short")
            if n * width > room:
                (value_at,) = read("Q" if big else "I", value_at)
            tags[tag] = kind, read(form * n if len(form) > 1 else f"{n}{form}", value_at)
        yield order, tags
        (at,) = read("Q" if big else "I", at)


def _page(raw: bytes, order: str, tags: dict) -> dict:
    def every(tag: int, default: tuple[int, ...]) -> tuple[int, ...]:
        kind, values = tags.get(tag, (3, default))
        if not values or kind not in INTEGERS or min(values) < 0:
            raise BadTiff(f"tag {tag} is missing or has no number")
        return values

    def first(tag: int, *default: int) -> int:
        return every(tag, default)[0]

    width, height, per = first(WIDTH), first(HEIGHT), first(SAMPLES, 1)
    bits, scheme, predictor, planes = first(BITS, 1), first(COMPRESSION, NONE), first(PREDICTOR, 1), first(PLANAR, 1)
    if scheme not in UNPACK or bits not in (8, 16) or any(b != bits for b in every(BITS, (1,))) or predictor not in (1, 2) or planes != 1:
        raise BadTiff(f"not read: compression {scheme}, {bits} bits, predictor {predictor}, planes {planes}")
    kind = np.dtype(np.uint8 if bits == 8 else np.uint16).newbyteorder(order)
    tiled = TILE_OFFSETS in tags
    offsets, counts = every(TILE_OFFSETS if tiled else STRIP_OFFSETS, ()), every(TILE_COUNTS if tiled else STRIP_COUNTS, ())
    w, h = (first(TILE_WIDTH), first(TILE_HEIGHT)) if tiled else (width, min(height, first(ROWS_PER_STRIP, height)))
    if not (width and height and per and w and h):
        raise BadTiff("a page, strip or tile has no size")
    if width * height * per * kind.itemsize > MOST_BYTES:
        raise BadTiff("the page is larger than a binary value")
    across, down = -(-width // w), -(-height // h)
    if len(offsets) != across * down or len(counts) != len(offsets):
        raise BadTiff("the strips or tiles don't cover the page")
    heights = [h if tiled else min(h, height - k // across * h) for k in range(len(offsets))]
    for at, size, rows in zip(offsets, counts, heights, strict=True):
        if at + size > len(raw):
            raise BadTiff("cut short")
        if rows * w * per * kind.itemsize > size * MOST_GAIN[scheme]:
            raise BadTiff("a strip or tile holds too little")
    out = np.zeros((height, width, per), kind)
    for k, (at, size, rows) in enumerate(zip(offsets, counts, heights, strict=True)):
        top, left = k // across * h, k % across * w
        want = rows * w * per * kind.itemsize
        block = UNPACK[scheme](raw[at : at + size], want)
        if len(block) < want:
            raise BadTiff("a strip or tile holds too little")
        part = np.frombuffer(block, kind, rows * w * per).reshape(rows, w, per)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=kind.newbyteorder("="))
        out[top : top + rows, left : left + w] = part[: height - top, : width - left]
    return {"width": width, "height": height, "samples": per, "bits": bits, "compression": scheme, "predictor": predictor, "pixels": out.tobytes()}


def feature(pixels: bytes, width: int, height: int) -> str:
    """Size, mean, deviation, distinct values and entropy of a page's bytes."""
    counts = np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)
    n = counts.sum()
    values = np.arange(256)
    mean = (counts * values).sum() / n
    deviation = np.sqrt(max(0.0, (counts * values**2).sum() / n - mean**2))
    share = counts[counts > 0] / n
    return f"{width}x{height};mean={mean:.4f};sd={deviation:.4f};distinct={(counts > 0).sum()};entropy={-(share * np.log2(share)).sum() + 0.0:.4f}"


def walk(raw: bytes | None) -> Iterator[dict]:
    """The pages of a file; one that can't be read has its `error`, and a broken chain of directories ends with one."""
    if not raw:
        return
    number = 0
    try:
        for order, tags in _directories(raw):
            try:
                page = _page(raw, order, tags)
                page |= {"feature": feature(page["pixels"], page["width"], page["height"]), "error": None}
            except BadTiff as e:
                page = {"error": str(e)}
            yield page | {"page": number}
            number += 1
    except BadTiff as e:
        yield {"page": number, "error": str(e)}


def pages(raw: bytes | None) -> list[dict]:
    return list(walk(raw))


def encode(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, strip_rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None) -> bytes:
    """A little-endian file of 8-bit pages, each given as a (rows, columns) or (rows, columns, samples) array."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for image in images:
        image = np.asarray(image, np.uint8)
        image = image[:, :, None] if image.ndim == 2 else image
        height, width, per = image.shape
        w, h = tile or (width, min(height, strip_rows))
        parts = []
        for top in range(0, height, h):
            for left in range(0, width, w):
                block = image[top : top + h, left : left + w]
                if tile:
                    block = np.pad(block, ((0, h - block.shape[0]), (0, w - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros((block.shape[0], 1, per), np.uint8))
                parts.append(PACK[compression](block.tobytes()))
        offsets = []
        for part in parts:
            offsets.append(len(out))
            out += part + b"\0" * (len(part) % 2)
        tags = {WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [8] * per), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [1 if per < 3 else 2]), SAMPLES: (3, [per]), PREDICTOR: (3, [predictor])}
        if tile:
            tags |= {TILE_WIDTH: (4, [w]), TILE_HEIGHT: (4, [h]), TILE_OFFSETS: (4, offsets), TILE_COUNTS: (4, [len(p) for p in parts])}
        else:
            tags |= {STRIP_OFFSETS: (4, offsets), ROWS_PER_STRIP: (4, [h]), STRIP_COUNTS: (4, [len(p) for p in parts])}
        entries = bytearray()
        for tag in sorted(tags):
            kind, values = tags[tag]
            body = struct.pack(f"<{len(values)}{FIELD[kind][0]}", *values)
            if len(body) > 4:
                at = len(out)
                out += body + b"\0" * (len(body) % 2)
                body = struct.pack("<I", at)
            entries += struct.pack("<HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def payload(text: str | None) -> tuple[int, bytes]:
    """The text's UTF-8 length, and its bytes filled up with 0 to a positive multiple of ROW."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(ROW, -(-len(raw) // ROW) * ROW), b"\0")


def _store(batches):
    for batch in pieces(batches):
        sizes, media, digests = [], [], []
        for text in column(batch, "text"):
            size, body = payload(text)
            sizes.append(size)
            media.append(encode([np.frombuffer(body, np.uint8).reshape(-1, ROW)]))
            digests.append(hashlib.sha256(media[-1]).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("doc_id")), pa.array(sizes, pa.int64()), pa.array([len(m) for m in media], pa.int64()), pa.array(digests, pa.string()), pa.array(media, pa.binary())],
            ["doc_id", "n_bytes", "media_bytes", "media_sha256", "media"],
        )


def store(docs: DataFrame) -> DataFrame:
    """Each text as a one-page file of 64 samples a row: doc_id, n_bytes, media_bytes, media_sha256, media."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_store, "doc_id bigint, n_bytes bigint, media_bytes bigint, media_sha256 string, media binary")


def _walker(key: str, media: str, carry: list[str]):
    names = PAGE_COLUMNS
    kinds = [*[pa.int32()] * 7, pa.binary(), pa.string(), pa.string()]

    def table_of(batch: pa.RecordBatch, source: list[int], rows: list[dict]) -> pa.RecordBatch:
        kept = batch.select([key, *carry]).take(pa.array(source, pa.int64()))
        return pa.RecordBatch.from_arrays([*kept.columns, *(pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True))], [key, *carry, *names])

    def run(batches):
        for batch in by_size(batches, media, BATCH_BYTES):
            rows, source, held = [], [], 0
            at_media = batch.schema.get_field_index(media)
            for at in range(batch.num_rows):
                for page in walk(batch.column(at_media)[at].as_py()):
                    rows.append(page)
                    source.append(at)
                    held += len(page.get("pixels", b""))
                    if held >= BATCH_BYTES:
                        yield table_of(batch, source, rows)
                        rows, source, held = [], [], 0
            yield table_of(batch, source, rows)

    return run


def explode_pages(df: DataFrame, key: str, media: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per page of the files in column `media`, with the key and the carried columns.

    A key or carried column named like one of a page's own columns is refused.
    """
    clash = {key, *carry} & set(PAGE_COLUMNS)
    if clash or len({key, *carry}) <= len(carry):
        raise ValueError(f"columns that would stand twice: {', '.join(sorted(clash)) or 'the key or a carried one'}; rename them")
    given = df.select(key, *carry, media)
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    tail = PAGE_SCHEMA.split(", ", 1)[1]
    return given.mapInArrow(_walker(key, media, list(carry)), f"{head}, {tail}")


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every text as a TIFF, reads its page back and describes what was read."""
    read = explode_pages(store(table(spark, sf_dir, "documents")), "doc_id", "media", ("n_bytes", "media_bytes", "media_sha256"))
    return read.select(
        "doc_id", "n_bytes", F.length("pixels").cast("bigint").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -ROW, ROW)).alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
    )
