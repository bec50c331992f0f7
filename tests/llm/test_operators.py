"""The training-data operators against brute force, round trips and odd inputs."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import chat, common, decontaminate, langmodel, licenses, linededup, neardup, sentencepieces, tiff, toxicity, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null ids and texts, empty and blank texts, a repeated row, one id with two texts.
ODD = [(None, "one two three four five six", "en", "s", 1), (90, None, None, None, None), (91, "", "en", "s", 0), (92, " \n\t ", "en", "s", 4), (93, "short", "en", "s", 5), (93, "short", "en", "s", 5), (94, "a b", "en", "s", 3), (94, "c d e f g h i j", "en", "s", 9)]


def docs(spark, rows, clash=True):
    """A documents table; with columns whose names the operators use inside."""
    df = spark.createDataFrame([(*r, "en", "s", len(r[1] or ""))[:5] if len(r) == 2 else r for r in rows], DOCS)
    if not clash:
        return df
    return df.withColumns({c: F.lit("x") for c in ("id", "d", "h", "pos", "runs", "component", "signature", "score", "bucket", "k", "rank", "n_lines", "ids", "toxic")})


def words(rng, n, kinds=400):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


# Shared helpers


def test_word_hashes_match_the_definition():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("aB é\t\n\x0b\x0c\r  漢\x00ſ") for _ in range(rng.randrange(40)))
        want = text.encode().lower().split()
        got = common.word_hashes(text)
        assert len(got) == len(want)
        assert all((a == b) == (x == y) for (a, x), (b, y) in itertools.combinations(zip(got.tolist(), want, strict=True), 2))


def test_by_size_keeps_all_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (5, 1, 9, 0, 3)] + [None])], ["t"])
    parts = list(common.by_size([batch], "t", 8))
    assert sum((p.column(0).to_pylist() for p in parts), []) == batch.column(0).to_pylist() and len(parts) == 3


# 1


def brute_groups(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations([(i, s) for i, group in sets.items() for s in group], 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def near_copies(rng, n_groups=25, loose=40):
    rows, at = [], 0
    for g in range(n_groups):
        base = words(rng, rng.choice((4, 12, 60, 150)), 5000)
        for _ in range(rng.choice((1, 2, 6))):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9)}"
            rows.append((at, " ".join(copy)))
            at += 1
    passage = words(rng, 40, 5000)
    rows += [(at + k, " ".join(passage + words(rng, rng.randrange(5, 40), 5000))) for k in range(loose)]  # share a passage, mostly too little
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("blocks", [(256, 512, 1_000_000), (3, 5, 1_000_000), (256, 512, 150)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(neardup, "OUTSIDE_ROWS", blocks[0])
    monkeypatch.setattr(neardup, "ALL_ROWS", blocks[1])
    monkeypatch.setattr(neardup, "OUTSIDE_SHINGLES", blocks[2])
    monkeypatch.setattr(neardup, "ALL_SHINGLES", 2 * blocks[2])
    rows = near_copies(random.Random(blocks[0]))
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs(spark, rows), 4).collect()}
    want = brute_groups(rows, 4, 80)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_pivot_rounds_and_shuffled_ids(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CROWDED", 0)
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    rows = near_copies(random.Random(5), 12)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(spark, rows), 4).collect()}
    assert got == brute_groups(rows, 4, 80)


def test_near_duplicates_odd_rows(spark):
    got = neardup.near_duplicates(docs(spark, [*ODD, (95, "C D e f g h i j"), (96, "Short"), (97, "a b")]), 5).collect()
    assert len(got) == len(ODD) + 3
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[None] == {(2, None, True)} and by[90] == {(0, 90, True)}
    assert by[91] == {(0, 91, True)} and by[92] == {(0, 92, True)} and by[93] == {(1, 93, True)} and by[96] == {(1, 93, False)}
    assert {c for _, c, _ in by[94]} == {94} and by[95] == {(4, 94, False)} and by[97] == {(1, 94, False)}
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    kept = neardup.drop_near_duplicates(docs(spark, [*ODD, (95, "C D e f g h i j")]))
    assert kept.columns == docs(spark, []).columns and kept.count() == len(ODD)


def test_pruning_bounds():
    rng = np.random.default_rng(0)
    bounds = neardup.least_matches(80)
    alike = rng.random((20_000, neardup.PERMUTATIONS)) < 0.8
    assert len(neardup.unpruned(alike, np.ones_like(alike), bounds)) == len(alike)
    apart = rng.random((2000, neardup.PERMUTATIONS)) < 0.4
    assert len(neardup.unpruned(apart, np.ones_like(apart), bounds)) == 0


# 2


def brute_lines(rows, least):
    """Deletes, place by place, what an earlier place has in a run of enough words."""
    lines = [[(n, x) for n, x in enumerate(t.split("\n")) if x.strip(" \t\r")] if t else [] for _, t in rows]
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    first, gone = {}, {k: set() for k in order}
    for k in order:
        for a in range(len(lines[k])):
            for b in range(a, len(lines[k])):
                run = tuple(x for _, x in lines[k][a : b + 1])
                if sum(len(re.findall("[^ \t\r]+", x)) for x in run) >= least:
                    if first.setdefault(run, (k, a)) != (k, a):
                        gone[k].update(range(a, b + 1))
    out = {}
    for k in order:
        drop, marked = set(), sorted(gone[k])
        for p, q in zip(marked, [*marked[1:], None][: len(marked)], strict=True):
            drop.update(range(lines[k][p][0], (lines[k][q][0] if q == p + 1 else lines[k][p][0]) + 1))
        out[rows[k][0]] = "\n".join(x for n, x in enumerate(rows[k][1].split("\n")) if n not in drop)
    return out


@pytest.mark.parametrize(("hot", "most"), [(64, 100_000), (1, 100_000), (1, 3)])
def test_line_dedup_equals_brute_force(spark, monkeypatch, hot, most):
    monkeypatch.setattr(linededup, "HOT", hot)
    monkeypatch.setattr(linededup, "BROADCAST_RUNS", most)
    rng = random.Random(hot + most)
    pool = [rng.choice((" ", " ", "\t", "  ", " \t")).join(words(rng, n)) for n in (1, 2, 3, 4, 5, 6, 8, 12)] + [" a b\t", "c\td\r"]
    for _ in range(2):
        rows = [(i, "\n".join(rng.choice([*pool, "", " "]) for _ in range(rng.randrange(1, 14)))) for i in range(25)]
        got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs(spark, rows, False), 10).collect()}
        assert got == brute_lines(rows, 10)


def test_line_dedup_shuffled_join_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(linededup, "BROADCAST_DOCS", -1)
    run = " ".join(f"p{n}" for n in range(40))
    rows = [*ODD, (1, f"a\n{run}\nb"), (2, f"{run}"), (2, f"{run}"), (3, f"c\n\n{run}"), (None, run)]
    base = docs(spark, rows)
    got = sorted(((r["doc_id"] or -1), r["text"]) for r in linededup.dedup_lines(base, 30).collect() if r["text"] is not None)
    assert len(got) == len(rows) - 1
    assert (-1, run) in got and (1, "a\nb") in got and got.count((2, "")) == 2 and (3, "c\n") in got and (91, "") in got
    kept = linededup.clean_documents(docs(spark, rows), 30)
    assert kept.columns == docs(spark, rows).columns
    texts = [(r["doc_id"], r["text"], r["n_chars"]) for r in kept.collect()]
    assert len(texts) == len(rows) - 2 and (1, "a\nb", 3) in texts and (91, "", 0) in texts
    assert linededup.dedup_lines(docs(spark, [], False)).count() == 0


# 3


def plain_language_model(rows):
    """log10 scores by id, and the probability function of (context tuple, word), by loops over tokens."""
    cut = lambda t: [*(w.lower() for w in (t or "").encode().split()), b"\n"]
    part = {i: -1 if i is None else zlib.crc32(str(i).encode()) % 5 for i, _ in rows}

    def count(ids):
        grams = [Counter(), Counter(), Counter()]
        starts = 0
        for i, text in rows:
            if part[i] in ids:
                line = [b"", *cut(text)]
                starts += 1
                for k in range(1, len(line)):
                    for order in range(1, 4):
                        if k - order + 1 >= 0:
                            grams[order - 1][tuple(line[k - order + 1 : k + 1])] += 1
        return grams, starts, sum(grams[0].values())

    everything, main = count({0, 2, 3, 4}), count({2, 3, 4})
    flat = 1 / (len(everything[0][0]) + 1)
    weights = [{}, {}, {}]

    def context_count(counts, context):
        grams, starts, total = counts
        return total if not context else starts if context == (b"",) else grams[len(context) - 1][context]

    bucket = lambda counts, context: math.floor(math.log2(context_count(counts, context))) if context else 0

    def p(counts, context, word, order):
        if order == 0:
            return flat
        below = p(counts, context, word, order - 1)
        of = context[len(context) - order + 1 :]
        if len(of) < order - 1 or not context_count(counts, of):
            return below
        a = weights[order - 1].get(bucket(counts, of), 0.0)
        return a * counts[0][order - 1][(*of, word)] / context_count(counts, of) + (1 - a) * below

    for order in range(1, 4):
        events = {}
        for i, text in rows:
            line = [b"", *cut(text)]
            for k in range(1, len(line)) if part[i] == 0 else ():
                of = tuple(line[max(0, k - order + 1) : k])
                if len(of) == order - 1 and context_count(main, of):
                    events.setdefault(bucket(main, of), []).append((main[0][order - 1][(*of, line[k])] / context_count(main, of), p(main, tuple(line[max(0, k - 2) : k]), line[k], order - 1)))
        for b, seen in events.items():
            a = 0.5
            for _ in range(60):
                a = min(1 - 1e-6, sum(a * high / (a * high + (1 - a) * low) for high, low in seen if high) / len(seen))
            weights[order - 1][b] = a
        if order == 1:
            weights[0].setdefault(0, 0.5)
            weights[0][0] = max(weights[0][0], 1e-6)
    score = lambda t: sum(math.log10(p(everything, tuple([b"", *cut(t)][max(0, k - 2) : k]), [b"", *cut(t)][k], 3)) for k in range(1, len(cut(t)) + 1))
    return [(i, score(t)) for i, t in rows], lambda context, word: p(everything, context, word, 3), everything


def test_langmodel_base_counts(spark):
    rng = random.Random(2)
    vocabulary = [f"t{int(rng.paretovariate(0.8)) % 60}" for _ in range(3000)]
    rows = [*ODD[1:], (None, "t1 t1 t2")] + [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 60)))) for i in range(120)]
    tokens = lambda t: [*((t or "").encode().lower().split()), None]
    learnt = Counter(w for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 != 1 for w in tokens(r[1]))
    n, v = sum(learnt.values()), len(learnt)
    got = langmodel.score_documents(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted((-1 if i is None else i, len(tokens(t)), sum(learnt[w] > 0 for w in tokens(t)), round(sum(math.log10((learnt[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for i, t, *_ in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {n}
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in got)
    assert langmodel.score_documents(docs(spark, [])).count() == 0


@pytest.mark.parametrize("block_tokens", [langmodel.FLUSH, 40])
def test_langmodel_scores_equal_a_plain_version(spark, block_tokens):
    """In one block, and in very many blocks and buckets."""
    rng = random.Random(6)
    vocabulary = [f"t{int(rng.paretovariate(0.8)) % 60}" for _ in range(3000)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for i in range(150)] + [(None, "t1 t2 new t1"), (3, "t1 T1 t2")]
    want, probability, (grams, _, total) = plain_language_model(rows)
    got = langmodel.score_documents(docs(spark, rows, block_tokens == 40), block_tokens).collect()
    assert [x for _, x in sorted((str(r["doc_id"]), r["score"]) for r in got)] == pytest.approx([x for _, x in sorted((str(i), x) for i, x in want)], rel=1e-4)
    assert {r["train_tokens"] for r in got} == {total}
    for context in ((b"",), (b"", b"t1"), (b"t1", b"t2"), (b"t5", b"never")):  # over all words and one unknown it is a distribution
        assert sum(probability(context, w) for (w,) in grams[0]) + probability(context, b"unknown") == pytest.approx(1.0)


def test_em_finds_the_mixture():
    got = langmodel._learn(np.zeros(1, int), np.array([1.0]), np.array([1e-9]), np.array([30.0]), np.bincount([0], [100.0], langmodel.BUCKETS))
    assert got[0] == pytest.approx(0.3, abs=1e-6)


# 4


def test_template_language():
    run = lambda t, **v: chat.compile_template(t)(**v)[0]
    assert run("a{{ x.y[0] ~ '!' | upper }}b", x={"y": ["q"]}) == "aq!b"
    assert run("{% for i in l %}{{ loop.index }}{{ i }}{% if not loop.last %},{% endif %}{% endfor %}", l=["a", "b"]) == "1a,2b"
    assert run("{% if a == 1 %}x{% elif a in b %}y{% else %}z{% endif %}", a=2, b=[2]) == "y"
    assert run("{% set q = n + 1 -%}   {{ q if q > 2 else 'no' }}{# gone #}", n=1) == "no"
    assert chat.fold(chat.parse("{{ 'a' ~ 1 }}{% if false %}x{% endif %}b")) == [("text", "a1b")]
    text, marks = chat.compile_template("<{% generation %}{{ t }}{% endgeneration %}>")(t="é😀")
    assert text == "<é😀>" and marks == [(1, 3)]
    for bad in ("{% for x %}{% endfor %}", "{{ a b }}", "{{ a | nope }}", "{% if a %}", "{{ f('x') }}", "{% nope %}", "{{ }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    with pytest.raises(chat.TemplateError):
        run("{{ x.__class__ }}", x="text")
    assert run("{{ x.__class__ }}", x={}) == ""


def test_chat_round_trip(spark):
    rng = random.Random(6)
    odd = ["", chat.PROBE, "\\", "\\l", "<turn>### User:\n", "</turn>\n", "a\n\n", "é😀", None, "###", "\\\\h<"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "x:\n<", None]), rng.choice(odd), 1) for c in range(30) for t in range(rng.randrange(1, 6))]
    rows += [(None, 0, "assistant", "lost", 1), (3, None, "user", "first", 1), (4, 0, "user", "twice", 1), (4, 0, "user", "twice", 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, messages int")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(frame)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0), r or "", x or "") for c, t, r, x, _ in rows if c == conv)
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        row = got[conv]
        assert (row["n_turns"], row["turns_sha256"], row["loss_chars"], row["loss_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(frame.limit(0)).count() == 0
    with pytest.raises(chat.TemplateError):
        chat.parse_rendered("<turn>### User:\nx</turn>")


# 5


@pytest.mark.parametrize("scheme", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_tiff_round_trip(scheme, predictor, tile):
    rng = np.random.default_rng(1)
    for shape in ((1, 64), (70, 64), (300, 33, 3)):
        for kinds in (2, 256):
            images = [rng.integers(0, kinds, shape).astype(np.uint8), np.full(shape, 7, np.uint8)]
            got = tiff.pages(tiff.encode(images, scheme, predictor, 32, tile))
            assert [(p["page"], p["error"], p["pixels"]) for p in got] == [(k, None, im.tobytes()) for k, im in enumerate(images)]


def test_tiff_big_endian_and_wide_samples():
    """A hand-made file: big-endian, one strip of 16-bit samples, none compressed."""
    import struct

    tags = [(256, 3, 1, 2 << 16), (257, 3, 1, 1 << 16), (258, 3, 1, 16 << 16), (259, 3, 1, 1 << 16), (273, 4, 1, 8), (277, 3, 1, 1 << 16), (278, 3, 1, 1 << 16), (279, 4, 1, 4)]
    raw = b"MM\0*" + struct.pack(">I", 12) + struct.pack(">HH", 258, 3) + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", *t) for t in tags) + b"\0\0\0\0"
    page = tiff.pages(raw)[0]
    assert (page["width"], page["height"], page["bits"], page["pixels"]) == (2, 1, 16, struct.pack(">HH", 258, 3))


def test_tiff_broken_files(spark):
    good = tiff.encode([np.zeros((4, 64), np.uint8)])
    loop = bytearray(tiff.encode([np.zeros((1, 64), np.uint8)]))
    loop[-4:] = loop[4:8]  # the next directory is the same one
    assert len(tiff.pages(bytes(loop))) == 1
    rows = [(1, good), (1, good), (2, None), (3, b""), (4, b"text"), (5, good[:-30]), (6, good.replace(b"\x03\x01\x03\x00\x01\x00\x00\x00\x08\x00", b"\x03\x01\x03\x00\x01\x00\x00\x00\x63\x00"))]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "key long, media binary, page string")
    got = tiff.explode_pages(frame.withColumnRenamed("page", "extra"), "key", "media", ("extra",)).collect()
    assert sorted((r["key"], r["error"] is None) for r in got) == [(1, True), (1, True), (4, False), (5, False), (6, False)]
    assert tiff.explode_pages(frame.limit(0), "key", "media").count() == 0


def test_tiff_goes_on_after_a_page_that_cannot_be_read():
    raw = tiff.encode([np.full((2, 64), k, np.uint8) for k in range(3)])
    entry = b"\x03\x01\x03\x00\x01\x00\x00\x00"
    second = raw.index(entry, raw.index(entry) + 1) + len(entry)
    got = tiff.pages(raw[:second] + b"\x63" + raw[second + 1 :])  # an unknown compression
    assert [(p["page"], p["error"] is None) for p in got] == [(0, True), (1, False), (2, True)]
    assert got[2]["pixels"] == bytes([2]) * 128


def tiff_with(tags, data=b"\0" * 256):
    """A little-endian file of one page: the data from byte 8 on, then the given (tag, kind, number, value bytes)."""
    import struct

    at = 8 + len(data)
    body = b"".join(struct.pack("<HHI", t, k, n) + v.ljust(4, b"\0") for t, k, n, v in tags)
    return b"II*\0" + struct.pack("<I", at) + data + struct.pack("<H", len(tags)) + body + b"\0\0\0\0"


def test_tiff_malformed_tags_give_an_error_row():
    import struct

    short, long = lambda *v: struct.pack(f"<{len(v)}H", *v), lambda v: struct.pack("<I", v)
    good = {256: (3, 1, short(16)), 257: (3, 1, short(16)), 258: (3, 1, short(8)), 259: (3, 1, short(1)), 273: (4, 1, long(8)), 277: (3, 1, short(1)), 278: (3, 1, short(16)), 279: (4, 1, long(256))}
    make = lambda changes, data=b"\0" * 256: tiff.pages(tiff_with([(t, *v) for t, v in sorted((good | changes).items()) if v], data))
    assert [p["error"] for p in make({})] == [None]
    bomb = zlib.compress(b"\0" * 3_000_000)
    for changes in (
        {278: (3, 1, short(0))}, {256: (3, 0, b"")}, {256: (2, 1, b"a")}, {256: (3, 1, short(0))}, {257: (3, 1, short(0))}, {277: (3, 1, short(0))},
        {273: (4, 0, b"")}, {279: (2, 2, b"ab")}, {258: (3, 2, short(8, 16))}, {256: (9, 1, struct.pack("<i", -4))}, {256: None}, {273: None},
        {256: (4, 1, long(2**31)), 257: (4, 1, long(2**31)), 278: (4, 1, long(2**31))}, {256: (4, 1, long(60000)), 257: (4, 1, long(30000)), 278: (4, 1, long(30000))},
        {322: (3, 1, short(0)), 323: (3, 1, short(16)), 324: (4, 1, long(8)), 325: (4, 1, long(256))}, {322: (4, 1, long(2**30)), 323: (4, 1, long(2**30)), 324: (4, 1, long(8)), 325: (4, 1, long(256))},
        {259: (3, 1, short(8)), 279: (4, 1, long(len(bomb) + 10**6))}, {279: (4, 1, long(255))}, {273: (5, 1, long(0))},
    ):
        got = make(changes)
        assert len(got) == 1 and got[0]["error"] and "pixels" not in got[0], changes
    page = make({259: (3, 1, short(8)), 279: (4, 1, long(len(bomb)))}, bomb)[0]  # no more is decoded than the page takes
    assert page["error"] is None and page["pixels"] == b"\0" * 256
    assert tiff._inflate(bomb, 100) == b"\0" * 100 and len(tiff.unpack_bits(b"\x81a" * 50, 100)) < 300 and len(tiff.unpack_lzw(tiff.pack_lzw(b"a" * 5000), 100)) < 300


def test_tiff_never_raises():
    rng = random.Random(8)
    images = [np.random.default_rng(2).integers(0, 4, (40, 24, 3)).astype(np.uint8), np.zeros((3, 5), np.uint8)]
    files = [tiff.encode(images, scheme, 2, 16, tile) for scheme in tiff.PACK for tile in (None, (16, 16))]
    for _ in range(3000):
        raw = bytearray(rng.choice(files))
        for _ in range(rng.randrange(1, 6)):
            raw[rng.choice((rng.randrange(len(raw)), max(0, len(raw) - rng.randrange(1, 200))))] = rng.choice((0, 1, 2, 255, rng.randrange(256)))
        raw = bytes(raw[: rng.choice((len(raw), rng.randrange(len(raw))))])
        assert all((p["error"] is None) == ("pixels" in p) for p in tiff.pages(raw))


def test_tiff_query_equals_the_payload(spark, tmp_path):
    texts = [(1, "abc"), (2, None), (3, ""), (4, "é" * 500), (5, "x" * 70_000), (6, "abc"), (None, "z")]
    docs(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in tiff.op5_tiff(spark, str(tmp_path)).collect()}
    for i, t in texts:
        raw = (t or "").encode()
        body = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
    assert (got[1]["media_sha256"], got[1]["feature"]) == (got[6]["media_sha256"], got[6]["feature"])


# 6


def brute_licenses(text):
    """Every block of words against every template, with sets."""
    low = licenses.lowered(text)
    all_words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.encode().split()
        for k in range(len(all_words) - len(p) + 1):
            if all_words[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    orders = [licenses.words(licenses.lowered(t)) for _, t in licenses.TEMPLATES]
    blocks = {}
    for t, order in enumerate(orders):
        width = min(len(all_words), int(len(order) / 0.95 + 1e-9))
        hit = [k for k in range(len(all_words) - width + 1) if len(set(order) & set(all_words[k : k + width])) >= 0.95 * len(set(order)) - 1e-9]
        if hit and width:
            blocks[t] = width, hit
    found = set()
    for t, (width, hit) in blocks.items():
        taken = set()
        for u, (wide, starts) in blocks.items():
            if set(orders[t]) < set(orders[u]):
                used = set()
                for k in sorted(starts, key=lambda k: (all_words[k : k + len(orders[u])] != orders[u], k)):  # noqa: B023
                    if not used & set(range(k, k + wide)):
                        used |= set(range(k, k + wide))
                taken |= used
        if any(not taken & set(range(k, k + width)) for k in hit):
            found.add(t)
    return len(all_words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {licenses.TEMPLATES[t][0] for t in found})), sorted(found)


def test_licenses_equal_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", "CC-BY", "All Rights\nreserved all rights reserved", "K cc by"]
    for label, template in licenses.TEMPLATES:
        w = template.split()
        texts += [template, "x y\n" + template.upper() + "\nz", " ".join(rng.sample(w, len(w))), " ".join(w[: len(w) * 3 // 4]), "\n".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9)), "\n" * 40 + template]
        cut = [x for k, x in enumerate(w) if k != len(w) // 2]
        texts += ["a b c " + " ".join(cut), "\n".join(w), " ".join(f"{x} filler" for x in w), " ".join([*w[:3], "and", "so", *w[3:]]), template + " " + rng.choice(licenses.TEMPLATES)[1]]
    pool = [x for _, t in licenses.TEMPLATES for x in t.split()]
    texts += [" ".join(rng.choice(pool) for _ in range(400)) for _ in range(10)]
    texts.append("Licensed " + "x " * 20 + "under CC " + "y " * 20 + "BY 4.0")
    assert brute_licenses(texts[-1])[6] == [] and brute_licenses("Licensed under the Apache License,\nVersion 2.0")[6] == [0]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "licensed under cc by 4.0"), (1, "")]
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "templates")
    got = sorted((str(r["doc_id"]), str(tuple(r[n] for n in names))) for r in licenses.scan_licenses(docs(spark, rows)).collect())
    assert got == sorted((str(i), str(brute_licenses(t))) for i, t in rows)
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


def test_license_query_finds_wrapped_notices(spark, tmp_path):
    """A notice broken over lines, at any width and with comment marks, has the label of the unbroken one."""
    rows = []
    for k, (_, template) in enumerate(licenses.TEMPLATES):
        w = template.split()
        for width in (2, 3, 4, 5, 9):
            rows.append((k * 100 + width, "x\n" * 5 + "\n".join("# " + " ".join(w[i : i + width]) for i in range(0, len(w), width)) + "\ny"))
    rows.append((9001, "licensed under\nCC BY 4.0\nz\nlicensed under CC BY-SA 4.0"))
    rows.append((9002, "licensed under CC BY-SA\n4.0 licensed under CC BY-SA 4.0"))
    rows.append((9000, "all of these\nwords have rights and\nsome are reserved"))
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in licenses.op6_licenses(spark, str(tmp_path)).collect()}
    for k, (label, _) in enumerate(licenses.TEMPLATES):
        assert all(label in got[k * 100 + width]["labels"].split(",") for width in (2, 3, 4, 5, 9)), label
    assert got[9000]["labels"] == ""
    assert got[9001]["labels"] == "cc-by,cc-by-4.0,cc-by-sa-4.0"
    assert got[9002]["labels"] == "cc-by,cc-by-sa-4.0"


def test_license_query_keeps_a_notice_beside_a_larger_one(spark, tmp_path):
    rows = [(1, "licensed under CC BY 4.0 and licensed under CC BY-SA 4.0"), (2, "licensed under CC BY-SA 4.0 licensed under CC BY 4.0"), (3, "licensed under CC BY-NC-SA 4.0, licensed under CC BY-SA 4.0")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["labels"] for r in licenses.op6_licenses(spark, str(tmp_path)).collect()}
    assert got == {1: "cc-by,cc-by-4.0,cc-by-sa-4.0", 2: "cc-by,cc-by-4.0,cc-by-sa-4.0", 3: "cc-by,cc-by-nc-sa-4.0,cc-by-sa-4.0"}


# 7


def test_grammar_contexts():
    m = toxicity.Model()
    count = lambda t: {e: n for e, n in zip(toxicity.EVENTS, m.sums(t)[1], strict=True) if n}
    assert count("You are an idiot.") == {"insult+target": 1}
    assert count("idiot, you") == {"insult+target": 1}
    assert count("a clown walked by") == {"insult": 1}
    assert count("he is not a moron") == {"insult+negated": 1}
    assert count("an idiot you are not.") == {"insult+negated": 1}
    assert count("you idiot, don't touch it") == {"insult+target": 1}
    assert count("she said that you are scum") == {"insult+reported": 1}
    assert count("He said: you idiot.") == {"insult+reported": 1}
    assert count('"You idiot", she said.') == {"insult+reported": 1}
    assert count("I will kill you. Nice day.") == {"threat+target": 1}
    assert count("idiotic weather, idiots!\nNo. trash") == {"insult": 3}
    assert count(None) == count("") == count("nothing at all") == {}


def test_composition_adds_weights():
    g = toxicity.from_start(toxicity.PRIOR)
    events, weights = g.run(["target", "other", "insult", "other", "insult"], [0.0, 0.0, 3.0, 0.0, 2.0])
    assert [e for e in events if e] == ["insult+target", "insult"]
    assert weights == pytest.approx([0, 0, 3 + toxicity.PRIOR[1], 0, 2 + toxicity.PRIOR[0]])


def plain_toxicity(text, lexicon, contexts, line):
    """The score by loops over words, without transducers."""
    total = dict.fromkeys(toxicity.EVENTS, 0.0)
    lists = {k: set(getattr(toxicity, k).split()) for k in ("TARGETS", "NEGATIONS", "REPORTS", "THREATS")}

    def weight(word):
        word = word.split("'")[0]
        if word in lexicon:
            return lexicon[word]
        return max(((len(s), w) for s, w in lexicon.items() if s.endswith("*") and word.startswith(s[:-1])), default=(0, None))[1]

    for clause in re.split(r"[.!?;\n]+", (text or "").lower()):
        ws = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", clause)
        kind = lambda w: next((k for k, name in (("target", "TARGETS"), ("negation", "NEGATIONS"), ("report", "REPORTS")) if w in lists[name]), None)
        kinds = [kind(w) for w in ws]
        for i, w in enumerate(ws):
            if kinds[i] or weight(w) is None:
                continue
            n, tag = len(ws), ""
            if "target" in kinds[max(0, i - 3) : i] + kinds[i + 1 : i + 4]:
                tag = "+target"
            if "negation" in kinds[max(0, i - 3) : i] or kinds[-1] == "negation" and n - 1 - i <= 3:
                tag = "+negated"
            if "report" in kinds[:i] or "report" in kinds[max(i + 1, n - 3) :]:
                tag = "+reported"
            event = ("threat" if w in lists["THREATS"] else "insult") + tag
            total[event] += weight(w) + contexts[toxicity.EVENTS.index(event)]
    s = sum(max(0.0, v) for v in total.values())
    n = len((text or "").split())
    z = line[0] + line[1] * math.log1p(s) + line[2] * math.log1p(s / (1 + n / 100))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_toxicity_score_equals_a_plain_version():
    rng = random.Random(31)
    lexicon = toxicity._prior_lexicon() | {"zorb*": 2.5, "zorblik": 4.0, "zorbli*": 1.0, "réê*": 2.0}
    model = toxicity.Model(lexicon, (0.5, 1.0, -2.0, -1.5, -1.0, 0.7, -2.5, -2.0), (-4.0, 1.5, 2.0))
    some = "idiot clown kill hurt you they not never nicht said wrote zorb zorblik zorblike zorbus réêa réê the a green it's don't idiot's trash".split()
    seen = set()
    for _ in range(2000):
        text = "".join(rng.choice(some) + rng.choice([" ", " ", " ", ", ", ": ", ". ", "; ", "\n", "! "]) for _ in range(rng.randrange(0, 25)))
        assert model.score(text) == pytest.approx(plain_toxicity(text, lexicon, model.contexts, model.line), abs=1e-12), text
        seen.add(round(model.score(text), 2))
    assert len(seen) > 20
    assert model.score(None) == model.score("") == pytest.approx(1 / (1 + math.exp(4)))


def test_toxicity_fit_reaches_the_least_loss():
    rng = np.random.default_rng(3)
    counts = rng.poisson(0.4, (400, len(toxicity.EVENTS))).astype(float)
    weights, words = counts * 3, rng.integers(5, 800, 400).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(weights[:, :2].sum(axis=1) - 4)))).astype(float)

    def loss(w):
        total = np.maximum(weights + counts * w[:8], 0).sum(axis=1)
        p = 1 / (1 + np.exp(-np.clip(w[8] + w[9] * np.log1p(total) + w[10] * np.log1p(total / (1 + words / 100)), -30, 30)))
        ridge = np.array([*[toxicity.RIDGE_CONTEXT] * 8, *toxicity.RIDGE_LINE])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum() + (ridge * (w - np.array([*toxicity.PRIOR, *toxicity.PRIOR_LINE])) ** 2).sum() / 2

    contexts, line = toxicity.fit_weights(weights, counts, words, y)
    best = np.array([*contexts, *line])
    assert loss(best) < loss(np.array([*toxicity.PRIOR, *toxicity.PRIOR_LINE])) - 10
    for k in range(11):
        for step in (-1e-2, 1e-2):
            moved = best.copy()
            moved[k] += step
            assert loss(moved) > loss(best) - 1e-6


def test_toxicity_recall_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    frame, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(spark, frame, labels)
    got = toxicity.score(spark, frame, model).join(labels, "doc_id").where("held_out").join(frame.select("doc_id", "text"), "doc_id").collect()
    toxic = [r for r in got if r["toxic"]]
    # Of the labelled texts without any word of the lexicon none can be found.
    able = [r for r in toxic if any(model.sums(r["text"])[1])]
    assert sum(r["predicted"] for r in able) >= 0.95 * len(able) and sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic)
    assert sum(r["predicted"] for r in got if not r["toxic"]) <= 1


def test_toxicity_learns_hidden_stems(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        w = words(rng, 60)
        toxic = i % 3 == 0
        if toxic:
            for _ in range(2):
                w[rng.randrange(60)] = "zorblik" + rng.choice(["a", "en", "ung", "ieren", "o", "t"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic) if i % 100 else 1 - int(toxic), 0))
    labels += [(5, None, 0), (None, 1, 0), (6, 0, 0)]
    frame, marks = docs(spark, [*rows, *ODD]), spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    model = toxicity.fit(spark, frame, marks)
    assert "zorblik*" in model.lexicon
    got = toxicity.score(spark, frame, model).collect()
    assert len(got) == len(rows) + len(ODD)
    held = [(r["predicted"], int(r["doc_id"] % 3 == 0)) for r in got if r["held_out"] and r["doc_id"] < 900]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    clean = toxicity.drop_toxic(spark, frame, marks)
    assert clean.columns == frame.columns and clean.where("doc_id BETWEEN 90 AND 94").count() >= 5
    empty = toxicity.fit(spark, frame, marks.limit(0))
    assert empty.lexicon.keys() == toxicity._prior_lexicon().keys() and empty.contexts == pytest.approx(toxicity.PRIOR) and empty.line == pytest.approx(toxicity.PRIOR_LINE)
    assert toxicity.score(spark, docs(spark, []), empty).count() == 0


def test_toxicity_sample_keeps_rows_that_share_a_footer():
    import pyarrow as pa

    rng = random.Random(12)
    footer = " ".join(words(rng, 25, 10_000))
    texts = [f"{' '.join(words(rng, 40, 10_000))} {footer}" for _ in range(30)]
    texts += [texts[0] + " more", texts[1]]
    batch = pa.record_batch({"doc_id": list(range(len(texts))), "toxic": [0] * 31 + [1], "text": texts})
    got = next(iter(toxicity._sketches([batch])))
    rows = list(zip(got.column(0).to_pylist(), got.column(got.num_columns - 1).to_pylist(), strict=True))
    assert toxicity.one_of_each(rows) == list(range(30))  # the near and the exact copy go
    assert toxicity.one_of_each_label([(i, int(i == 31), keys) for i, keys in rows]) == [*range(30), 31]  # its label is another


# 8


def test_url_filters_equal_brute_force(spark):
    import datetime as dt

    rng = random.Random(10)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    hosts = ["a.com", "www.a.com", "x.y.b.org", "b.org", "c"]
    entries = [(rng.choice(["ads", "bad"]), rng.choice(["a.com", "b.org", "y.b.org", "a.com/p", "a.com/p/q", "c"]), rng.choice(["add", "remove"]), day(rng.randrange(90))) for _ in range(60)]
    captures = [(n, f"http://{rng.choice(hosts)}{rng.choice(['', ':80', ''])}/{rng.choice(['', 'p', 'p/q', 'p//q?z=/r'])}", dt.datetime(2024, 1, 1) + dt.timedelta(rng.randrange(100), rng.randrange(86400))) for n in range(150)]
    captures += [(900, None, captures[0][2]), (901, "nothing", captures[0][2]), (902, captures[0][1], None), (None, "https://user@A.COM./p", dt.datetime(2024, 2, 1)), captures[0]]

    def active(name, pattern, at):
        state = {}
        for d in sorted({e[3] for e in entries if e[:2] == (name, pattern)}):
            state[d] = all(e[2] == "add" for e in entries if e[:2] == (name, pattern) and e[3] == d)
        before = [d for d in state if d <= at.date()]
        return bool(before) and state[max(before)]

    def patterns(url):
        import re

        m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
        if not m or not m[1]:
            return set()
        host = m[1].lower().rstrip(".")
        parts = host.split(".")
        out = {".".join(parts[k:]) for k in range(max(len(parts) - 1, 1))}
        path = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", url)[1]
        steps = [s for s in path.split("/") if s]
        return out | {"/".join([host, *steps[: k + 1]]) for k in range(len(steps))}

    frame = spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp").withColumns({"list": F.lit(1), "pattern": F.lit(1), "month": F.lit(1)})
    log = spark.createDataFrame([*entries, (None, "a.com", "add", day(0)), ("ads", "a.com", "add", None)], "list string, pattern string, action string, day date")
    got = urlfilter.evaluate(frame, log).collect()
    assert len(got) == len(set(captures))
    for r in got:
        hits = [] if r["fetched_at"] is None else [n for n in ("ads", "bad") for p in patterns(r["url"]) if active(n, p, r["fetched_at"])]
        assert (r["blocked"], r["lists"], r["n_entries"]) == (bool(hits), ",".join(sorted(set(hits))), len(hits))
    far = frame.unionByName(frame.limit(1).withColumns({"page_id": F.lit(-1).cast("long"), "fetched_at": F.lit("9998-12-31 05:00:00").cast("timestamp")}))
    open_log = log.unionByName(spark.createDataFrame([("ads", f"open{k}.com", "add", day(0)) for k in range(300)] + [("ads", "x.com", "add", dt.date(1, 1, 1))], log.schema))
    again = urlfilter.evaluate(far, open_log)
    assert sorted(map(str, again.where("page_id IS NULL OR page_id >= 0").collect())) == sorted(map(str, got))
    assert urlfilter.evaluate(frame.limit(0), log).count() == 0
    assert urlfilter.evaluate(frame, log.limit(0)).where("blocked").count() == 0


# 9


def test_sentencepiece_equals_the_library():
    spm = pytest.importorskip("sentencepiece")
    model = spm.SentencePieceProcessor(model_file=sentencepieces.MODEL_FILE)
    v = sentencepieces.Vocabulary.load()
    rng = random.Random(11)
    parts = ["a", "b", "the", " ", "  ", "\n", "é", "漢", "x", "in", "ing", "_", "0", "12", "-", "😀", "\t", "     ", "tion", "str", "ation", "er"]
    texts = ["", " ", "a", *("".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(1500))]
    for text, ids in zip(texts, v.encode(texts), strict=True):
        assert ids.tolist() == model.encode(text)
        assert v.decode(ids) == text


def test_sentencepiece_known_ids():
    """Ids that the library gave for these texts, but for the bytes of the mark."""
    v = sentencepieces.Vocabulary.load()
    texts = ["Hello world, the quick brown fox!", "naïve café ▁ 漢字 😀\n\tdone  x"]
    want = [[22557, 1526, 28725, 272, 2936, 9060, 285, 1142, 28808], [1879, 28920, 333, 28345, 28705, 229, 153, 132, 28705, 233, 191, 165, 29031, 28705, 30575, 13, 12, 10381, 28705, 1318]]
    assert [x.tolist() for x in v.encode(texts)] == want and [v.decode(x) for x in want] == texts


def test_sentencepiece_unigram_is_the_best_sequence():
    pieces_ = ["<unk>", "▁", "a", "b", "ab", "▁a", "ba", "aba", "▁ab"]
    scores = [0.0, -3.0, -2.0, -2.5, -2.2, -3.1, -3.6, -4.0, -5.5]
    v = sentencepieces.Vocabulary(pieces_, scores, [2] + [1] * 8, sentencepieces.UNIGRAM)

    def best(word):
        if not word:
            return 0.0
        return max((best(word[: -len(p)]) + s for p, s in zip(pieces_[1:], scores[1:], strict=True) if word.endswith(p)), default=-1e9)

    for n in range(1, 8):
        for letters in itertools.product("ab", repeat=n):
            word = "▁" + "".join(letters)
            ids = np.frombuffer(dict(v.encode_sorted([word]))[word], np.int32)
            assert "".join(pieces_[i] for i in ids) == word
            assert sum(scores[i] for i in ids) == pytest.approx(best(word))


def test_sentencepiece_documents(spark):
    rows = [*ODD, (1, "x ▁ y▁"), (2, "w" * 3000 + " z"), (3, " lead"), (4, "\n\n"), (5, "\x00\x7f")]
    got = sentencepieces.encode_documents(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["round_trip"] and (r["ids"] is None) == (r["doc_id"] == 90) and (r["ids"] is None or len(r["ids"]) == r["n_pieces"])
    back = sentencepieces.decode_documents(sentencepieces.encode_documents(docs(spark, rows))).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in back) == sorted((str(r[0]), str(r[1])) for r in rows)
    assert sentencepieces.encode_documents(docs(spark, [])).count() == 0


# 10


def brute_tiles(doc, item, least):
    """Longest unmarked match first, found by trying all places."""
    used_d, used_i, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and d + n not in used_d and i + n not in used_i:
                    n += 1
                if n > best[0]:
                    best = (n, d, i)
        if best[0] < least:
            return sorted(out)
        n, d, i = best
        used_d.update(range(d, d + n))
        used_i.update(range(i, i + n))
        out.append((d, i, n))


def test_tiling_equals_brute_force():
    rng = random.Random(12)
    for _ in range(600):
        kinds = rng.choice((2, 3, 4, 20))
        doc, item = ([rng.randrange(kinds) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        got, want = decontaminate.tile(doc, item, 3), brute_tiles(doc, item, 3)
        assert got == want
        for d, i, n in got:
            assert doc[d : d + n] == item[i : i + n] and n >= 3
        spots = [k for d, _, n in got for k in range(d, d + n)]
        assert len(spots) == len(set(spots))


def test_decontamination(spark, monkeypatch):
    rng = random.Random(13)
    items = [(k, " ".join(words(rng, 30, 9000))) for k in range(12)] + [(20, None), (21, ""), (22, "too short"), (23, "same words in here again"), (24, "same words in here again")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    noise = lambda n: " ".join(words(rng, n, 9000))
    swapped = lambda t: " ".join(t.split()[15:] + ["and"] + t.split()[:15])
    rows = [(1, noise(50)), (2, f"{noise(20)} {items[0][1].upper()}, {noise(20)}"), (3, swapped(items[1][1])), (4, " ".join(items[2][1].split()[:10])), (5, noise(9000) + " " + items[3][1]), (6, "SAME words in here again!"), *ODD, (2, items[0][1])]
    frame = docs(spark, rows)
    want = [(2, 0), (2, 0), (3, 1), (5, 3), (6, 23), (6, 24)]
    rows += [(7, f"{noise(3)} {items[4][1]} {noise(9)} {items[5][1]}"), (None, items[6][1]), (8, items[7][1] + " " + "same words in here again " * 3)]
    frame = docs(spark, rows)
    want = sorted([*want, (7, 4), (7, 5), (8, 7), (8, 23), (8, 24), (None, 6)], key=str)
    for most, docs_bound in ((decontaminate.BLOCK_BYTES, 0), (0, 10**6), (0, 0)):  # broadcast, and joined with or without a broadcast of keys
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", most)
        monkeypatch.setattr(decontaminate, "BROADCAST_DOCS", docs_bound)
        got = decontaminate.find_leaks(spark, frame, benchmark).collect()
        assert sorted(((r["doc_id"], r["item_id"]) for r in got), key=str) == want
        kept = decontaminate.drop_leaks(spark, frame, benchmark)
        assert kept.columns == frame.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in rows if r[0] not in (2, 3, 5, 6, 7, 8) and (r[0] is not None or r[1] != items[6][1]))
    three = next(r for r in got if r["doc_id"] == 3)
    assert [(t["doc_start"], t["item_start"], t["length"]) for t in three["tiles"]] == [(0, 15, 15), (16, 0, 15)]
    assert decontaminate.find_leaks(spark, frame, benchmark.limit(0)).count() == 0
    assert decontaminate.find_leaks(spark, frame.limit(0), benchmark).count() == 0


@pytest.mark.parametrize("most", [decontaminate.BLOCK_BYTES, 0])
def test_decontamination_of_short_items_and_scripts_without_spaces(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", most)
    items = [(1, "Too short"), (2, "short"), (3, "法国的首都是哪一座城市"), (4, "ประเทศไทยอยู่ที่ไหน"), (5, "首都")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "it is too, SHORT and too short"), (2, "too long, not short"), (3, "shorter"), (4, "请问法国的首都是哪一座城市吗"), (5, "ก่อน ประเทศไทยอยู่ที่ไหน หลัง"), (6, "日本語の文章です"), (7, "a_b"), (8, None)]
    got = sorted((r["doc_id"], r["item_id"], r["matched_tokens"], r["item_tokens"]) for r in decontaminate.find_leaks(spark, docs(spark, rows), benchmark).collect())
    assert [x[:2] for x in got] == [(1, 1), (1, 2), (2, 2), (4, 3), (4, 5), (5, 4)]
    assert all(m == n for _, _, m, n in got)
    assert sorted(r["doc_id"] for r in decontaminate.drop_leaks(spark, docs(spark, rows), benchmark).collect()) == [3, 6, 7, 8]
    assert decontaminate.tokens("ab_c 1漢字é") == ["ab", "c", "1", "漢", "字", "é"]


def test_decontamination_by_join_equals_the_broadcast(spark, monkeypatch):
    """Frequent windows are left out of the join, and no leak with them."""
    rng = random.Random(21)
    pool = [" ".join(words(rng, rng.choice((4, 5, 8)), 30)) for _ in range(25)]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    benchmark = spark.createDataFrame([(k % 37 or None, text(rng.randrange(1, 9))) for k in range(40)], "item_id long, text string")
    frame = docs(spark, [(k, text(rng.randrange(0, 12))) for k in range(120)] + ODD)
    found = []
    for most in (decontaminate.BLOCK_BYTES, 0):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", most)
        found.append(sorted(map(str, decontaminate.find_leaks(spark, frame, benchmark).collect())))
    assert found[0] == found[1] and len(found[0]) > 100
