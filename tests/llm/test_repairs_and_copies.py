"""Conversation repair, the filter audit and exact copies against brute force and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import convrepair, exactdedup, filteraudit
from weftgraph.plans.materialize import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("id", "row", "key", "size", "n", "link", "bucket", "b", "part", "mask", "digest", "least", "kept", "sha256")
#: Null ids and texts, empty and blank texts, repeated rows, an id with two texts.
ODD = [(None, "Same text."), (None, "Same text."), (1, None), (2, ""), (3, " \n"), (4, "Same text."), (4, "Same text."), (5, "same text."), (5, "Same text."), (6, "é" * 70_000), (7, "é" * 70_000), (-8, "")]


def docs(spark, rows, clash=True):
    df = spark.createDataFrame([(i, t, ("en", "de", None)[k % 3], "s", 1) for k, (i, t) in enumerate(rows)], DOCS)
    return df.withColumns({c: F.lit("x") for c in CLASH}) if clash else df


# 13


def copies(rows):
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    out = []
    for t, ids in by.items():
        known = [i for i in ids if i is not None]
        keep = max(known, default=None)
        for k, i in enumerate(sorted(ids, key=lambda x: (x is not None, x or 0), reverse=True)):
            out.append((i, keep, len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()))
    return Counter(out)


def few_keys(text):
    return F.shiftleft(F.xxhash64(text).bitwiseAND(F.lit(3)), 62)


@pytest.mark.parametrize("hashed", [exactdedup._key, few_keys])
def test_exact_groups_equal_plain_ones(spark, hashed):
    rng = random.Random(3)
    rows = ODD + [(100 + k, f"text {rng.randrange(40)}" if k % 3 else "hot") for k in range(400)]
    got = exactdedup.groups(docs(spark, rows).repartition(5), hashed=hashed, most_keys=3, most_bytes=2000)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == copies(rows)


def test_buckets_split_and_the_directory_doubles(spark):
    scratch = Scratch(spark, "t")
    rows = exactdedup.keyed(docs(spark, [(k, f"t{k}") for k in range(3000)]), scratch)
    index = exactdedup.ExactIndex.build(rows, scratch, most_keys=8)
    slots = {r["slot"]: r["bucket"] for r in index.slots.collect()}
    assert sorted(slots) == list(range(1 << index.depth)) and index.depth >= 9  # over more than one pass
    for slot, bucket in slots.items():
        assert slot >> (index.depth - bucket.bit_length() + 1) == bucket - (1 << bucket.bit_length() - 1)
    sizes = Counter(r["bucket"] for r in index.entries.select("bucket").collect())
    assert max(sizes.values()) <= 8 and sum(sizes.values()) == 3000
    # Halves that were split hold more than a bucket may, together.
    assert all(sizes[b] + sizes[b ^ 1] > 8 for b in sizes if b > 1 and b ^ 1 in sizes and {b, b ^ 1} <= set(slots.values()))


@pytest.mark.parametrize("hashed", [exactdedup._key, few_keys])
def test_an_inserted_batch_equals_a_rebuild(spark, hashed):
    scratch, rng = Scratch(spark, "t"), random.Random(4)
    rows = [(k, f"text {rng.randrange(150)}") for k in range(600)]
    key = lambda part: exactdedup.keyed(docs(spark, part), scratch, hashed=hashed)
    grown = exactdedup.ExactIndex.build(key(rows[:200]), scratch, hashed, most_keys=4).insert(key(rows[200:230]), scratch).insert(key(rows[230:]), scratch)
    whole = exactdedup.ExactIndex.build(key(rows), scratch, hashed, most_keys=4)
    of = lambda index: sorted(map(tuple, index.entries.select("bucket", "key", "link", "links", "text", "n", "keep_id").collect()))
    assert of(grown) == of(whole) and grown.depth == whole.depth
    found = grown.find(key([(900, "text 7"), (901, "new")])).select("id", "keep_id", "n").collect()
    with_7 = [i for i, t in rows if t == "text 7"]
    assert [tuple(r) for r in found] == [(900, max(with_7), len(with_7))]


def test_exact_copies_are_dropped_with_their_columns(spark):
    given = docs(spark, ODD)
    left = exactdedup.drop_copies(given)
    assert left.columns == given.columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter([2, 3, 5, 5, 7])
    assert exactdedup.groups(docs(spark, [])).count() == 0 and exactdedup.drop_copies(docs(spark, [])).count() == 0


# 12


def failed(text, doc_id, least):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
        "E": doc_id is not None and least is not None and least < doc_id,
    }


def audited(rows, labels):
    """rows: doc_id, text, part."""
    good, toxic = ({i for i, *q in labels if i is not None and q[k] == 1} for k in (0, 1))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    out = []
    for part in {p for *_, p in rows}:
        judged = [(i, failed(t, i, least.get(t))) for i, t, p in rows if p == part]
        total = Counter()
        lines = []
        for order in permutations("ABCDE"):
            gone = set()
            for step, f in enumerate(order, 1):
                here = {k for k, (_, bad) in enumerate(judged) if bad[f]}
                new = here - gone
                gone |= here
                total[f] += len(new)
                ids = [judged[k][0] for k in new]
                lines.append((part, "".join(order), step, len(judged) - len(gone), len(new), len(here) - len(new), sum(bad[f] and sum(bad.values()) == 1 for _, bad in judged), sum(i in good for i in ids), sum(i in toxic for i in ids), f))
        out += [(*line[:-1], total[line[-1]]) for line in lines]
    return sorted(out)


def test_the_audit_equals_all_orders_played_through(spark):
    rng = random.Random(5)
    texts = [t or "" for _, t in ODD] + [" ".join(rng.choice(["aa", "BB", "c$", "dd"] + [f"w{k}" for k in range(rng.choice([1, 400]))]) for _ in range(rng.choice([5, 199, 200, 450]))) for _ in range(60)]
    ids = [i for i, _ in ODD] + list(range(50, 110))
    texts += texts[-20:]
    ids += list(range(20, 40))
    rows = list(zip(ids, texts, strict=True))
    given = docs(spark, rows)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in ids] + [(60, 1, 1), (None, 1, 1)]
    got = filteraudit.audit(given.repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    parts = [(i, t, ("en", "de", "")[k % 3]) for k, (i, t) in enumerate(rows)]
    assert sorted(map(tuple, got.collect())) == audited(parts, labels)
    assert filteraudit.audit(docs(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_the_removal_polynomial_is_exact(spark):
    rng = random.Random(6)
    for _ in range(20):
        by = {m: rng.randrange(10**rng.randrange(1, 16)) for m in range(32) if rng.random() < 0.8}
        poly = filteraudit.Removal(by)
        for chosen in range(32):
            assert poly.at(chosen) == sum(n for m, n in by.items() if m & chosen)
        assert all((120 * poly.shapley(k)).denominator == 1 for k in range(5))
        assert sum(poly.shapley(k) for k in range(5)) == poly.at(31)
    assert [filteraudit.Removal({0b00101: 6}).shapley(k) for k in range(5)] == [3, 0, 3, 0, 0]


# 11


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return out


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, faults, most_inserts=3):
    """Every sequence of edits with few inserts, the cheapest and then least."""
    best = None

    def go(at, audit, cost, made, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        initials = "".join(r[:1] or "-" for r, _ in made)  # a row without a role fits nowhere
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in made))
        if not re.match("^s?(ua)*u?$", initials):
            return
        if inserts < most_inserts:
            for role in ("user", "assistant"):
                go(at, audit + "I", cost + 3, [*made, (role, "")], inserts + 1)
        if at < len(rows):
            _, _, role, text = rows[at]
            go(at + 1, audit + "D", cost + 4, made, inserts)
            if faults[at] not in ("blank", "duplicate"):
                extra = 3 if faults[at] else 0
                go(at + 1, audit + "K", cost + extra, [*made, (role, text)], inserts)
                for new in ("user", "assistant"):
                    go(at + 1, audit + "R", cost + 3 + extra, [*made, (new, text)], inserts)

    go(0, "", 0, [], 0)
    return best


def plain_repairs(rows):
    hurt, out = plain_damage(rows), []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in hurt if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults = faults_of(own)
        turns = {r[1] for r in own if r[1] is not None}
        cost, audit, text = cheapest(own, faults)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return Counter(out)


TURNS = "conv_id long, turn long, role string, text string"


def test_repairs_equal_all_edits_tried(spark):
    rng = random.Random(7)
    rows = [(None, None, None, None), (None, 3, "user", "One."), (None, None, "user", "Zero!"), (1, 0, "user", None), (2, 0, "", "a."), (2, 1, "system", "b."), (2, 1, "system", "b."), (3, None, "user", "x." * 50_000)]
    for conv in range(10, 90):
        n = rng.randrange(1, 5)
        rows += [(conv, t if rng.random() < 0.8 else rng.choice([None, 9]), rng.choice(["system", "user", "assistant", "assistant", "user", "tool"]), rng.choice(["Yes.", "No!", "cut off", " \t", "Why?\n ", "A. B"]) + str(rng.randrange(3)) * (rng.random() < 0.1)) for t in range(n)]
    given = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("x") for c in ("fault", "place", "pass", "copy", "nth", "how", "edit", "step")})
    got = convrepair.repairs(convrepair.damaged(given.repartition(3)))
    assert Counter(map(tuple, got.collect())) == plain_repairs(rows)
    assert convrepair.repairs(convrepair.damaged(spark.createDataFrame([], TURNS))).count() == 0


def test_a_long_conversation_ends_sound_and_passes_as_a_stream(spark):
    rng = random.Random(8)
    rows = [(5, t, rng.choice(["user", "assistant"]), f"Turn {t}" + rng.choice([".", ""])) for t in range(4000)]
    turns = convrepair.repaired_turns(spark.createDataFrame(rows, TURNS)).orderBy("step").collect()
    left = [(r["role"], r["text"]) for r in turns if r["edit"] != "D"]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in left)) and [r["step"] for r in turns] == list(range(len(turns)))
    got = convrepair.repairs(spark.createDataFrame(rows, TURNS)).first()
    assert got["audit"] == "".join(r["edit"] for r in turns)
    assert got["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
    price = {"K": 0, "R": 3, "D": 4, "I": 3}
    cut = iter(not t.endswith(".") for *_, t in rows)
    assert got["cost"] == sum(price[r["edit"]] + (3 if r["edit"] != "I" and next(cut) and r["edit"] in "KR" else 0) for r in turns)


# Mended this round: 5, 7, 10


def test_a_page_column_is_not_carried_twice(spark):
    from weftgraph.llm import tiff

    media = tiff.store(docs(spark, [(1, "abc")])).withColumn("page", F.lit(7)).withColumn("other", F.lit("x"))
    with pytest.raises(ValueError, match="page"):
        tiff.explode_pages(media, "doc_id", "media", ("page",))
    with pytest.raises(ValueError, match="twice"):
        tiff.explode_pages(media, "doc_id", "media", ("doc_id",))
    assert tiff.explode_pages(media, "doc_id", "media", ("other",)).first()["other"] == "x"


def test_training_texts_do_not_depend_on_the_order_of_rows(spark):
    from weftgraph.llm import toxicity

    rng = random.Random(11)
    rows = [(k % 60, " ".join(rng.choice(["you", "idiot", "nice", "weather", "go", "home", "now"]) for _ in range(12))) for k in range(180)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(60)], "doc_id long, toxic int")
    seen = set()
    for parts in (1, 3, 7):
        rng.shuffle(rows)
        given = docs(spark, rows).repartition(parts)
        picked = toxicity.training_rows(given, labels)
        seen.add(tuple(sorted(map(tuple, picked.select("doc_id", "toxic", "text").collect()))))
    assert len(seen) == 1 and len({r[0] for r in next(iter(seen))}) == len(next(iter(seen)))


def test_a_document_with_very_many_items_is_tiled_in_parts(spark, monkeypatch):
    """One document against thousands of items that share a passage: bounded parts, the leaks of the broadcast way."""
    from weftgraph.llm import decontaminate

    rng = random.Random(12)
    passage = " ".join(f"p{k}" for k in range(12))
    items = [(k, f"{passage} q{k}" if k % 3 else f"{passage} " + " ".join(f"z{rng.randrange(99)}" for _ in range(14))) for k in range(3000)]
    rows = [(1, f"before {passage} after q7 {passage}"), (2, "clean text of its own with no passage"), (3, f"{passage} q11"), (None, passage)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    given = docs(spark, rows)
    leaks = lambda: sorted(((r["doc_id"], r["item_id"], r["matched_tokens"]) for r in decontaminate.find_leaks(spark, given, benchmark).collect()), key=str)
    kept = lambda: sorted(r["doc_id"] for r in decontaminate.drop_leaks(spark, given, benchmark).collect())
    want = leaks(), kept()
    assert len(want[0]) >= 6000 and want[1] == [2]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 0)
    parts = decontaminate.joined_candidates(given, benchmark, part_bytes=20_000)
    sizes = [sum(len(i["text"]) for i in r["items"]) for r in parts.collect()]
    assert len(sizes) > 12 and max(sizes) < 40_000
    assert (leaks(), kept()) == want
