"""The stored indexes against scans, rebuilds and brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators import search, segments, substrings, traverse
from weftgraph.operators.segments import Segments
from weftgraph.operators.vectors import VectorIndex, unit


@pytest.fixture
def home(tmp_path):
    made = iter(range(100))
    return lambda: f"file://{tmp_path}/{next(made)}"


# Vectors


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id string, v array<float>").select("id", unit(F.col("v")).alias("unit"))


def grouped(rng, n, size=16, groups=12):
    middles = rng.normal(size=(groups, size))
    return (middles[rng.integers(groups, size=n)] + 0.3 * rng.normal(size=(n, size))).astype(float)


def brute(rows, asked, k):
    ids, all_ = [i for i, _ in rows], np.array([v for _, v in rows], np.float32).astype(float)
    all_ /= np.linalg.norm(all_, axis=1)[:, None]
    q = np.array(asked, float)
    score = np.round(all_ @ (q / np.linalg.norm(q)), 9)
    return [i for _, i in sorted((-s, i) for i, s in zip(ids, score, strict=True))][:k]


def test_vector_index_recall_and_exact_way(spark, home):
    rng = np.random.default_rng(1)
    rows = [(f"v{k:04d}", v.tolist()) for k, v in enumerate(grouped(rng, 1500))]
    rows += [("copy1", rows[0][1]), ("copy2", rows[0][1])]
    odd = [(None, rows[0][1]), ("none", None), ("empty", []), ("zero", [0.0] * 16), ("other", [1.0] * 5)]
    index = VectorIndex.build(vectors(spark, rows + odd), home())
    assert index.cells().count() == len(rows) and index.probes < len(index.centroids)
    asked = spark.createDataFrame([(k, rows[k][1]) for k in range(0, 1500, 50)], "question long, v array<float>").select("question", unit(F.col("v")).alias("unit"))
    want = {(k, i) for k in range(0, 1500, 50) for i in brute(rows, rows[k][1], 15)}
    full = {(r["question"], r["id"]) for r in index.nearest(asked, 15, len(index.centroids)).collect()}
    assert full == want
    got = {(r["question"], r["id"]) for r in index.nearest(asked, 15).collect()}
    assert len(got & want) / len(want) >= 0.95
    for k in (0, 700):
        exact = index.top_k(rows[k][1], 15, exact=True).collect()
        assert [r["id"] for r in exact] == brute(rows, rows[k][1], 15)
        near = index.top_k(rows[k][1], 15).collect()
        assert len({*near} & {*exact}) >= 14  # the same scores to the last digit
    assert index.top_k([0.0] * 16, 5).count() == 0 and index.top_k([1.0] * 5, 5).count() == 0


def test_vector_index_reads_the_probed_folders_only(spark, home):
    rows = [(f"v{k}", v.tolist()) for k, v in enumerate(grouped(np.random.default_rng(2), 400))]
    index = VectorIndex.build(vectors(spark, rows), home())
    plan = index.cells([3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell", "cell") and "IN (3,5)" in plan


def test_vector_index_batches_and_copies(spark, home):
    rng = np.random.default_rng(3)
    rows = [(f"v{k:03d}", v.tolist()) for k, v in enumerate(grouped(rng, 300))]
    index = VectorIndex.build(vectors(spark, rows[:200]), home())
    moved = [("v007", rows[250][1]), *rows[200:]]
    index.add(vectors(spark, moved), home())
    index.add(vectors(spark, [("v009", None)]), home())
    live = [(i, v) for i, v in rows if i not in ("v007", "v009")] + [("v007", rows[250][1])]
    saved = index.save(home())
    loaded = VectorIndex.load(spark, saved.store.folders[0])
    folded = loaded.compact(home())
    for one in (index, loaded, folded):
        assert one.cells().count() == len(live)
        assert [r["id"] for r in one.top_k(rows[250][1], 10, exact=True).collect()] == brute(live, rows[250][1], 10)
    assert VectorIndex.build(vectors(spark, []), home()).top_k([1.0], 3).count() == 0


# Substrings

NODES = "id string, label string, name string, path string, full_name string, filepath string, repo string, code string"
FIELDS = ("name", "path", "full_name", "filepath", "code")


def some_nodes(rng, n):
    pieces = ["foo", "Bar", "ba", "é漢字", "aaa", "aaaa", "_", "x", "😀y", "License", "\n"]
    word = lambda: "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6)))
    maybe = lambda: word() if rng.random() < 0.8 else None
    return [(f"n{k:03d}", rng.choice(["Function", "File", "Module", "User"]), maybe(), maybe(), maybe(), maybe(), rng.choice(["r1", "r2", None]), maybe()) for k in range(n)]


def test_substrings_equal_a_scan(spark, home):
    rng = random.Random(1)
    rows = some_nodes(rng, 300)
    nodes = spark.createDataFrame(rows, NODES)
    index = substrings.SubstringIndex.build(nodes, FIELDS, home())
    asked = ["foo", "FOOBAR", "aaaaa", "字foo", "é漢字", "😀y", "barfoobar", "ba", "x", "", "nowhere", "licensefoo"]
    words = spark.createDataFrame([(k, w) for k, w in enumerate(asked)], "pos int, word string")
    for fields in (["code"], ["name", "path", "full_name"]):
        want = {(r["word"], r["id"]) for r in substrings.holding(nodes, fields, words, "word").collect()}
        got = substrings.holding(nodes, fields, words, "word", index)
        assert {(r["word"], r["id"]) for r in got.collect()} == want and len(want) > 50
        assert got.count() == len(want)
        limited = substrings.holding(nodes.where("label = 'File'"), fields, words, "word", index, 3, "label = 'File'")
        plain = {}
        for w, i in sorted((w, i) for w, i in want if dict((r[0], r[1]) for r in rows)[i] == "File"):
            plain.setdefault(w, []).append(i)
        first = {(r["word"], r["id"]) for r in limited.collect()}
        assert all({(w, i) for i in ids[:3]} <= first for w, ids in plain.items())


@pytest.mark.parametrize("most", [2, 1000])
def test_substrings_named_or_joined(spark, home, monkeypatch, most):
    monkeypatch.setattr(substrings, "MOST_NAMED", most)
    nodes = spark.createDataFrame(some_nodes(random.Random(2), 80), NODES)
    index = substrings.SubstringIndex.build(nodes, FIELDS, home())
    words = spark.createDataFrame([("foo",), ("bar",)], "word string")
    want = {tuple(r) for r in substrings.holding(nodes, ["code"], words, "word").select("word", "id").collect()}
    assert {tuple(r) for r in substrings.holding(nodes, ["code"], words, "word", index).select("word", "id").collect()} == want


def test_substring_batches_hide_older_rows(spark, home):
    rows = some_nodes(random.Random(3), 60)
    index = substrings.SubstringIndex.build(spark.createDataFrame(rows[:40], NODES), FIELDS, home())
    new = [(rows[5][0], "File", "brandnew", *rows[5][3:]), *rows[40:]]
    index.add(spark.createDataFrame(new, NODES), FIELDS, home())
    index.remove(spark.createDataFrame([(rows[7][0],)], "id string"), home())
    live = spark.createDataFrame([r for k, r in enumerate(rows) if k not in (5, 7)] + new[:1], NODES)
    saved = index.save(home())
    whole = substrings.SubstringIndex.load(spark, saved.store.folders[0])
    for one in (index, whole):
        assert sorted(map(tuple, one.known().select("id", "label").collect())) == sorted(map(tuple, live.select("id", "label").collect()))
        for word in ("foo", "brandnew"):
            want = {r["id"] for r in substrings.holding(live, ["name", "code"], spark.createDataFrame([(word,)], "word string"), "word").collect()}
            assert {r["id"] for r in one.matches([word], ["name", "code"]).collect()} == want


def test_traversals_by_the_index_equal_scans(spark, home):
    nodes = spark.createDataFrame(some_nodes(random.Random(4), 200), NODES)
    index = substrings.SubstringIndex.build(nodes, FIELDS, home())
    words = lambda name: spark.createDataFrame([(0, "foo"), (1, "Bar"), (2, "ba"), (3, "zzz")], f"pos int, {name} string")
    both = lambda f: [sorted(map(str, f(g).collect())) for g in (None, index)]
    for repos in (None, ["r1"]):
        a, b = both(lambda g: traverse.field_grep(nodes.where("label = 'Function'"), words("field"), repos, 4, grams=g).select("field", "id", "rel_type"))  # noqa: B023
        assert a == b and a
        a, b = both(lambda g: traverse.path_boost(nodes.where("label = 'Function'"), words("hint"), repos, 4, grams=g).select("hint", "id"))  # noqa: B023
        assert a == b and a
        a, b = both(lambda g: traverse.subject_definition(nodes, "Foo", repos, g))  # noqa: B023
        assert a == b and a
    a, b = both(lambda g: traverse.impact_seeds(nodes, words("subject"), 5, grams=g))
    assert a == b and a


def test_a_named_search_reads_gram_folders_and_no_texts(spark, home):
    nodes = spark.createDataFrame(some_nodes(random.Random(5), 50), NODES)
    index = substrings.SubstringIndex.build(nodes, FIELDS, home())
    plan = index.matches(["foo"], ["code"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*folder", plan) and "code#" not in plan


# Texts


def texts(spark, rows):
    return spark.createDataFrame(rows, "sha string, t string")


def ranked(index, question, limit=10):
    return [tuple(r) for r in index.ask(question, limit).collect()]


def many_texts(rng, n):
    words = [f"w{k}" for k in range(60)] + ["où", "l'été", "naïve", "漢字", "the"]
    weights = [1 / (1 + k) for k in range(60)] + [0.05] * 4 + [3.0]
    return [(f"s{k:05d}", " ".join(rng.choices(words, weights, k=rng.choice([0, 2, 5, 30, 200]))) if k % 17 else None) for k in range(n)]


def test_ranked_search_skips_blocks_and_equals_the_whole_ranking(spark, home, monkeypatch):
    monkeypatch.setattr(search, "LOT_TEXTS", 8)
    monkeypatch.setattr(search, "FIRST_LOTS", 6)
    docs = texts(spark, many_texts(random.Random(6), 1500) + [(f"r{k}", "rare the") for k in range(20)])
    index = search.TextIndex.build(docs, "sha", F.col("t"), home())
    for question in ("the w40", "rare the", "", "où est l'été naïve 漢字"):
        whole = ranked(index, question, None)
        assert ranked(index, question) == whole[:10]
        assert [tuple(r) for r in search.search(docs, "sha", F.col("t"), question, None).collect()] == whole
    blocks, skipped = index.skipped(["the", "rare"])
    assert skipped > 0.8 * blocks > 100  # a frequent word is not read in full
    assert 0 < index.skipped(["the", "w40"])[1]
    assert search.words_of("Où est l'été?") == ["où", "est", "l", "été"]


def test_text_batches_equal_a_rebuild_and_cut_new_texts_only(spark, home):
    rows = many_texts(random.Random(7), 300)
    changed = [("s00003", "the new one"), ("s00004", None), ("s00300", "w1 w2 fresh")]
    index = search.TextIndex.build(texts(spark, rows[:250]), "sha", F.col("t"), home())
    folder = home()
    index.add(texts(spark, rows[250:]), F.col("t"), folder)
    index.add(texts(spark, changed), F.col("t"), home(), replaced=texts(spark, rows[3:5]))
    whole = search.TextIndex.build(texts(spark, rows[:3] + rows[5:] + changed), "sha", F.col("t"), home())
    saved = index.save(home())
    loaded = search.TextIndex.load(spark, saved.store.folders[0], "sha")
    for one in (index, loaded):
        for question in ("the new", "fresh w2 où"):
            assert ranked(one, question, None) == ranked(whole, question, None)
        assert sorted(map(tuple, one.postings().collect())) == sorted(map(tuple, whole.postings().collect()))
    assert spark.read.parquet(f"{folder}/terms").count() == 50  # what the batch had cut into words


def test_a_table_of_questions_equals_one_by_one(spark, home, monkeypatch):
    monkeypatch.setattr(search, "LOT_TEXTS", 8)
    monkeypatch.setattr(search, "FIRST_LOTS", 4)
    rows = many_texts(random.Random(8), 600) + [(f"r{k}", "rare the") for k in range(20)]
    index = search.TextIndex.build(texts(spark, rows[:500]), "sha", F.col("t"), home())
    index.add(texts(spark, rows[500:]), F.col("t"), home())
    index.add(texts(spark, [("s00003", "the w40 w40"), ("s00004", None)]), F.col("t"), home(), replaced=texts(spark, rows[3:5]))
    asked = {1: "the w40", 2: "rare the The", 3: "où est l'été naïve 漢字", 4: "nowhere", 5: "", 6: "w1 w2 w3 w59", 7: None}
    given = spark.createDataFrame([*asked.items(), (None, "the"), (2, "rare")], "sha bigint, text string").withColumnRenamed("sha", "key")
    got = index.ask_each(given, "key", F.col("text")).orderBy("key", "rank").collect()
    for key, question in asked.items():
        assert [(r["sha"], r["score"]) for r in got if r["key"] == key] == ranked(index, question or "")
    assert {r["key"] for r in got} == {1, 2, 3, 6} and [r["rank"] for r in got if r["key"] == 1] == list(range(1, 11))
    empty = search.TextIndex.build(texts(spark, []), "sha", F.col("t"), home())
    assert empty.ask_each(given, "key", F.col("text")).count() == 0 and index.ask_each(given.limit(0), "key", F.col("text")).count() == 0


# Segments and the graph


def test_segments_hide_and_show_again(spark, home):
    store = Segments(spark, "string")
    rows = lambda *r: spark.createDataFrame(r, "key string, v int")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    store.write(home(), {"t": (rows(("a", 1), ("b", 2)), [])})
    store.write(home(), {"t": (rows(("a", 3)), [])}, keys("a"))
    store.write(home(), {"t": (rows(), [])}, keys("b"))
    store.write(home(), {"t": (rows(("b", 4)), [])}, keys("b"))
    live = store.live(store.table("t", "key string, v int")).select("key", "v")
    assert sorted(map(tuple, live.collect())) == [("a", 3), ("b", 4)]
    assert not store.many and Segments(spark, "string", ["x"] * (segments.MOST_SEGMENTS + 1)).many


def test_indexes_follow_the_graph(spark):
    from weftgraph.plans import ingest
    from weftgraph.plans.materialize import Scratch

    def commits(*rows):
        return spark.createDataFrame(rows, "sha string, message string, seq int")

    def functions(*rows):
        return spark.createDataFrame([(i, i.rsplit("::", 1)[-1], "a.py", "r", code, v, 0) for i, code, v in rows], "id string, name string, filepath string, repo string, code string, embedding array<float>, seq int").withColumn("unit", unit(F.col("embedding")))

    g, scratch = Graph(spark), Scratch(spark, "t")

    def step(label, batch):
        before = ingest._tables(g)
        ingest._merge(g, label, batch)
        ingest.settle(g, scratch, before)

    step("Commit", commits(("aaa1", "first fix", 0), ("bbb2", "second fix", 0)))
    step("Function", functions(("r::a.py::f", "def f(): pass", [1.0, 0.0])))
    assert [r["sha"] for r in g.index_texts().ask("first").collect()] == ["aaa1"]
    assert g.index_grams().matches(["def f"], ["code"]).count() == 1 and g.index_vectors().top_k([1.0, 0.1], 5).count() == 1
    assert g.index_grams("Commit").matches(["bb2"], ["sha"]).count() == 1
    step("Commit", commits(("aaa1", "changed words", 1), ("ccc3", "third fix", 1)))
    step("Function", functions(("r::a.py::f", "def other(): pass", [0.0, 1.0]), ("r::a.py::g", "def g(): pass", [0.0, 1.0])))
    text = g.index_texts()
    assert len(text.store.folders) == 2  # a segment, no rebuild
    whole = search.TextIndex.build(g.label("Commit"), "sha", F.concat_ws(" ", "summary_text", "message", "diff_text"), f"{scratch.home}/whole")
    for question in ("first", "third fix changed"):
        assert ranked(text, question) == ranked(whole, question)
    assert {r["id"] for r in g.index_vectors().top_k([0.0, 1.0], 5).collect()} == {"Function::r::a.py::f", "Function::r::a.py::g"}
    assert g.index_vectors().top_k([1.0, 0.0], 1).first()["score"] == 1.0  # a function keeps its first vector
    assert {r["id"] for r in g.index_grams().matches(["def g"], ["code"]).collect()} == {"Function::r::a.py::g"}
    assert g.index_grams().matches(["other"], ["code"]).count() == 0 and g.index_grams("Commit").matches(["ccc"], ["sha"]).count() == 1


# Many patterns, keyed state


def test_automaton_equals_the_nested_loop(spark, monkeypatch):
    from weftgraph.functions import patterns

    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abc/") for _ in range(rng.randrange(n)))
    names = [word(5) for _ in range(60)]
    automaton = patterns.Automaton(names)
    for _ in range(200):
        text = word(15)
        assert automaton.found(text) == {p for p in names if p in text}
    monkeypatch.setattr(patterns, "PART", 7)
    modules = [word(12).upper() for _ in range(40)]
    deps = spark.createDataFrame([(f"f{k}", m) for k, m in enumerate(modules)] + [("f0", None)], "src string, dst string")
    helpers = [f"o{k}/{w}" for k, w in enumerate(names[:20])] + [None]
    got = {(r["src"], r["dst"]) for r in traverse.cross_repo_links_of_all(deps, spark.createDataFrame([(h,) for h in helpers], "full_name string")).collect()}
    loop = {(f"f{k}", h) for k, m in enumerate(modules) for h in helpers if h and h.rsplit("/", 1)[-1] in m.lower()}
    assert got == loop


def test_keyed_state_equals_the_fold_of_the_whole_log(spark, tmp_path):
    from weftgraph.operators import upsert
    from weftgraph.streaming import temporal, upserts

    rng = random.Random(9)
    log = [(f"s{rng.randrange(6)}", f"d{rng.randrange(3)}", rng.choice(["add", "remove"]), f"c{n}", n) for n in range(120)] + [("s9", "d9", "remove", "c", 500), (None, "d", "add", "c", 501)]
    shape = "src string, dst string, op string, sha string, seq long"
    want = sorted(map(tuple, upsert.temporal_edges(spark.createDataFrame(log[:-1], shape)).collect()))
    rng.shuffle(log)  # late writes
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        given, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
        for part in (log[:70], log[70:] + log[:5]):  # some writes come twice
            spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(given)
            rows = spark.readStream.schema(shape).parquet(given)
            upserts.run_to_end(lambda: temporal.changes(rows, out, checkpoint))  # noqa: B023  a restart from the checkpoint
    finally:
        spark.conf.unset(key)
    assert sorted(map(tuple, temporal.current(spark, out).collect())) == want


def test_keyed_state_by_any_order_and_split():
    from weftgraph.streaming import temporal

    rng = random.Random(10)
    for _ in range(200):
        log = [(n, rng.choice(["add", "remove"]), f"c{n}") for n in range(rng.randrange(1, 8))]
        replayed = None
        for _, op, sha in log:
            if op == "add":
                replayed = (sha, None, True) if replayed is None else (replayed[0], replayed[1], True)
            elif replayed:
                replayed = (replayed[0], sha, False)
        mixed = log + rng.sample(log, 1)
        rng.shuffle(mixed)
        cut = rng.randrange(len(mixed) + 1)
        assert temporal.edge_of(temporal.folded(temporal.folded(None, iter(mixed[:cut])), iter(mixed[cut:]))) == replayed


def test_adjacency_is_read_by_bucket_and_joined_without_a_shuffle(spark):
    from weftgraph.plans.adjacency import Adjacency

    nodes = spark.createDataFrame([(f"n{k}", "Function") for k in range(50)], "id string, label string")
    edges = spark.createDataFrame([(f"n{k}", "CALLS" if k % 2 else "USES", f"n{k * 7 % 50}") for k in range(50)] + [("n1", "CALLS", "gone")], "src string, type string, dst string")
    near = Adjacency.build(nodes, edges, 8)
    assert {tuple(r) for r in near.edges_of(["n7"], False).select("src", "dst").collect()} == {(f"n{k}", "n7") for k in range(50) if k * 7 % 50 == 7}
    shown = {"spark.sql.sources.bucketing.autoBucketedScan.enabled": "false", "spark.sql.maxMetadataStringLength": "10000"}
    for name, value in shown.items():
        spark.conf.set(name, value)
    try:
        plan = near.edges_of(["n1"], True)._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in shown:
            spark.conf.unset(name)
    assert "SelectedBucketsCount: 1 out of 8" in plan
    for out in (True, False):
        rows = near.hop(["CALLS"], out)
        assert rows.count() == sum(k % 2 for k in range(50)) + (1 if out else 0)
        key, wanted = ("src", "n1") if out else ("dst", "n7")
        assert {r["other"] for r in rows.where(f"id = '{wanted}'").collect()} == {(r[2] if out else r[0]) for r in map(tuple, edges.where("type = 'CALLS'").collect()) if r[0 if key == "src" else 2] == wanted}
        counted = rows.groupBy("id", "type").agg(F.count("*").alias("n"))
        counted.collect()
        assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
