"""What queries move between tasks: rows and bytes of their shuffles, which stand on disk until they end."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import search, substrings, traverse
from weftgraph.plans import queries_text
from weftgraph.plans.adjacency import Adjacency

SF = "/root/testdata/sf0.001"


def moved(spark, rows):
    """Records and bytes that running a query, or a function, writes to shuffles."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def stages():
        found = store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)
        return {found.apply(k).stageId(): (found.apply(k).shuffleWriteRecords(), found.apply(k).shuffleWriteBytes()) for k in range(found.size())}

    before = stages()
    rows() if callable(rows) else rows.write.format("noop").mode("overwrite").save()
    return tuple(map(sum, zip(*(v for k, v in stages().items() if k not in before), strict=True)))


def _functions(spark, n):
    return spark.range(n).select(F.lit("r").alias("repo"), F.concat(F.lit("f"), "id").alias("id"), (F.col("id") % 2).cast("string").alias("name"), F.col("id").alias("pos"))


@pytest.mark.parametrize("ordered", [False, True])
def test_pairs_of_equal_names_are_not_moved(spark, ordered):
    f = _functions(spark, 400)
    calls, named = f.select("repo", F.col("id").alias("caller_id"), F.col("name").alias("callee"), F.col("pos").alias("caller_pos")), f.select("repo", "id", "name", F.col("pos").alias("scan_pos"))
    edges = traverse.resolve_calls(calls.unionByName(calls), named.unionByName(named), ordered)
    got = edges.collect()
    assert len(got) == len({*got}) == (2 * 200 * 201 // 2 if ordered else 2 * 200 * 200)
    assert moved(spark, edges)[0] < 10_000  # of 80,000 or 40,200 pairs none


@pytest.mark.parametrize("ordered", [False, True])
def test_functions_of_several_names_give_an_edge_once(spark, ordered):
    f = [("r", "a", "x", 1), ("r", "a", "y", 2), ("r", "a", "x", 5), ("q", "a", "x", 1), ("r", "b", "x", 9), ("r", "n", None, 0), ("r", "late", "y", None)]
    c = [("r", "c", "x", 5), ("r", "c", "y", 5), ("r", "c", "x", 3), ("q", "c", "x", 5), ("r", "d", None, 5), ("r", "e", "x", None)]
    edges = traverse.resolve_calls(spark.createDataFrame(c, "repo string, caller_id string, callee string, caller_pos int"), spark.createDataFrame(f, "repo string, id string, name string, scan_pos int"), ordered)
    want = {(s, "CALLS", d) for r, s, n, p in c for q, d, m, o in f if r == q and n == m and n is not None and (not ordered or (o is not None and p is not None and o <= p))}
    assert sorted(map(tuple, edges.collect())) == sorted(want)


def test_functions_that_call_their_own_name_move_once(spark):
    f = _functions(spark, 400).withColumn("repo", F.concat(F.lit("r"), F.col("pos") % 3)).withColumn("id", F.concat(F.md5("id"), F.md5("name")))
    calls, named = f.select("repo", F.col("id").alias("caller_id"), F.col("name").alias("callee"), F.col("pos").alias("caller_pos")), f.select("repo", "id", "name", F.col("pos").alias("scan_pos"))
    edges = traverse.resolve_calls(calls, named, True)
    records, size = moved(spark, edges)
    assert records <= 400 and size < 1.5 * 400 * 64  # once for both sides, where they are the same rows
    assert moved(spark, lambda: traverse.resolve_calls(calls, named, True))[0] <= 400  # and hashes of ids


def test_made_patches_move_as_numbers(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    records, size = moved(spark, queries_text.patch_temporal(spark, SF))
    assert records <= lines and size < 1.5 * Path(f"{SF}/lineitem.parquet").stat().st_size


def test_made_patches_move_as_numbers_additive(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    records, size = moved(spark, queries_text.patch_additive(spark, SF))
    assert records <= lines and size < 1.5 * Path(f"{SF}/lineitem.parquet").stat().st_size


def test_an_index_of_texts_moves_each_text_once(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, folder = docs.count(), f"file://{tmp_path}/index"
    made = []
    records, _ = moved(spark, lambda: made.append(search.TextIndex.build(docs, "doc_id", F.col("text"), folder)))
    assert records < n + 200  # the texts, and counts by length
    want = docs.select("doc_id", F.size(search.terms_of(F.col("text"))).alias("n")).where("n > 0").collect()
    got = made[0].postings().groupBy("key").agg(F.sum("tf").alias("n"), F.max("length").alias("length")).collect()
    assert sorted((r["doc_id"], r["n"], r["n"]) for r in want) == sorted(map(tuple, got))


def test_an_index_of_texts_moves_and_keeps_no_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "LOT_TEXTS", 4)
    monkeypatch.setattr(search, "TASK_WORDS", 60)
    words = [f"w{k % 37}" for k in range(400)]
    rows = [(k, None if k == 5 else " ".join(words[k : k + k % 23])) for k in range(300)] + [(300, " ".join(words)), (301, "?!")]
    docs, made = spark.createDataFrame(rows, "k bigint, t string").repartition(3), []
    plain = docs.cache()
    plain.count()
    records, _ = moved(spark, lambda: made.append(search.TextIndex.build(plain, "k", F.col("t"), f"file://{tmp_path}/index")))
    assert records < 20 and spark.read.parquet(f"{tmp_path}/index/terms").columns == ["key", "length"]
    want = [(w, k, t.split().count(w), len(t.split())) for k, t in rows if t and t != "?!" for w in set(t.split())]
    assert sorted(map(tuple, made[0].postings().select("term", "key", "tf", "length").collect())) == sorted(want)
    blocks = spark.read.parquet(f"{tmp_path}/index/blocks").collect()
    for b in blocks:
        assert (b["n"], b["most"], b["least"]) == (len(b["texts"]), max(t["tf"] for t in b["texts"]), min(t["length"] for t in b["texts"])) and b["n"] <= 4
        assert [t["key"] for t in b["texts"]] == sorted(t["key"] for t in b["texts"]) and max(t["length"] for t in b["texts"]) + 1 < 2 * (b["least"] + 1)
    assert len({(b["lot"], b["term"]) for b in blocks}) == len(blocks)
    plain.unpersist()


def test_a_search_without_words_finds_nothing(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "k int, t string")
    assert search.search(rows, "k", F.col("t"), "?!").count() == 0
    assert [r["k"] for r in search.search(rows, "k", F.col("t"), "b").collect()] == [1]


def test_an_index_of_substrings_moves_texts_and_no_grams(spark, tmp_path):
    nodes = spark.createDataFrame([(f"n{k}", "Function", "r", f"some text {k} of words") for k in range(300)], "id string, label string, repo string, code string")
    made = []
    records, _ = moved(spark, lambda: made.append(substrings.SubstringIndex.build(nodes, ("code",), f"file://{tmp_path}/grams")))
    assert records <= 300 + 50  # of some 6,000 grams none
    assert sorted(r["id"] for r in made[0].matches(["text 17 "], ["code"]).collect()) == ["n17"]


def test_blame_of_functions_moves_as_much_as_blame_of_files(spark):
    from weftgraph.plans import queries_graph

    files, functions = (moved(spark, q(spark, SF))[0] for q in (queries_graph.blame_latest5, queries_graph.blame_functions))
    assert functions < files + 2000  # besides, 200 functions and the latest five commits of as many files


def test_adjacency_makes_its_edges_once(spark):
    edges = spark.range(20_000).select((F.col("id") % 50).cast("string").alias("src"), F.lit("CALLS").alias("type"), (F.col("id") % 70).cast("string").alias("dst")).distinct()
    nodes = spark.range(70).select(F.col("id").cast("string").alias("id"))
    alone, made = moved(spark, edges)[0], []
    records, _ = moved(spark, lambda: made.append(Adjacency.build(nodes, edges, buckets=2)))
    assert records <= alone + 70 + 2 * 350  # one distinct, the nodes, and the 350 edges in both directions
    assert made[0].into.count() == made[0].out.count() == 350


def test_an_index_of_shas_holds_no_key_for_each_gram(spark, tmp_path):
    commits = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("id"), F.lit("Commit").alias("label"), F.lit(None).cast("string").alias("repo"), F.lit(None).cast("string").alias("code")).withColumn("sha", F.col("id"))
    index = substrings.SubstringIndex.build(commits, ("sha",), f"file://{tmp_path}/grams")
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 150 * 20_000  # of 30 keys of 16 bytes at least, two
    word = commits.first()["id"][5:15]
    assert sorted(r["id"] for r in index.matches([word], ["sha"]).collect()) == sorted(r["id"] for r in commits.where(F.col("sha").contains(word)).collect())


def test_substrings_don_t_reach_over_two_texts(spark, tmp_path):
    rows = [(f"n{k}", "Function", None, code) for k, code in enumerate(["xabc", "defx", "abcdef", "abc", "def", "ab", "cdef", "abcabcdefdef"])]
    index = substrings.SubstringIndex.build(spark.createDataFrame(rows, "id string, label string, repo string, code string").coalesce(1), ("code",), f"file://{tmp_path}/grams")
    for word in ("abcdef", "abc", "cdef", "abcd", "defx", "fab"):
        assert sorted(r["id"] for r in index.matches([word], ["code"]).collect()) == sorted(i for i, *_, code in rows if word in code)


def test_the_adjacency_of_the_change_graph_moves_numbers(spark):
    from weftgraph.plans import projection, queries_graph

    nodes, edges = queries_graph._impact_graph(spark, SF)
    _, size = moved(spark, lambda: Adjacency.build(nodes, edges, 4))
    made = []
    _, small = moved(spark, lambda: made.append(Adjacency.of_numbers(projection.numbered_nodes(spark, SF), projection.numbered_edges(spark, SF, 4), 4)))
    assert small < size / 3
    ids = [r["id"] for r in nodes.orderBy(F.md5("id")).limit(30).collect()] + ["nowhere"]
    for out in (True, False):
        want = edges.where(F.col("src" if out else "dst").isin(ids)).select("src", "type", "dst", "is_active").collect()
        assert sorted(map(str, made[0].edges_of(ids, out).select("src", "type", "dst", "is_active").collect())) == sorted(map(str, want))


def test_what_a_hint_names_meets_changes_without_moving_them(spark):
    shas = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("sha"), "id")
    commits = shas.select("sha", *(F.lit("m").alias(c) for c in ("timestamp", "message", "summary_text", "diff_text", "repo")))
    changes = shas.select(F.col("sha").alias("src"), F.concat(F.lit("f"), F.col("id") % 5000).alias("dst"))
    targets = spark.range(5000).select(F.concat(F.lit("f"), "id").alias("id"), *(F.concat(F.lit(c), "id").alias(c) for c in ("name", "filepath", "code")), F.lit("File").alias("label"))
    hints = spark.createDataFrame([(shas.where("id = 77").first()["sha"][:12],)], "hint string")
    rows = []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20KB")
    try:
        records, _ = moved(spark, lambda: rows.extend(traverse.commit_targets(commits, changes, targets, hints).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [r["name"] for r in rows] == ["name77"] and records < 1000


def test_what_a_question_names_is_made_of_the_lines_that_name_it(spark):
    from weftgraph.plans import projection, queries_graph, queries_text

    corpus = queries_text.corpus(spark, SF)
    nodes, edges = queries_graph._impact_graph(spark, SF)
    edges = edges.select("src", "type", "dst", "is_active").unionByName(projection.text_edges(spark, SF)).cache()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.concat(F.lit("doc_"), "doc_id").alias("id"))
    ids = [r["id"] for kind in ("File::%", "Function::%", "Module::%") for r in nodes.where(F.col("id").like(kind)).orderBy(F.md5("id")).limit(8).collect()]
    ids += [r["id"] for r in docs.orderBy(F.md5("id")).limit(8).collect()] + ["doc_0", "doc_1", "nowhere"]
    for out in (True, False):
        want = edges.where(F.col("src" if out else "dst").isin(ids)).collect()
        got = corpus.edges.edges_of(ids, out).select("src", "type", "dst", "is_active").collect()
        assert sorted(map(str, got)) == sorted(map(str, want)) and len({r["type"] for r in want}) == 2
    edges.unpersist()

    g = projection.change_graph(spark, SF)
    changes = g.edge("MODIFIED").select("src", "dst").collect()
    assert sorted(corpus.changes.of_nodes(nodes.where(F.col("id").isin(ids)).select("id")).collect()) == sorted(r for r in changes if r["dst"] in ids)
    shas = sorted({r["src"] for r in changes})[:9]
    assert sorted(corpus.changes.of_commits(spark.createDataFrame([(s,) for s in [*shas, shas[0], "nowhere"]], "sha string")).collect()) == sorted(r for r in changes if r["src"] in shas)
    assert sorted(map(str, corpus.authored.collect())) == sorted(map(str, g.edge("AUTHORED").select("src", "dst").collect()))
    columns = ["sha", "timestamp", "summary_text", "diff_text", "message", "url", "repo"]
    assert sorted(map(str, corpus.commits.select(columns).collect())) == sorted(map(str, projection.commits_in_repos(spark, SF).select(columns).collect()))
    text = F.concat_ws(" ", "summary_text", "message", "diff_text")
    for limit in (10, None):
        assert corpus.texts.ask("urgent f", limit).collect() == search.search(corpus.commits, "sha", text, "urgent f", limit).collect()


def test_the_corpus_moves_no_lines_and_keeps_no_texts(spark, tmp_path):
    from weftgraph.plans import queries_text

    for name in ("part", "supplier", "nation", "region", "lineitem", "orders", "customer", "documents", "embeddings"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    orders, customers, vectors, docs = (spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("orders", "customer", "embeddings", "documents"))
    records, _ = moved(spark, lambda: queries_text.corpus(spark, str(tmp_path)))
    assert records <= orders + customers + vectors + docs + 100
