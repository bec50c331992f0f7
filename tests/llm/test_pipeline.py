"""The pipeline's stages against plain versions, on tables with every kind of case."""

import itertools
import random
from pathlib import Path

import corpus_pipeline
import pytest
from test_operators import ODD, brute_groups, brute_lines, docs, words

import __spark_entry__
from weftgraph.llm import decontaminate, sentencepieces, toxicity


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(21)
    long = lambda n: words(rng, n, 20_000)
    items = [(k, " ".join(long(30))) for k in range(4)]
    passage = " ".join(long(55))
    rows = []
    for i in range(60):
        text = long(rng.randrange(20, 90))
        if i % 6 == 1:
            text[5] = "idiot"
            text[9] = rng.choice(["worthless", "scum"])
        lines = [" ".join(text[k : k + 15]) for k in range(0, len(text), 15)]
        if i % 5 == 0:
            lines.insert(1, passage)
        if i % 10 == 3:
            lines.append(items[i // 10 % 4][1])
        rows.append((i, "\n".join(lines)))
    base = long(120)
    for k in range(4):  # near copies on one line, so that no line repeats
        copy = list(base)
        copy[10 * k] = f"changed{k}"
        rows.append((100 + k, " ".join(copy)))
    rows += [(110, rows[2][1]), (111, rows[2][1])]  # exact copies
    frame = docs(spark, [*rows, *ODD], False)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 1), 0) for i in range(60)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), frame, items


def test_each_stage_equals_a_plain_version(spark, tables):
    path, frame, items = tables
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "sentencepiece"]
    rows = lambda df: sorted((str(r["doc_id"]), str(r["text"])) for r in df.collect())

    clean = stages["toxicity"](spark, frame, path).cache()
    model = toxicity.fit(spark, frame, spark.read.parquet(f"{path}/labels.parquet"))
    assert rows(clean) == sorted((str(r["doc_id"]), str(r["text"])) for r in frame.collect() if model.score(r["text"]) < toxicity.THRESHOLD)
    assert all(r["doc_id"] is None or r["doc_id"] >= 60 or r["doc_id"] % 6 != 1 for r in clean.collect())

    lines = stages["line_dedup"](spark, clean, path).cache()
    known = [(r["doc_id"], r["text"]) for r in clean.collect() if r["doc_id"] is not None and not 90 <= r["doc_id"] < 100]
    want = brute_lines(known, 30)
    assert {r["doc_id"]: r["text"] for r in lines.collect() if r["doc_id"] in want} == {i: t for i, t in want.items() if t.strip()}
    assert lines.where("doc_id >= 90 AND doc_id < 100").count() == clean.where("doc_id >= 90 AND doc_id < 100").count()
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect() if r["doc_id"] in want)

    unique = stages["near_dedup"](spark, lines, path).cache()
    pairs = [(r["doc_id"], r["text"]) for r in lines.collect() if r["doc_id"] is not None]
    groups = brute_groups(pairs, 5, 80)
    assert sorted(r["doc_id"] for r in unique.collect() if r["doc_id"] is not None) == sorted(i for i, _ in pairs if groups[i] == i)
    assert unique.where("doc_id >= 100 AND doc_id < 104").count() == 1

    safe = stages["decontaminate"](spark, unique, path).cache()

    def leaks(text):
        doc = decontaminate.tokens(text)
        for _, item in items:
            want = decontaminate.tokens(item)
            codes = {w: n for n, w in enumerate(dict.fromkeys(want))}
            if sum(n for _, _, n in decontaminate.tile([codes.get(w, -1) for w in doc], [codes[w] for w in want])) >= 0.5 * len(want):
                return True
        return False

    assert rows(safe) == sorted((str(r["doc_id"]), str(r["text"])) for r in unique.collect() if not leaks(r["text"]))
    assert safe.count() < unique.count()

    last = stages["sentencepiece"](spark, safe, path)
    vocabulary = sentencepieces.Vocabulary.load()
    assert sorted((str(r["doc_id"]), str(vocabulary.decode(r["ids"]))) for r in last.collect()) == rows(safe)
    for a, b in itertools.pairwise((frame, clean, lines, unique, safe)):
        assert a.dtypes == b.dtypes


def test_run_registered_and_empty(spark, tables):
    path, frame, _ = tables
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "ids", "n_pieces", "round_trip"] and out.where("NOT round_trip").count() == 0
    left = [p.name for p in Path(out._weft_path.removeprefix("file://")).parent.iterdir()]
    assert len(left) == 1 and left[0].endswith("sentencepiece")  # only the last stage's table is kept
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    empty = frame.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, empty, path)
        assert empty.columns == frame.columns
    assert corpus_pipeline.STAGES[-1][1](spark, empty, path).count() == 0
