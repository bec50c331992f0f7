"""Queries over texts: vectors, ranked search, routing, rendering, extraction."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from weftgraph import schema as X
from weftgraph.functions import imports, patches, render, router, syntax
from weftgraph.graph import FOUND_BY
from weftgraph.operators import search, traverse
from weftgraph.operators.substrings import SubstringIndex
from weftgraph.operators.vectors import VectorIndex, unit
from weftgraph.plans.adjacency import Changes, Edges
from weftgraph.plans.materialize import Scratch, stored
from weftgraph.plans.projection import SQL as GRAPH
from weftgraph.plans.projection import as_commits, bare_text_nodes, change_graph, commit_table, edges_near, files, numbered_commits, numbered_nodes, text_edges, text_nodes
from weftgraph.sources import readers
from weftgraph.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Questions of the registered queries, as fixed values.
REPOS = ("src1", "src3", "src7")
SEARCH = "license reserved the that"
FIELDS = ("license", "reserved")


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _document_index(spark, sf):
    """The stored text index of the documents."""

    def make(scratch):
        return search.TextIndex.build(table(spark, sf, "documents"), "doc_id", F.col("text"), f"{scratch.home}/index")

    return stored(spark, [f"{sf}/documents.parquet"], "documents-index", make)


def _unit_vectors(spark, sf):
    """The text graph's vectors scaled to length 1, stored."""
    tables = [f"{sf}/documents.parquet", f"{sf}/embeddings.parquet"]
    return stored(spark, tables, "vectors", lambda scratch: scratch.put(text_nodes(spark, sf).select("id", "embedding", "unit"), "vectors"))


#: What queries store once, by the query that asks it.
PREPARED = {"bm25_topk": _document_index, "vector_topk": _unit_vectors}


def _text_node_index(spark, sf):
    """The text graph's nodes in order of their ids, and the index of their substrings, both stored."""

    def make(scratch):
        # Each file stands in the order of the ids, so that a reader skips the pages that it doesn't ask; texts are not moved for it.
        nodes = scratch.put(bare_text_nodes(spark, sf).withColumn("full_name", F.lit(None).cast("string")).sortWithinPartitions("id"), "nodes")
        return nodes, SubstringIndex.build(nodes, FOUND_BY, f"{scratch.home}/grams")

    return stored(spark, [f"{sf}/documents.parquet"], "text-grams", make)


def _embedding_index(spark, sf):
    """The stored index of the embeddings by vec_id."""

    def make(scratch):
        return VectorIndex.build(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), unit(F.col("embedding")).alias("unit")), f"{scratch.home}/vectors")

    return stored(spark, [f"{sf}/embeddings.parquet"], "vector-index", make)


def _with(body: str) -> str:
    return f"WITH {GRAPH.rstrip()}{body if body.startswith(',') else ' ' + body}"


def _question_vector(spark, sf):
    """The vector of the question: that of the first embedding."""
    return table(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"]


_DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: CAST({0}[i] AS DOUBLE) * CAST({1}[i] AS DOUBLE)))"
_SCORED = f"""q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
scored AS (SELECT t.*, (1 + {_DOT.format('e.embedding', 'q.v')} / (sqrt({_DOT.format('e.embedding', 'e.embedding')}) * sqrt({_DOT.format('q.v', 'q.v')}))) / 2 AS score FROM textnode t JOIN embeddings e ON e.vec_id = t.doc_id, q)"""
_TOP = "(SELECT * FROM scored {0} ORDER BY score DESC, id LIMIT 5)"
_IN = "(" + ", ".join(f"'{r}'" for r in REPOS) + ")"


@_query(_with(f", {_SCORED} SELECT id, round(score, 6) AS score FROM {_TOP.format('')}"))
def vector_topk(spark, sf):
    return search.top_k(_unit_vectors(spark, sf), _question_vector(spark, sf)).select("id", F.round("score", 6).alias("score"))


def _searched(spark, sf, repos=None, prefilter=False):
    nodes = text_nodes(spark, sf)
    return search.vector_search(nodes, text_edges(spark, sf), _question_vector(spark, sf), X.TOP_K, repos, prefilter)


@_query(_with(f", {_SCORED} SELECT id, repo, round(score, 6) AS score FROM {_TOP.format('')} WHERE repo IN {_IN}"))
def vector_topk_filtered(spark, sf):
    """The repository filter after the top k: fewer rows may be left."""
    return _searched(spark, sf, REPOS).select("id", "repo", F.round("score", 6).alias("score"))


@_query(_with(f", {_SCORED} SELECT id, repo, round(score, 6) AS score FROM {_TOP.format(f'WHERE repo IN {_IN}')}"))
def vector_topk_prefiltered(spark, sf):
    return _searched(spark, sf, REPOS, True).select("id", "repo", F.round("score", 6).alias("score"))


@_query(_with(f""", {_SCORED}, hits AS {_TOP.format('')}, near AS (SELECT h.id, t.name, t.filepath AS path, t.code, row_number() OVER (PARTITION BY h.id ORDER BY t.name) AS r FROM hits h JOIN textedge e ON e.src = h.id JOIN textnode t ON t.id = e.dst)
  SELECT h.id, n.name, n.path, md5(n.code) AS code_md5 FROM hits h JOIN near n ON n.id = h.id AND r <= 4"""))
def vector_expand(spark, sf):
    """The best functions with at most four distinct neighbours each."""
    return _searched(spark, sf).select("id", F.explode("connected").alias("c")).select("id", "c.name", "c.path", F.md5("c.code").alias("code_md5"))


_ASKED = "embeddings a JOIN embeddings b ON a.vec_id % 50 = 0"
_NEAR = f"round({_DOT.format('a.embedding', 'b.embedding')} / (sqrt({_DOT.format('a.embedding', 'a.embedding')}) * sqrt({_DOT.format('b.embedding', 'b.embedding')})), 9)"


def _nearest(spark, sf, exact):
    index = _embedding_index(spark, sf)
    asked = table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("question"), unit(F.col("embedding")).alias("unit"))
    return index.nearest(asked, X.TOP_K, len(index.centroids) if exact else None).select("question", F.col("rank").cast("bigint").alias("rank"), "id", F.round("score", 6).alias("score"))


@_query(f"""SELECT question, rank, id, round((1 + c) / 2, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY question ORDER BY c DESC, id) AS rank FROM (SELECT a.vec_id AS question, b.vec_id AS id, {_NEAR} AS c FROM {_ASKED})) WHERE rank <= 5""")
def vector_nearest(spark, sf):
    """The five nearest vectors to each whose id is divisible by 50, with all cells probed."""
    return _nearest(spark, sf, True)


@_query()
def vector_nearest_index(spark, sf):
    """The same from as many cells as the index found that it needs."""
    return _nearest(spark, sf, False)


_TERMS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda t: t <> '')"
_BM25 = """posts AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(terms) AS term FROM corpus) WHERE term IN ({0}) GROUP BY ALL),
n AS (SELECT count(*) AS n, avg(len(terms)) AS average FROM corpus), df AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
ranked AS (SELECT key, round(sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(terms) / average))), 6) AS score FROM posts JOIN df USING (term) JOIN corpus USING (key), n GROUP BY key)"""


def _terms(question):
    return ", ".join(f"'{w}'" for w in question.split())


@_query(f"WITH corpus AS (SELECT doc_id AS key, {_TERMS} AS terms FROM documents), {_BM25.format(_terms(SEARCH))} SELECT key AS doc_id, score FROM ranked ORDER BY score DESC, key LIMIT 10")
def bm25_topk(spark, sf):
    return _document_index(spark, sf).ask(SEARCH)


@_query(f"WITH corpus AS (SELECT doc_id AS key, {_TERMS} AS terms FROM documents), {_BM25.format(_terms(SEARCH))} SELECT key AS doc_id, score FROM ranked")
def bm25_all(spark, sf):
    """Every document that holds a term of the question, with its score."""
    return _document_index(spark, sf).ask(SEARCH, None)


@_query(f"""WITH corpus AS (SELECT doc_id AS key, {_TERMS} AS terms FROM documents), asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
posts AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest(terms) AS term FROM corpus) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
n AS (SELECT count(*) AS n, avg(len(terms)) AS average FROM corpus), df AS (SELECT term, count(*) AS df FROM posts GROUP BY term),
ranked AS (SELECT item_id, key, round(sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(terms) / average))), 6) AS score FROM asked JOIN posts USING (term) JOIN df USING (term) JOIN corpus USING (key), n GROUP BY item_id, key)
SELECT * FROM (SELECT item_id, key AS doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, key) AS INTEGER) AS rank FROM ranked) WHERE rank <= 10""")
def bm25_questions(spark, sf):
    """Every benchmark item as a question: the ten documents that answer it best."""
    return _document_index(spark, sf).ask_each(table(spark, sf, "benchmark"), "item_id", F.col("text"))


@_query(f"WITH corpus AS (SELECT doc_id AS key, {_TERMS} AS terms FROM documents) SELECT term, count(DISTINCT key) AS df, count(*) AS n FROM (SELECT key, unnest(terms) AS term FROM corpus) GROUP BY term")
def fulltext_index(spark, sf):
    """The inverted index, summed up per term."""
    return _document_index(spark, sf).postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


@_query(_with(f", corpus AS (SELECT sha AS key, {_TERMS.replace('text', 'message')} AS terms FROM commits), {_BM25.format(_terms('urgent f'))}, top AS (SELECT key FROM ranked ORDER BY score DESC, key LIMIT 3) SELECT left(key, 12) AS hint, path FROM top JOIN modified ON sha = key JOIN file USING (p_partkey)"))
def fulltext_to_files(spark, sf):
    """The files that the three commits found best by their text changed."""
    g = change_graph(spark, sf)
    commits = commit_table(g)
    top = search.search(commits, "sha", F.coalesce("summary_text", "message", "diff_text", F.lit("")), "urgent f", 3)
    targets = g.label("File").select(F.col("node_id").alias("id"), F.col("path").alias("name"), F.col("path").alias("filepath"), F.lit("").alias("code"), F.lit("File").alias("label"))
    return traverse.commit_targets(commits, g.edge("MODIFIED"), targets, top.select(F.substring("sha", 1, 12).alias("hint"))).select("hint", F.col("filepath").alias("path"))


@_query(_with("SELECT id, name, filepath, repo, code, 'SUBJECT_DEFINITION' AS rel_type FROM textnode WHERE contains(name, 'doc_1') ORDER BY length(code) DESC, id LIMIT 1"))
def subject_definition(spark, sf):
    return traverse.subject_definition(text_nodes(spark, sf).withColumn("full_name", F.lit(None).cast("string")), "doc_1")


_GREP = "SELECT * FROM (SELECT f.field, t.*, row_number() OVER (PARTITION BY f.field ORDER BY t.id) AS r FROM textnode t JOIN (VALUES " + ", ".join(f"('{f}')" for f in FIELDS) + ") f(field) ON contains(lower(t.code), f.field)) WHERE r <= 20"


def _fields(spark):
    return spark.createDataFrame([(f,) for f in FIELDS], "field string")


@_query(_with(f"SELECT field, id, 'REFERENCES_FIELD_' || upper(field) AS rel_type FROM ({_GREP})"))
def field_grep(spark, sf):
    return traverse.field_grep(text_nodes(spark, sf), _fields(spark)).select("field", "id", "rel_type")


@_query(SQL["field_grep"])
def field_grep_indexed(spark, sf):
    """The same by the index of substrings."""
    nodes, grams = _text_node_index(spark, sf)
    return traverse.field_grep(nodes, _fields(spark), grams=grams).select("field", "id", "rel_type")


@_query(_with("SELECT id, CASE WHEN contains(lower(code), 'license') THEN md5(array_to_string(list_transform(string_split(regexp_replace(code, chr(10) || '$', ''), chr(10)), lambda x: CASE WHEN contains(lower(x), 'license') THEN '>>> ' ELSE '    ' END || x), chr(10))) ELSE md5(code) END AS marked FROM textnode"))
def mark_hit_lines(spark, sf):
    """Every text with the lines that hold a term marked."""
    return text_nodes(spark, sf).select("id", F.md5(render.mark_hit_lines(F.col("code"), F.lit("license"))).alias("marked"))


@_query(_with("SELECT hint, id FROM (SELECT h.hint, t.id, row_number() OVER (PARTITION BY h.hint ORDER BY t.id) AS r FROM textnode t JOIN (VALUES ('src1/'), ('/fr/'), ('nowhere')) h(hint) ON contains(lower(t.filepath), h.hint)) WHERE r <= 8"))
def path_hint_boost(spark, sf):
    return traverse.path_boost(text_nodes(spark, sf), _hints(spark)).select("hint", "id")


def _hints(spark):
    return spark.createDataFrame([("src1/",), ("/fr/",), ("nowhere",)], "hint string")


@_query(SQL["path_hint_boost"])
def path_hint_indexed(spark, sf):
    nodes, grams = _text_node_index(spark, sf)
    return traverse.path_boost(nodes, _hints(spark), grams=grams).select("hint", "id")


# Blocks

_RULE = "chr(10) || repeat('─', 60)"
_BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


@_query(_with(f""", r AS (SELECT *, doc_id // 20 AS g, trim(code, {_BLANK}) AS body FROM textnode)
  SELECT g, md5('[Source: vector-search]' || chr(10) || string_agg({_RULE} || chr(10) || 'Function : ' || name || chr(10) || 'File     : ' || filepath || chr(10) || 'Repo     : ' || repo || chr(10) || 'Code     :' || chr(10) || body, chr(10) ORDER BY doc_id)) AS block_md5 FROM r WHERE length(body) > 0 GROUP BY g"""))
def context_block(spark, sf):
    """All texts as blocks of twenty each."""
    rows = text_nodes(spark, sf).select(
        F.floor(F.col("doc_id") / 20).alias("g"), F.col("doc_id").alias("ord"), F.lit("vector-search").alias("source"), "name", F.lit(None).cast("string").alias("func_name"), "filepath", "repo",
        F.lit(None).cast("string").alias("rel_type"), "code", F.array().cast(X.CONNECTED).alias("connected"),
    )
    return render.context_block(rows, ["g"]).select("g", F.md5("block").alias("block_md5"))


@_query(_with(f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY filepath ORDER BY committed_at DESC NULLS FIRST, commit_sha) AS n FROM blame)
  SELECT filepath, md5('[Source: blame-traversal]' || chr(10) || string_agg({_RULE} || chr(10) || 'Author     : ' || author || chr(10) || 'Commit SHA : ' || commit_sha || chr(10) || 'Date       : ' || committed_at || chr(10) || 'Message    : ' || commit_msg || chr(10) || 'File       : ' || filepath, chr(10) ORDER BY n)) AS block_md5 FROM ranked WHERE n <= 5 GROUP BY filepath"""))
def blame_block(spark, sf):
    """The latest changes of every file as a block of text."""
    from pyspark.sql import Window

    g = change_graph(spark, sf)
    paths = g.label("File").select(F.col("node_id").alias("target"), F.col("path").alias("filepath"))
    rows = traverse.latest(traverse.authored_changes(g.edge("AUTHORED"), g.label("Commit"), g.edge("MODIFIED")).join(paths, "target"), ["filepath"])
    ord_ = F.row_number().over(Window.partitionBy("filepath").orderBy(F.desc_nulls_first("committed_at"), "commit_sha"))
    blocks = render.blame_block(rows.select("*", F.lit("").alias("func_name"), ord_.alias("ord"), F.col("filepath").alias("key")), ["key"])
    return blocks.select(F.col("key").alias("filepath"), F.md5("block").alias("block_md5"))


# Questions: one per part, in six forms.

_FORMS_SPARK = (
    "concat('who changed ', slug, '.py?')", "concat('show the last ', p_size, ' commits of AFRICA/NATION_', p_partkey % 25)",
    "concat('what files did commit ', substring(md5(cast(p_partkey as string)), 1, 7), ' change?')", "concat('remove the Event field from struct Block', initcap(substring_index(p_name, ' ', 1)), 'Data')",
    "concat('is the ', slug, ' table an important problem (in x/y)?')", "concat('move package `', slug, '` to orbiter-', p_size, ' repo')",
)
_FORMS_DUCK = (
    "'who changed ' || slug || '.py?'", "'show the last ' || p_size || ' commits of AFRICA/NATION_' || p_partkey % 25",
    "'what files did commit ' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 7) || ' change?'", "'remove the Event field from struct Block' || upper(p_name[1]) || lower(split_part(p_name, ' ', 1)[2:]) || 'Data'",
    "'is the ' || slug || ' table an important problem (in x/y)?'", "'move package `' || slug || '` to orbiter-' || p_size || ' repo'",
)
_ASKED = f"""asked AS (SELECT 'p' || p_partkey AS qid, CASE p_partkey % 6 {' '.join(f'WHEN {n} THEN {f}' for n, f in enumerate(_FORMS_DUCK))} END AS q FROM (SELECT *, replace(p_name, ' ', '_') AS slug FROM part))"""


def _asked(spark, sf):
    part = table(spark, sf, "part").withColumn("slug", F.replace("p_name", F.lit(" "), F.lit("_")))
    form = "CASE p_partkey % 6 " + " ".join(f"WHEN {n} THEN {f}" for n, f in enumerate(_FORMS_SPARK)) + " END"
    return part.selectExpr("concat('p', p_partkey) AS qid", f"{form} AS query")


def _re(pattern: str) -> str:
    """A pattern for the other engine: no Unicode switch, quotes doubled."""
    return pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace("'", "''")


def _duck_all(pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all(q, '{_re(pattern)}', {group})"


def _duck_low(pattern: str) -> str:
    return f"list_transform({_duck_all(pattern)}, lambda x: lower(x))"


def _duck_once(values: str) -> str:
    """Distinct values in their order, joined."""
    return f"array_to_string(list_filter({values}, lambda x, i: list_position({values}, x) = i), '|')"


def _any(words) -> str:
    return "regexp_matches(lower(q), '" + "|".join(words) + "')"


_WORDS = "[" + ", ".join(f"CASE WHEN regexp_matches(lower(q), '\\b{w}\\b') THEN '{w}' END" for w in router.COMPONENT_WORDS) + "]"
_SIGNALS = {
    "search_terms": "coalesce(nullif(trim(regexp_replace(regexp_replace(q, '[/\\\\?*~^\\[\\]{}()!]', ' ', 'g'), '\\s+', ' ', 'g')), ''), q)",
    "path_hints": _duck_once(f"list_concat(list_transform({_duck_all(router.PAIR.replace('(?U)', '').replace(chr(92) + 'b', ''), 1)}, lambda p: lower(split_part(p, '/', -1))), {_duck_low('(?i)' + chr(92) + 'b([' + chr(92) + 'w' + chr(92) + '-]+)' + chr(92) + '.go' + chr(92) + 'b')}, list_filter({_WORDS}, lambda w: w IS NOT NULL))"),
    "blame": f"regexp_matches(q, '{_re(router.BLAME)}')",
    "func_hints": _duck_once(f"list_filter(list_concat({_duck_all(router.QUOTED_NAME)}, list_filter({_duck_all(router.NAME)}, lambda w: lower(w) NOT IN {router.BLAME_STOP}), list_transform({_duck_all(router.FILE_NAME)}, lambda f: regexp_replace(f, '\\.[^.]*$', ''))), lambda w: length(w) > 2)"),
    "file_hints": _duck_once(f"list_concat({_duck_all(router.FILE_NAME)}, {_duck_all(router.PAIR)})"),
    "impact": _any(router.IMPACT_WORDS),
    "subjects": _duck_once("list_filter(list_concat(" + ", ".join(_duck_low(p) for p in router.SUBJECTS) + f"), lambda c: length(c) > 2 AND c NOT IN {router.SUBJECT_STOP})"),
    "field_hints": _duck_once(f"list_concat({_duck_low(router.FIELD_VERB)}, list_filter({_duck_low(router.FIELD_NAME)}, lambda w: w NOT IN {router.FIELD_STOP}))"),
    "repo_hints": _duck_once(f"list_concat({_duck_low(router.PAIR)}, list_filter({_duck_low(router.REPO_NAME)}, lambda w: length(w) > 2))"),
    "commit_gate": _any(router.COMMIT_WORDS),
    "recency": _any(router.RECENT_WORDS),
    "repo_hint": f"nullif(regexp_extract(q, '{_re(router.PAIR)}', 1), '')",
    "commit_limit": "CASE WHEN regexp_matches(q, '\\b\\d+\\b') THEN CAST(least(CAST(regexp_extract(q, '\\b(\\d+)\\b', 1) AS BIGINT), 20) AS INTEGER) ELSE 10 END",
    "shas": f"array_to_string(list_filter({_duck_all(router.SHA)}, lambda s, i: list_position({_duck_low(router.SHA)}, lower(s)) = i), '|')",
    "commit_files": f"regexp_matches(q, '{_re(router.COMMIT_FILES)}') AND contains(lower(q), 'commit')",
}


@_query(f"WITH {_ASKED} SELECT qid, {', '.join(f'{v} AS {k}' for k, v in _SIGNALS.items())} FROM asked")
def router_signals(spark, sf):
    """What every question asks about."""
    rows = router.signals(_asked(spark, sf))
    joined = {f.name: F.array_join(f.name, "|") for f in rows.schema if f.dataType.simpleString().startswith("array")}
    return rows.withColumns(joined).drop("query")


@_query()
def router_conversations(spark, sf):
    """The same for all turns of the conversations, whose words are of several languages."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("query"))
    return router.signals(turns).drop("query")


# Extraction


@_query("SELECT host, target_module, count(*) AS n FROM (SELECT regexp_extract(url, '^[^:]+://([^/?#]*)', 1) AS host, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target_module FROM pages) GROUP BY ALL")
def href_dependencies(spark, sf):
    """Links from hosts to targets."""
    rows = table(spark, sf, "pages").select(F.regexp_extract("url", "^[^:]+://([^/?#]*)", 1).alias("host"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("target_module"))
    return rows.groupBy("host", "target_module").agg(F.count("*").alias("n"))


_IMPORT_LINES = "['import ' || slug, 'from ' || slug || '.core import x, y', 'const a = require(''' || slug || ''')', '# import hidden', '#include <' || slug || '.h>', 'x = 1  # because of ' || slug, '   use std::' || slug || ';', '', 'import React from ''' || slug || '''']"


@_query(f"""WITH l AS (SELECT p_partkey || '.py' AS path, unnest({_IMPORT_LINES}) AS line, generate_subscripts({_IMPORT_LINES}, 1) - 1 AS pos FROM (SELECT *, replace(p_name, ' ', '_') AS slug FROM part)),
  s AS (SELECT path, pos, trim(line) AS line FROM l WHERE trim(line) <> '' AND (NOT starts_with(trim(line), '#') OR starts_with(trim(line), '#include'))),
  e AS ({' UNION ALL '.join(f"SELECT path, pos, {k} AS which, regexp_extract(line, '{_re(p)}', 1) AS target_module FROM s" for k, p in enumerate(imports.IMPORT_PATTERNS))})
  SELECT path, target_module, min(pos * 6 + which) AS ord FROM e WHERE target_module <> '' GROUP BY ALL""")
def generic_imports(spark, sf):
    """Dependencies of a made source text per part."""
    parts = table(spark, sf, "part").withColumn("slug", F.replace("p_name", F.lit(" "), F.lit("_")))
    s = F.col("slug")
    lines = F.array(
        F.concat(F.lit("import "), s), F.concat(F.lit("from "), s, F.lit(".core import x, y")), F.concat(F.lit("const a = require('"), s, F.lit("')")), F.lit("# import hidden"), F.concat(F.lit("#include <"), s, F.lit(".h>")),
        F.concat(F.lit("x = 1  # because of "), s), F.concat(F.lit("   use std::"), s, F.lit(";")), F.lit(""), F.concat(F.lit("import React from '"), s, F.lit("'")),
    )
    files_ = parts.select(F.concat(F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), F.array_join(lines, "\n").alias("text"))
    return imports.imports(imports.source_lines(files_, ["path"]), ["path"])


@_query("""SELECT 'a' || n_nationkey || '.go' AS path, unnest(['fmt', 'github.com/x/y' || n_nationkey, 'os']) AS target_module, CAST(unnest([0, 1, 2]) AS BIGINT) AS ord FROM nation
  UNION ALL SELECT 'm' || n_nationkey || '/go.mod', unnest(['github.com/a/b', 'github.com/c/d' || n_nationkey, 'github.com/e/f', '../local']), CAST(unnest([0, 1, 2, 3]) AS BIGINT) FROM nation""")
def go_imports(spark, sf):
    """Imports and module requirements of made Go files, one of each kind per nation."""
    key = F.col("n_nationkey").cast("string")
    nation = table(spark, sf, "nation")
    source = F.concat(F.lit('package a\n\nimport (\n\t"fmt"\n\t// no\n\talias "github.com/x/y'), key, F.lit('"\n)\nimport "os"\nfunc f() {}\n'))
    module = F.concat(F.lit("module m\nrequire (\n\tgithub.com/a/b v1.0.0\n)\nrequire github.com/c/d"), key, F.lit(" v2.0.0\nreplace github.com/e/f => ../local\n"))
    made = nation.select(F.concat(F.lit("a"), key, F.lit(".go")).alias("path"), source.alias("text")).unionByName(nation.select(F.concat(F.lit("m"), key, F.lit("/go.mod")).alias("path"), module.alias("text")))
    return imports.imports(imports.source_lines(made, ["path"]), ["path"])


_PATCH = ("l_orderkey", "l_partkey", "path")


def _patches(spark, sf, text):
    """A made patch per order line. The lines are dealt by their keys before any text is made, and what a patch names is
    made distinct where they lie, so that only numbers move."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").repartition("l_orderkey", "l_partkey")
    return lines.select("l_orderkey", "l_partkey", F.concat(F.lit("pkg/"), F.col("l_partkey").cast("string"), F.lit(".py")).alias("path"), text.alias("patch"))


def _by_sha(rows):
    return rows.withColumn("sha", F.md5(F.col("l_orderkey").cast("string")))


@_query("""SELECT DISTINCT md5(CAST(l_orderkey AS VARCHAR)) AS sha, 'pkg/' || l_partkey || '.py' AS path, unnest(['+', '-']) AS sign, unnest(['json' || l_suppkey, 'sys' || l_linenumber]) AS target_module FROM lineitem""")
def patch_temporal(spark, sf):
    """Dependencies that made patches add and remove."""
    text = F.concat(F.lit("--- a\n+++ b\n@@ -1,3 +1,3 @@\n import os\n-import sys"), F.col("l_linenumber").cast("string"), F.lit("\n+import json"), F.col("l_suppkey").cast("string"))
    return _by_sha(imports.patch_imports(patches.signed_lines(_patches(spark, sf, text), _PATCH), _PATCH)).select("sha", "path", "sign", "target_module")


@_query("SELECT DISTINCT md5(CAST(l_orderkey AS VARCHAR)) AS sha, 'pkg/' || l_partkey || '.py' AS path, unnest(['os', 'json' || l_suppkey]) AS target_module FROM lineitem")
def patch_additive(spark, sf):
    """Dependencies on the new side of made patches, context lines included."""
    text = F.concat(F.lit("@@ -1,3 +1,3 @@\n import os\n-import sys\n+import json"), F.col("l_suppkey").cast("string"))
    return _by_sha(imports.additive_patch_imports(_patches(spark, sf, text), _PATCH)).select("sha", "path", "target_module")


_PY = "import os\n\ndef outer_{0}(x):\n    def inner():\n        return g(x)\n    return inner()\n\nclass C:\n    async def m_{0}(self):\n        self.h()\n        return outer_{0}(1)\n"
_GO = "package p\n\nfunc f_{0}(a int) (int, error) {{\n\treturn g(a), fmt.Errorf(\"}}\")\n}}\n\nfunc (s *S) m_{0}() {{\n\tgo func() {{ s.run(f_{0}(1)) }}()\n}}\n"


def _sources(spark, sf):
    key = F.col("p_partkey").cast("string")
    fill = lambda text: F.replace(F.lit(text.replace("{{", "{").replace("}}", "}").replace("{0}", "\x00")), F.lit("\x00"), key)
    rows = files(spark, sf)
    py = rows.select("repo", F.concat("path", F.lit(".py")).alias("path"), fill(_PY).alias("text"))
    go = rows.select("repo", F.concat("path", F.lit(".go")).alias("path"), fill(_GO).alias("text"))
    return py.unionByName(go)


@_query(_with("""SELECT repo, path || '.py' AS path, unnest(['outer_' || p_partkey, 'inner', 'm_' || p_partkey]) AS name, unnest([3, 4, 9]) AS start, unnest([6, 5, 11]) AS "end" FROM file
  UNION ALL SELECT repo, path || '.go', unnest(['f_' || p_partkey, 'm_' || p_partkey]), unnest([3, 7]), unnest([5, 9]) FROM file"""))
def ast_functions(spark, sf):
    """Functions of a made Python and Go file per part."""
    return syntax.parse_sources(_sources(spark, sf)).where("kind = 'function'").select("repo", "path", "name", "start", "end")


@_query(_with("""SELECT repo, path || '.py' AS path, unnest(['outer_' || p_partkey, 'outer_' || p_partkey, 'inner', 'm_' || p_partkey]) AS name, unnest(['g', 'inner', 'g', 'outer_' || p_partkey]) AS callee FROM file
  UNION ALL SELECT repo, path || '.go', unnest(['f_' || p_partkey, 'f_' || p_partkey, 'm_' || p_partkey, 'm_' || p_partkey]), unnest(['g', 'Errorf', 'run', 'f_' || p_partkey]) FROM file"""))
def ast_calls(spark, sf):
    return syntax.parse_sources(_sources(spark, sf)).where("kind = 'call'").select("repo", "path", "name", "callee")


# Sources


@_query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def file_contents(spark, sf):
    """Base64 bodies decoded to text."""
    bodies = table(spark, sf, "documents").select("doc_id", F.base64(F.encode("text", "UTF-8")).alias("content"))
    return bodies.select("doc_id", F.md5(readers.decode_content(F.col("content"))).alias("text_md5"))


@_query("SELECT md5(CAST(o_orderkey AS VARCHAR)) AS sha, CASE WHEN o_custkey % 2 = 0 THEN 'user' || o_custkey ELSE 'unknown' END AS author, o_orderpriority AS message, 2 AS n_files FROM orders WHERE o_orderkey % 10 <> 0")
def commit_payloads(spark, sf):
    """Commit payloads as JSON text, parsed; empty payloads of failed fetches fall away."""
    o = table(spark, sf, "orders")
    file_ = F.struct(F.lit("a.py").alias("filename"), F.lit("+x").alias("patch"), F.lit(3).alias("additions"))
    body = F.struct(
        F.md5(F.col("o_orderkey").cast("string")).alias("sha"), F.struct(F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("user"), F.col("o_custkey").cast("string"))).otherwise("").alias("login")).alias("author"),
        F.struct(F.col("o_orderpriority").alias("message")).alias("commit"), F.array(file_, file_).alias("files"),
    )
    payload = F.when(F.col("o_orderkey") % 10 == 0, F.lit("{}")).otherwise(F.to_json(body))
    return readers.parse_details(o.select(payload.alias("payload"))).select("sha", "author", "message", F.size("files").alias("n_files"))


@_query()
def embeddings_offline(spark, sf):
    """The hash embedding of every document."""
    return table(spark, sf, "documents").select("doc_id", readers.embed(F.col("text")).alias("embedding"))


# Whole questions over both graphs


def corpus(spark, sf):
    """The change graph's commits and files beside the text graph's functions. What no table has as questions find it is
    stored once, by number; nodes are read and edges made where a question names them."""
    from weftgraph.plans.retrieve import Corpus

    def make(scratch):
        g = change_graph(spark, sf)
        nodes = g.node_view("File", "Function", "Module").unionByName(bare_text_nodes(spark, sf).withColumn("full_name", F.lit(None).cast("string")))
        numbered = scratch.put(numbered_commits(spark, sf), "commits")
        commits, authored = as_commits(numbered)
        ids = table(spark, sf, "documents").select("doc_id").where("doc_id IS NOT NULL")
        numbers = numbered_nodes(spark, sf).select("nr", "id").unionByName(ids.select((4 * F.col("doc_id") + 3).alias("nr"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id")))
        edges = Edges(numbers, functools.partial(edges_near, spark, sf))
        files_ = files(spark, sf).select(F.col("p_partkey").alias("nr"), F.concat_ws("::", F.lit("File"), "path", "repo").alias("id"))
        changes = Changes(files_, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("nr")), lambda c: F.md5(c.cast("string")))
        index = search.TextIndex.build(numbered.select(F.col("nr").alias("sha"), "message"), "sha", F.col("message"), f"{scratch.home}/index", "md5(cast(key as string))")
        known = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding").join(ids, "doc_id")
        vectors = scratch.put(known, "vectors").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), "embedding", unit(F.col("embedding")).alias("unit"))
        return Corpus(nodes, edges, commits, authored, changes, texts=index, vectors=search.Vectors(vectors))

    tables = ("part", "supplier", "nation", "region", "lineitem", "orders", "customer", "documents", "embeddings")
    return stored(spark, [f"{sf}/{t}.parquet" for t in tables], "corpus", make)


QUESTIONS = (
    "who changed doc_17?", "show the last 5 commits of AFRICA/NATION_0", "what files did commit e4da3b7 change?", "what depends on Supplier#000000007 if we remove the license field?",
    "find commits about urgent fixes",
)


@_query()
def hybrid_retrieve(spark, sf):
    """Five questions routed, retrieved and put together as text."""
    from weftgraph.plans import retrieve

    c, vector, out = corpus(spark, sf), _question_vector(spark, sf), None
    for question in QUESTIONS:
        one = retrieve.assemble(retrieve.retrieve_rows(c, question, vector=vector)).withColumn("question", F.lit(question))
        out = one if out is None else out.unionByName(one)
    return out


@_query()
def hybrid_rows(spark, sf):
    """The retrieved rows of the question with the most stages."""
    from weftgraph.plans import retrieve

    return retrieve.retrieve_rows(corpus(spark, sf), "who changed the last commit that moved package blue?", vector=_question_vector(spark, sf))


# Streams: the same results as over the tables at rest


def _streamed(spark, sf, run):
    scratch = Scratch(spark, "stream")
    rows = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")  # a pattern may name a file or a folder
    return run(rows, scratch.home)


@_query("SELECT user_id, arg_min(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def stream_upsert(spark, sf):
    from weftgraph.streaming import upserts

    def run(rows, home):
        upserts.run_to_end(lambda: upserts.stream_upsert(rows, f"{home}/table", f"{home}/checkpoint", ["user_id"], ["event_type"], ["value"], "event_id"))
        return upserts.Versions(spark, f"{home}/table").latest().select("user_id", "event_type", "value")

    return _streamed(spark, sf, run)


@_query("SELECT DISTINCT user_id FROM events")
def stream_incremental(spark, sf):
    from weftgraph.streaming import upserts

    def run(rows, home):
        upserts.run_to_end(lambda: upserts.stream_new(rows, f"{home}/table", f"{home}/checkpoint", "user_id"))
        return upserts.Versions(spark, f"{home}/table").latest().select("user_id")

    return _streamed(spark, sf, run)
