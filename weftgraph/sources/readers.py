"""Inputs of the ingest as DataFrames.

Anything a hosting service returns is read from files that Spark can reach: JSON
for listings and commit payloads, base64 for contents. Live fetching is map-side: each
task asks for its keys and tries again on its own, and nothing that goes wrong with one
key ends the job (`host` has the commit list as a data source).
"""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph import schema as X
from weftgraph.functions.patches import author_of

# Answers that are tried again, tries, and seconds that a spent rate limit waits.
RETRY_STATUS = (429, 500, 502, 503, 504)
TRIES = 5
RATE_LIMIT_PAUSE = 60.0
#: Commits that a page of a listing holds.
PAGE = 100
#: Length of the offline vectors.
VECTOR_SIZE = 64


def decode_content(content: Column) -> Column:
    """Base64 to text; bytes that are no UTF-8 become replacement characters, broken base64 null."""
    raw = F.try_to_binary(F.regexp_replace(content, r"\s", ""), F.lit("base64"))
    return F.coalesce(F.try_validate_utf8(raw.cast("string")), F.make_valid_utf8(raw.cast("string")))


def repo_tree(spark: SparkSession, path: str) -> DataFrame:
    """A recursive listing: repo, pos, path, type (tree or blob)."""
    return spark.read.schema(X.TREE).json(path)


def local_tree(spark: SparkSession, root: str, repo: str) -> tuple[DataFrame, DataFrame]:
    """A folder that Spark can reach, as a listing and its contents."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    inner = F.regexp_replace("path", r"^[a-z]+:/+" + re.escape(base) + "/", "")
    files = found.select(F.lit(repo).alias("repo"), inner.alias("path"), F.base64("content").alias("content"))
    steps = F.split("path", "/")
    leading = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    dirs = files.where(F.size(steps) > 1).select("repo", F.explode(leading).alias("path")).distinct()
    tree = dirs.withColumn("type", F.lit("tree")).unionByName(files.select("repo", "path").withColumn("type", F.lit("blob")))
    return tree.withColumn("pos", F.lit(0)), files


def commit_list(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """Listed commits in their order, at most `most` of each repository."""
    rows = spark.read.schema(X.COMMIT_LIST).json(path)
    return rows if most is None else rows.where(F.col("pos") < most)


def commit_details(spark: SparkSession, path: str) -> DataFrame:
    return flatten_details(spark.read.schema(X.COMMIT_DETAIL).json(path))


def parse_details(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Commit payloads held as JSON text."""
    return flatten_details(payloads.withColumn("_d", F.from_json(column, X.COMMIT_DETAIL)).select("_d.*"))


def flatten_details(details: DataFrame) -> DataFrame:
    """sha, author, timestamp, message, url, files; payloads without a sha (failed fetches) are left out."""
    return details.where("sha IS NOT NULL").select(
        "sha", author_of(F.col("author.login"), F.col("commit.author.name")).alias("author"), F.coalesce("commit.author.date", F.lit("")).alias("timestamp"),
        F.coalesce("commit.message", F.lit("")).alias("message"), F.coalesce("html_url", F.lit("")).alias("url"), "files",
    )


def exploded_files(details: DataFrame) -> DataFrame:
    """A row per changed file: sha, pos and the file's properties."""
    return details.select("sha", F.posexplode("files").alias("pos", "f")).select("sha", "pos", "f.*")


#: What a fetch gives: the status and body of an answer, and its headers if it has any.
Fetch = Callable[[str], tuple]


def http_fetch(base: str, token: str | None = None, accept: str = "application/json", timeout: float = 30.0) -> Fetch:
    """Fetches `base` and the key below it over HTTP, with a token in the headers where there is one."""
    headers = {"Accept": accept} | ({"Authorization": f"Bearer {token}"} if token else {})

    def fetch(key: str) -> tuple:
        from http.client import HTTPException, InvalidURL
        from urllib.error import HTTPError
        from urllib.parse import quote
        from urllib.request import Request, urlopen

        try:
            url = f"{base.rstrip('/')}/{quote(key, safe='/?&=%:@+,;~')}"
            with urlopen(Request(url, headers=headers), timeout=timeout) as answer:  # noqa: S310  the base is the caller's
                return answer.status, answer.read().decode("utf-8", "replace"), dict(answer.headers)
        except HTTPError as e:
            return e.code, None, dict(e.headers or {})
        except (InvalidURL, UnicodeError):
            return 0, None, {}  # no such key can be asked for
        except (OSError, HTTPException) as e:  # a connection that broke, was cut short or never came about
            raise TimeoutError(str(e)) from e

    return fetch


def pause_of(status: int, headers: dict, turn: int) -> float | None:
    """Seconds until the next try; None if there is none. An answer's own `Retry-After` counts; a spent rate limit waits long."""
    low = {str(k).lower(): v for k, v in headers.items()}
    limited = status == 403 and (str(low.get("x-ratelimit-remaining")) == "0" or "retry-after" in low)
    if status not in RETRY_STATUS and not limited:
        return None
    try:
        return max(0.0, float(low["retry-after"]))
    except (KeyError, ValueError):
        return RATE_LIMIT_PAUSE if limited else 2.0**turn


def with_retries(fetch: Fetch, key: str, wait: Callable[[float], None] = time.sleep) -> str | None:
    """What `fetch` gives for a key; tried again after a pause on busy, limited and failing answers and on time-outs. Null if it fails otherwise."""
    for turn in range(TRIES):
        try:
            status, body, *rest = fetch(key)
        except TimeoutError:
            status, body, rest = 503, None, []
        except Exception:  # noqa: BLE001  one key's failure is no one else's
            return None
        if status == 200:
            return body
        pause = pause_of(status, rest[0] if rest else {}, turn)
        if pause is None:
            return None
        if turn + 1 < TRIES:
            wait(pause)
    return None


def quoted(path: Column) -> Column:
    """A path as it stands in an address, its slashes kept."""
    return F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def fetch_each(keys: DataFrame, column: str, fetch: Fetch, partitions: int = 8) -> DataFrame:
    """`column` and `payload` for each key, fetched by `partitions` tasks at once; null where fetching failed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(payload=[with_retries(fetch, k) for k in pdf[column]])

    out = T.StructType([*keys.select(column).schema.fields, T.StructField("payload", T.StringType())])
    return keys.select(column).repartition(partitions).mapInPandas(run, out)


def hash_vector(text: str | None, size: int = VECTOR_SIZE) -> list[float]:
    """The offline embedding of a text: words hashed to signed places, scaled to length 1; [] without words."""
    out = np.zeros(size)
    for word in re.findall("[a-z0-9]+", (text or "").lower()):
        code = zlib.crc32(word.encode())
        out[code % size] += 1.0 if code >> 16 & 1 else -1.0
    norm = np.sqrt((out * out).sum())
    return (out / norm).astype(np.float32).tolist() if norm else []


def _embed_batch(texts: pd.Series) -> pd.Series:
    known = {t: hash_vector(t) for t in texts.unique()}
    return texts.map(known)


def embed(texts: Column) -> Column:
    """`hash_vector` of each text; a text that a batch repeats is embedded once."""
    return F.pandas_udf(_embed_batch, "array<float>")(texts)


def embed_distinct(df: DataFrame, column: str, model: Callable[[Column], Column] = embed) -> DataFrame:
    """Adds `embedding`, computed once for each distinct text; null for null."""
    vectors = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("embedding", model(F.col(column)))
    return df.join(vectors, column, "left")


def summarize_each(commits: DataFrame, model: Callable[[list[str]], list[str]], column: str = "prompt") -> DataFrame:
    """Adds `summary_text` from a text model that answers a batch of prompts; null where the answer is blank or the model fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                answers = [(a or "").strip() or None for a in model(pdf[column].tolist())]
            except Exception:  # noqa: BLE001  any failure of the outside model leaves the summary to the fallback
                answers = [None] * len(pdf)
            yield pdf.assign(summary_text=answers)

    return commits.mapInPandas(run, T.StructType([*commits.schema.fields, T.StructField("summary_text", T.StringType())]))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a stored graph can be reached."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
