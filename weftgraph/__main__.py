"""Ingests a repository as the environment says: python -m weftgraph.

WEFT_REPO      owner/name (needed)
WEFT_GRAPH     folder of the stored graph (needed); a new snapshot is written to WEFT_OUT
WEFT_OUT       folder of the new snapshot (needed; must not exist)
WEFT_API       base of the hosting service's REST interface, or
WEFT_INPUTS    folders of JSON lines, comma-joined: tree, contents, commit list, commit details, and recent commits' files (optional)
WEFT_TOKEN     token for the service
WEFT_COMMITS   commits at most (200)
WEFT_FORCE     true: commits that are stored already are read again
WEFT_LOG       log level of the session (WARN)
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession

from weftgraph.plans.engine import Engine
from weftgraph.sources import readers

NEEDED = ("WEFT_REPO", "WEFT_GRAPH", "WEFT_OUT")


def main(env: dict[str, str], spark: SparkSession | None = None) -> int:
    missing = [n for n in NEEDED if not env.get(n)]
    if not env.get("WEFT_API") and not env.get("WEFT_INPUTS"):
        missing.append("WEFT_API or WEFT_INPUTS")
    if missing:
        print(f"missing in the environment: {', '.join(missing)}", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("weftgraph").getOrCreate()
    spark.sparkContext.setLogLevel(env.get("WEFT_LOG", "WARN"))
    engine = Engine(spark, path=env["WEFT_GRAPH"])
    most, options = int(env.get("WEFT_COMMITS", "200")), {"force": env.get("WEFT_FORCE", "").lower() == "true"}
    if env.get("WEFT_INPUTS"):
        run = engine.bootstrap(env["WEFT_REPO"], env["WEFT_INPUTS"].split(","), most=most, **options)
    else:
        run = engine.fetch(env["WEFT_REPO"], readers.http_fetch(env["WEFT_API"], env.get("WEFT_TOKEN")), most, **options)
    engine.save(env["WEFT_OUT"])
    print(", ".join(f"{k} {n}" for k, n in run.items()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main(dict(os.environ)))
