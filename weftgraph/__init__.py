"""weftgraph: a Spark-first analytics engine for code-knowledge graphs."""
