"""Signals of a question as columns: what it asks about and which stages it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph import schema as X

# Words and patterns that route a question.
COMPONENT_WORDS = ("help", "textinput", "textarea", "list", "paginator", "progress", "spinner", "viewport", "filepicker", "table", "cursor", "key", "styles", "style")
BLAME = (
    r"(?iU)\bwho\b.{0,25}\b(added|wrote|changed|modified|introduced|created|implemented|broke|touched|owns|did)\b"
    r"|\bwhich commit\b|\bwhen was\b|\bwhen did\b|\bgit blame\b|\bblame\b|\bwho is responsible\b|\bwho owns\b"
)
BLAME_STOP = ("who", "what", "when", "where", "which", "how", "the", "this", "that", "was", "were", "has", "have", "did", "does", "added", "changed", "introduced", "modified", "created", "wrote")
IMPACT_WORDS = (
    "move", "moved", "moving", "migrate", "migrated", "migration", "extract", "extracted", "update", "updated", "updating",
    "remove", "removed", "removing", "delete", "deleted", "deleting", "rename", "renamed", "renaming", "change", "changed", "changing",
    "modify", "modified", "modifying", "drop", "dropped", "dropping", "deprecate", "deprecated", "affect", "affected", "affects",
    "impact", "impacts", "depend", "depends", "dependency", "dependencies", "import", "imports", "refactor", "split", "separate",
    "what breaks", "what will break", "what changes", "breaking", "breaks",
)
SUBJECT_STOP = (
    "the", "from", "into", "what", "will", "get", "this", "that", "to", "in", "of", "a", "an", "and", "or", "if", "is", "are",
    "for", "at", "by", "be", "it", "on", "as", "do", "how", "field", "repo", "repository", "package", "struct", "class",
)
COMMIT_WORDS = ("commit", "commits", "merge", "push", "pr", "pull request", "issue", "bug", "fix", "release", "tag", "author", "contributor", "last", "recent", "latest", "history")
RECENT_WORDS = ("last", "recent", "latest", "newest", "history")
COMMIT_FILES = (
    r"(?iU)\b(what|which)\b.{0,30}\b(file|files|changed|modified|touched|affect)\b"
    r"|\b(file|files)\b.{0,20}\b(commit|sha|hash)\b"
    r"|\bcommit\b.{0,20}\b(change|changed|modify|modified|touch|touched|affect)\b"
    r"|\bshow\b.{0,20}\b(file|files)\b.{0,20}\bcommit\b"
)
QUOTED_NAME = r"(?U)['\"`]([\w_]+)['\"`]"
NAME = r"(?U)\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+|[A-Z][a-zA-Z0-9]{2,})\b"
FILE_NAME = r"(?iU)\b([\w_\-]+\.(?:py|go|ts|js|java|cpp|c|rb|rs|kt))\b"
PAIR = r"(?U)\b([\w\-]+/[\w\-]+)\b"
SUBJECTS = (
    r"(?U)['\"`]([\w_\-\.]+)['\"`]",
    r"(?iU)\b(?:package|module|library|pkg|component|resource|struct|class|type|field|property|attribute)\s+([\w_\-\.]+)",
    r"(?iU)\b(?:update|modify|remove|rename|delete|drop|deprecate|change|adding|removing)\s+([\w_\-\.]+)",
    r"(?U)\b([A-Z][a-z]+(?:[A-Z][a-z0-9]*)+)\b",
    r"(?U)\b([a-z][a-z0-9]+(?:[_\-][a-z0-9]+)+)\b",
    r"(?iU)\b(?:move|extract|migrate|split)\s+([\w_\-\.]+)",
)
FIELD_VERB = (
    r"(?iU)\b(?:remov(?:e|ing)|delet(?:e|ing)|dropp?(?:ing)?|renam(?:e|ing)|updat(?:e|ing))\s+(?:the\s+)?([A-Za-z_][\w_]*)\s+"
    r"(?:field|property|attribute|column|param|parameter|arg|argument)"
)
FIELD_NAME = r"(?U)\b([A-Z][a-z]+|[a-z][a-z0-9]+)\s+[Ff]ield\b"
FIELD_STOP = ("the", "a", "this", "that", "some", "any")
REPO_NAME = r"(?iU)\b([\w][\w\-]+)\s+(?:repo|repository|codebase|service|module)\b"
SHA = r"(?iU)\b([0-9a-f]{7,40})\b"
SEARCH_SIGNS = r"[/\\?*~^\[\]{}()!]"
PATH_PAIR = r"(?U)[\w\-]+/[\w\-]+"
GO_FILE = r"(?iU)\b([\w\-]+)\.go\b"
NUMBER = r"(?U)\b(\d+)\b"


def _all(q: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(q, F.lit(pattern), group)


def _lower(values: Column) -> Column:
    return F.transform(values, F.lower)


def _longer_than(values: Column, n: int) -> Column:
    return F.filter(values, lambda v: F.length(v) > n)


def _any_of(low: Column, words: tuple[str, ...]) -> Column:
    """Any of the words as a substring, not as a whole word."""
    return low.rlike("|".join(words))


def sanitize(q: Column) -> Column:
    """The question without the signs of the search syntax; itself if nothing is left."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.regexp_replace(q, SEARCH_SIGNS, " "), r"\s+", " ")), F.lit("")), q)


def path_hints(q: Column) -> Column:
    pairs = F.transform(_all(q, PATH_PAIR, 0), lambda p: F.lower(F.substring_index(p, "/", -1)))
    files = _lower(_all(q, GO_FILE))
    words = F.filter(F.array(*map(F.lit, COMPONENT_WORDS)), lambda w: F.rlike(F.lower(q), F.concat(F.lit(r"(?U)\b"), w, F.lit(r"\b"))))
    return F.array_distinct(F.concat(pairs, files, words))


def blame_func_hints(q: Column) -> Column:
    names = F.filter(_all(q, NAME), lambda w: ~F.lower(w).isin(*BLAME_STOP))
    stems = F.transform(_all(q, FILE_NAME), lambda f: F.regexp_replace(f, r"\.[^.]*$", ""))
    return F.array_distinct(_longer_than(F.concat(_all(q, QUOTED_NAME), names, stems), 2))


def blame_file_hints(q: Column) -> Column:
    return F.array_distinct(F.concat(_all(q, FILE_NAME), _all(q, PAIR)))


def impact_subjects(q: Column) -> Column:
    found = F.concat(*(_lower(_all(q, p)) for p in SUBJECTS))
    return F.array_distinct(F.filter(found, lambda c: (F.length(c) > 2) & ~c.isin(*SUBJECT_STOP)))


def field_hints(q: Column) -> Column:
    named = F.filter(_lower(_all(q, FIELD_NAME)), lambda w: ~w.isin(*FIELD_STOP))
    return F.array_distinct(F.concat(_lower(_all(q, FIELD_VERB)), named))


def repo_hints(q: Column) -> Column:
    return F.array_distinct(F.concat(_lower(_all(q, PAIR)), _longer_than(_lower(_all(q, REPO_NAME)), 2)))


def repo_in_question(q: Column) -> Column:
    """The first a/b pair; null if there is none."""
    return F.nullif(F.regexp_extract(q, PAIR, 1), F.lit(""))


def commit_limit(q: Column) -> Column:
    """The first number of the question, 20 at most; 10 without one."""
    number = F.nullif(F.regexp_extract(q, NUMBER, 1), F.lit(""))
    value = F.when(F.length(number) > 9, X.RECENT_MOST).otherwise(F.try_to_number(number, F.lit("999999999")).cast("int"))
    return F.when(value.isNull(), X.RECENT_DEFAULT).otherwise(F.least(value, F.lit(X.RECENT_MOST)))


def shas(q: Column) -> Column:
    """Hex words of 7 to 40 digits, the first spelling of each."""
    found = _all(q, SHA)
    return F.filter(found, lambda s, i: F.array_position(_lower(found), F.lower(s)) == i + 1)


def signals(questions: DataFrame, column: str = "query") -> DataFrame:
    """All signals as columns beside the question."""
    q = F.col(column)
    low = F.lower(q)
    return questions.withColumns(
        {
            "search_terms": sanitize(q), "path_hints": path_hints(q), "blame": q.rlike(BLAME), "func_hints": blame_func_hints(q),
            "file_hints": blame_file_hints(q), "impact": _any_of(low, IMPACT_WORDS), "subjects": impact_subjects(q), "field_hints": field_hints(q),
            "repo_hints": repo_hints(q), "commit_gate": _any_of(low, COMMIT_WORDS), "recency": _any_of(low, RECENT_WORDS),
            "repo_hint": repo_in_question(q), "commit_limit": commit_limit(q), "shas": shas(q),
            "commit_files": q.rlike(COMMIT_FILES) & low.contains("commit"),
        }
    )
