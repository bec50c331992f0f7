"""Toxicity by a weighted finite-state pattern grammar (operator 7).

A text is cut into clauses. Each word of a clause that holds a hit is read by a
lexical transducer, which writes a class (insult, threat, target, negation, report
or other) with the weight that the lexicon gives the word. Small transducers over
these classes are composed into two, as in a bimachine. One reads a clause from its
end: it marks what a report near the end or a negation at the end comes after
("you idiot, she said", "an idiot you are not") and what a target follows. The
other reads it from the start: it marks what follows a target or a negation, and what
follows a report anywhere in the clause, and writes an event for each insult or threat
with a learnt weight for that context. Weights along a path add up: an event weighs
what its word and its context do.

A text's weight is the sum of its events' weights, by kind of event 0 at least. The
score is a logistic function of the logarithms of the weight and of the weight per
hundred words, so one marked word in a long text says less than in a short one.

Words beyond the seed lexicon are induced from labelled rows: words and word
beginnings that stand in toxic texts far more often than chance has it (a G-test), by
texts that hold them at all, or in two different words. A word weighs the logarithm of
the ratio of its rates in toxic and in other texts, drawn towards a prior; seeds whose
ratio is against them are dropped. The context weights and the logistic function are
fitted together, with a ridge around prior values. All use at most `FIT_ROWS` labelled
rows of the training folds, taken in the order of a hash of doc_id; rows that are near
copies of another with the same label count once.

Cases: a null or empty text has no clause and gets the intercept's score; a
null doc_id has no fold and is not held out; repeated rows are scored one by
one; labels with a null are left out, and where a doc_id is labelled twice the
larger label counts; an empty label table leaves the priors; extra columns are
not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import by_size, column, mix, pieces, windows, word_hashes
from weftgraph.plans.materialize import Scratch
from weftgraph.sources.tables import table

#: Labelled rows used for the fit.
FIT_ROWS = 12_000
#: A stem must stand in so many toxic texts, with this share of all texts that hold it, and so far from chance (G).
STEM_SUPPORT = 3
STEM_PURITY = 0.8
STEM_G = 13.0
STEM_LENGTHS = range(3, 11)
#: Bytes of text whose words and beginnings a task counts at once.
BATCH_BYTES = 2_000_000
SKETCHES = 8
#: Equal min-hashes of near copies: 0.94 of pairs at a similarity of 0.8 have so many, and 0.0004 at 0.1.
SAME = 5
THRESHOLD = 0.7
#: Weight of a seed before any is counted (induced words have none), so many counts that it stands for, and the largest weight.
WORD_PRIOR, WORD_PRIOR_COUNT, MOST_WORD = 3.0, 4.0, 6.0

# The seed lexicon. A star marks a beginning of words.
INSULTS = (
    "asshole bastard bitch clown coward creep cretin degenerate disgusting dumb dumbass fool freak garbage idiot* imbecile* jackass jerk "
    "liar loser losers lunatic maggot moron* parasite pathetic pig pigs psycho retard* rat rats scum scumbag sicko slut stupid trash traitor "
    "vermin vile whore worthless wimp "
    "abruti* connard* crétin* débile* minable ordure pourriture salaud* "
    "arschloch blödmann dummkopf idioten schwachkopf trottel versager wichser abschaum "
    "estúpid* gilipollas imbécil* inútil mierda pendejo* basura"
)
THREATS = "kill murder strangle stab shoot hang burn destroy hurt crush slaughter tuer tuerai détruire töten umbringen vernichten matar mataré matarte destruir"
TARGETS = "you your yours youre u ur he she they them him her his their people everyone tu toi vous ton ta votre ils elles du dich dir ihr euch sie usted ustedes tú ellos ellas te"
NEGATIONS = "not no never neither nor isn wasn aren don doesn didn won wouldn cannot can't isn't wasn't aren't don't doesn't didn't won't ne pas jamais aucun nicht kein keine keinen nie niemals nunca jamás tampoco"
REPORTS = "said says wrote writes called calls claimed claims quoted quotes reported reports alleged according dit disait écrit appelle sagte sagt schrieb nannte dijo dice escribió llamó"

CLASSES = ("insult", "threat", "target", "negation", "report", "other")
EVENTS = tuple(f"{kind}{context}" for kind in ("insult", "threat") for context in ("", "+target", "+negated", "+reported"))
# Prior weights of the contexts, in the order of EVENTS, and of the logistic function.
PRIOR = (0.6, 1.2, -2.6, -2.2, -2.7, -1.5, -2.9, -2.7)
PRIOR_LINE = (-5.0, 2.0, 2.0)
#: How firmly the fit holds to the priors.
RIDGE_CONTEXT, RIDGE_LINE = 2.0, (0.1, 1.0, 1.0)
#: Words after which a negation, and within which a target, still counts; words at a clause's end in which a report counts for what stands before it.
REACH = 3

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE_END = re.compile(r"[.!?;\n]+")
TAGS = ("target", "negated", "reported")
MARKED = ("insult", "threat")
#: Classes, and insults and threats with any tags.
SYMBOLS = (*CLASSES, *("+".join((kind, *tags)) for kind in MARKED for n in range(1, len(TAGS) + 1) for tags in combinations(TAGS, n)))


class Transducer:
    """A deterministic weighted transducer: (state, symbol) -> (state, output, weight); states are tuples."""

    def __init__(self, start: tuple, arcs: dict[tuple, tuple[tuple, str, float]]) -> None:
        self.start, self.arcs = start, arcs

    def compose(self, after: Transducer) -> Transducer:
        """Feeds what this one writes to `after`; weights add up."""
        start = (*self.start, *after.start)
        arcs, todo, seen = {}, [(self.start, after.start)], {(self.start, after.start)}
        symbols = {s for _, s in self.arcs}
        while todo:
            a, b = todo.pop()
            for symbol in symbols:
                if (a, symbol) not in self.arcs:
                    continue
                a2, written, w1 = self.arcs[a, symbol]
                if (b, written) not in after.arcs:
                    continue
                b2, out, w2 = after.arcs[b, written]
                arcs[(*a, *b), symbol] = ((*a2, *b2), out, w1 + w2)
                if (a2, b2) not in seen:
                    seen.add((a2, b2))
                    todo.append((a2, b2))
        return Transducer(start, arcs)

    def run(self, symbols: list[str], weights: list[float]) -> tuple[list[str], list[float]]:
        """What is written for each symbol, and its weight with that of its arc."""
        state, out, total = self.start, [], []
        for symbol, weight in zip(symbols, weights, strict=True):
            state, written, w = self.arcs[state, symbol]
            out.append(written)
            total.append(weight + w)
        return out, total


def _tagged(symbol: str, tag: str) -> str:
    kind, *tags = symbol.split("+")
    return "+".join((kind, *(t for t in TAGS if t == tag or t in tags)))


def _mark(trigger: str, tag: str, then) -> Transducer:
    """Tags insults and threats read in a state above 0; `then(state, triggers)` is the next state, from -1 at the start."""
    arcs, todo, seen = {}, [-1], {-1}
    while todo:
        state = todo.pop()
        for symbol in SYMBOLS:
            kind = symbol.split("+")[0]
            after = then(state, kind == trigger)
            arcs[(state,), symbol] = ((after,), _tagged(symbol, tag) if state > 0 and kind in MARKED else symbol, 0.0)
            if after not in seen:
                seen.add(after)
                todo.append(after)
    return Transducer((-1,), arcs)


def _within(state: int, triggers: bool) -> int:
    """For REACH words after the trigger."""
    return REACH if triggers else max(0, state - 1)


def _ever(state: int, triggers: bool) -> int:
    """From the trigger on."""
    return int(triggers or state > 0)


def _near_start(state: int, triggers: bool) -> int:
    """From the trigger on, if it is among the first REACH words: states below 0 count them, -9 is too late."""
    if state > 0 or triggers and state != -9:
        return 1
    return -9 if state in (-9, -REACH) else state - 1


def _only_first(state: int, triggers: bool) -> int:
    """For REACH words after the trigger, if that is the first word."""
    return REACH if triggers and state == -1 else max(0, state - 1)


def from_end() -> Transducer:
    """Marks by what comes after, read from the end of a clause."""
    return _mark("target", "target", _within).compose(_mark("negation", "negated", _only_first)).compose(_mark("report", "reported", _near_start))


def event_of(symbol: str) -> str:
    """Reported speech outweighs negation, and that a target."""
    kind, *tags = symbol.split("+")
    return kind + next((f"+{t}" for t in reversed(TAGS) if t in tags), "")


def from_start(contexts: tuple[float, ...]) -> Transducer:
    """Marks by what came before, and writes one event per insult or threat with its context's weight."""
    arcs = {((), s): ((), event_of(s), contexts[EVENTS.index(event_of(s))]) if s.split("+")[0] in MARKED else ((), "", 0.0) for s in SYMBOLS}
    marks = _mark("target", "target", _within).compose(_mark("negation", "negated", _within)).compose(_mark("report", "reported", _ever))
    return marks.compose(Transducer((), arcs))


def _branch(words: list[str]) -> str:
    """A regular expression with shared prefixes for the words; an entry without a star ends at a word end."""
    trie: dict = {}
    for word in words:
        node = trie
        for ch in word.rstrip("*"):
            node = node.setdefault(ch, {})
        node["*" if word.endswith("*") else "$"] = {}

    def write(node: dict) -> str:
        if "*" in node:
            return r"[^\W\d_]*"
        parts = [re.escape(ch) + write(sub) for ch, sub in sorted(node.items()) if ch != "$"]
        if "$" in node:
            parts.append(r"(?![^\W\d_])")
        return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

    return write(trie)


def _prior_lexicon() -> dict[str, float]:
    return dict.fromkeys((*INSULTS.split(), *THREATS.split()), WORD_PRIOR)


@dataclass
class Model:
    """Lexicon and weights; everything a task needs to score texts."""

    #: Weights of words, and of beginnings with a star.
    lexicon: dict[str, float] = field(default_factory=_prior_lexicon)
    contexts: tuple[float, ...] = PRIOR
    line: tuple[float, ...] = PRIOR_LINE

    def __post_init__(self) -> None:
        self._ready = False

    def _prepare(self) -> None:
        threats = set(THREATS.split())
        # Only a clause with a hit is read word by word.
        self._hit = re.compile(r"(?<![^\W\d_])" + _branch(sorted(self.lexicon))) if self.lexicon else None
        self._class = {w: c for c, words in (("report", REPORTS), ("negation", NEGATIONS), ("target", TARGETS)) for w in words.split()}
        self._class |= {w: "threat" for w in threats & self.lexicon.keys()}
        self._lengths = sorted({len(s) - 1 for s in self.lexicon if s.endswith("*")}, reverse=True)
        self._back, self._forth = from_end(), from_start(self.contexts)
        self._ready = True

    def stem(self, word: str) -> str | None:
        """The lexicon's entry for a lower-cased word: itself, or its longest beginning."""
        word = word.split("'")[0]
        if word in self.lexicon:
            return word
        return next((word[:n] + "*" for n in self._lengths if word[:n] + "*" in self.lexicon), None)

    def read(self, clause: str) -> tuple[list[str], list[float]]:
        """What the lexical transducer writes for the words of a lower-cased clause."""
        kinds, weights = [], []
        for word in WORD.findall(clause):
            kind, stem = self._class.get(word), None
            if kind in (None, "threat"):
                stem = self.stem(word)
                kind = kind or ("insult" if stem else "other")
            kinds.append(kind)
            weights.append(self.lexicon[stem] if stem else 0.0)
        return kinds, weights

    def clauses(self, text: str | None) -> Iterator[str]:
        """The lower-cased clauses that hold a hit."""
        if not self._ready:
            self._prepare()
        if not text or self._hit is None:
            return
        low, done = text.lower(), 0
        for hit in self._hit.finditer(low):
            if hit.start() < done:
                continue
            start = done
            for end in CLAUSE_END.finditer(low, done):
                if end.start() >= hit.start():
                    break
                start = end.end()
            stop = CLAUSE_END.search(low, hit.start())
            done = stop.end() if stop else len(low)
            yield low[start:done]

    def events(self, clause: str) -> list[tuple[str, float]]:
        """Events of a clause with their path weights."""
        kinds, weights = self.read(clause)
        kinds, weights = self._back.run(kinds[::-1], weights[::-1])
        return [(e, w) for e, w in zip(*self._forth.run(kinds[::-1], weights[::-1]), strict=True) if e]

    def sums(self, text: str | None) -> tuple[list[float], list[int]]:
        """By kind of event, the path weights' sum and the number of events."""
        weights, counts = [0.0] * len(EVENTS), [0] * len(EVENTS)
        for clause in self.clauses(text):
            for event, weight in self.events(clause):
                k = EVENTS.index(event)
                weights[k] += weight
                counts[k] += 1
        return weights, counts

    def score(self, text: str | None) -> float:
        total = sum(max(0.0, w) for w in self.sums(text)[0])
        return float(_logistic(np.array(self.line), np.array([total]), np.array([n_words(text)]))[0])


def n_words(text: str | None) -> int:
    return len(text.split()) if text else 0


def _logistic(line: np.ndarray, total: np.ndarray, words: np.ndarray) -> np.ndarray:
    z = line[0] + line[1] * np.log1p(total) + line[2] * np.log1p(total / (1 + words / 100))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fold(doc_id) -> int:
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % 3


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, toxic, text) of at most `rows` labelled documents of the training folds; of a doc_id's texts the one of the least hash."""
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
        .groupBy("doc_id").agg(F.max("toxic").cast("bigint").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    known = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # of `rows` rows at most
    return known.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")).select("doc_id", "toxic", "least.text")


def _sketches(batches):
    """Eight min-hashes of each text's four-word windows; near copies share most of them."""
    seeds = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64))[:, None]
    for batch in pieces(batches):
        keys = []
        for text in column(batch, "text"):
            codes = word_hashes(text)
            shingles = windows(codes, min(4, max(1, len(codes))))
            keys.append((mix(shingles[None, :] ^ seeds).min(axis=1) >> np.uint64(1)).astype(np.int64).tolist() if len(shingles) else [])
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("toxic")), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "toxic", "keys"])


def one_of_each(sketches: list[tuple[int, list[int]]]) -> list[int]:
    """Sampled rows without near copies: in order of doc_id, those that share `SAME` min-hashes or more with none taken before."""
    ids: list[int] = []
    taken = np.zeros((len(sketches), SKETCHES), np.int64)
    held = 0
    for i, keys in sorted(sketches, key=lambda x: x[0]):
        if keys:
            if ((taken[:held] == np.array(keys, np.int64)).sum(axis=1) >= SAME).any():
                continue
            taken[held] = keys
            held += 1
        ids.append(i)
    return ids


def one_of_each_label(sketches: list[tuple[int, int, list[int]]]) -> list[int]:
    """The same of (doc_id, toxic, min-hashes), where rows of different labels are no copies."""
    return sorted(i for label in (False, True) for i in one_of_each([(i, keys) for i, toxic, keys in sketches if (toxic > 0) == label]))


def _beginnings(batches):
    """Per batch: in how many toxic and other texts each word and word beginning stands, and in two different words."""
    for batch in by_size(batches, "text", BATCH_BYTES):
        seen: dict[str, list[int]] = {}
        for toxic, text in zip(column(batch, "toxic"), column(batch, "text"), strict=True):
            held: Counter = Counter()
            for w in set(WORD.findall((text or "").lower())):
                held[w] += 1
                for n in STEM_LENGTHS:
                    if n <= len(w):
                        held[w[:n] + "*"] += 1
            for k, times in held.items():
                row = seen.setdefault(k, [0, 0, 0, 0])
                row[int(toxic > 0)] += 1
                row[2 + int(toxic > 0)] += times > 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([v[i] for v in seen.values()], pa.int64()) for i in (1, 0, 3, 2))], ["stem", "toxic", "clean", "toxic2", "clean2"])


def _g(toxic: F.Column, clean: F.Column, all_toxic: int, all_clean: int) -> F.Column:
    """The G statistic of a stem against the labels."""
    n = all_toxic + all_clean
    cells = ((toxic, all_toxic, toxic + clean), (clean, all_clean, toxic + clean), (all_toxic - toxic, all_toxic, n - toxic - clean), (all_clean - clean, all_clean, n - toxic - clean))
    return 2 * sum((F.when(seen > 0, seen * F.log(seen * n / (side * held))).otherwise(0.0) for seen, side, held in cells), F.lit(0.0))


def induce_stems(sample: DataFrame) -> list[str]:
    """Words and beginnings (starred) that mark toxic texts, the surest first; of equal ones the longest. One that another
    covers is left out, and one that covers others needs `STEM_SUPPORT` more toxic texts than each of them."""
    sides = {r["t"]: r["n"] for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("t")).agg(F.count("*").alias("n")).collect()}
    counted = sample.mapInArrow(_beginnings, "stem string, toxic bigint, clean bigint, toxic2 bigint, clean2 bigint").groupBy("stem").agg(*(F.sum(c).alias(c) for c in ("toxic", "clean", "toxic2", "clean2")))

    def sure(toxic: str, clean: str) -> F.Column:
        t, c = F.col(toxic), F.col(clean)
        g = _g(t, c, sides.get(1, 0), sides.get(0, 0))
        return F.when((t >= STEM_SUPPORT) & (t >= STEM_PURITY * (t + c)) & (g >= STEM_G), F.struct(g.alias("g"), t.alias("n")))

    # As many rows at most as the sample, which is bounded, has words and beginnings.
    rows = counted.select("stem", F.greatest(sure("toxic", "clean"), sure("toxic2", "clean2")).alias("best")).where("best IS NOT NULL").collect()
    stems: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: (-round(r["best"]["g"], 6), -len(r["stem"].rstrip("*")), r["stem"])):
        stem, n = r["stem"], r["best"]["n"]
        word = stem.rstrip("*")
        if any(word[:k] + "*" in stems for k in range(1, len(word) + 1)):
            continue
        if stem.endswith("*") and any(s.startswith(word) and n < m + STEM_SUPPORT for s, m in stems.items()):
            continue
        stems[stem] = n
    return list(stems)


def _occurrences(shared):
    """Per batch: how often each entry of the lexicon stands in toxic and in other texts; `''` counts all words."""

    def run(batches):
        model = shared.value
        model._prepare()
        for batch in pieces(batches):
            seen: dict[str, list[int]] = {}
            for toxic, text in zip(column(batch, "toxic"), column(batch, "text"), strict=True):
                found = Counter(s for clause in model.clauses(text) for w in WORD.findall(clause) if (s := model.stem(w)))
                found[""] = n_words(text)
                for k, times in found.items():
                    seen.setdefault(k, [0, 0])[int(toxic > 0)] += times
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([v[i] for v in seen.values()], pa.int64()) for i in (1, 0))], ["stem", "toxic", "clean"])

    return run


def word_weight(toxic: int, clean: int, all_toxic: int, all_clean: int, prior: float) -> float:
    """The logarithm of the ratio of a word's rates, drawn towards the prior."""
    seen = toxic + clean
    ratio = math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))
    return min(MOST_WORD, (seen * ratio + WORD_PRIOR_COUNT * prior) / (seen + WORD_PRIOR_COUNT))


def weigh(sample: DataFrame, stems: list[str]) -> dict[str, float]:
    """The lexicon: seeds and stems with their weights, without those that speak against toxicity."""
    lexicon = dict.fromkeys(stems, 0.0) | _prior_lexicon()
    shared = sample.sparkSession.sparkContext.broadcast(Model(lexicon))
    rows = sample.mapInArrow(_occurrences(shared), "stem string, toxic bigint, clean bigint").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()
    seen = {r["stem"]: (r["toxic"], r["clean"]) for r in rows}
    weights = {s: word_weight(*seen.get(s, (0, 0)), *seen.get("", (0, 0)), prior) for s, prior in lexicon.items()}
    return {s: w for s, w in sorted(weights.items()) if w > 0}


def fit_weights(weights: np.ndarray, counts: np.ndarray, words: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """(contexts, line) of least logistic loss with a ridge around the priors, by a quasi-Newton search.

    Rows are texts, with lexical weights and numbers of events by kind, and numbers of words.
    """
    prior = np.array([*PRIOR, *PRIOR_LINE])
    ridge = np.array([*[RIDGE_CONTEXT] * len(PRIOR), *RIDGE_LINE])
    k, hundreds = len(PRIOR), 1 + words / 100

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        by_kind = weights + counts * w[:k]
        total = np.maximum(by_kind, 0).sum(axis=1)
        p = _logistic(w[k:], total, words)
        slope = (w[k + 1] / (1 + total) + w[k + 2] / (hundreds + total)) * (p - y)
        parts = [(slope[:, None] * counts * (by_kind > 0)).sum(axis=0), [(p - y).sum(), ((p - y) * np.log1p(total)).sum(), ((p - y) * np.log1p(total / hundreds)).sum()]]
        value = -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum() + (ridge * (w - prior) ** 2).sum() / 2
        return value, np.concatenate(parts) + ridge * (w - prior)

    w, inverse = prior.copy(), np.eye(len(prior)) / (1 + len(y) / 10)
    value, slope = loss(w)
    for _ in range(rounds):
        step = -inverse @ slope
        size = 1.0
        while size > 1e-6 and (new := loss(w + size * step))[0] > value + 1e-4 * size * (slope @ step):
            size /= 2
        if size <= 1e-6:
            break
        moved, turned = size * step, new[1] - slope
        w, value, slope = w + moved, *new
        along = moved @ turned
        if along > 1e-12:
            side = np.eye(len(w)) - np.outer(moved, turned) / along
            inverse = side @ inverse @ side.T + np.outer(moved, moved) / along
        if np.abs(moved).max() < 1e-8:
            break
    return tuple(float(v) for v in w[:k]), tuple(float(v) for v in w[k:])


def _features(shared):
    """Lexical weights and counts by kind of event: the contexts of the shared model weigh nothing."""

    def run(batches):
        model = shared.value
        for batch in pieces(batches):
            rows = [[*weights, *counts, n_words(t)] for t in column(batch, "text") for weights, counts in (model.sums(t),)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)).cast(pa.int64()) for n in ("doc_id", "toxic")), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    return run


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model learnt from labelled rows outside the held-out fold."""
    scratch = Scratch(spark, "toxicity")
    labelled = scratch.put(training_rows(docs, labels, rows), "labelled")
    sketches = [(r["doc_id"], r["toxic"], r["keys"]) for r in labelled.mapInArrow(_sketches, "doc_id bigint, toxic bigint, keys array<bigint>").collect()]  # of `rows` rows at most
    ids = spark.createDataFrame([(i,) for i in one_of_each_label(sketches)], "doc_id bigint")
    sample = scratch.put(labelled.join(F.broadcast(ids), "doc_id"), "sample")
    model = Model(weigh(sample, induce_stems(sample)))
    plain = spark.sparkContext.broadcast(Model(model.lexicon, (0.0,) * len(EVENTS)))
    got = sorted(sample.mapInArrow(_features(plain), "doc_id bigint, toxic bigint, x array<double>").collect(), key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in got], float).reshape(len(got), 2 * len(EVENTS) + 1)
    k = len(EVENTS)
    model.contexts, model.line = fit_weights(x[:, :k], x[:, k : 2 * k], x[:, -1], np.array([float(r["toxic"] > 0) for r in got]))
    scratch.drop(labelled, sample)
    return model


def _scorer(shared):
    def run(batches):
        model = shared.value
        for batch in pieces(batches):
            ids = column(batch, "doc_id")
            scores = [model.score(t) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([fold(i) == 1 for i in ids], pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return run


def score(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, in one map-side pass."""
    return docs.select("doc_id", "text").mapInArrow(_scorer(spark.sparkContext.broadcast(model)), "doc_id bigint, held_out boolean, score double, predicted int")


def _keeper(shared):
    def run(batches):
        model = shared.value
        for batch in pieces(batches):
            yield batch.filter(pa.array([model.score(t) < THRESHOLD for t in column(batch, "text")], pa.bool_()))

    return run


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents scored below the threshold, all columns kept."""
    return docs.mapInArrow(_keeper(spark.sparkContext.broadcast(fit(spark, docs, labels))), docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores for the whole table, learnt from the label table's training folds."""
    docs = table(spark, sf_dir, "documents")
    return score(spark, docs, fit(spark, docs, table(spark, sf_dir, "labels")))
