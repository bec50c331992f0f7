"""SentencePiece encoding and decoding by a shared-prefix forward pass (operator 9).

A text gets a leading mark, its spaces become marks, and it is cut into marked
words (marks, then other characters) and line ends, between which no piece can
reach. The distinct words of a batch are sorted, which lays them out as the
depth-first walk of their trie: of each word only the part beyond the prefix it
shares with the word before is computed, on top of the forward states kept for
that prefix.

The forward state of a prefix is its best last piece. In a unigram model that is
Viterbi's: the piece that maximises the score of the prefix. The public model at
hand is a BPE model, whose scores are merge ranks; the largest sum of ranks is
not what its merges give, so there the state is the one piece compatible with
the merges: pieces a, b may stand side by side only if merging the text of both
gives just a, b, and a prefix has exactly one sequence of which all neighbours
are so. The results equal the SentencePiece library's.

Characters outside the vocabulary become byte pieces. A mark character (U+2581)
in a text becomes bytes too, so that decoding gives back every text exactly;
this is the one place where the ids differ from the library's.

Cases: a null text gives null ids, an empty one no ids; a null doc_id keeps its
row; repeated rows are encoded alike; very long words cost one state per
character; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import by_size, column, int_lists, pieces
from weftgraph.sources.tables import table

#: Where the public tokenizer files lie; any other model file can be named instead.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# Kinds of pieces and of models in the public model format.
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
UNIGRAM, BPE = 1, 2
#: Stands for no piece: the start of a word, or a character outside the vocabulary.
NOTHING = 1 << 31
#: Pairs of pieces of which a task remembers whether they can be neighbours.
MOST_PAIRS = 500_000
#: Steps of the automaton that are kept beside those of its trie.
MOST_SHORTCUTS = 200_000
#: Words after which a task begins to forget those not used since.
REMEMBERED = 100_000
#: Text encoded together: the more, the more prefixes are shared. A longer text is a batch of its own.
BATCH_CHARS = 3_000_000


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        elif kind == 2:
            size = varint()
            yield number, raw[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield number, struct.unpack("<f" if size == 4 else "<d", raw[at : at + size])[0]
            at += size


@dataclass
class Memory:
    """Ids of words that earlier batches had: those used of late, and those of the time before."""

    known: dict[str, bytes] = field(default_factory=dict)
    before: dict[str, bytes] = field(default_factory=dict)

    def turn(self) -> None:
        """Forgets what was used in neither time."""
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}


@dataclass
class Vocabulary:
    """Pieces, scores and kind of a model, with the tables of the forward pass."""

    texts: list[str]
    scores: list[float]
    kinds: list[int]
    model: int = BPE
    known: dict[str, int] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str = MODEL_FILE) -> Vocabulary:
        return cls.parse(Path(path).read_bytes())

    @classmethod
    def parse(cls, raw: bytes) -> Vocabulary:
        texts, scores, kinds, model = [], [], [], UNIGRAM
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                texts.append(piece.get(1, b"").decode())
                scores.append(piece.get(2, 0.0))
                kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                model = dict(_fields(value)).get(3, UNIGRAM)
        return cls(texts, scores, kinds, model)

    def __post_init__(self) -> None:
        self.known = {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k in (NORMAL, USER)}
        self._bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds, strict=True)) if k == BYTE}
        self._unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self._shortcuts: set[tuple[int, str]] = set()
        self._automaton()
        self._beside: dict[int, bool] = {}
        self._halves: dict[str, tuple[str, str] | None] = {}
        ranks: dict[float, list[str]] = {}
        for t, i in self.known.items():
            ranks.setdefault(self.scores[i], []).append(t)
        #: Pieces that share their score with others, such as runs of marks: their merges are replayed.
        self._tied = {t for same in ranks.values() if len(same) > 1 for t in same}
        self._longest = max(map(len, self.known), default=1)
        self._lowest = min((self.scores[i] for i in self.known.values()), default=0.0) - 10
        self._raw = [bytes((int(t[3:5], 16),)) if k == BYTE else t.replace(MARK, " ").encode() for t, k in zip(self.texts, self.kinds, strict=True)]
        self._line = "\n" if not any("\n" in t for t in self.known) else ""
        stop = f"{MARK}{self._line}"
        self._word = re.compile(f"{MARK}*[^{stop}]+|{MARK}+" + (f"|{self._line}" if self._line else ""))

    def _automaton(self) -> None:
        """States that know which pieces of two characters or more end at a character, longest first."""
        self._next: list[dict[str, int]] = [{}]
        self._ends: list[tuple[tuple[int, int], ...]] = [()]
        self._back = [0]
        for text, at in self.known.items():
            node = 0
            for ch in text:
                if ch not in self._next[node]:
                    self._next[node][ch] = len(self._next)
                    self._next.append({})
                    self._ends.append(())
                    self._back.append(0)
                node = self._next[node][ch]
            if len(text) > 1:
                self._ends[node] = ((len(text), at),)
        level = list(self._next[0].values())
        while level:  # shorter ends come from the state of the longest proper suffix
            deeper = []
            for node in level:
                self._ends[node] += self._ends[self._back[node]]
                for ch, child in self._next[node].items():
                    self._back[child] = self._step(self._back[node], ch)
                    deeper.append(child)
            level = deeper

    def _step(self, node: int, ch: str) -> int:
        """The state after one more character; what is found on the way back is kept."""
        got = self._next[node].get(ch)
        while got is None and node:
            node = self._back[node]
            got = self._next[node].get(ch)
        return got or 0

    # BPE: merges and compatible neighbours

    def merge(self, text: str) -> list[str]:
        """Merges neighbours, best score first, leftmost among equals, until none is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                at = self.known.get(parts[i] + parts[i + 1])
                if at is not None and (best is None or self.scores[at] > best[0]):
                    best = (self.scores[at], i)
            if best is None:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _parts(self, piece: str) -> tuple[str, str] | None:
        """The two pieces of a piece's last merge; None if merging its characters doesn't give it."""
        if piece not in self._halves:
            whole, parts = self.known.get(piece), list(piece)
            found = None
            if whole is not None:
                for cut in range(1, len(piece)):
                    if self.merge(piece[:cut]) == [piece[:cut]] and self.merge(piece[cut:]) == [piece[cut:]] and self.merge(piece) == [piece]:
                        # Two halves stood side by side before the last merge only if nothing else joined them.
                        if self._apart(piece[:cut], piece[cut:], self._rank(piece)):
                            found = (piece[:cut], piece[cut:])
                            break
            self._halves[piece] = found if len(parts) > 1 else None
        return self._halves[piece]

    def _rank(self, piece: str) -> float:
        return -self.scores[self.known[piece]]

    def _apart(self, a: str, b: str, before: float) -> bool:
        """Whether a and b stay two pieces while merges of rank below `before` are done.

        The merges that made both sides are undone, latest first; at each stage
        the pieces that meet at the border must not have had a merge of their own
        that came before the one undone last.
        """
        limit, at_limit = before, False
        while True:
            across = self.known.get(a + b)
            if across is not None:
                rank = -self.scores[across]
                if rank < limit or (at_limit and rank == limit):
                    return False
            rank_a = self._rank(a) if len(a) > 1 else None
            rank_b = self._rank(b) if len(b) > 1 else None
            if rank_a is None and rank_b is None:
                return True
            if rank_b is None or (rank_a is not None and rank_a > rank_b):
                halves = self._parts(a)
                if halves is None:
                    return False
                limit, at_limit, a = rank_a, False, halves[1]  # among equals the left one goes first
            else:
                halves = self._parts(b)
                if halves is None:
                    return False
                limit, at_limit, b = rank_b, True, halves[0]

    def _fits(self, before: int, at: int) -> bool:
        """Whether a piece can follow another, or stand first or after an unknown character (NOTHING), in a finished encoding."""
        if len(self._beside) > MOST_PAIRS:
            self._beside.clear()
        b = self.texts[at]
        if before == NOTHING:
            got = self.merge(b) == [b]
        else:
            a = self.texts[before]
            got = self.merge(a + b) == [a, b] if a in self._tied or b in self._tied else self._apart(a, b, np.inf)
        self._beside[before << 32 | at] = got
        return got

    def _extend_bpe(self, word: str, last: list[int], sizes: list[int], nodes: list[int], start: int) -> None:
        """Appends, for each prefix longer than `start`, the id and length of its encoding's last piece."""
        single, fits, after, ends = self.known.get, self._beside.get, self._next, self._ends
        node = nodes[start]
        for end in range(start + 1, len(word) + 1):
            ch = word[end - 1]
            then = after[node].get(ch)
            if then is None:
                then = self._step(node, ch)
                if len(self._shortcuts) < MOST_SHORTCUTS:
                    self._shortcuts.add((node, ch))
                    after[node][ch] = then
            node = then
            for n, at in ends[node]:
                if n <= end:
                    before = last[end - n]
                    ok = fits(before << 32 | at)
                    if ok or (ok is None and self._fits(before, at)):
                        break
            else:  # one piece always fits, so it is the character itself
                n, at = 1, single(ch, NOTHING)
            last.append(at)
            sizes.append(n)
            nodes.append(node)

    def _extend_unigram(self, word: str, last: list[int], sizes: list[int], best: list[float], start: int) -> None:
        """The same for the sequence of the best score, which `best` holds for each prefix."""
        known, scores = self.known, self.scores
        for end in range(start + 1, len(word) + 1):
            top, at, n = (best[end - 1] + self._lowest, NOTHING, 1) if word[end - 1] not in known else (-np.inf, NOTHING, 1)
            for size in range(1, min(self._longest, end) + 1):
                piece = known.get(word[end - size : end])
                if piece is not None and (score := best[end - size] + scores[piece]) > top:
                    top, at, n = score, piece, size
            last.append(at)
            sizes.append(n)
            best.append(top)

    def encode_sorted(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """The ids (as 32-bit integers) of sorted distinct words: a depth-first walk of their trie."""
        last, sizes, nodes, best = [NOTHING], [0], [0], [0.0]
        before = ""
        for word in words:
            if word.startswith(before):
                shared = len(before)
            else:
                shared = 0
                for x, y in zip(before, word):  # noqa: B905  they differ before either ends
                    if x != y:
                        break
                    shared += 1
                del last[shared + 1 :], sizes[shared + 1 :], nodes[shared + 1 :]
            if self.model == BPE:
                self._extend_bpe(word, last, sizes, nodes, shared)
            else:
                del best[shared + 1 :]
                self._extend_unigram(word, last, sizes, best, shared)
            before = word
            ids: list[int] = []
            end = len(word)
            while end:
                if last[end] != NOTHING:
                    ids.append(last[end])
                else:
                    ids.extend(self._bytes.get(b, self._unknown) for b in reversed(word[end - 1].encode("utf-8", "surrogatepass")))
                end -= sizes[end]
            ids.reverse()
            yield word, array("i", ids).tobytes()

    # whole texts

    def split(self, text: str) -> list[str]:
        """Marked words of a text; the character U+2581 stands as its own item, '' before it."""
        if not text:
            return []
        if MARK not in text:
            return self._word.findall(MARK + text.replace(" ", MARK))
        out: list[str] = []
        for k, part in enumerate(text.split(MARK)):
            if k:
                out.append("")
            marked = part.replace(" ", MARK)
            out += self._word.findall(marked if k else MARK + marked)
        return out

    def encode(self, texts: list[str | None], memory: Memory | None = None) -> list[np.ndarray | None]:
        """Ids of each text of a batch."""
        memory = memory or Memory()
        known = memory.known
        known[""] = array("i", [self._bytes.get(b, self._unknown) for b in MARK.encode()]).tobytes()
        cut = [None if t is None else self.split(t) for t in texts]
        new = set().union(*(words for words in cut if words)).difference(known)
        again = new & memory.before.keys()
        known.update((w, memory.before[w]) for w in again)
        known.update(self.encode_sorted(sorted(new - again)))
        out = [None if words is None else np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in cut]
        memory.turn()
        return out

    def decode(self, ids: np.ndarray | list[int] | None) -> str | None:
        if ids is None:
            return None
        text = b"".join(map(self._raw.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _encoder(shared):
    def run(batches):
        vocabulary, memory = shared.value, Memory()
        for batch in by_size(batches, "text", BATCH_CHARS):
            texts = column(batch, "text")
            got = vocabulary.encode(texts, memory)
            lists = int_lists([np.zeros(0, np.int32) if g is None else g for g in got])
            if any(g is None for g in got):
                lists = pa.ListArray.from_arrays(lists.offsets, lists.values, mask=pa.array([g is None for g in got]))
            same = [vocabulary.decode(g) == t for g, t in zip(got, texts, strict=True)]
            sizes = [None if g is None else len(g) for g in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(sizes, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_pieces", "round_trip"])

    return run


def encode_documents(docs: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """doc_id, ids, n_pieces, and whether the decoded ids equal the text, of each row; one map-side pass.

    The driver reads the model file; tasks get it by broadcast (its size is the vocabulary's).
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model_file))
    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return given.mapInArrow(_encoder(shared), "doc_id bigint, ids array<int>, n_pieces bigint, round_trip boolean")


def _decoder(shared):
    def run(batches):
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared.value.decode(i) for i in column(batch, "ids")], pa.string())], ["doc_id", "text"])

    return run


def decode_documents(encoded: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """doc_id and text of each row of ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model_file))
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(shared), "doc_id bigint, text string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text of the table, each decoded again and compared."""
    return encode_documents(table(spark, sf_dir, "documents"))
