"""Packing of tokenised documents into sequences whose mixture of sources is held window by window.

Each source is a queue of tokens. Deficit round-robin serves every queue in each window by its share
and carries what rounding left it owed. Documents may be cut anywhere, so a queue is never owed a whole
token after its turn, and what it has had after r windows has a closed form: for queues in a fixed
order, with P tokens in a queue and those before it, floor(r * P / R) counts what these have had
after r of R windows; a queue has had the difference to the one before it. Any task can thus place
any document once it knows where the document lies in its queue: deficits cross windows and partitions
without being handed on. Windows fill one stream without gaps, which is cut into sequences; only the
last one can be short. Where target proportions differ from the sources' own, queues run dry one after the
other, and the same holds within each phase from one such end to the next.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator, Mapping

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from meterloom.llm.bpe_text import is_settled, settled_pattern
from meterloom.llm.common import mapped, written

#: Pieces of a generation whose ids a worker keeps, some 400 bytes each, and how long they are at most: longer ones
#: are seldom met again. Of two generations the older one goes, but for what was met again.
_PIECES_KEPT, _PIECE_CHARS = 300_000, 64
#: Queue of the sources that are too small for a share in every window, or have no target of their own;
#: the other queues are named after their sources, with OWN before.
POOL, OWN = "pool", "own:"
#: Slices of a phase that has queues which are too small for its windows.
SLICES = 1000
#: Rows of the table of queue beginnings up to which it is sent to every task.
BROADCAST_ROWS = 200_000


class WordIds:
    """Ids of texts, put together from those of pieces between blanks.

    Only for tokenizers that lower-case, drop white space and treat what lies between alone. Pieces
    whose classes no Unicode version disputes are split by the tokenizer's own pattern and share the
    ids of their words, which are kept as pieces, too; words new to this worker go to the library many
    at a time, without what settled words in lower case don't need, and their ids are told apart by the
    mark of word ends."""

    def __init__(self, path: str, end: int):
        self.tokenizer = Tokenizer.from_file(path)
        held = json.loads(self.tokenizer.to_str())
        self.narrow = self.tokenizer.get_vocab_size() <= 65_536
        steps = held["pre_tokenizer"].get("pretokenizers", [])
        splits = [x["pattern"]["Regex"] for x in steps if x["type"] == "Split"]
        suffix = held["model"].get("end_of_word_suffix")
        self._split = settled_pattern(splits[0]).findall if len(splits) == 1 and suffix else None
        self._of_words = self.tokenizer
        if [x["type"] for x in steps] == ["Split", "ByteLevel"] and not (steps[1]["use_regex"] or steps[1]["add_prefix_space"]):
            self._of_words = Tokenizer(self.tokenizer.model)
            self._of_words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._is_end = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self._is_end[[i for word, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if suffix and word.endswith(suffix)]] = True
        self._special = re.compile("|".join(re.escape(x["content"][:2]) for x in held["added_tokens"]) or r"(?!)")
        self._ids, self._old = {"": b""}, {}
        self.end = end

    def _is_plain(self, text: str, low: str) -> bool:
        return self._split is not None and is_settled(low) and self._special.search(text) is None

    def _learned(self, pieces: list[str], plain: bool) -> dict[str, bytes]:
        """Ids of pieces that are not kept, and of their words."""
        found, split, new = {}, {}, {}
        for piece in pieces:
            if plain and piece.isalpha():
                new[piece] = None
            elif plain:
                split[piece] = self._split(piece)
            elif self._is_plain(piece, low := piece.lower()):
                split[piece] = self._split(low)
            else:
                found[piece] = array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        for words in split.values():
            for word in words:
                if word not in found and word not in new:
                    if (ids := self._ids.get(word) or self._old.get(word)) is None:
                        new[word] = None
                    else:
                        found[word] = ids
        new = list(new)
        for at in range(0, len(new), 200):
            words = new[at : at + 200]
            ids = np.array(self._of_words.encode(" ".join(words), add_special_tokens=False).ids, dtype=np.uint32)
            ends = (4 * (np.nonzero(self._is_end[ids])[0] + 1)).tolist()
            packed = ids.tobytes()
            if len(ends) != len(words) or ends[-1] != len(packed):
                raise ValueError("word ends can't be told apart")
            found.update(zip(words, [packed[a:b] for a, b in zip([0, *ends], ends)]))
        for piece, words in split.items():
            found[piece] = b"".join([found[word] for word in words])
        return found

    def encode(self, text: str) -> bytes:
        plain = self._is_plain(text, low := text.lower())
        pieces = (low if plain else text).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        if len(self._ids) > _PIECES_KEPT:
            self._old, self._ids = self._ids, {"": b""}
        found = list(map(self._ids.get, pieces))
        if None in found:
            places = [i for i, ids in enumerate(found) if ids is None]
            lacking = {pieces[i] for i in places}
            met = {piece: self._old[piece] for piece in lacking if piece in self._old}
            if new := list(lacking - met.keys()):
                met.update(self._learned(new, plain))
            for i in places:
                found[i] = met[pieces[i]]
            self._ids.update(met if max(map(len, met)) <= _PIECE_CHARS else {piece: ids for piece, ids in met.items() if len(piece) <= _PIECE_CHARS})
        return b"".join(found) + self.end.to_bytes(4, "little")


@functools.cache
def word_ids(path: str, end: int) -> WordIds:
    return WordIds(path, end)


def tokenised(df: DataFrame, path: str, *, end: int) -> DataFrame:
    """doc_id, source, part, start, n and ids of each row of df (doc_id, text, source): its ids with
    `end` behind them, and where they begin among the tokens of its source in its part of the table.
    A null text is empty, a null source is the empty one."""

    def start() -> Callable:
        own, part = word_ids(path, end), TaskContext.get().partitionId()
        reached: dict[str, int] = {}

        def place(text: str, source: str) -> tuple[int, int, int, bytes]:
            ids = own.encode(text)
            at = reached.get(source, 0)
            reached[source] = at + len(ids) // 4
            return part, at, len(ids) // 4, np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes() if own.narrow else ids

        return lambda texts, sources: zip(*map(place, texts, sources))

    docs = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source"))
    return mapped(docs, ["doc_id", "source"], ["text", "source"], start, "part int, start bigint, n bigint, ids binary")


class Mixture:
    """Where tokens of queues lie in the stream. queues: (name, tokens), each with at least two
    tokens a window, or a single window."""

    def __init__(self, queues: list[tuple[str, int]], windows: int):
        self.windows, self.before, self.total = windows, {}, 0
        for name, tokens in queues:
            self.before[name] = (self.total, self.total + tokens)
            self.total += tokens

    def had(self, name: str, window: int) -> int:
        """What a queue has had when a window begins."""
        low, high = self.before[name]
        return window * high // self.windows - window * low // self.windows

    def window(self, name: str, place: int) -> int:
        """The window of the token that lies at a place of a queue."""
        low, high = self.before[name]
        found = min(self.windows - 1, place * self.windows // (high - low))
        while self.had(name, found) > place:
            found -= 1
        while self.had(name, found + 1) <= place:
            found += 1
        return found

    def at(self, name: str, window: int) -> int:
        """Where in the stream a queue's turn in a window begins."""
        low, _ = self.before[name]
        return window * self.total // self.windows + (window + 1) * low // self.windows - window * low // self.windows

    def turns(self, name: str, place: int, n: int) -> Iterator[tuple[int, int]]:
        """Where in the stream each turn of n tokens from a place of a queue on lies, and its length."""
        while n:
            window = self.window(name, place)
            turn = min(n, self.had(name, window + 1) - place)
            yield self.at(name, window) + place - self.had(name, window), turn
            place, n = place + turn, n - turn


class Phases:
    """A stream of mixtures, one after the other. With natural proportions, where all queues run dry
    together, it is a single one; else a phase ends where a queue runs dry, and those that are left share
    the next one by their targets. Queues with less than two tokens for each window of a phase, say a pool that
    next to nothing is left for, don't set the number of its windows: the phase is cut into slices, and
    behind the windows of each stands such queues' part of it."""

    def __init__(self, queues: list[tuple[str, int]], window_tokens: int, targets: Mapping[str, float] | None = None):
        left = {name: tokens for name, tokens in queues if tokens}
        self.phases: list[tuple[Mixture, int, dict[str, int]]] = []
        self.window_tokens, self.served, self.base = window_tokens, dict.fromkeys(left, 0), 0
        self.turns: dict[str, tuple[list[int], list[int]]] = {name: ([], []) for name in left}
        while left:
            if targets is None:
                turn = dict(left)
            else:
                ends = min(left, key=lambda name: (left[name] / targets[name], name))
                time = left[ends] / targets[ends]
                turn = {name: tokens if name == ends else min(tokens, int(time * targets[name])) for name, tokens in left.items()}
            windows = -(-sum(turn.values()) // window_tokens)
            small = {name: n for name, n in turn.items() if n < 2 * windows}
            large = {name: n for name, n in turn.items() if name not in small}
            if targets is None or windows == 1 or not any(small.values()) or not large:
                self._serve(turn)
            else:
                slices = min(windows, SLICES)
                for i in range(slices):
                    for part in (large, small):
                        self._serve({name: (i + 1) * n // slices - i * n // slices for name, n in part.items()})
            left = {name: n - turn[name] for name, n in left.items() if n > turn[name]}

    def _serve(self, turn: dict[str, int]) -> None:
        turn = {name: n for name, n in turn.items() if n}
        if not turn:
            return
        total = sum(turn.values())
        windows = max(1, min(-(-total // self.window_tokens), min(turn.values()) // 2))
        for name in turn:
            begins, places = self.turns[name]
            begins.append(self.served[name])
            places.append(len(self.phases))
        self.phases.append((Mixture(list(turn.items()), windows), self.base, {name: self.served[name] for name in turn}))
        for name, n in turn.items():
            self.served[name] += n
        self.base += total

    def pieces(self, name: str, place: int, n: int, size: int) -> Iterator[tuple[int, int, int, int]]:
        """start, length, sequence and offset of each piece of n tokens from a place of a queue on."""
        begins, places = self.turns[name]
        done, turn_at = 0, bisect_right(begins, place) - 1
        while done < n:
            mixture, base, first = self.phases[places[turn_at]]
            turn_at += 1
            low, high = mixture.before[name]
            own = place + done - first[name]
            for at, turn in mixture.turns(name, own, min(n - done, high - low - own)):
                at += base
                while turn:
                    length = min(turn, size - at % size)
                    yield done, length, at // size, at % size
                    done, at, turn = done + length, at + length, turn - length


def _queues(sizes: list[tuple[str, int]], pooled: int, window_tokens: int) -> tuple[list[tuple[str, int]], int]:
    """Queues that can each be served in every window, the smallest joining the pool while need be."""
    total = sum(n for _, n in sizes) + pooled
    windows = max(1, -(-total // window_tokens))
    sizes = sorted(sizes, key=lambda x: (-x[1], x[0]))
    while sizes and windows > 1 and (sizes[-1][1] < 2 * windows or 0 < pooled < 2 * windows):
        pooled += sizes.pop()[1]
    return [*sizes, *([(POOL, pooled)] if pooled else [])], windows


def pack(df: DataFrame, path: str, *, size: int = 2048, window_tokens: int = 131_072, end: int = 1, targets: Mapping[str, float] | None = None) -> DataFrame:
    """A row for each piece of a document of df (doc_id, text, source): doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset, and source.

    `targets` are the proportions of sources that each window of window_tokens is to hold; sources
    without one share what is left up to 1. Where a source runs dry, those that are left share the windows
    after it by their targets. Without targets, proportions are the sources' shares of all tokens, so
    all run dry together; a source with fewer than two tokens a window is then served from a pool. Every
    row, repeated ones included, is placed once; an empty table gives no pieces. Tokens of one part of a
    queue follow those of the parts before it, parts being those in which the table was tokenised and
    written: other splits of the table give other sequences, with the same mixture."""
    if targets is not None and (min(targets.values(), default=1) <= 0 or sum(targets.values()) > 1 + 1e-9):
        raise ValueError("targets are above 0 and together at most 1")
    tokens = written(tokenised(df, path, end=end), "tokens")
    narrow = word_ids(path, end).narrow
    by_part = written(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")), "parts")
    by_source = by_part.groupBy("source").agg(F.sum("n").alias("n"))
    total = by_source.agg(F.sum("n")).first()[0] or 0
    windows = max(1, -(-total // window_tokens))
    # At most window_tokens / 2 sources have two tokens in every window, so this list is bounded.
    named = by_source.where(F.col("source").isin(list(targets))) if targets is not None else by_source.where(F.col("n") >= 2 * windows)
    large = [tuple(row) for row in named.collect()] if windows > 1 or targets is not None else []
    pooled = total - sum(n for _, n in large)
    if targets is None:
        queues, windows = _queues([(OWN + name, n) for name, n in large], pooled, window_tokens)
        shares = None
    else:
        queues = [*[(OWN + name, n) for name, n in sorted(large)], *([(POOL, pooled)] if pooled else [])]
        shares = {OWN + name: share for name, share in targets.items()} | {POOL: max(1 - sum(targets.values()), 1e-9)}
    own = [name for name, _ in queues if name != POOL]
    spark = df.sparkSession
    names = spark.createDataFrame([(name.removeprefix(OWN), name) for name in own], "source string, queue string")
    marked = by_part.join(F.broadcast(names), "source", "left").withColumn("queue", F.coalesce("queue", F.lit(POOL)))
    within = F.sum("n").over(Window.partitionBy("part", "queue").orderBy("source").rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("within", F.coalesce(within, F.lit(0)))
    parts = marked.groupBy("part", "queue").agg(F.sum("n").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", "queue", F.coalesce(earlier, F.lit(0)).alias("base"))
    begins = written(marked.join(parts, ["part", "queue"]).select("part", "source", "queue", (F.col("base") + F.col("within")).alias("base")), "queues")
    begins = F.broadcast(begins) if begins.count() <= BROADCAST_ROWS else begins
    placed = tokens.join(begins, ["part", "source"]).select("doc_id", "source", "queue", (F.col("base") + F.col("start")).alias("place"), "n", "ids")

    def start() -> Callable:
        stream = Phases(queues, window_tokens, shares)

        def cut(*columns: list) -> Iterator[tuple]:
            rows = []
            for doc_id, source, queue, place, n, ids in zip(*columns):
                ids = memoryview(ids if not narrow else np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes())
                for start, length, sequence, offset in stream.pieces(queue, place, n, size):
                    rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, sequence, offset, source))
            return zip(*rows)

        return cut

    pieces = f"doc_id {df.schema['doc_id'].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string"
    return mapped(placed, [], placed.columns, start, pieces)
