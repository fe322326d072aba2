"""Token counts by a transducer that adds numbers instead of writing tokens.

`CountTransducer` turns the token automaton of a vocabulary into one over bytes. Its state holds what
later tokens can still depend on: the longest end of the word that begins some token and, for each
place within it, the last token of the word up to there and the tokens counted up to there against
those counted now. Each transition is annotated with the tokens that its byte adds (below zero where
the byte joins tokens into one). States and transitions are made when first met.

A long text is cut anywhere into chunks of a fixed size. What a chunk does to the state before it is
kept as its map: `head`, which has to be read together with what is pending; `count`, which holds
whatever came before; `tail`, which is pending afterwards. Some boundaries of words are such in every
context, as before white space or between letters and digits, so head and tail end and begin at those.
Maps compose, and composition is associative: the chunks of a text are counted by different tasks, the
maps of neighbours are composed by others, and theirs by one for each text. A chunk without any boundary,
say of one letter throughout, is all head: of such a text one task holds the whole.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import mapped
from meterloom.llm.merge_automaton import START, merge_automaton

_STATES_KEPT = 300_000
_CHUNKS_KEPT = 800_000
_BIAS, _SHIFT = 512, 10
_SPACE = r"(?<=[^\s\x1c-\x1f])(?=[ \n])"
#: Boundaries whatever stands around them: before white space, between a letter and a digit, and
#: between an ideograph and a full-width mark.
_SAFE = re.compile(_SPACE + r"|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[\u4e00-\u9fff])(?=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])|(?<=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])(?=[\u4e00-\u9fff])")
#: Chunks whose maps are composed in one group before the groups of a text meet.
SCAN_CHUNKS = 64


class CountTransducer:
    def __init__(self, path: str):
        self.automaton = merge_automaton(path)
        self.bpe = self.automaton.bpe
        self._reset()

    def _reset(self) -> None:
        self._held: list[tuple] = []
        self._numbers: dict[tuple, int] = {}
        self._next: dict[int, int] = {}
        self._state((b"", (START,), (0,)))

    def _state(self, held: tuple) -> int:
        if (found := self._numbers.get(held)) is None:
            found = self._numbers[held] = len(self._held)
            self._held.append(held)
        return found

    def _transition(self, state: int, byte: int) -> int:
        """The next state and the annotation, in one number, as they are kept."""
        end, last, counts = self._held[state]
        end += bytes((byte,))
        for at in range(len(last)):
            token = self.bpe.ids.get(end[at:])
            if token is not None and self.automaton.has_arc(last[at], token):
                break
        else:
            raise ValueError("a byte without a token")
        added = counts[at] + 1
        last, counts = (*last, token), (*counts, added)
        keep = 0
        while keep < len(end) and end[keep:] not in self.bpe.beginnings:
            keep += 1
        after = self._state((end[keep:], last[keep:], tuple(n - added for n in counts[keep:])))
        found = self._next[state << 8 | byte] = after << _SHIFT | added + _BIAS
        return found

    def count(self, word: bytes) -> int:
        get, state, total = self._next.get, 0, 0
        for byte in word:
            if (found := get(state << 8 | byte)) is None:
                found = self._transition(state, byte)
            state = found >> _SHIFT
            total += (found & 1023) - _BIAS
        if len(self._held) > _STATES_KEPT:
            self._reset()
        return total

    def count_chunk(self, chunk: str) -> int:
        return sum(1 if isinstance(word, int) else self.count(word) for word in self.bpe.words(chunk))


class TextCounter:
    """Counts of texts and maps of chunks, with the counts of frequent pieces at hand."""

    def __init__(self, path: str):
        self.transducer = CountTransducer(path)
        self._counts: dict[str, int] = {}
        inside = any(_SAFE.search(x) for x in self.transducer.bpe.special)
        self._safe = re.compile(_SPACE) if inside else _SAFE

    def count(self, text: str) -> int:
        counts, total = self._counts, 0
        if len(counts) > _CHUNKS_KEPT:
            counts.clear()
        for piece in self.transducer.bpe.chunks(text):
            if (n := counts.get(piece)) is None:
                n = counts[piece] = self.transducer.count_chunk(piece)
            total += n
        return total

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        """head, count, tail; a chunk without a boundary is all head, and its count is None."""
        cuts = (match.start() for match in self._safe.finditer(chunk))
        first = next(cuts, None)
        if first is None:
            return chunk, None, ""
        final = first
        for final in cuts:
            pass
        return chunk[:first], self.count(chunk[first:final]), chunk[final:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of a's text followed by b's."""
        if a[1] is None:
            return (a[0] + b[0], *b[1:])
        if b[1] is None:
            return (a[0], a[1], a[2] + b[0])
        return a[0], a[1] + self.count(a[2] + b[0]) + b[1], b[2]

    def scan(self, maps: list[tuple]) -> tuple:
        """All maps composed, neighbours first."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def apply(self, map_: tuple) -> int:
        """The count that a map gives where nothing is pending before it or follows."""
        head, count, tail = map_
        return self.count(head) + (count or 0) + self.count(tail)


@functools.cache
def text_counter(path: str) -> TextCounter:
    return TextCounter(path)


def count_tokens(df: DataFrame, path: str, *, limit: int = 1024, chunk_chars: int = 65_536) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) for each row of df (doc_id, text).

    path: a byte-level BPE file of the tokenizers library. Counts are those of the whole text without
    added special tokens; special strings within the text count as one each. A null text is empty: 0
    bytes, 0 tokens. Repeated rows and ids each give a row. Texts of more than chunk_chars characters
    are counted in chunks by separate tasks; only heads and tails of chunks come together, by row.
    """
    docs = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = "doc_id bigint, n_bytes bigint, n_tokens bigint"

    def whole() -> Callable:
        counter = text_counter(path)
        return lambda texts: ([counter.count(text) for text in texts],)

    def chunked() -> Callable:
        counter = text_counter(path)
        return lambda chunks: zip(*[counter.chunk_map(chunk) for chunk in chunks])

    def scanned(rows: pd.DataFrame) -> tuple:
        rows = rows.sort_values("seq")
        return text_counter(path).scan([(h, None if pd.isna(c) else int(c), t) for h, c, t in zip(rows["head"], rows["closed"], rows["tail"])])

    def neighbours(rows: pd.DataFrame) -> pd.DataFrame:
        head, closed, tail = scanned(rows)
        found = rows.iloc[:1].assign(seq=rows["seq"].min() // SCAN_CHUNKS, head=head, closed=pd.array([closed], dtype="Int64"), tail=tail)
        return found[["doc_id", "n_bytes", "row", "seq", "head", "closed", "tail"]]

    def composed(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.iloc[:1][["doc_id", "n_bytes"]].assign(n_tokens=text_counter(path).apply(scanned(rows)))

    length, n_bytes = F.length("text"), F.octet_length("text").cast("long").alias("n_bytes")
    short = mapped(docs.where(length <= chunk_chars).select("doc_id", n_bytes, "text"), ["doc_id", "n_bytes"], ["text"], whole, "n_tokens bigint")
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((length - 1) / chunk_chars).cast("int")),
        lambda i: F.struct(i.alias("seq"), F.substring("text", i * chunk_chars + 1, F.lit(chunk_chars)).alias("chunk")),
    )
    long = (
        docs.where(length > chunk_chars)
        .select("doc_id", n_bytes, "text", F.monotonically_increasing_id().alias("row"))
        .select("doc_id", "n_bytes", "row", F.explode(pieces).alias("piece"))
        .select("doc_id", "n_bytes", "row", "piece.*")
        .repartition("row", "seq")
    )
    maps = mapped(long, ["doc_id", "n_bytes", "row", "seq"], ["chunk"], chunked, "head string, closed bigint, tail string", rows=64)
    near = maps.groupBy("row", F.floor(F.col("seq") / SCAN_CHUNKS).alias("part")).applyInPandas(neighbours, maps.schema)
    long = near.groupBy("row").applyInPandas(composed, sizes)
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)
