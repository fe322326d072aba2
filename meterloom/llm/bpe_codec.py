"""BPE encoding and decoding of documents with the merge automaton."""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.llm.common import mapped
from meterloom.llm.merge_automaton import merge_automaton

_CHUNKS_KEPT = 800_000


class Codec:
    """Ids of whole texts as little-endian unsigned 32-bit numbers, and the text that ids spell."""

    def __init__(self, path: str):
        self.automaton = merge_automaton(path)
        self._ids: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        ids, found = self._ids, []
        if len(ids) > _CHUNKS_KEPT:
            ids.clear()
        for chunk in self.automaton.bpe.chunks(text):
            if (own := ids.get(chunk)) is None:
                own = ids[chunk] = _packed(self.automaton.encode_chunk(chunk))
            found.append(own)
        return b"".join(found)

    def decode(self, packed: bytes) -> str:
        return self.automaton.decode(_unpacked(packed)).decode("utf-8", "replace")


def _packed(ids: list[int]) -> bytes:
    return b"".join([i.to_bytes(4, "little") for i in ids])


def _unpacked(packed: bytes) -> array:
    found = array("I")
    found.frombytes(packed)
    return found


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(df: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit) of each row of df (doc_id, text).

    A null text is empty and has no ids. No special tokens are added; special strings in a text
    become their own id. Repeated rows each give a row."""

    def start() -> Callable:
        own = codec(path)
        return lambda texts: ([own.encode(text) for text in texts],)

    return mapped(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["doc_id"], ["text"], start, "ids binary")


def decode_documents(df: DataFrame, path: str) -> DataFrame:
    """doc_id and text of each row of df (doc_id, ids); null ids give an empty text."""

    def start() -> Callable:
        own = codec(path)
        return lambda packed: ([own.decode(ids or b"") for ids in packed],)

    return mapped(df, ["doc_id"], ["ids"], start, "text string")


def round_trip(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of df (doc_id, text): encoding,
    and decoding of the ids that came out, in one pass, so that ids needn't be stored."""

    def start() -> Callable:
        own = codec(path)

        def digests(text: str) -> tuple[int, str, str]:
            ids = own.encode(text)
            return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()

        return lambda texts: zip(*map(digests, texts))

    docs = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return mapped(docs, ["doc_id"], ["text"], start, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
