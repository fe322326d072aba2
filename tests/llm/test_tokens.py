"""Token counts, the codec and packing against the tokenizers library."""

import hashlib
import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from meterloom.llm import bpe_codec, packing, token_counts
from meterloom.llm.bpe_text import ByteBpe

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
random.seed(5)
ODD = [None, "", " ", "\n\n  x \t\n", "a" * 3000, "<|endoftext|>a <|endoftext|><|endoftext", "it's they'll 12²½ 漢字\U00020000 é\x85\xa0 ü \x1c\x1f!?", " ".join(["wórd"] * 700)]
ODD += ["".join(random.choice("ab  \n\tthe'sl9²é漢​\x1c\x85!A") for _ in range(random.randrange(120))) for _ in range(150)]
ODD += ["".join(chr(random.choice([random.randrange(32, 0xD7FF), random.randrange(0x10000, 0x30000)])) for _ in range(60)) for _ in range(60)]
DOCS = [(i, text, "src" if i % 3 else None, "extra") for i, text in enumerate(ODD)] + [(900, "again", "src", "x"), (900, "again", "src", "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, text string, source string, n_tokens string")


@pytest.fixture(scope="module")
def expected():
    library = Tokenizer.from_file(BYTE_BPE)
    return [e.ids for e in library.encode_batch([row[1] or "" for row in DOCS], add_special_tokens=False)]


@pytest.mark.parametrize("chunk_chars", [65_536, 13])
def test_counts_are_the_librarys(docs, expected, chunk_chars):
    found = sorted(map(tuple, token_counts.count_tokens(docs, BYTE_BPE, limit=20, chunk_chars=chunk_chars).collect()))
    assert found == sorted((row[0], len((row[1] or "").encode()), len(ids), len(ids) > 20) for row, ids in zip(DOCS, expected))


def test_maps_compose_in_any_grouping():
    counter = token_counts.text_counter(BYTE_BPE)
    library = Tokenizer.from_file(BYTE_BPE)
    for text in ["the quick  brown\nfox's den, aaaa bbbb  \n cc", "x" * 50, "a b"]:
        maps = [counter.chunk_map(text[i : i + 4]) for i in range(0, len(text), 4)]
        left = maps[0]
        for map_ in maps[1:]:
            left = counter.compose(left, map_)
        assert counter.apply(left) == counter.apply(counter.scan(maps)) == len(library.encode(text).ids)


def test_split_agrees_on_each_code_point():
    bpe, library = ByteBpe(BYTE_BPE), Tokenizer.from_file(BYTE_BPE)
    for c in [*range(0x400), *range(0x2000, 0x2100), *range(0x2EBF0, 0x2EC00)]:
        text = f"a{chr(c)}{chr(c)}1 {chr(c)}b !{chr(c)} {chr(c)}"
        assert bpe.words(text) == [text[a:b].encode() for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], hex(c)


def test_codec_round_trip(docs, expected):
    encoded = bpe_codec.encode_documents(docs, BYTE_BPE)
    assert sorted((r.doc_id, bytes(r.ids)) for r in encoded.collect()) == sorted((row[0], array("I", ids).tobytes()) for row, ids in zip(DOCS, expected))
    assert sorted(map(tuple, bpe_codec.decode_documents(encoded, BYTE_BPE).collect())) == sorted((row[0], row[1] or "") for row in DOCS)
    sha = lambda data: hashlib.sha256(data).hexdigest()
    assert sorted(map(tuple, bpe_codec.round_trip(docs, BYTE_BPE).collect())) == sorted((row[0], len(ids), sha(array("I", ids).tobytes()), sha((row[1] or "").encode())) for row, ids in zip(DOCS, expected))


def test_word_ids_are_the_librarys():
    library, own = Tokenizer.from_file(WORD_BPE), packing.word_ids(WORD_BPE, 1)
    texts = [row[1] or "" for row in DOCS] + [f"a{chr(c)}{chr(c)}1 {chr(c)}B !{chr(c)} {chr(c)} 'S{chr(c)}'LL" for c in range(0x400)] + ["<|ENDOFTEXT|> a<|startoftext|>b", "e\u0301 \u0301e İIıſ"]
    assert [own.encode(text) for text in texts] == [array("I", [*e.ids, 1]).tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


def test_settled_words_go_to_the_library_as_words(monkeypatch):
    """Without the normaliser and the split that they have been through, each once while it is kept; when
    generations change, ids stay the same."""
    monkeypatch.setattr(packing, "_PIECES_KEPT", 40)
    library, own = Tokenizer.from_file(WORD_BPE), packing.WordIds(WORD_BPE, 1)
    own.tokenizer = None
    texts = ["It's naïve, they'll see: x''t 12²½ ''s \x85é\xa0ü", "a" * 300 + " b", *[f"word{i}th naïve-{i} the {i % 7}, Ünit{i}" for i in range(60)]]
    for text in [*texts, *texts[::-1]]:
        assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]
        assert max(map(len, own._ids)) <= 64


def test_empty_tables(docs):
    none = docs.where("false")
    assert token_counts.count_tokens(none, BYTE_BPE).count() == bpe_codec.round_trip(none, BYTE_BPE).count() == packing.pack(none, WORD_BPE).count() == 0


@pytest.mark.parametrize("size, window", [(2048, 131_072), (64, 512), (16, 40)])
def test_packing_places_each_token_once(docs, size, window):
    library = Tokenizer.from_file(WORD_BPE)
    encoded = [[*e.ids, 1] for e in library.encode_batch([row[1] or "" for row in DOCS], add_special_tokens=False)]
    pieces = packing.pack(docs, WORD_BPE, size=size, window_tokens=window).collect()
    own = {row[0]: ids for row, ids in zip(DOCS, encoded)}
    reached, slots = {}, {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        ids = own[p.doc_id]
        assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(array("I", ids[p.start : p.start + p.length]).tobytes())
        reached[p.doc_id] = reached.get(p.doc_id, 0) + p.length
        slots.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert reached == {i: len(ids) * sum(row[0] == i for row in DOCS) for i, ids in own.items()}
    total = sum(map(len, encoded))
    assert sorted(slots) == list(range(-(-total // size)))
    for sequence, held in slots.items():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at == min(size, total - sequence * size)


def test_windows_hold_the_mixture():
    queues = [("a", 50_000), ("b", 30_000), ("c", 20_001)]
    mixture = packing.Mixture(queues, 100)
    for window in range(100):
        for name, tokens in queues:
            assert abs(mixture.had(name, window + 1) - mixture.had(name, window) - tokens / 100) <= 2
            assert abs(mixture.had(name, window) - window * tokens / 100) <= 1


def test_targets_hold_until_a_queue_runs_dry():
    queues, targets = [("a", 60_000), ("b", 30_000), ("c", 30_001)], {"a": 0.2, "b": 0.3, "c": 0.5}
    stream = packing.Phases(queues, 1000, targets)
    taken, spans = {name: np.zeros(120_001, dtype=int) for name, _ in queues}, []
    for name, tokens in queues:
        for place in range(0, tokens, 777):
            n, done = min(777, tokens - place), 0
            for start, length, sequence, offset in stream.pieces(name, place, n, 64):
                assert start == done and offset + length <= 64
                taken[name][sequence * 64 + offset : sequence * 64 + offset + length] += 1
                done += length
            assert done == n
    assert (sum(taken.values()) == 1).all()
    for window in range(0, 60_000, 1000):  # c runs dry after 60,002 tokens
        assert all(abs(taken[name][window : window + 1000].sum() - 1000 * targets[name]) <= 20 for name in targets)
    for window in range(61_000, 80_000, 1000):  # then a and b share by 2 to 3
        assert abs(taken["a"][window : window + 1000].sum() - 400) <= 8 and not taken["c"][window : window + 1000].any()


def test_packing_with_targets_and_odd_names(spark):
    rows = [(i, "word " * (i % 40), ["pool", "own:x", "\0pool", None][i % 4]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    natural = packing.pack(df, WORD_BPE, size=64, window_tokens=512).collect()
    asked = packing.pack(df, WORD_BPE, size=64, window_tokens=512, targets={"pool": 0.5, "own:x": 0.2, "absent": 0.1}).collect()
    for pieces in (natural, asked):
        slots = sorted((p.sequence_id * 64 + p.offset, p.length) for p in pieces)
        assert all(a + n == b for (a, n), (b, _) in zip(slots, slots[1:])) and slots[0][0] == 0
        assert sum(p.length for p in pieces) == sum(i % 40 + 1 for i in range(400))
    early = [p for p in asked if p.sequence_id < 32]
    share = sum(p.length for p in early if p.source == "pool") / sum(p.length for p in early)
    assert abs(share - 0.5 / 0.9) < 0.06


@pytest.mark.parametrize("pooled", [1, 1000, 40_000])
def test_targets_hold_beside_a_pool_that_nothing_is_left_for(pooled):
    """Ten thousand million tokens, by numbers alone."""
    each, window = 5 * 10**9, 131_072
    stream = packing.Phases([("a", each), ("b", each), ("pool", pooled)], window, {"a": 0.5, "b": 0.5, "pool": 1e-9})
    assert stream.served == {"a": each, "b": each, "pool": pooled} and stream.base == 2 * each + pooled
    rng, seen = np.random.default_rng(5), []
    for name, tokens in (("a", each), ("b", each)):
        for place in rng.integers(0, tokens - 3000, 50).tolist():
            found = list(stream.pieces(name, place, 3000, 2048))
            assert sum(n for _, n, _, _ in found) == 3000 and found[0][0] == 0
            at = found[0][2] * 2048 + found[0][3]
            # Half of what came before is its own, give or take a window and what the pool has had.
            assert abs(at - 2 * place) < 2 * window + pooled
            seen += [(sequence * 2048 + offset, n) for _, n, sequence, offset in found]
    seen.sort()
    assert all(at + n <= other for (at, n), (other, _) in zip(seen, seen[1:]) if at != other)


def test_slices_leave_no_gap():
    queues = [("a", 4000), ("b", 4001), ("c", 7), ("pool", 3)]
    stream = packing.Phases(queues, 100, {"a": 0.4, "b": 0.5, "c": 0.001, "pool": 1e-9})
    taken = []
    for name, tokens in queues:
        for place in range(0, tokens, 13):
            taken += [at for _, n, s, o in stream.pieces(name, place, min(13, tokens - place), 64) for at in range(s * 64 + o, s * 64 + o + n)]
    assert sorted(taken) == list(range(sum(n for _, n in queues)))
