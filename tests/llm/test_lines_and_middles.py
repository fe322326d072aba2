"""Shared lines, texts cut for filling in, and the audit of sources, against plain versions and by their SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from meterloom.llm import fill_in_middle, line_dedup, registry, source_divergence

random.seed(11)
LONG = "This line stands in more documents than it should, word for word"
OTHER = "Ünd diese Zeile mit ÄÖÜ steht auch in mehreren Dokumenten, É"
NEAR = "z" * 40
TEXTS = [None, "", "\n", "\n\n", "one", "one\n", "a\r\nb\r\n", "<P> inside", "a <S", "> b\nc", "tail <M>", "é漢字\nß\n\nlast 🎈", "x" * 70_000, "row\n" * 30_000]
TEXTS += [f"own {i}\n{LONG}\n  {LONG.upper()}\t\n{OTHER}\r\nend {i}" for i in range(6)]
TEXTS += [f"{OTHER.swapcase()}\n{OTHER}", NEAR[:39], NEAR, NEAR, NEAR + "\n" + NEAR, f"\v{NEAR}\f\n{NEAR.upper()}", f"{NEAR}x", NEAR]
ROWS = [(None if i == 4 else i, t, None if i % 5 == 0 else "en" if i % 2 else "de", None if i % 3 == 0 else f"s{i % 4}") for i, t in enumerate(TEXTS)]
ROWS += [(900, LONG, "fr", "s1"), (900, LONG, "fr", "s1"), (None, LONG, "fr", "s1")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain_lines(rows, least_chars=40, least_documents=5):
    key = lambda line: lower(line.strip(" \t\n\v\f\r"))
    held = defaultdict(set)
    for i, (doc, text, *_) in enumerate(rows):
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                held[key(line)].add(i)
    last = {k: max((rows[i][0] for i in places if rows[i][0] is not None), default=None) for k, places in held.items() if len(places) >= least_documents}
    found = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if key(x) not in last or last[key(x)] == doc]
        found.append((doc, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return found


def told(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("heavy", [1, 3, 100_000])
def test_shared_lines(docs, monkeypatch, heavy):
    monkeypatch.setattr(line_dedup, "HEAVY_KEYS", heavy)  # 1: all by shuffle, 3: both ways, many: all by broadcast
    found = told(line_dedup.drop_shared_lines(docs).collect())
    assert found == told(plain_lines(ROWS))
    assert sum(r[2] for r in found) > 10
    assert told(line_dedup.drop_shared_lines(docs, least_chars=3, least_documents=2).collect()) == told(plain_lines(ROWS, 3, 2))


def test_lines_of_an_empty_table(docs):
    assert line_dedup.drop_shared_lines(docs.where("false")).count() == 0


def test_a_line_that_only_rows_without_id_hold_stays(spark):
    rows = [(None, NEAR)] * 5
    found = line_dedup.drop_shared_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [r.kept for r in found] == [NEAR] * 5


SPLIT = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t\n\v\f\r]*[ \t\n\v\f\r]+|[^ \t\n\v\f\r]+", "char": r"(?s:.)"}


def plain_middle(doc, text, unit, rate=100, spm_rate=50):
    text, digest = text or "", hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    units = re.findall(SPLIT[unit], text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc, n, "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return doc, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("unit", ["line", "word", "char"])
def test_middles(docs, unit):
    found = fill_in_middle.fill_in_middle(docs, unit=unit)
    assert told(found.collect()) == told(plain_middle(doc, text, unit) for doc, text, *_ in ROWS)
    back = found.select("doc_id", fill_in_middle.restored().alias("text")).collect()
    assert told(back) == told((doc, text or "") for doc, text, *_ in ROWS)
    assert {r.form for r in found.collect()} == {"plain", "psm", "spm"}


def test_rates_and_an_empty_table(docs):
    found = fill_in_middle.fill_in_middle(docs, rate=50, spm_rate=20)
    assert told(found.collect()) == told(plain_middle(doc, text, "line", 50, 20) for doc, text, *_ in ROWS)
    assert fill_in_middle.fill_in_middle(docs.where("false")).count() == 0


def test_the_kernel_takes_slices_of_a_batch():
    texts = pa.array(["skipped\n", *[t for _, t, *_ in ROWS]])[1:]
    assert texts.offset == 1
    whole = list(fill_in_middle._slices(texts, 100))
    assert [a for a, _ in whole] == [0, *[b for _, b in whole[:-1]]] and whole[-1][1] == len(texts) and len(whole) > 5
    draws = np.array([[int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[i : i + 8], 16) for d, *_ in ROWS] for i in (0, 8, 16, 24)])
    marks, units = (b"<P>", b"<S>", b"<M>"), fill_in_middle.UNITS["line"]
    found = []
    for a, b in whole:
        found += zip(*(x.to_pylist() for x in fill_in_middle._transformed(texts[a:b], draws[:, a:b], units, 100, 50, marks)))
    assert [tuple(r) for r in found] == [plain_middle(d, t, "line")[1:] for d, t, *_ in ROWS]


def plain_audit(rows, least, smooth, shown):
    counts, documents, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(terms)
        documents[lang or ""].update(set(terms))
    found = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in documents[lang].items() if n >= least)
        own = {s: {t: counts[g, s][t] for t in kept} for g, s in groups if g == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + smooth) // (sum(c.values()) + smooth * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in own.items()}, share(whole)
        for s in own:
            parts = {"pair": [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in own if o != s], "term": [(t, p[s][t] - q[t]) for t in kept if own[s][t] and p[s][t] > q[t]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                found += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(items, 1) if part == "pair" or i <= shown]
    return found


@pytest.fixture(scope="module")
def corpus(spark):
    words = [f"w{chr(97 + i)}{'é' * (i % 3)}" for i in range(26)] + ["Über", "X"]
    rows = [(i, " ".join(random.choices(words, weights=[1 / (k + 1 + i % 5) for k in range(28)], k=random.randrange(60))), random.choice(["en", "de", None]), random.choice([None, "", "a", "b", "B", "é", "z"])) for i in range(400)]
    rows += [(1, "...", "nothing", "a"), (2, None, "nothing", "b"), (3, "x " * 5000, "en", "alone"), (3, "x " * 5000, "en", "alone"), (4, "rare", "tiny", "only")]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


@pytest.mark.parametrize("least", [1, 30, 10_000])
def test_audit(corpus, least):
    rows, df = corpus
    assert told(source_divergence.audit(df, least_documents=least, terms_shown=4).collect()) == told(plain_audit(rows, least, 5, 4))


def test_blocks_and_both_tallies(corpus, monkeypatch):
    rows, df = corpus
    monkeypatch.setattr(source_divergence, "BLOCK_CELLS", 10)
    monkeypatch.setattr(source_divergence, "SMALL_ROWS", 0)
    assert told(source_divergence.audit(df, least_documents=2).collect()) == told(plain_audit(rows, 2, 5, 50))
    cells = pa.table({"lang": ["l"] * 60, "source": [f"s{i % 7}" for i in range(60)], "term": [f"t{i // 7}" for i in range(60)], "n": [1 + i * i % 11 for i in range(60)]})
    dense = source_divergence._tallied(cells).to_pylist()
    monkeypatch.setattr(source_divergence, "DENSE", 0)
    assert source_divergence._tallied(cells).to_pylist() == dense and sum(r["times"] for r in dense) == 8 * 21 + 6


def test_shares_of_very_large_counts(spark):
    big = 9 * 10**14
    df = spark.createDataFrame([(big, 4 * big, 1000)], "n bigint, total bigint, terms bigint")
    assert df.select(source_divergence._share("n", "total", "terms", 5)).first()[0] == 1 + 10**9 * (big + 5) // (4 * big + 5000)


def test_terms_of_pieces(monkeypatch):
    monkeypatch.setattr(source_divergence, "PIECE", 7)
    text = "Aé bb  cccccccccccccccc\x85d-e1F" * 20
    assert [t.decode() for piece in source_divergence.term_lists(text.encode()) for t in piece] == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def test_audit_of_an_empty_table(corpus):
    assert source_divergence.audit(corpus[1].where("false")).count() == 0


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_line_dedup", "op13_fill_in_middle"])
def test_queries_give_the_rows_of_their_sql(spark, docs, corpus, tmp_path, name):
    table = corpus[1] if name.startswith("op11") else docs
    table.withColumnsRenamed({}).write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = sorted(df.columns)
    assert told(df.select(*columns).collect()) == told(con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall())
