"""Trained operators against plain versions of their arithmetic and held-out labels."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterloom.llm import language_id, license_scan, quality, registry, toxicity

SMALL = "/root/testdata/sf0.01"


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    labels = np.array(labels, dtype=bool)
    return (ranks[labels].sum() - labels.sum() * (labels.sum() + 1) / 2) / (labels.sum() * (~labels).sum())


def labelled(spark, found, name):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    return found.where("held_out").join(labels, "doc_id").where(F.col(name).isNotNull())


def test_quality_on_held_out_rows(spark):
    rows = labelled(spark, registry.op10_quality(spark, SMALL), "quality").collect()
    assert auc([r.score for r in rows], [r.quality for r in rows]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", F.col("toxic").alias("marked"))
    rows = registry.op4_toxicity(spark, SMALL).where("held_out").join(labels, "doc_id").where("marked IS NOT NULL").collect()
    assert auc([r.severity for r in rows], [r.marked for r in rows]) > 0.85


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang", "text")
    rows = registry.op7_language_id(spark, SMALL).where("held_out").join(docs, "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    rows = registry.op7_language_id(spark, SMALL).join(docs, "doc_id").collect()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in rows)


def test_normal_equations_are_the_whole_ones(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(300, len(quality.STATISTICS))), rng.integers(0, 2, 300)
    stats = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], "doc_id bigint, " + ", ".join(f"{n} double" for n in quality.STATISTICS)).repartition(5)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id bigint, label int")
    model = quality.fit(stats, labels, waves=32)
    z = model.features(x)
    plain = np.linalg.solve(z.T @ z + 0.1 * np.eye(33), z.T @ y)
    assert np.allclose(model.weights, plain, atol=1e-6)


def test_isotonic_levels_never_fall():
    rng = np.random.default_rng(1)
    at, y, n = np.sort(rng.random(50)), rng.random(50), rng.integers(1, 9, 50)
    places, levels = quality.isotonic(at, y, n)
    assert (np.diff(levels) > 0).all() and (np.diff(places) > 0).all()
    assert np.isclose(np.average(y, weights=n) * n.sum(), sum(np.interp(a, places, levels, left=levels[0]) * 0 for a in at) + (y * n).sum())


@pytest.mark.parametrize("grades", [3, 4])
def test_thresholds_keep_their_order(grades):
    rng = np.random.default_rng(2)
    rows = []
    for _ in range(400):
        x = {int(s): 1.0 for s in rng.choice(6, 2, replace=False)}
        rows.append((min(grades - 1, sum(s >= 3 for s in x) + int(rng.random() < 0.1)), x))
    weights, thresholds = toxicity.learn(rows, 6, grades)
    assert (np.diff(thresholds) > 0).all() and weights[3:].min() > weights[:3].max()


def test_far_texts_are_rejected(spark):
    rng = np.random.default_rng(3)
    text = lambda words: " ".join(rng.choice(words, 60))
    rows = [(i, text("the house and river with many trees".split()), "en") for i in range(40)] + [(100 + i, text("der baum und das wasser mit vielen".split()), "de") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(df)
    asked = spark.createDataFrame([(1, "the river and the house", None), (2, "das wasser und der baum", None), (3, "漢字 仮名 交じり", None), (4, "12 !", None), (5, None, None)], "doc_id bigint, text string, lang string")
    found = {r.doc_id: r for r in language_id.predict(asked, model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 4, 5)] == ["en", "de", "und", "und"]
    assert [found[i].rejected for i in (1, 2, 3, 4, 5)] == [False, False, True, True, True]


def test_licences_come_from_the_nearest_directory(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [(1, "a/LICENSE", mit), (2, "a/b/c/x.txt", "plain"), (3, "a/b/COPYING", f"{gpl}\nand much more is said here about nothing at all"), (4, "a/b/c/d/y.txt", "plain"), (5, "z/y.txt", "plain"), (6, "a/b/own.py", f"# {mit}\n" + "code of another kind entirely " * 30), (7, None, None)]
    found = {r.doc_id: r for r in license_scan.inherit(license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, path string, text string"))).collect()}
    assert {i: found[i].licence for i in range(1, 8)} == {1: "MIT", 2: "GPL-3.0", 3: "GPL-3.0", 4: "GPL-3.0", 5: None, 6: "MIT", 7: None}
    assert found[2].granted_by == found[4].granted_by == "a/b" and found[6].granted_by is None and not found[6].grants


def test_every_language_is_learned(spark, monkeypatch):
    """Many languages, each of its own letters; with a shuffle in place of the broadcast, too."""
    rng = random.Random(9)
    alphabet = [chr(c) for c in range(0x3B1, 0x3C9)] + [chr(c) for c in range(0x430, 0x450)] + [chr(c) for c in range(97, 123)]
    letters = {f"l{n}": rng.sample(alphabet, 4) for n in range(230)}
    rows = [(n, " ".join("".join(rng.choice(own) for _ in range(5)) for _ in range(30)), lang) for n, (lang, own) in enumerate((x for x in letters.items() for _ in range(3)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for most in (100_000, 10):
        monkeypatch.setattr(language_id, "BROADCAST_LANGUAGES", most)
        model = language_id.fit(df)
        assert set(model.languages) == set(letters)
    right = language_id.predict(df, model, carry=["doc_id", "lang"]).where("lang = lang_pred").count()
    assert right > 0.95 * len(rows)


ODD = [None, "", "12 34 !", "one", "Tie tie", "Tie tie", "é漢字 straße", "word " * 3000]


def test_severities_are_their_plain_arithmetic(spark):
    """Logits over a dense table of features, and each grade's chance from the thresholds, for every text."""
    rng, words = random.Random(4), [f"w{chr(97 + i)}{'xyz' * (i % 3)}" for i in range(20)]
    rows = [(i, " ".join(rng.choices(words[: 8 + 12 * (i % 2)], k=rng.randrange(1, 40))), i % 2) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "wa")], "doc_id bigint, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, label int"))
    assert len(model.slots) > 20 and len(model.thresholds) == 2
    texts = {i: t for i, t, _ in rows} | {1000 + i: t for i, t in enumerate(ODD)} | {None: "wa"}
    found = toxicity.severities(docs, model).collect()
    assert len(found) == len(texts)
    for r in found:
        dense = np.zeros(len(model.slots))
        for word in re.findall(r"[^\W\d_]+", (texts[r.doc_id] or "").lower()):
            for feature in [word] + [word[:n] + "~" for n in (4, 5, 6, 7) if len(word) > n]:
                if feature in model.slots:
                    dense[model.slots[feature]] += 1
        logit = float(np.log1p(dense) @ model.weights)
        one, two = (1 / (1 + math.exp(-min(30, max(-30, logit - t)))) for t in model.thresholds)
        assert abs(r.severity - (one + two)) < 1e-9 and r.toxic == (one >= 0.5)
        assert r.grade == int(np.argmax([1 - one, one - two, two]))


def test_the_nearest_centroid_is_the_nearest_of_all(spark):
    """Every text against every centroid, one by one, with n-grams counted one by one."""
    rng = random.Random(5)
    letters = {"en": "abcdefgh", "de": "fghijklmü", "el": "αβγδεζ"}
    rows = [(i, " ".join("".join(rng.choices(own, k=4)) for _ in range(rng.randrange(1, 50))), lang) for i, (lang, own) in enumerate(x for x in letters.items() for _ in range(60))]
    rows += [(1000 + i, t, None) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.fit(df)
    assert len(model.vectors) > 3
    for r, (_, text, _) in zip(sorted(language_id.predict(df, model).collect(), key=lambda r: r.doc_id), rows):
        plain = re.sub(r"(?:[\W\d_])+", " ", (text or "").lower())
        if not plain.strip():
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        counts = np.zeros(language_id.DIMENSIONS)
        for at in range(len(plain)):
            mixed = 0
            for n in range(3):
                if at + n < len(plain):
                    mixed = (mixed * 0x100000001B3 ^ (ord(plain[at + n]) + n + 1)) & (2**64 - 1)
                    counts[(mixed * 0x9E3779B97F4A7C15 & (2**64 - 1)) >> 52] += 1
        weighed = np.log1p(counts) * model.idf
        cosines = [float(v @ weighed) / math.sqrt(float(weighed @ weighed)) for v in model.vectors]
        best = max(cosines)
        near = {lang for c, lang in zip(cosines, model.languages) if c > best - 1e-12}
        assert r.lang_pred in near and abs(r.score - min(1, max(0, best))) < 1e-9
        assert r.rejected == (r.score < model.least[r.lang_pred])
