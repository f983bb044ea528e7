import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quern.llm import features, language_id, quality_classifier, toxicity
from quern.llm import words as W


def say(rng, n, syllables):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


SYLLABLES = {"en": ["th", "er", "ing", "on"], "de": ["sch", "ei", "ung", "ä"], "fr": ["eau", "ç", "oi", "é"]}


def test_network_gradient_is_that_of_its_loss(monkeypatch):
    monkeypatch.setattr(language_id, "HIDDEN", 3)
    monkeypatch.setattr(language_id, "EMBED", 2)
    net = language_id.Network(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    ids = rng.integers(97, 103, (5, 6)).astype(np.uint8)
    mask = (np.arange(6) < np.array([6, 4, 3, 6, 2])[:, None]).astype(np.float64)
    labels = np.array([0, 1, 2, 0, 1])
    _, g = net.gradient(ids, mask, labels)
    for name, p in net.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in p.shape)
            if name == "e":
                at = (rng.integers(97, 103), at[1])
            held, step = p[at], 1e-3
            p[at] = held + step
            up = net.gradient(ids, mask, labels)[0]
            p[at] = held - step
            down = net.gradient(ids, mask, labels)[0]
            p[at] = held
            assert abs((up - down) / (2 * step) - g[name][at]) < 2e-3


def test_language_id_on_held_out_texts(spark):
    rng = random.Random(1)
    rows = [(k, say(rng, rng.randint(3, 60), SYLLABLES[lang]), lang) for k in range(400) for lang in [rng.choice(list(SYLLABLES))]]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 34 !!", "de"), (1003, "thering eronth", None), (1004, say(rng, 30_000, SYLLABLES["fr"]), "fr"), (None, "schei ungung", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = features.fold(F.col("doc_id"), 3) == 1
    net = language_id.train(docs.filter(~held))
    found = {r.doc_id: r for r in language_id.predict(docs, net).collect()}
    assert len(found) == len(rows)
    out = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 1 and r[0] < 1000]
    assert sum(found[i].lang_pred == lang for i, _, lang in out) >= 0.97 * len(out)
    assert [found[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and found[1004].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in found.values())
    assert language_id.predict(docs.limit(0), net).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, language_id.train(docs.limit(0))).collect()} == {"und"}


def test_words_read_alone_or_together_score_alike():
    net = language_id.Network(["a", "b"])
    data = "thing ésch thing a-very-long-word-that-is-cut-in-pieces-as-it-is-read x".encode()
    whole = language_id.pooled(net, W.cut(np.frombuffer(data, np.uint8), np.array([0, len(data)])))[0]
    known = language_id.Known(net)
    again = [language_id.pooled(net, W.cut(np.frombuffer(data, np.uint8), np.array([0, len(data)])), known)[0] for _ in range(2)]
    assert np.allclose(whole, again[0]) and np.allclose(again[0], again[1])


def test_factorization_machine_learns_a_pair():
    rng = np.random.default_rng(2)
    lists, labels = [], []
    for _ in range(1200):
        a, b = map(bool, rng.random(2) < 0.5)
        lists.append(np.unique(np.concatenate((np.array([11] * a + [22] * b, np.int64), rng.integers(100, 4000, 5)))))
        labels.append(float(a and b))
    model = toxicity.fit(np.array(labels), lists)
    doc = np.repeat(np.arange(4), [2, 1, 1, 0])
    score = model.score(doc, np.array([11, 22, 11, 22]), 4)
    assert score[0] > 0.9 and max(score[1:]) < 0.3


def test_factorization_machine_learns_a_pair_of_neutral_terms():
    """The label is whether exactly one of two terms is there: each is as frequent in both labels."""
    rng = np.random.default_rng(5)
    lists, labels = [], []
    for _ in range(3000):
        a, b = map(bool, rng.random(2) < 0.5)
        lists.append(np.unique(np.concatenate((np.array([11] * a + [22] * b, np.int64), rng.integers(100, 400, 5)))))
        labels.append(float(a != b))
    model = toxicity.fit(np.array(labels), lists)
    score = model.score(np.repeat(np.arange(4), [2, 1, 1, 0]), np.array([11, 22, 11, 22]), 4)
    assert min(score[1], score[2]) > 0.8 and max(score[0], score[3]) < 0.2


def test_factorization_machine_learns_rare_terms():
    """An insult in eight toxic rows of a thousand, and in no others, is below the screen and still learnt."""
    rng = np.random.default_rng(6)
    lists, labels = [], []
    for k in range(4000):
        bad = k % 4 == 0
        own = [5000 + k // 32] if bad and k % 32 < 4 else [7 + k % 3] if bad else []
        own = [6000] if bad and k % 500 == 0 else own
        lists.append(np.unique(np.concatenate((np.array(own, np.int64), rng.integers(100, 1500, 8)))))
        labels.append(float(bad))
    model = toxicity.fit(np.array(labels), lists)
    score = model.score(np.array([0, 1, 2]), np.array([6000, 7, 300]), 3)
    assert score[0] > 0.5 and score[1] > 0.9 and score[2] < 0.5


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(3)
    plain = [f"p{k}" for k in range(500)]
    rows, labels = [], []
    for k in range(900):
        bad = rng.random() < 0.25
        w = [rng.choice(plain) for _ in range(rng.randint(5, 60))]
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["Scumbag!", "vilest.", "scumbags"])
        rows.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    rows += [(2000, None), (2001, ""), (None, "vilest"), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks.filter(features.fold(F.col("doc_id"), 5) != 0))
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    out = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((found[i] >= 0.5) == y for i, y in out) >= 0.97 * len(out)
    assert found[2000] < 0.5 and found[2001] == found[2000] and found[None] >= 0.5
    assert toxicity.score(docs, toxicity.train(docs, marks.limit(0))).count() == len(rows)


def test_quality_on_held_out_texts(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(800):
        good = rng.random() < 0.7
        t = say(rng, rng.randint(10, 80), SYLLABLES["en"])
        rows.append((k, t if good else " ".join(x + rng.choice(["$$$", "!!", " |"]) for x in t.upper().split()), "en", f"s{k % 7}", len(t)))
        if k % 2:
            labels.append((k, int(good)))
    rows += [(2000, None, None, None, None), (2001, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality_classifier.train(docs, marks.filter(features.fold(F.col("doc_id"), 5) != 0))
    found = {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    out = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(found) == len(rows) and sum((found[i] >= 0.5) == y for i, y in out) >= 0.95 * len(out)
    assert quality_classifier.score(docs, quality_classifier.train(docs, marks.limit(0))).count() == len(rows)
    assert quality_classifier.score(docs.limit(0), model).count() == 0


def surest_of(pool, free):
    """What the operator's pool does, over arrays."""

    def surest(models, scales, quotas):
        out = []
        for m, v, (a, b), quota in zip(models, pool, scales, quotas, strict=True):
            p = features.logistic(a * np.clip(m.raw(v), -features.MOST_SURE, features.MOST_SURE) + b)
            picks = []
            for label in (0, 1):
                sure = (p if label else 1 - p) * free
                order = np.argsort(-sure, kind="stable")[: quota[label]]
                picks.append(order[sure[order] >= quality_classifier.SURE])
                free[picks[-1]] = False
            pick = np.concatenate(picks)
            out.append(([x[pick] for x in pool], (p[pick] > 0.5).astype(float)))
        return out

    return surest


def test_a_useless_view_does_no_harm():
    """One view says nothing of the label: with co-training the other is as good as alone, or better."""
    for seed in range(4):
        rng = np.random.default_rng(seed + 20)

        def draw(n, rng=rng):
            y = (rng.random(n) < 0.85).astype(float)
            return y, [(2 * y[:, None] - 1) * 0.5 + rng.normal(0, 1, (n, 12)), rng.normal(0, 1, (n, 12))]

        y, views = draw(300)
        _, pool = draw(3000)
        truth, test = draw(6000)
        found = []
        for rounds in (0, 3):
            model = quality_classifier.co_train(views, y, surest_of(pool, np.ones(3000, bool)), rounds)
            score, each = model.score(test)
            found.append([((x >= 0.5) == (truth > 0))[truth == label].mean() for x in (score, each[0]) for label in (0, 1)])
            assert model.trust[0] > 0.9
        assert (np.array(found[1]) >= np.array(found[0]) - 0.01).all()


def test_views_teach_each_other():
    """Two views, independent given the label: few labels and co-training beat few labels alone, in each view and together."""
    found = []
    for seed in range(4):
        rng = np.random.default_rng(seed)

        def draw(n, rng=rng):
            y = (rng.random(n) < 0.5).astype(float)
            return y, [(2 * y[:, None] - 1) * 0.4 + rng.normal(0, 1, (n, 12)) for _ in range(2)]

        y, views = draw(40)
        _, pool = draw(3000)
        truth, test = draw(4000)
        free = np.ones(len(pool[0]), bool)

        surest = surest_of(pool, free)

        for rounds in (0, 3):
            score, each = quality_classifier.co_train(views, y, surest, rounds).score(test)
            found.append([((x >= 0.5) == (truth > 0)).mean() for x in (score, *each)])
    alone, taught = np.array(found).reshape(4, 2, 3).mean(axis=0)
    assert (taught > alone + 0.02).all()


def test_quality_edges(spark):
    rng = random.Random(14)
    schema = "doc_id long, text string, lang string, source string, n_chars long, label string, place int"
    rows = [(k, say(rng, 20, SYLLABLES["en"]) * (1 if k % 3 else 2), None, f"s{k % 4}", None, "clash", 1) for k in range(60)]
    rows += [(None, "x", None, None, None, None, None), (7, rows[7][1], None, "s3", None, "clash", 1), (99, "long " * 60_000, "en", "s", 300_000, "c", 1), (100, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    marks = spark.createDataFrame([(k, k % 2) for k in range(0, 60, 2)] + [(k, 1) for k in range(1, 60, 2)] + [(None, 1), (7, 0)], "doc_id long, quality int")
    model = quality_classifier.train(docs, marks)
    found = quality_classifier.score(docs, model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found) and len({r.score for r in found if r.doc_id == 7}) == 1
    again = quality_classifier.score(docs.repartition(5), quality_classifier.train(docs.repartition(3), marks)).collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in again) == sorted((str(r.doc_id), round(r.score, 9)) for r in found)


def test_a_rare_language_is_learnt(spark):
    rng = random.Random(17)
    rows = [(k, say(rng, 12, SYLLABLES["de" if k % 300 == 5 else "en"]), "de" if k % 300 == 5 else "en", "clash") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    net = language_id.train(docs, 200)
    assert net.classes == ["de", "en"]
    assert language_id.predict(docs.filter("lang = 'de'"), net).filter("lang_pred = 'de'").count() >= 9


def test_calibration_stays_bounded_on_clean_splits():
    a, b = features.calibrate(np.array([-1.0] * 50 + [1.0] * 50), np.array([0.0] * 50 + [1.0] * 50))
    assert 0 < a < 20 and abs(b) < 20


def test_an_even_sample_of_many_kinds(spark):
    """Thousands of kinds are counted in Spark; each has its rows up to an even share, and the sample keeps its bound."""
    rows = [(k, f"rare{k}") for k in range(3000)] + [(10_000 + k, "common") for k in range(9000)] + [(30_000 + k, "some") for k in range(400)]
    found = features.even_sample(spark.createDataFrame(rows, "doc_id long, kind string"), 4000, "kind").groupBy("kind").count().collect()
    counts = {r.kind: r["count"] for r in found}
    assert sum(k.startswith("rare") for k in counts) == 3000 and counts["some"] > 300 and sum(counts.values()) < 4400
    small = features.even_sample(spark.createDataFrame(rows[:50], "doc_id long, kind string"), 4000, "kind")
    assert small.count() == 50 and features.even_sample(small.limit(0), 10, "kind").count() == 0


def test_long_words_are_cut_between_characters():
    for text in ["é" * 40, "語" * 33, "a" + "é" * 30, "\U0001f600" * 20, "x" * 24, "y" * 49]:
        data = np.frombuffer(text.encode(), np.uint8)
        word, lo, length, _ = language_id.pieces(data, np.array([0]), np.array([len(data)]))
        parts = [bytes(data[a : a + n]).decode() for a, n in zip(lo, length, strict=True)]
        assert "".join(parts) == text and (word == 0).all() and (length > 0).all()
