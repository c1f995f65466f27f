"""The classifiers: held-out accuracy, the same results from plain loops, odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import plain

from ledgerweave.llm import ftrl, language_id, quality, queries


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op4_language_id(spark, sf).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 150 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    # Calibrated: the mean score is close to the accuracy.
    assert abs(np.mean([r.score for r in held]) - np.mean([r.lang_pred == truth[r.doc_id] for r in held])) < 0.06


def test_language_odd(spark, odd, none):
    from pyspark.sql import functions as F

    rows = language_id.identify(odd.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb"))).collect()
    assert len(rows) == 13
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3)} == {"und"}
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    rows = language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}
    assert language_id.identify(none.withColumn("lang", F.lit("x"))).count() == 0


def test_quality_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op7_quality(spark, sf).collect()
    known = [(r.kept, labels[r.doc_id] == 1) for r in rows if r.doc_id in labels]
    assert np.mean([a == b for a, b in known]) > 0.97
    assert np.mean([r.kept for r in rows]) > 0.7


def test_quality_held_out(spark):
    """Labels of one half teach, those of the other half judge."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.score(docs, labels.filter("doc_id % 2 = 0")).select("row.doc_id", "kept").join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    right = np.mean([r.kept == (r.quality == 1) for r in got])
    assert right > 0.98, right


def test_marks_come_from_all_documents(spark):
    """All sure marks of every class and view, copies once; a bound on the sample keeps those with the smallest hashes."""
    rng, n = np.random.default_rng(6), 4000
    words = ["alpha", "Beta", "GAMMA 7", "delta,", "12", "eps!"]
    rows = [(i, " ".join(rng.choice(words, 6)), f"s{rng.integers(40)}", "en", int(rng.integers(1, 999))) for i in range(n)]
    rows += [rows[5]] * 700
    docs = spark.createDataFrame(rows, "key long, text string, source string, lang string, n_chars long").repartition(7)
    weights = [rng.normal(size=(size, 2)) * 20 for size in quality.VIEWS]
    margins = []
    for v in (0, 1):
        viewed = {r[0]: quality.meta_view(*r[2:]) if v else quality.text_view(r[1]) for r in rows}
        margins.append({k: float(np.diff(x.astype(np.float32).astype(float) @ weights[v][at])[0]) for k, (at, x) in viewed.items()})
    given, cal = [{1: 1, 2: 0}, {3: 1}], [(0.8, -0.8 * np.median(list(m.values()))) for m in margins]
    for most in (10**6, 60):
        got = quality.marked(docs, weights, cal, given, most)
        for v in (0, 1):
            sure = {k: 1 / (1 + np.exp(-np.clip(cal[v][0] * m + cal[v][1], -30, 30))) for k, m in margins[v].items()}
            for y in (0, 1):
                mine = [k for k, p in sure.items() if (p if y else 1 - p) >= quality.SURE and k not in given[1 - v]]
                want = sorted(mine, key=quality.place)[:most]
                assert len(want) > 50 and {k for w, c, k, _ in got if (w, c) == (v, y)} == set(want)
    assert set(quality.looked_up(docs, {5, 3999})) == {5, 3999}


def test_language_against_plain_loops(spark, sf):
    """The same predictions and scores from loops over dictionaries."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 2500").limit(60).cache()
    known = docs.withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30))).collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in known}
    learned = sorted((r for r in known if not held[r.doc_id]), key=lambda r: r.h)
    bits = language_id.BITS
    counts = {r.doc_id: plain.grams(r.text, bits) for r in known}
    df = Counter(f for r in learned for f in counts[r.doc_id])
    idf = lambda f: math.log((1 + len(learned)) / (1 + df[f])) + 1

    def features(doc_id):
        x = {f: (1 + math.log(c)) * idf(f) for f, c in counts[doc_id].items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        return {f: v / size for f, v in x.items()}

    langs = sorted({r.lang for r in learned})
    by = [(features(r.doc_id), k, i) for k, g in enumerate(langs) for i, r in enumerate(r for r in learned if r.lang == g)]
    train, rest = [x for x in by if x[2] % 5], [x for x in by if x[2] % 5 == 0]
    weights = plain.ftrl([x[0] for x in train], [x[1] for x in train], len(langs), alpha=0.3, epochs=4, seed=0)
    heat = ftrl.temperature(np.array([plain.scores(x[0], weights, len(langs)) for x in rest]), [x[1] for x in rest])
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert {i: r.held_out for i, r in got.items()} == held
    for i in counts:
        p = plain.softmax([s / heat for s in plain.scores(features(i), weights, len(langs))])
        assert got[i].lang_pred == langs[int(np.argmax(p))] and abs(got[i].score - max(p)) < 1e-3


def test_every_language_is_learned(spark):
    """Three hundred languages of few documents each: none is left out."""
    rng = random.Random(3)
    rows = []
    for g in range(300):
        words = ["".join(chr(0x4E00 + 12 * g + rng.randint(0, 9)) for _ in range(5)) for _ in range(8)]
        rows += [(10 * g + k, " ".join(rng.choices(words, k=20)), f"l{g:03d}") for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language_id.feature_bits(300) < language_id.BITS == language_id.feature_bits(256)
    got = language_id.identify(docs).collect()
    truth = {i: g for i, _, g in rows}
    assert len({r.lang_pred for r in got}) > 290
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out]) > 0.95


def test_quality_against_plain_loops(spark, sf):
    """The same scores from loops over dictionaries, with the same rounds of marks."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) < 2500").limit(120).cache()
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    key = F.xxhash64("text", "source", "lang", "n_chars").alias("key")
    rows = docs.join(labels.select("doc_id", "quality"), "doc_id", "left").withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30))).select("*", key).collect()
    single = lambda x: x.astype(np.float32).astype(float)
    views = {r.doc_id: [dict(zip(at.tolist(), single(x).tolist())) for at, x in (quality.text_view(r.text), quality.meta_view(r.source, r.lang, r.n_chars))] for r in rows}
    known = [r for y in (0, 1) for r in sorted((r for r in rows if r.quality == y), key=lambda r: r.h)]
    place = Counter()
    fitted, rest = [], []
    for r in known:
        (rest if place[r.quality] % 4 == 3 else fitted).append(r)
        place[r.quality] += 1
    assert min(place.values()) >= 4
    others = {r.key: r for r in rows if r.quality is None}
    given, margin = [{}, {}], lambda row, w: float(np.subtract(*plain.scores(row, w, 2)[::-1]))
    for turn in range(quality.ROUNDS + 1):
        weights, cal = [], []
        for v in (0, 1):
            extra = sorted(given[v].items())
            x = [views[r.doc_id][v] for r in fitted] + [views[others[k].doc_id][v] for k, _ in extra]
            weights.append(plain.ftrl(x, [r.quality for r in fitted] + [y for _, y in extra], 2, alpha=0.5, epochs=3, seed=turn))
            cal.append(plain.calibrated([margin(views[r.doc_id][v], weights[v]) for r in rest], [r.quality for r in rest]))
        if turn == quality.ROUNDS:
            break
        before = [dict(g) for g in given]
        for v in (0, 1):
            for y in (1, 0):
                for k, r in others.items():
                    p = 1 / (1 + math.exp(-(cal[v][0] * margin(views[r.doc_id][v], weights[v]) + cal[v][1])))
                    if (p if y else 1 - p) >= quality.SURE and k not in before[1 - v]:
                        given[1 - v].setdefault(k, y)
    assert any(given)
    prior = math.log(place[1] / place[0])
    got = {r.doc_id: r for r in quality.score(docs, labels).select("row.doc_id", "score", "kept").collect()}
    for i, (text, meta) in views.items():
        logit = sum(cal[v][0] * margin(x, weights[v]) + cal[v][1] for v, x in ((0, text), (1, meta))) - prior
        assert abs(got[i].score - 1 / (1 + math.exp(-logit))) < 1e-3 and got[i].kept == (got[i].score >= 0.5)


def test_quality_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None), (3, 7), (4, 0), (4, 1)], "doc_id long, quality int")
    assert quality.keep_good(odd, labels).count() == 13  # nothing to learn from
    many = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    scored = quality.score(odd, many)
    assert scored.count() == 13 and scored.select("row.*").columns == odd.columns
    assert quality.keep_good(none, many).count() == 0
    # One document of each class is enough to learn from.
    two = quality.score(odd, spark.createDataFrame([(1, 1), (8, 0)], "doc_id long, quality int")).collect()
    assert len({r.score for r in two}) > 2


def test_ftrl_and_calibration():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 6))
    y = (x[:, 0] - x[:, 1] > 0).astype(int)
    rows = [(np.arange(6), r) for r in x]
    model = ftrl.SoftmaxFTRL(6, 2, l1=1.0).fit(rows[:400], y[:400], epochs=5)
    s = ftrl.scores(rows[400:], model.weights())
    assert (s.argmax(1) == y[400:]).mean() > 0.95
    assert ftrl.temperature(s, y[400:]) > 0
    slope, _ = ftrl.platt(s[:, 1] - s[:, 0], y[400:])
    assert slope > 0
