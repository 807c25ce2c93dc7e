import random
import zlib

import numpy as np

from pyspark.sql import functions as F

from stranda.llm import op3_language as op


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = op.op3_language(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) >= 0.97 * len(held)


def test_mixtures_nulls_repeats_and_empty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = op.learn(docs)
    one = {r.lang: r.text for r in docs.filter("n_chars BETWEEN 900 AND 1500").collect()}
    mixed, _ = model.mixture(one["en"][:900] + " " + one["de"][:900])
    assert set(mixed) == {"en", "de"} and all(0.35 < x < 0.65 for x in mixed.values())
    odd = spark.createDataFrame([(1, None, None), (None, one["en"], "xx"), (2, "123 !!", "en"), (3, "", "en"), (3, "", "en"), (4, "é" * 100000, "fr")], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = sorted(((str(r.doc_id), r.lang_pred, r.held_out) for r in op.detect(odd, model).collect()))
    assert [x[1] for x in got][:4] == ["und"] * 4 and got[-1] == ("None", "en", False)
    assert op.detect(odd.limit(0)).count() == 0 and {r.lang_pred for r in op.detect(odd.filter("doc_id = 1")).collect()} == {"und"}
    kept = op.keep(odd, model=model)
    assert kept.columns == odd.columns and one["en"] in {r.text for r in kept.collect()} and kept.filter("doc_id IN (1, 2, 3)").count() == 0


def test_unknown_languages_and_gibberish_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = op.calibrate(docs, op.learn(docs))
    clean = {r.lang: r.text for r in docs.filter("n_chars BETWEEN 900 AND 1500").collect()}
    rng = random.Random(5)
    gibberish = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(150))
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä"
    greek = "όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα"
    texts = {"gibberish": gibberish, "fi": finnish, "el": greek, "mixed": clean["en"][:900] + " " + clean["de"][:900]}
    texts |= {f"short {k}": " ".join(v.split()[:12]) for k, v in clean.items()}
    df = spark.createDataFrame(list(texts.items()), "name string, text string")
    assert {r.name for r in op.keep(df, model=model).collect()} == set(texts) - {"gibberish", "fi", "el"}
    kept = op.keep(docs, model=model).count()
    assert kept >= 0.98 * docs.count(), kept


def test_mixture_equals_brute_force():
    """EM against the best proportions of a fine grid, and the selected set against all pairs by penalised likelihood."""
    rng = np.random.default_rng(5)
    grams = rng.integers(0, op.BUCKETS, 3000)
    rows = [(lang, -1, 10) for lang in "abc"]
    for k, lang in enumerate("abc"):
        own = grams[k * 1000 : (k + 1) * 1000]
        rows += [(lang, int(b), int(n)) for b, n in zip(*np.unique(own, return_counts=True), strict=True)]
    model = op.Model(rows)
    for share in (0.0, 0.2, 0.5, 0.8):
        text = np.concatenate([rng.choice(grams[:1000], int(400 * share)), rng.choice(grams[1000:2000], 400 - int(400 * share))])
        bucket, count = np.unique(text, return_counts=True)
        like = lambda s, i, j: float(count @ np.log(s * model.p[bucket, i] + (1 - s) * model.p[bucket, j]))  # noqa: E731,B023
        grid = max(np.linspace(0.001, 0.999, 999), key=lambda s: like(s, 0, 1))
        found, _ = op._em(model.p[bucket][:, [0, 1]], count)
        assert abs(found[0] - grid) < 0.05  # STEPS are few
        _, chosen, proportions, total = model._select(bucket, count)
        single = max(float(count @ np.log(model.p[bucket, i])) for i in range(3))
        pairs = {(i, j): max(like(s, i, j) for s in np.linspace(0.01, 0.99, 99)) for i in range(3) for j in range(i)}
        best = max(pairs, key=pairs.get)
        worth = pairs[best] - single > op.PENALTY * np.log(400) / 2
        assert (len(chosen) == 2) == worth and (not worth or set(chosen) == set(best)) and abs(proportions.sum() - 1) < 1e-9


def test_all_texts_and_pieces_are_learned_from(spark, monkeypatch):
    """Counts of more texts of a language than a sample would take, and fits of all pieces of a held-out text."""
    n = 6000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("un texte").alias("text"), F.lit("fr").alias("lang"))
    seen = []

    class Spy(op.Model):
        def __init__(self, rows):
            seen.extend(rows)
            super().__init__(rows)

    monkeypatch.setattr(op, "Model", Spy)
    op.learn(docs)
    learned = sum(zlib.crc32(str(i).encode()) % op.FOLDS != 0 for i in range(n))
    assert {x[2] for x in seen} == {learned} and len(seen) == 1 + len(" un texte ") - 2


def test_fits_of_all_pieces_equal_one_by_one():
    rng = np.random.default_rng(7)
    rows = [(lang, -1, 10) for lang in "abc"]
    own = rng.integers(0, op.BUCKETS, (3, 400))
    rows += [(lang, int(b), int(k)) for lang, g in zip("abc", own, strict=True) for b, k in zip(*np.unique(g, return_counts=True), strict=True)]
    model = op.Model(rows)
    text = np.concatenate([rng.choice(own[0], 500), rng.choice(own[1:].ravel(), 600), rng.choice(own.ravel(), 307), rng.integers(0, op.BUCKETS, 100)])
    for size in op.SIZES:
        want = [model.fit(text[at : at + size])[1] for at in range(0, len(text) - size + 1, size)]
        assert np.allclose(model.fit_pieces(text, size), want)

    class Broadcast:
        value = model

    words = " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(120))
    batch = next(op._fits(Broadcast)(iter([op.pa.RecordBatch.from_arrays([op.pa.array(["a"]), op.pa.array([words])], ["lang", "text"])])))
    assert batch.num_rows == len(op.trigrams(words)) // op.SIZES[0] > 4
