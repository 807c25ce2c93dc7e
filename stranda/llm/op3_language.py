"""Multilingual mixture inference: a document's language proportions by expectation-maximisation over n-gram likelihoods.

Learning: hashed character trigrams of lower-cased letters and single spaces are counted for each language, over documents
with a lang whose crc32(doc_id as text) mod 5 is not 0; all of them are used, taken whole. The model is a table of BUCKETS log-probabilities for each language (add-one smoothing, and a
floor of LEAST_DOCS documents for a language to be learned) of at most LANGUAGES languages, whatever the corpus holds.

Inference, for each whole text, alone and from its trigram counts only: the best single language has a closed form; from
there, languages are added one by one, the one that the full mixture gives the largest share first, as long as the
log-likelihood of the set's mixture, by EM, grows by more than PENALTY * log(n) / 2 for n trigrams (a BIC for each further
proportion). The prediction is the language with the largest proportion in the selected set, the score that proportion times
its share of the likelihood among single languages' per-trigram means; mixtures are returned too.

`keep` asks for an absolute fit: the selected mixture's log-likelihood per trigram, plus the entropy of its proportions, so
that a mixed text is held to the mean of its parts. It is compared with all pieces of SIZES trigrams of held-out texts of the predicted
language, so it does not depend on how many languages are learned; without held-out texts, only `und` goes.

Null text, or no letter: `und`, score 0. Null doc_id: never learned from and not held out. Null lang: predicted like others.
Ties go to the alphabetically first language. With nothing to learn from, all are `und`. Repeated rows: a row of results
each. An empty table gives no rows. Other columns are ignored by `detect` and kept by `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, pieces, table

BUCKETS = 1 << 15
LEAST_DOCS = 3
LANGUAGES = 256  # the most frequent ones are learned
PENALTY = 4.0
STEPS = 12
FOLDS = 5
_CELLS = 1 << 21  # probabilities that are held at a time for pieces of one size
SIZES = (8, 32, 128, 512, 2048)  # trigrams of the held-out pieces that `keep` is calibrated on
LOW, FAR = 0.05, 4.0  # `keep`: a fit may be so many times as far under the median as that quantile is


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def trigrams(text: str) -> np.ndarray:
    """Buckets of the trigrams of a text: lower-cased letters, all between them as one space."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[np.minimum(code, len(_LETTER) - 1)]
    if code.size and int(code.max()) >= len(_LETTER):
        big = np.flatnonzero(code >= len(_LETTER))
        letter = letter.copy()
        letter[big] = [chr(c).isalpha() for c in code[big]]
    if not letter.any():
        return np.zeros(0, np.int64)
    code = np.where(letter, code, 32).astype(np.uint64)
    keep = np.ones(len(code), bool)
    keep[1:] = letter[1:] | letter[:-1]
    code = np.concatenate([[np.uint64(32)], code[keep], [np.uint64(32)]])
    return (mix64(code[:-2] | code[1:-1] << np.uint64(21) | code[2:] << np.uint64(42)) & np.uint64(BUCKETS - 1)).astype(np.int64)


_LETTER = np.array([chr(c).isalpha() for c in range(0x2000)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in pieces(batches, "text"):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = found.setdefault(lang, np.zeros(BUCKETS, np.int64))
            own += np.bincount(trigrams(text), minlength=BUCKETS)
            docs[lang] = docs.get(lang, 0) + 1
    for lang, own in found.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1), pa.string()), pa.array([*at, -1], pa.int32()), pa.array([*own[at], docs[lang]], pa.int64())], ["lang", "bucket", "n"])


class Model:
    """langs, sorted, and log_p[bucket, language]."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        docs = {lang: n for lang, bucket, n in rows if bucket < 0}
        self.langs = sorted(lang for lang, n in docs.items() if n >= LEAST_DOCS) or sorted(docs)
        place = {lang: i for i, lang in enumerate(self.langs)}
        counts = np.ones((BUCKETS, max(len(self.langs), 1)))
        for lang, bucket, n in rows:
            if bucket >= 0 and lang in place:
                counts[bucket, place[lang]] += n
        self.log_p = np.log(counts / counts.sum(axis=0))
        self.p = np.exp(self.log_p)
        self.least: dict[str, list[float]] = {}  # the least fit of each of SIZES, by language

    def fit(self, grams: np.ndarray) -> tuple[str, float]:
        """(language, log-likelihood per trigram under the selected mixture, plus the entropy of its proportions)."""
        bucket, count = np.unique(grams, return_counts=True)
        _, chosen, share, like = self._select(bucket, count)
        some = share[share > 0]
        top = min(range(len(chosen)), key=lambda i: (-share[i], chosen[i]))
        return self.langs[chosen[top]], like / len(grams) - float(some @ np.log(some))

    def fit_pieces(self, grams: np.ndarray, size: int) -> np.ndarray:
        """The second value of fit for each whole piece of `size` trigrams, one after the other.

        The mixtures of a single language and of two are worked out for many pieces at once; a piece that asks for more goes to fit."""
        most = max(1, _CELLS // (size * len(self.langs)))
        whole = grams[: len(grams) // size * size].reshape(-1, size)
        return np.concatenate([np.zeros(0), *(self._fit_some(whole[at : at + most]) for at in range(0, len(whole), most))])

    def _fit_some(self, grams: np.ndarray) -> np.ndarray:
        n = grams.shape[1]
        single = self.log_p[grams].sum(axis=1)
        best = single.argmax(axis=1)
        row = np.arange(len(grams))
        like = single[row, best]
        if len(self.langs) > 1:
            p = self.p[grams]
            full = _em_each(p)[0]
            full[row, best] = -1
            pair = np.stack([best, full.argmax(axis=1)], axis=1)
            now = _em_each(np.take_along_axis(p, pair[:, None, :], axis=2))[1]
            for i in np.flatnonzero(now - like > PENALTY * np.log(n) / 2):
                like[i] = self.fit(grams[i])[1] * n
        return like / n

    def fits(self, text: str | None) -> bool:
        """Whether the text is in learned languages, as far as its length can tell."""
        grams = trigrams(text or "")
        if not len(grams) or not self.langs:
            return False
        lang, fit = self.fit(grams)
        least = self.least.get(lang)
        return least is None or fit >= float(np.interp(np.log(len(grams)), np.log(SIZES), least))

    def _select(self, bucket: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray, float]:
        """(log-likelihoods of single languages, the selected set, its proportions and log-likelihood)."""
        single = count @ self.log_p[bucket]
        best = int(np.argmax(single))
        chosen, share, like = [best], np.ones(1), float(single[best])
        p, n = self.p[bucket], int(count.sum())
        if len(self.langs) > 1:
            full, _ = _em(p, count)
            for more in (int(i) for i in np.argsort(-full, kind="stable") if i != best):
                tried, now = _em(p[:, [*chosen, more]], count)
                if now - like <= PENALTY * np.log(n) / 2:
                    break
                chosen, share, like = [*chosen, more], tried, now
        return single, chosen, share, like

    def mixture(self, text: str | None) -> tuple[dict[str, float], float]:
        """(proportions of the selected languages, score); empty and 0 where there is nothing to tell from."""
        grams = trigrams(text or "")
        if not len(grams) or not self.langs:
            return {}, 0.0
        bucket, count = np.unique(grams, return_counts=True)
        single, chosen, share, _ = self._select(bucket, count)
        n = int(count.sum())
        top = min(range(len(chosen)), key=lambda i: (-share[i], chosen[i]))
        mean = np.exp((single - single.max()) / max(n, 1) * min(n, 50))
        score = float(share[top] * mean[chosen[top]] / mean.sum())
        return {self.langs[i]: float(s) for i, s in sorted(zip(chosen, share, strict=True), key=lambda x: (-x[1], x[0]))}, min(1.0, max(0.0, score))


def _em(p: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, float]:
    """(proportions, log-likelihood) of a mixture of the columns of p for the counted n-grams."""
    share, n = np.full(p.shape[1], 1 / p.shape[1]), count.sum()
    for _ in range(STEPS):
        total = p @ share
        share = share * ((count / total) @ p) / n
    return share, float(count @ np.log(p @ share))


def _em_each(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_em for each piece of p[piece, n-gram, language], its n-grams counted one by one."""
    share = np.full((p.shape[0], p.shape[2], 1), 1 / p.shape[2])
    for _ in range(STEPS):
        share = share * ((1 / (p @ share)).transpose(0, 2, 1) @ p).transpose(0, 2, 1) / p.shape[1]
    return share[:, :, 0], np.log(p @ share).sum(axis=(1, 2))


def _fits(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = trigrams(text)
                for n in SIZES:
                    found = model.value.fit_pieces(grams, n)
                    if len(found):
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([n] * len(found), pa.int32()), pa.array(found)], ["lang", "n", "fit"])

    return run


def calibrate(docs: DataFrame, model: Model) -> Model:
    """Sets the model's least fits from all held-out texts of its languages; two numbers a size reach the driver."""
    some = _known(docs, held_out(F.col("doc_id"))).filter(F.col("lang").isin(model.langs))
    found = some.mapInArrow(_fits(docs.sparkSession.sparkContext.broadcast(model)), "lang string, n int, fit double").groupBy("lang", "n").agg(F.percentile_approx("fit", [LOW, 0.5], 10_000).alias("q")).collect()
    for lang in model.langs:
        at = sorted((r.n, r.q[1] - FAR * (r.q[1] - r.q[0])) for r in found if r.lang == lang)
        if at:
            model.least[lang] = np.interp(np.log(SIZES), np.log([n for n, _ in at]), [x for _, x in at]).tolist()
    return model


def _known(docs: DataFrame, where: Column) -> DataFrame:
    """(lang, text) of all texts that have all columns."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").filter(where).select("lang", "text")


def learn(docs: DataFrame) -> Model:
    """Reads all texts of the LANGUAGES most frequent languages; at most BUCKETS + 1 sums for each reach the driver."""
    known = _known(docs, ~held_out(F.col("doc_id")))
    langs = [r.lang for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()]
    counted = known.filter(F.col("lang").isin(langs)).mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return Model([tuple(r) for r in counted.collect()])


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = [model.value.mixture(t) for t in batch.column(1).to_pylist()]
            pred = [next(iter(m), "und") for m, _ in found]
            parts = pa.array([list(m.items()) for m, _ in found], pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array([s for _, s in found], pa.float64()), parts], ["doc_id", "lang_pred", "score", "mixture"])

    return run


def detect(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, mixture (language -> proportion)."""
    model = docs.sparkSession.sparkContext.broadcast(model or learn(docs))
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, mixture map<string, double>")
    return found.withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score", "mixture")


def keep(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs, all columns kept, whose text fits the learned languages; without a model (see `calibrate`), it is learned from docs."""
    model = docs.sparkSession.sparkContext.broadcast(model or calibrate(docs, learn(docs)))

    @F.arrow_udf("boolean")
    def known(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array((model.value.fits(text.as_py()) for text in batch), pa.bool_())

    return docs.filter(known(F.col("text").cast("string")))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents")).drop("mixture")


QUERIES = {"op3_language": op3_language}
