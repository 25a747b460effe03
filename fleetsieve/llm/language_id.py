"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Runs of one to three lower-cased code points are hashed into `buckets` features. Document frequencies
come from every labelled training text, in one pass that sends one vector per task. The model is
trained with follow-the-regularised-leader (proximal) and elastic-net penalties on a sample of the
training rows, at most `sample` of them and about as many of each language; a fifth of the sample is
held back to calibrate a temperature. Whole texts are read for statistics, training and prediction.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetsieve.llm.common import fresh

BUCKETS, SAMPLE, ROUNDS = 1 << 15, 6000, 3
CHUNK = 1 << 20  # code points of a text that are hashed at a time
_KEYS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def term_counts(text: str, buckets=BUCKETS) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text."""
    total = np.zeros(buckets, np.int64)
    shift = np.uint32(32 - buckets.bit_length() + 1)
    for at in range(0, len(text), CHUNK):
        points = np.frombuffer(text[at:at + CHUNK + 2].lower().encode("utf-32-le", "replace"), "<u4")
        own = min(CHUNK, len(points))
        h = np.zeros(len(points), np.uint32)
        for n in range(3):
            keep = len(points) - n
            if keep <= 0:
                break
            h = (h[:keep] ^ points[n:].astype(np.uint32)) * _KEYS[n]
            h ^= h >> np.uint32(15)
            total += np.bincount((h[:own] * _KEYS[0]) >> shift, minlength=buckets)
    return total


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and their weights: (1 + log tf) idf, of length one."""
    counts = term_counts(text, len(idf))
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    return at, x / (np.sqrt((x * x).sum()) or 1.0)


class Ftrl:
    """Per-coordinate FTRL-proximal for a softmax over classes."""

    def __init__(self, features, classes, alpha=2.0, beta=1.0, l1=0.05, l2=0.05):
        self.z, self.n = np.zeros((features + 1, classes)), np.zeros((features + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at):
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at, x, label):
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = np.outer(x, p)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def softmax(scores):
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm."""
    if not len(logits):
        return 1.0
    def loss(t):
        return -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-300)).mean()
    a, b, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def held_out(doc_id: Column, folds=5) -> Column:
    """crc32 of the id as text, modulo 5, is 0. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def corpus_statistics(train: DataFrame, buckets=BUCKETS) -> tuple[dict, np.ndarray]:
    """Rows (lang, text) -> number of texts of each language, smoothed IDF of each feature."""
    def run(batches):
        seen, n = np.zeros(buckets, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                seen += term_counts(text.as_py(), buckets) > 0
                n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], n))], names=["feature", "n"])

    sums = train.select("text").mapInArrow(run, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    texts = int(sums.n[sums.feature == -1].sum())
    known = sums[sums.feature >= 0]
    df = np.zeros(buckets)
    df[known.feature] = known.n
    langs = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    return langs, np.log((1 + texts) / (1 + df)) + 1


def fit(docs: DataFrame, doc_id="doc_id", text="text", lang="lang", buckets=BUCKETS, sample=SAMPLE, rounds=ROUNDS, seed=7):
    """(languages, idf, weights, temperature) learnt from the rows that aren't held out and have a label
    and a letter in their text; None if there are no such rows."""
    train = docs.filter(~held_out(F.col(doc_id)) & F.col(lang).isNotNull() & F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))).select(
        F.col(doc_id).cast("string").alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes, idf = corpus_statistics(train, buckets)
    if not sizes:
        return None
    langs = sorted(sizes)
    each = sample / len(langs)
    share = F.create_map(*[y for k in langs for y in (F.lit(k), F.lit(min(1.0, each / sizes[k])))])
    draw = F.xxhash64(F.lit(seed), "doc_id", "text")
    drawn = train.withColumn("draw", draw).filter(F.pmod("draw", F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20)).select("draw", "lang", "text")

    def run(batches):
        for batch in batches:
            rows = [vector(x.as_py(), idf) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a for a, _ in rows], pa.list_(pa.int32())), pa.array([x for _, x in rows], pa.list_(pa.float32()))], names=["draw", "lang", "at", "x"])

    rows = drawn.mapInArrow(run, "draw bigint, lang string, at array<int>, x array<float>").orderBy("draw").limit(sample).toArrow()
    label = np.array([langs.index(x) for x in rows["lang"].to_pylist()], int)
    xs = [(np.asarray(a.values), np.asarray(x.values, float)) for a, x in zip(rows["at"], rows["x"])]
    order = np.random.default_rng(seed).permutation(len(xs))
    checked, used = order[:len(xs) // 5], order[len(xs) // 5:]
    model = Ftrl(buckets, len(langs))
    for _ in range(rounds):
        for i in used:
            model.learn(*xs[i], label[i])
    w = model.weights(np.arange(buckets + 1))
    logits = np.array([x @ w[at] + w[-1] for at, x in (xs[i] for i in checked)]).reshape(-1, len(langs))
    return langs, idf.astype(np.float32), w.astype(np.float32), temperature(logits, label[checked])


def predict(docs: DataFrame, model, text="text", lang_pred="lang_pred", score="score") -> DataFrame:
    """The table with a predicted language and its calibrated probability. Texts that are null or have
    no letter get `und` and 0.0; so does everything if nothing could be learnt."""
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.withColumns({lang_pred: F.lit("und"), score: F.lit(0.0)})
    langs, idf, w, heat = model
    shared = docs.sparkSession.sparkContext.broadcast((idf, w))  # (buckets + 1) x languages numbers

    @F.pandas_udf("lang string, score double")
    def classify(texts):
        import pandas as pd
        idf, w = shared.value
        out = []
        for x in texts:
            if x is None:
                out.append((None, None))
                continue
            at, v = vector(x, idf)
            p = softmax((v @ w[at] + w[-1]) / heat)
            out.append((langs[int(p.argmax())], float(p.max())))
        return pd.DataFrame(out, columns=["lang", "score"])

    name, = fresh(docs, "found")
    found = F.col(name)
    return docs.withColumn(name, classify(F.when(lettered, F.col(text)))).withColumns({
        lang_pred: F.coalesce(found["lang"], F.lit("und")), score: F.least(F.coalesce(found["score"], F.lit(0.0)), F.lit(1.0))}).drop(name)


def identify(docs: DataFrame, doc_id="doc_id", text="text", lang="lang", **settings) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row. Repeated rows get equal results; an empty table
    or one without labels is answered with `und`."""
    model = fit(docs, doc_id, text, lang, **settings)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return predict(slim, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, doc_id="doc_id", text="text", lang="lang", least=0.3, **settings) -> DataFrame:
    """The rows whose text has a language that was learnt, by a probability of at least `least`: texts
    of two languages or with a few words among numbers stay, those no language explains go. A table
    without a labelled row teaches no language and loses only its texts without a letter; nulls have none."""
    pred, score = fresh(docs, "lang_pred", "lang_score")
    model = fit(docs, doc_id, text, lang, **settings)
    if model is None:
        return docs.filter(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    rows = predict(docs, model, text, pred, score)
    return rows.filter((F.col(pred) != "und") & (F.col(score) >= least)).select(*docs.columns)
