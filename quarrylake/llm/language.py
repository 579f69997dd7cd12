"""Language ID by hierarchical discrimination: the family first, then the language within it.

Features are hashed byte n-grams of the whole text's letters. Families are told apart, and languages
within a family, by linear support vector machines between two classes each (one-versus-one), fitted on
a bounded sample of labelled texts. The machines of all levels are one small matrix, so a text is read
once and scored by a product of its feature vector with that matrix.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylake.llm.cluster import bounded_batches, held_out_by, lean, release
from quarrylake.llm.textcore import LOWER, chunks

#: Labelled texts learnt from: so many of each language, and so many in all, at most.
MOST_PER_LANGUAGE, MOST_TEXTS = 1000, 6000
LOG2_FEATURES = 12
#: Texts whose feature vectors (16 kB each) are made at once, at most.
MATRIX_ROWS = 512
#: The family of each language code; one that isn't listed is a family of its own.
FAMILIES: dict[str, str] = {
    **dict.fromkeys(("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "fy", "af", "lb"), "germanic"),
    **dict.fromkeys(("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"), "romance"),
    **dict.fromkeys(("ru", "uk", "be", "bg", "sr", "hr", "bs", "sl", "mk", "pl", "cs", "sk"), "slavic"),
    **dict.fromkeys(("fi", "et", "hu"), "uralic"),
    **dict.fromkeys(("lt", "lv"), "baltic"),
    **dict.fromkeys(("hi", "ur", "bn", "mr", "gu", "pa", "ne"), "indic"),
    **dict.fromkeys(("tr", "az", "kk", "uz"), "turkic"),
}
UNDETERMINED = "und"

_LETTER = np.full(256, 32, np.uint8)
for _b in range(256):
    if 97 <= LOWER[_b] <= 122 or _b >= 128:
        _LETTER[_b] = LOWER[_b]


def feature_matrix(data: np.ndarray, offsets: np.ndarray, log2_features: int = LOG2_FEATURES) -> np.ndarray:
    """A row per text: square roots of counts of hashed 2- and 3-grams of letters, scaled to length 1."""
    n, size = len(offsets) - 1, 1 << log2_features
    b = _LETTER[data].astype(np.uint32)
    lengths = np.diff(offsets)
    doc = np.repeat(np.arange(n), lengths)
    total = np.zeros(n * size, np.float32)
    for width in (2, 3):
        if len(b) < width:
            continue
        m = len(b) - width + 1
        h = np.full(m, width * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for j in range(width):
            h = (h ^ b[j : j + m]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        inside = doc[:m] == doc[width - 1 :]
        index = doc[:m] * size + (h >> np.uint32(32 - log2_features)).astype(np.int64)
        total += np.bincount(index[inside], minlength=n * size).astype(np.float32)
    x = np.sqrt(total.reshape(n, size))
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 30.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss; y is +1 or -1. Deterministic accelerated gradient descent.

    ``x`` is used as it is, in single precision, so the fit takes no more memory than its rows.
    """
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb = w, b
    rate = 1 / (1 / penalty + 4.0)
    for k in range(1, steps + 1):
        slack = np.maximum(0, 1 - y * (x @ vw.astype(np.float32) + vb))
        g = share * y * slack * 2
        nw = vw - rate * (vw / penalty - g.astype(np.float32) @ x)
        nb = vb + rate * g.sum()
        vw, vb = nw + (k - 1) / (k + 2) * (nw - w), nb + (k - 1) / (k + 2) * (nb - b)
        w, b = nw, nb
    return w, b


class Hierarchy:
    """Machines between families and, within each family, between languages."""

    def __init__(self, families: dict[str, list[str]], pairs: list[tuple[str, str]], weights: np.ndarray, bias: np.ndarray):
        self.families, self.pairs, self.weights, self.bias = families, pairs, weights, bias

    @staticmethod
    def fit(x: np.ndarray, lang: np.ndarray) -> Hierarchy:
        languages = sorted(set(lang.tolist()))
        families: dict[str, list[str]] = {}
        for name in languages:
            families.setdefault("family " + FAMILIES.get(name, name), []).append(name)
        of = {name: f for f, names in families.items() for name in names}
        family = np.array([of[v] for v in lang])
        pairs, weights, bias = [], [], []
        for classes, label in [(sorted(families), family), *((sorted(names), lang) for _, names in sorted(families.items()))]:
            for a, b in combinations(classes, 2):
                rows = (label == a) | (label == b)
                w, c = fit_svm(x if rows.all() else x[rows], np.where(label[rows] == a, 1.0, -1.0))
                pairs.append((a, b))
                weights.append(w)
                bias.append(c)
        size = x.shape[1]
        return Hierarchy(families, pairs, np.array(weights, np.float32).reshape(-1, size), np.array(bias, np.float32))

    def _choose(self, classes: list[str], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the class with most won duels (ties: larger margins, then order) and its least margin."""
        n, k = len(margins), len(classes)
        votes, sums, least = np.zeros((n, k)), np.zeros((n, k)), np.full((n, k), np.inf)
        for j, (a, b) in enumerate(self.pairs):
            if a in classes and b in classes:
                ia, ib = classes.index(a), classes.index(b)
                m = margins[:, j]
                votes[:, ia] += m >= 0
                votes[:, ib] += m < 0
                for i, s in ((ia, m), (ib, -m)):
                    sums[:, i] += s
                    least[:, i] = np.minimum(least[:, i], s)
        best = (votes + 0.5 + np.tanh(sums / max(1, k)) / 4).argmax(axis=1)
        return best, least[np.arange(n), best]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(languages, scores): the score is a logistic function of the least margin on the way."""
        n = len(x)
        margins = x @ self.weights.T + self.bias if len(self.pairs) else np.zeros((n, 0), np.float32)
        names = sorted(self.families)
        family, margin = self._choose(names, margins)
        lang = np.full(n, UNDETERMINED, dtype=object)
        for k, f in enumerate(names):
            rows = np.flatnonzero(family == k)
            languages = sorted(self.families[f])
            which, inner = self._choose(languages, margins[rows])
            lang[rows] = np.array(languages, dtype=object)[which]
            margin[rows] = np.minimum(margin[rows], inner)
        return lang, 1 / (1 + np.exp(-3 * np.clip(margin, -10, 10).astype(np.float64)))


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """Predict the language of every whole text: doc_id, held_out, lang_pred, score (0 to 1); one row per row of ``docs``.

    Learns from text and non-null lang of rows whose crc32(id) mod 4 isn't 2: at most
    ``MOST_PER_LANGUAGE`` a language and ``MOST_TEXTS`` in all, chosen by a hash of the id. A text that is
    null or has no letter gets ``und`` and score 0, as does every text if there is nothing to learn from;
    with one language to learn, all others get it. Null ids are scored and not learnt from; repeated rows
    are scored each; a very long text is one row like others, read whole; an empty table gives no rows.
    Columns other than the three, whatever their names, are not read, and lang isn't for a prediction;
    with ``keep``, a struct ``kept`` of these columns of the same row is added.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    learnable = source.where("lang is not null and doc_id is not null and text is not null").where(~held_out_by(F.col("doc_id"), 4, 2))
    counts = {r["lang"]: r["count"] for r in learnable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_TEXTS).collect()}
    most = min(MOST_PER_LANGUAGE, MOST_TEXTS // max(1, len(counts)))
    # The hash threshold of each language leaves about ``most`` rows, and hardly ever a tenth more.
    shares = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, most / n))]) if counts else None
    model = None
    if counts:
        sample = learnable.where(lettered).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < shares[F.col("lang")] * F.lit(1 << 30))

        def describe(batches):
            for batch in batches:
                for lo, hi, data, offsets in chunks(batch.column(1), rows=MATRIX_ROWS):
                    x = feature_matrix(data, offsets).astype(np.float16)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "lang", "x"])

        # At most about MOST_TEXTS rows of 8 kB; nothing of them is held twice but in the precision of the fit.
        rows = sample.mapInArrow(lean(describe), "doc_id long, lang string, x binary").toArrow()
        if rows.num_rows:
            lang = np.array(rows["lang"].to_pylist(), object)
            order = np.lexsort((lang, rows["doc_id"].to_numpy()))
            x = np.empty((len(order), 1 << LOG2_FEATURES), np.float32)
            for k, raw in zip(np.argsort(order).tolist(), rows["x"]):
                x[k] = np.frombuffer(raw.as_buffer(), np.float16)
            del rows
            model = Hierarchy.fit(x, lang[order])
            del x
            release()
    shared = spark.sparkContext.broadcast(model)

    def predict(batches):
        machines = shared.value
        for batch in batches:
            has = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            lang, score = np.full(batch.num_rows, UNDETERMINED, dtype=object), np.zeros(batch.num_rows)
            for lo, hi, data, offsets in chunks(batch.column(1), rows=MATRIX_ROWS):
                if machines is not None:
                    lang[lo:hi], score[lo:hi] = machines.predict(feature_matrix(data, offsets))
            lang[~has], score[~has] = UNDETERMINED, 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array(lang, pa.string()), pa.array(score, pa.float64()), *batch.columns[4:]], names=["doc_id", "held_out", "lang_pred", "score", *batch.schema.names[4:]]
            )

    kept = [F.struct(*keep).alias("kept")] if keep else []
    asked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *kept)
    asked = asked.select("doc_id", "text", lettered.alias("lettered"), held_out_by(F.col("doc_id"), 4, 2).alias("held_out"), *(["kept"] if keep else []))
    schema = "doc_id long, held_out boolean, lang_pred string, score double" + (f", kept {dict(asked.dtypes)['kept']}" if keep else "")
    return asked.mapInArrow(lean(predict), schema)
