"""Language identification by hierarchical discrimination: the family first, then the language within it.

Features are hashed counts of byte 1-, 2- and 3-grams of the whole text (A-Z folded, ASCII other than letters read
as space), damped and scaled to length one. One linear support vector machine per family, each against the rest, picks
the family; inside it one machine per language against its siblings picks the language. Machines are fitted by
accelerated gradient descent on the squared hinge loss.

Fitting uses a bounded sample: ``SAMPLE`` documents in all, shared evenly by the languages and drawn by hash. Everything
else runs over all documents, on whole texts, with no state beyond the weights (``DIMENSIONS`` floats a machine).

Edge cases: a text that is null or has no letter is ``und`` with score 0; without any labelled document everything is
``und``; a language missing from ``FAMILIES`` is a family of its own; a family of one language needs no second step;
repeated rows get equal answers; other columns ride in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog_audit.llm.sampling import per_class
from catalog_audit.llm.text import slices

DIMENSIONS = 4096
SAMPLE = 4000
ROWS = 256
#: Languages by family. Others stand alone.
FAMILIES = {"en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
            "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance"}
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def features(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of DIMENSIONS per text."""
    n = len(bounds) - 1
    own = _FOLD[data].astype(np.uint32)
    row = np.repeat(np.arange(n), np.diff(bounds))
    out = np.zeros(n * DIMENSIONS)
    code = np.zeros(len(own), np.uint32)
    for k in range(3):
        m = len(own) - k
        if m <= 0:
            break
        code = code[:m] * np.uint32(257) + own[k:] + np.uint32(1)
        whole = (row[:m] == row[k:]) & (own[:m] != 32) | (row[:m] == row[k:]) & (own[k:] != 32)
        bucket = (code * np.uint32(2654435761) + np.uint32(k * 40503)) >> np.uint32(20)
        out += np.bincount(row[:m][whole] * DIMENSIONS + bucket[whole], minlength=n * DIMENSIONS)
    out = np.sqrt(out.reshape(n, DIMENSIONS)).astype(np.float32)
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-9)


@F.arrow_udf(T.BinaryType())
def _vector(texts: pa.Array) -> pa.Array:
    rows = []
    for _, _, data, bounds in slices(texts, rows=ROWS):
        rows += [v.tobytes() for v in features(data, bounds)]
    return pa.array(rows, pa.binary())


def fit_svm(x: np.ndarray, y: np.ndarray, classes: list[str], strength: float = 30.0, steps: int = 120) -> np.ndarray:
    """(DIMENSIONS + 1, classes): one machine per class against the rest, classes weighted alike."""
    target = np.where(y[:, None] == np.array(classes)[None, :], 1.0, -1.0).astype(np.float32)
    weight = np.where(target > 0, 0.5 / np.maximum((target > 0).sum(0), 1), 0.5 / np.maximum((target < 0).sum(0), 1)).astype(np.float32)
    w = np.zeros((x.shape[1] + 1, len(classes)), np.float32)
    ahead, rate = w.copy(), 1.0 / (1.0 + 2.0 * strength)
    for step in range(steps):
        gap = np.maximum(0.0, 1.0 - target * (x @ ahead[:-1] + ahead[-1]))
        slope = -2.0 * strength * target * gap * weight
        grad = np.vstack([x.T @ slope + ahead[:-1] / len(x), slope.sum(0, keepdims=True)])
        new = ahead - rate * grad
        ahead = new + step / (step + 3.0) * (new - w)
        w = new
    return w


class LanguageModel:
    """``within`` has for each family its languages and the machine of each pair (i, j); a positive margin votes for i."""

    def __init__(self, families: list[str], top: np.ndarray, within: dict[str, tuple[list[str], dict[tuple[int, int], np.ndarray]]]):
        self.families, self.top, self.within = families, top, within

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        margin = x @ self.top[:-1] + self.top[-1]
        best = margin.argmax(1)
        score = _chance(margin[np.arange(len(x)), best]) if len(self.families) > 1 else np.ones(len(x))
        name = np.empty(len(x), object)
        for k, family in enumerate(self.families):
            at = np.flatnonzero(best == k)
            if len(at):
                langs, machines = self.within[family]
                pick, chance = voted(x[at], len(langs), machines)
                name[at] = np.array(langs, object)[pick]
                score[at] *= chance
        return name, score


def voted(x: np.ndarray, languages: int, machines: Mapping[tuple[int, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(language, chance) by the votes of all pairs; the chance is that of the winner's narrowest duel."""
    votes, sums = np.zeros((2, len(x), languages))
    narrow = np.full((len(x), languages), np.inf)
    for (i, j), w in machines.items():
        margin = (x @ w[:-1] + w[-1])[:, 0].astype(np.float64)
        votes[:, i] += margin > 0
        votes[:, j] += margin <= 0
        sums[:, i] += margin
        sums[:, j] -= margin
        narrow[:, i] = np.minimum(narrow[:, i], margin)
        narrow[:, j] = np.minimum(narrow[:, j], -margin)
    pick = np.where(votes == votes.max(1, keepdims=True), sums, -np.inf).argmax(1)
    return pick, np.where(languages > 1, _chance(narrow[np.arange(len(x)), pick]), 1.0)


def fit_pairs(x: np.ndarray, y: np.ndarray, langs: list[str]) -> dict[tuple[int, int], np.ndarray]:
    """One machine for every two languages, from their rows alone."""
    out = {}
    for i, a in enumerate(langs):
        for j in range(i + 1, len(langs)):
            at = (y == a) | (y == langs[j])
            out[i, j] = fit_svm(x[at], y[at], [a])
    return out


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-3.0 * np.clip(margin.astype(np.float64), -30, 30)))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE,
        families: Mapping[str, str] | None = None) -> LanguageModel | None:
    """Fit on a bounded sample of ``labelled``; None if no row has a language."""
    families = FAMILIES if families is None else families
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("key"))
    drawn = per_class(known, "lang", sample, "key").dropDuplicates(["lang", "key"]).select("lang", "key", _vector("text").alias("v")).toPandas().sort_values(["lang", "key"])
    if not len(drawn):
        return None
    x = np.frombuffer(b"".join(drawn["v"]), np.float32).reshape(-1, DIMENSIONS)
    y = drawn["lang"].to_numpy()
    family = np.array([families.get(v, v) for v in y], object)
    names = sorted(set(family))
    within = {}
    for f in names:
        at = family == f
        langs = sorted(set(y[at]))
        within[f] = (langs, fit_pairs(x[at], y[at], langs))
    return LanguageModel(names, fit_svm(x, family, names), within)


def identify(docs: DataFrame, model: LanguageModel | None, text: str = "text", keep: tuple[str, ...] = ("*",)) -> DataFrame:
    """(row, lang_pred, score) of every document, from its text alone."""
    own = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text"))
    if model is None:
        return own.select("row", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        for _, _, data, bounds in slices(texts, rows=ROWS):
            name, score = sent.value.predict(features(data, bounds))
            names += name.tolist()
            scores += score.tolist()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    told = own.select("row", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("written"), predict("text").alias("p"))
    return told.select("row", F.when(F.col("written"), F.col("p.lang")).otherwise("und").alias("lang_pred"),
                       F.when(F.col("written"), F.col("p.score")).otherwise(0.0).alias("score"))


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.crc32(doc_id.cast("string")) % folds == fold
