"""Operator 6, language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three letters (other characters become one space) are hashed into ``DIM``
features; a document's vector is its relative frequencies times idf. The weights are trained with
follow-the-regularised-leader (per-coordinate steps, elastic net, so most stay exactly zero) on a
bounded sample of the labelled rows, drawn per language so that a rare one is learned too, and a
temperature is fitted on a part of that sample kept aside. Prediction is one pass over whole texts, ``CHUNK`` code points at a time with the n-grams
across the cuts; the model, a table of fixed size, is broadcast.

Defined results: null text, or text without a letter, is ``und`` with score 0, as is everything
where no row has a label to learn from; repeated rows get equal answers; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import trim
from .shingles import row_chunks

#: Hashed features, and the bound on the labelled rows that the model is fitted on: each language
#: has an equal share of it, but ``LEAST`` rows at least (all of its rows, if they are fewer).
DIM, SAMPLE, LEAST = 1 << 15, 3000, 50
#: Code points of a training row at most; any text is read whole when it is judged.
LONGEST = 1 << 16
#: Label smoothing of the calibration, without which a sample read without error has no best temperature.
SMOOTH = 0.02
EPOCHS, ALPHA, BETA, L1, L2, SCALE = 3, 0.3, 1.0, 0.02, 0.01, 30.0
#: Code points that one step of prediction looks at together.
CHUNK = 1 << 16
_TABLE = 0x3000


def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(_TABLE)])


def _normal(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points with a blank for all but letters and text ends (0); which are letters; which are blanks."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters[np.minimum(cp, _TABLE - 1)] & (cp < _TABLE)
    for c in np.unique(cp[cp >= _TABLE]):
        if chr(c).isalpha():
            is_letter |= cp == c
    plain = np.where(is_letter | (cp == 0), cp, 32).astype(np.uint64)
    return plain, is_letter, plain == 32


def _hashed(x: np.ndarray) -> np.ndarray:
    """Feature ids of the 1-, 2- and 3-grams that start at each place; ``DIM``, a feature of no weight, where none does."""
    end = x == 0
    with np.errstate(over="ignore"):
        one = x * np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] ^ np.uint64(0x51)) * np.uint64(0xC2B2AE3D27D4EB4F) + one[1:]
        three = (two[:-1] ^ np.uint64(0x7F)) * np.uint64(0x165667B19E3779F9) + one[2:]
        stop2 = end[:-1] | end[1:]
        ids = np.full((len(x), 3), DIM, np.int32)
        for n, (h, bad) in enumerate(((one, end | (x == 32)), (two, stop2), (three, stop2[:-1] | end[2:]))):
            ids[: len(h), n] = np.where(bad, DIM, (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49))
    return ids


def ngram_features(texts: list[str | None], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids of all n-grams, each text's first place among them, and which texts have letters."""
    joined = "\0".join(f" {(t or '').lower()} ".replace("\0", " ") for t in texts) + "\0"
    x, is_letter, blank = _normal(joined, letters)
    keep = ~(blank & np.concatenate(([False], blank[:-1])))
    x, is_letter = x[keep], is_letter[keep]
    starts = np.concatenate(([0], np.flatnonzero(x == 0)[:-1] + 1))
    return _hashed(x), starts, np.add.reduceat(is_letter, starts) > 0


def sliced_features(text: str, letters: np.ndarray, size: int = CHUNK):
    """The same of one long text, ``size`` code points at a time: each n-gram with the slice it ends in."""
    low, carry = text.lower(), np.zeros(0, np.uint64)
    for at in range(0, len(low), size):
        part = low[at : at + size].replace("\0", " ")
        x, is_letter, blank = _normal(" " * (at == 0) + part + " " * (at + size >= len(low)), letters)
        before = np.concatenate(([len(carry) > 0 and carry[-1] == 32], blank[:-1]))
        x = np.concatenate((carry, x[~(blank & before)]))
        if len(x) < 3:
            x, known = np.concatenate((x, np.zeros(3 - len(x), np.uint64))), len(x)
        else:
            known = len(x)
        ids = _hashed(x)
        for n in range(3):
            ids[: max(0, len(carry) - n), n] = DIM
        yield ids, bool(is_letter.any())
        carry = x[:known][-2:]


@dataclass
class Model:
    languages: list[str]
    #: (DIM + 1) x languages: weight times idf and scale, the last row being zero.
    table: np.ndarray
    bias: np.ndarray
    temperature: float

    def scores(self, texts: list[str | None], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities, and which texts have a letter; more than ``CHUNK`` code points only alone."""
        if len(texts) == 1 and len(texts[0] or "") > CHUNK:
            total, used, any_letter = np.zeros((1, len(self.languages))), 0, False
            for ids, has_letter in sliced_features(texts[0], letters):
                total += sum(self.table[ids[:, n]].sum(axis=0, dtype=np.float64) for n in range(3))
                used, any_letter = used + int((ids != DIM).sum()), any_letter | has_letter
            return self.calibrated(total, np.array([used])), np.array([any_letter])
        ids, starts, has = ngram_features(texts, letters)
        total = np.zeros((len(texts), len(self.languages)))
        for n in range(3):
            total += np.add.reduceat(self.table[ids[:, n]], starts, axis=0, dtype=np.float64)
        return self.calibrated(total, np.add.reduceat((ids != DIM).sum(axis=1), starts)), has

    def calibrated(self, total: np.ndarray, used: np.ndarray) -> np.ndarray:
        return softmax((total / np.maximum(used, 1)[:, None] + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, str]], seed: int = 11) -> Model | None:
    """Fit on (text, language) rows; every fifth row only sets the temperature."""
    letters = _letters()
    rows = [r for r in rows if any(c.isalpha() for c in r[0])]
    if not rows:
        return None
    languages = sorted({lang for _, lang in rows})
    aside = [i % 5 == 4 and len(rows) >= 50 for i in range(len(rows))]
    docs, df = [], np.zeros(DIM + 1)
    for text, lang in rows:
        counts = np.zeros(DIM + 1, np.int64)
        for ids, _ in sliced_features(text, letters):
            counts += np.bincount(ids.ravel(), minlength=DIM + 1)
        f = np.flatnonzero(counts[:DIM])
        c = counts[f]
        df[f] += 1
        docs.append((f, c / c.sum(), languages.index(lang)))
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    k = len(languages)
    z, n, w = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))
    bias = np.zeros(k)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            if aside[i]:
                continue
            f, tf, y = docs[i]
            x = (tf * idf[f] * SCALE)[:, None]
            zf, nf = z[f], n[f]
            wf = np.where(np.abs(zf) <= L1, 0.0, (np.sign(zf) * L1 - zf) / ((BETA + np.sqrt(nf)) / ALPHA + L2))
            p = softmax((x * wf).sum(axis=0, keepdims=True) + bias)[0]
            p[y] -= 1
            bias -= 0.01 * p
            g = x * p
            z[f] = zf + g - (np.sqrt(nf + g * g) - np.sqrt(nf)) / ALPHA * wf
            n[f] = nf + g * g
    w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    table = w * idf[:, None] * SCALE
    table[DIM] = 0
    model = Model(languages, table.astype(np.float32), bias, 1.0)
    held = [d for d, a in zip(docs, aside, strict=True) if a]
    if held:
        logits = np.array([(table[f] * tf[:, None]).sum(axis=0) + bias for f, tf, _ in held])
        truth = np.array([y for _, _, y in held])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 120))
        goal = np.full(logits.shape, SMOOTH / k)
        goal[np.arange(len(truth)), truth] += 1 - SMOOTH
        loss = [-(goal * np.log(softmax(logits / t) + 1e-12)).sum(axis=1).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def fit(docs: DataFrame, learn: Column, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model | None:
    """Train on about ``sample`` labelled rows that ``learn`` admits, drawn per language by id and text.

    Texts beyond ``LONGEST`` code points are no training rows, unless a language has no others.
    """
    rows = docs.where(learn & F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), F.col(label_col).cast("string").alias("l"), (F.length(text_col) > LONGEST).alias("long")
    )
    counts = rows.groupBy("l").agg(F.count_if(~F.col("long")).alias("n"), F.count(F.lit(1)).alias("all")).collect()  # one row a language, as in the model
    if not counts:
        return None
    most = max(LEAST, sample // len(counts))
    share = {r["l"]: min(1.0, (most if r["n"] else 1) / (r["n"] or r["all"])) for r in counts}
    bounds = F.create_map(*(F.lit(x) for lang in sorted(share) for x in (lang, int(share[lang] * (1 << 30)) + 1)))
    few = rows.where(~F.col("long") | F.col("l").isin([r["l"] for r in counts if not r["n"]]))
    few = few.where(F.pmod(F.xxhash64("i", "t", F.lit("lang")), F.lit(1 << 30)) < F.element_at(bounds, F.col("l")))
    picked = few.select("i", "t", "l").limit(2 * most * len(counts)).collect()
    return train([(r["t"], r["l"]) for r in sorted(picked, key=lambda r: (r["i"] or "", r["t"]))])


def predict(docs: DataFrame, model: Model | None, columns: list[str], text_col: str = "text", answer: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``columns`` of the rows plus the language and its score (named by ``answer``), in one pass over whole texts.

    The text travels to Python once, also where it is one of ``columns``.
    """
    parts = None if model is None else (model.languages, model.table, model.bias, model.temperature)
    shared = docs.sparkSession.sparkContext.broadcast(parts)  # at most some MB, whatever the input
    sent = columns if text_col in columns else [*columns, text_col]
    kept = docs.select(*sent)
    schema = kept.select(*columns).withColumns({answer[0]: F.lit(""), answer[1]: F.lit(0.0)}).schema
    place = sent.index(text_col)

    def judge(batches):
        letters, m = _letters(), shared.value and Model(*shared.value)
        for batch in batches:
            column = batch.column(place)
            upto = np.concatenate(([0], np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))))
            pred, score = ["und"] * len(column), [0.0] * len(column)
            for i, j in row_chunks(upto, CHUNK) if m is not None else ():
                p, has = m.scores(column.slice(i, j - i).to_pylist(), letters)
                for r in np.flatnonzero(has).tolist():
                    best = int(p[r].argmax())
                    pred[i + r], score[i + r] = m.languages[best], float(p[r, best])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(columns))), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*columns, *answer])
        trim()

    return kept.mapInArrow(judge, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``."""
    model = fit(docs, ~held_out())
    return predict(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])
