"""Language identification by a string kernel.

The kernel of two texts is the number of character n-grams (n = 1..4, the blended spectrum,
by presence) that both hold, over the geometric mean of their numbers. N-grams are taken from
lower-cased letters, a run of other characters counting as one blank, and are hashed to
``2**bits`` places. Nystroem landmarks give a finite feature space in which one-versus-rest
kernel ridge regression is solved; the map of a text to all class values is linear in its
n-gram presence, so ``landmarks' . weights`` is multiplied out once and texts are scored ``ROWS`` at
a time by one product of their presence matrix with it.

Fitting takes a bounded sample, by hash order of the ids: ``per_language`` rows a language,
``max_rows`` in all. Scoring reads whole texts of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lectern.llm._text import one_blas_thread

UNDETERMINED = "und"
_letters: list[np.ndarray] = []
#: Bytes of packed presence that fitting unpacks at once.
_BLOCK = 512
#: Texts of a presence matrix (4 * 2**bits bytes each).
ROWS = 64
_G, _P = np.uint32(0x9E3779B1), np.uint32(0x01000193)


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _presence(text: str | None, bits: int, longest: int, seen: np.ndarray) -> np.ndarray | None:
    """Sorted places of the text's n-grams; None if it has no letter. ``seen``: all False, and so again."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[code]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    code = np.where(letter, code, np.uint32(32))[keep]
    code = np.concatenate((np.array([32], np.uint32), code))
    gram, shift = code.copy(), np.uint32(32 - bits)
    for n in range(1, longest + 1):
        if n > 1:
            if len(gram) < 2:
                break
            gram = gram[:-1] * _P + code[n - 1 :]
        seen[((gram + np.uint32(n)) * _G) >> shift] = True
    places = np.flatnonzero(seen)
    seen[places] = False
    return places


@dataclass
class KernelModel:
    languages: list[str]
    weights: np.ndarray  # 2**bits x languages
    bits: int
    longest: int
    sharpness: float = 6.0

    def values(self, rows: list[np.ndarray]) -> np.ndarray:
        """Class values of texts from their places, at most ``ROWS`` at a time."""
        held = np.zeros((min(ROWS, len(rows)), 1 << self.bits), np.float32)
        out = []
        for low in range(0, len(rows), ROWS):
            part = rows[low : low + ROWS]
            for x, places in zip(held, part):
                x[places] = 1
            size = np.array([len(p) for p in part], np.float64)
            out.append((held[: len(part)] @ self.weights).astype(np.float64) / np.sqrt(size)[:, None])
            for x, places in zip(held, part):
                x[places] = 0
        return np.concatenate(out)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        seen = np.zeros(1 << self.bits, bool)
        names, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        rows, where = [], []

        def decide() -> None:
            value = self.values(rows)
            power = np.exp(self.sharpness * (value - value.max(1, keepdims=True)))
            best = value.argmax(1)
            chance = power[np.arange(len(best)), best] / power.sum(1)
            for i, k, p in zip(where, best, chance):
                names[i], score[i] = self.languages[k], p
            rows.clear()
            where.clear()

        for i, text in enumerate(texts if self.languages else []):
            places = _presence(text, self.bits, self.longest, seen)
            if places is not None:
                rows.append(places)
                where.append(i)
                if len(rows) == ROWS:
                    decide()
        if rows:
            decide()
        return names, score


def fit_presence(rows: list[tuple[str, bytes]], bits: int, longest: int, landmarks: int, ridge: float) -> KernelModel:
    """Fit on (language, packed presence) rows, in the given order. ``landmarks``: of the rows, taken evenly."""
    languages = sorted({name for name, _ in rows})
    if not languages:
        return KernelModel([], np.zeros((1 << bits, 0), np.float32), bits, longest)
    packed = np.frombuffer(b"".join(b for _, b in rows), np.uint8).reshape(len(rows), -1)
    size = np.sqrt(np.maximum(np.bitwise_count(packed).sum(1, dtype=np.int64), 1)).astype(np.float32)[:, None]
    y = np.array([[1.0 if name == k else -1.0 for k in languages] for name, _ in rows])
    mark = np.linspace(0, len(rows) - 1, min(landmarks, len(rows))).astype(int)
    # presence rows are unpacked a block of places at a time, so that they never stand whole in memory
    part = lambda j: np.unpackbits(packed[:, j : j + _BLOCK], axis=1).astype(np.float32) / size
    blocks = range(0, packed.shape[1], _BLOCK)
    nm = np.zeros((len(rows), len(mark)))
    for j in blocks:
        x = part(j)
        nm += x @ x[mark].T
    value, vector = np.linalg.eigh(nm[mark])
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = nm @ root
    solved = np.linalg.solve(phi.T @ phi + ridge * np.eye(phi.shape[1]), phi.T @ y)
    weights = np.concatenate([part(j)[mark].T @ (root @ solved) for j in blocks]).astype(np.float32)
    return KernelModel(languages, weights, bits, longest)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, per_language: int = 120, max_rows: int = 600, bits: int = 16, longest: int = 4, landmarks: int = 192, ridge: float = 0.1) -> KernelModel:
    """Fit on a sample of ``labelled``: rows with an id, a text with a letter and a language.

    The sample is bounded by ``per_language`` and ``max_rows``, taken by a hash of the id; only
    hashed presence bits of it reach the driver (8 KB a row).
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("id is not null and text is not null and lang is not null")
    order = Window.partitionBy("lang").orderBy("k", "id")
    few = rows.select("id", "lang", F.xxhash64(F.col("id").cast("string")).alias("k")).withColumn("r", F.dense_rank().over(order)).filter(F.col("r") <= per_language).distinct()
    chosen = sorted((r["lang"], r["id"]) for r in few.orderBy("r", "k", "lang", "id").limit(max_rows).collect())
    if not chosen:
        return fit_presence([], bits, longest, landmarks, ridge)

    def bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            got = []
            for key, text, lang in zip(*(batch.column(i).to_pylist() for i in range(3))):
                places = _presence(text, bits, longest, seen)
                if places is not None:
                    flags = np.zeros(1 << bits, bool)
                    flags[places] = True
                    got.append((str(key), lang, np.packbits(flags).tobytes()))
            yield pa.RecordBatch.from_pylist([dict(zip(("id", "lang", "bits"), g)) for g in got], pa.schema([("id", pa.string()), ("lang", pa.string()), ("bits", pa.binary())]))

    # of rows with one id and language the least text counts, so that the sample does not hang on their order
    mine = rows.filter(F.col("id").isin([i for _, i in chosen])).groupBy("id", "lang").agg(F.min("text").alias("text")).select("id", "text", "lang")
    pairs = set((lang, str(i)) for lang, i in chosen)
    sample = sorted((r["lang"], r["id"], bytes(r["bits"])) for r in mine.mapInArrow(bits_of, "id string, lang string, bits binary").toLocalIterator() if (r["lang"], r["id"]) in pairs)
    return fit_presence([(lang, flags) for lang, _, flags in sample], bits, longest, landmarks, ridge)


def identify(docs: DataFrame, model: KernelModel, text_col: str = "text", *, pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its share (0 to 1) among the learned ones.

    A null text, a text without letters, and any text under a model that has learned nothing get
    ``und`` and 0. Repeated rows get equal results; other columns pass through (one named like
    ``pred_col`` or ``score_col`` is replaced); an empty table gives an empty one.
    """
    kept = docs.drop(pred_col, score_col)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = kept.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        for batch in batches:
            names, value = held.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(value)], [*batch.schema.names, pred_col, score_col])

    schema = StructType([*kept.schema.fields, StructField(pred_col, StringType()), StructField(score_col, DoubleType())])
    return kept.mapInArrow(score, schema)


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id's text, modulo 4, is 2; False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
