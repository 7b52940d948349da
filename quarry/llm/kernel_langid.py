"""Language identification with a string kernel.

A text becomes the set of its n-grams of 1 to ORDERS symbols (blended spectrum):
lower-cased letters and marks, everything else a single space, a space at both
ends. The presence kernel of two texts is the number of grams both have, divided
by the root of the product of their own numbers. Grams are compared exactly; the
gram space is the VOCAB most shared grams of the landmark texts.

Nystroem: the kernel to LANDMARKS landmark texts, times the inverse root of the
landmarks' own kernel matrix, gives each text a short vector. One-versus-rest
kernel ridge regression (targets 1 and -1, bias) is solved on these vectors; its
normal equations are sums over training texts, added up per task. A batch of
texts is scored by two matrix products: presence rows with landmark rows, and
kernel rows with the weights of all languages.

The fit uses a bounded sample, a documented parameter: at most TRAIN_TEXTS
distinct texts of labelled rows, the same number per language, those of least
text hash; whole texts. Distinct texts are counted per language and hash, so
copies weigh once. Prediction reads every whole text, long ones in slices.

Defined cases: a null text or one without a letter (Unicode category L) is
``und`` with score 0, and so is every text when no labelled text has a letter; a text
whose grams are all unknown is predicted by the bias alone; equal scores go to
the first language by name; repeated rows are scored each; an empty table gives
an empty result; columns of other names are not read.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import materialise

ORDERS = 3
LANDMARKS = 192
TRAIN_TEXTS = 4000
VOCAB = 32_768
RIDGE = 1e-4
UNKNOWN = "und"
SLICE = 1 << 19
ROWS = 128
_SPACE = 32
#: Bits of a code point: three fit into one 64-bit gram key. Code point 0 is
#: mapped to a space, so grams of different length never share a key.
_BITS = 21
#: Ends a block of symbols that is followed by another one.
_BREAK = np.array([_SPACE, _SPACE], np.uint64)


@lru_cache(maxsize=1)
def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: the symbol it stands for, and whether it is a letter."""
    kinds = [unicodedata.category(chr(i))[0] for i in range(0x110000)]
    letter = np.array([k == "L" for k in kinds])
    word = np.array([k in "LM" for k in kinds])
    return np.where(word, np.arange(0x110000), _SPACE).astype(np.uint64), letter


def gram_keys(symbols: np.ndarray, order: int) -> np.ndarray:
    """The key of the gram that starts at each position."""
    n = max(0, len(symbols) - order + 1)
    key = symbols[:n].copy()
    for i in range(1, order):
        key = (key << np.uint64(_BITS)) | symbols[i: i + n]
    return key


def text_symbols(texts: list[str]) -> Iterator[tuple[np.ndarray, bool]]:
    """(symbols, whether there is a letter) of each text."""
    symbol, letter = _symbols()
    for text in texts:
        raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        word = symbol[raw]
        kept = (word != _SPACE) | np.concatenate([[True], word[:-1] != _SPACE])
        yield word[kept], bool(letter[raw].any())


class GramIndex:
    """Positions of gram keys in a vocabulary: hash tables tried one after the
    other, each holding the keys that collided in those before."""

    MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys.astype(np.uint64), np.uint64(0))  # the last: no gram has key 0
        self.size = len(keys)
        self.tables: list[tuple[np.uint64, np.uint64, np.ndarray]] = []
        rest, n = np.arange(self.size), 0
        while len(rest):
            bits = max(8, math.ceil(math.log2(32 * len(rest))))
            multiplier, shift = np.uint64(self.MULTIPLIERS[n % 4] + 2 * (n // 4)), np.uint64(64 - bits)
            table = np.full(1 << bits, self.size, np.int32)
            at = (self.keys[rest] * multiplier) >> shift
            table[at[::-1]] = rest[::-1]
            self.tables.append((multiplier, shift, table))
            rest, n = rest[table[at] != rest], n + 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, ``size`` for unknown ones."""
        if not self.tables:
            return np.full(len(keys), self.size, np.int32)
        multiplier, shift, table = self.tables[0]
        out = table[(keys * multiplier) >> shift]
        miss = np.flatnonzero(self.keys[out] != keys)
        out[miss] = self.size
        for multiplier, shift, table in self.tables[1:]:
            got = table[(keys[miss] * multiplier) >> shift]
            hit = self.keys[got] == keys[miss]
            out[miss[hit]], miss = got[hit], miss[~hit]
        return out


def presence(texts: list[str], index: GramIndex) -> tuple[np.ndarray, np.ndarray]:
    """(0/1 rows over the vocabulary, whether each text has a letter)."""
    out = np.zeros((len(texts), index.size + 1), np.float32)
    flat, letters = out.reshape(-1), np.zeros(len(texts), bool)
    held: list[np.ndarray] = []
    rows: list[int] = []

    def put() -> None:
        symbols = np.concatenate(held)
        row = np.repeat(np.array(rows, np.int64) * (index.size + 1), [len(h) for h in held])
        for order in range(1, ORDERS + 1):
            key = gram_keys(symbols, order)
            flat[row[: len(key)] + index.find(key)] = 1
        held.clear()
        rows.clear()

    total = 0
    for i, (symbols, has) in enumerate(text_symbols(texts)):
        letters[i] = has
        for lo in range(0, len(symbols), SLICE):
            # A slice starts with the last symbols of the one before. No text has two spaces in a row,
            # so no gram that reaches over the break is in the vocabulary.
            held.append(np.append(symbols[max(0, lo - ORDERS + 1): lo + SLICE], _BREAK))
            rows.append(i)
            total += len(held[-1])
            if total >= SLICE:
                put()
                total = 0
    if held:
        put()
    return out[:, : index.size], letters


@dataclass
class KernelModel:
    languages: list[str]
    keys: np.ndarray  # vocabulary
    landmarks: np.ndarray  # packed bits, one row per landmark
    weights: np.ndarray  # landmark kernel -> language scores
    bias: np.ndarray

    def _ready(self) -> tuple[GramIndex, np.ndarray, np.ndarray]:
        if "_cache" not in self.__dict__:
            rows = np.unpackbits(self.landmarks, axis=1, count=len(self.keys)).astype(np.float32)
            self.__dict__["_cache"] = GramIndex(self.keys), np.ascontiguousarray(rows.T), np.sqrt(rows.sum(axis=1))
        return self.__dict__["_cache"]

    def kernel(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(kernel to every landmark, whether each text has a letter)."""
        index, landmarks, norms = self._ready()
        rows, letters = presence(texts, index)
        own = np.sqrt(rows.sum(axis=1, dtype=np.float64))
        shared = (rows @ landmarks).astype(np.float64)  # whole numbers: exact
        return shared / np.maximum(own, 1)[:, None] / np.maximum(norms, 1)[None, :], letters

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        k, letters = self.kernel(texts)
        return np.clip((k @ self.weights + self.bias + 1) / 2, 0, 1).round(9), letters


def _sample(train: DataFrame, per_language: dict[str, int]) -> DataFrame:
    """(lang, h, text): of each language the distinct texts of least hash, at
    most the given number; stored. ``train``: lang, text."""
    spark = train.sparkSession
    hashed = train.select("lang", "text", F.xxhash64("text").alias("h"))
    keys = materialise(hashed.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n")).drop("n"))
    counts = {r["lang"]: r["n"] for r in keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Twice the share that is wanted, then the least hashes of that bounded rest.
    share = spark.createDataFrame([(g, min(1.0, 2 * per_language[g] / n + 30 / n), per_language[g]) for g, n in counts.items()],
                                  "lang string, share double, most long")
    place = F.pmod(F.xxhash64("h"), F.lit(1 << 32)) / float(1 << 32)
    near = keys.join(F.broadcast(share), "lang").where(place < F.col("share"))
    first = Window.partitionBy("lang").orderBy(place, "h")
    chosen = near.withColumn("i", F.row_number().over(first)).where("i <= most").select("lang", "h", "i")
    chosen = materialise(chosen)  # at most the sum of ``per_language`` rows
    found = hashed.join(F.broadcast(chosen), ["lang", "h"])
    return materialise(found.groupBy("lang", "h", "i").agg(F.min("text").alias("text")))


def _landmark_rows(texts: DataFrame) -> DataFrame:
    """(no, key): the distinct grams of every landmark text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for no, (symbols, _) in zip(b.column(0).to_pylist(), text_symbols(b.column(1).to_pylist()), strict=True):
                keys = np.unique(np.concatenate([np.unique(gram_keys(symbols, n)) for n in range(1, ORDERS + 1)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), no, np.int32)), pa.array(keys.astype(np.int64))], names=["no", "key"])

    return texts.select("no", "text").mapInArrow(run, "no int, key long")


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", train_texts: int = TRAIN_TEXTS,
        landmarks: int = LANDMARKS, vocab: int = VOCAB) -> KernelModel | None:
    """A model of the labelled rows; None when no row has a language and a letter."""
    spark = labelled.sparkSession
    train = labelled.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    train = train.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    languages = sorted(r["lang"] for r in train.select("lang").distinct().collect())  # one row per language
    if not languages:
        return None
    most = max(1, train_texts // len(languages))
    sample = _sample(train, dict.fromkeys(languages, most))
    # The first texts of each language are landmarks, too; a bounded table.
    each = max(1, landmarks // len(languages))
    marks = materialise(sample.where(F.col("i") <= each).select(
        (F.row_number().over(Window.orderBy("lang", "i")) - 1).alias("no"), "text"))
    grams = materialise(_landmark_rows(marks.repartition(8, "no")))
    common = grams.groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(vocab)
    keys = np.sort(np.array([r["key"] for r in common.select("key").collect()], np.int64).astype(np.uint64))
    table = spark.createDataFrame([(int(k), i) for i, k in enumerate(keys)], "key long, at int")
    numbers = grams.join(F.broadcast(table), "key").groupBy("no").agg(F.collect_list("at").alias("at")).orderBy("no").collect()
    rows = np.zeros((len(numbers), len(keys)), np.uint8)
    for i, r in enumerate(numbers):
        rows[i, r["at"]] = 1
    model = KernelModel(languages, keys, np.packbits(rows, axis=1), np.zeros((len(rows), 0)), np.zeros(0))
    norms = np.sqrt(rows.sum(axis=1, dtype=np.float64))
    own = (rows.astype(np.float32) @ rows.T.astype(np.float32)).astype(np.float64) / norms[:, None] / norms[None, :]
    value, vector = np.linalg.eigh(own)
    good = value > 1e-6 * value[-1]
    root = vector[:, good] / np.sqrt(value[good])[None, :]  # inverse root of the landmark kernel
    gram, moment, number = _normal_equations(sample, model, root)
    penalty = np.diag(np.append(np.full(root.shape[1], RIDGE * number), 1e-9))
    solved = np.linalg.solve(gram + penalty, moment)
    model.weights, model.bias = root @ solved[:-1], solved[-1]
    return model


def _normal_equations(sample: DataFrame, model: KernelModel, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums over the training texts, added up per task; the driver adds one
    bounded row per task, in the order of the tasks."""
    width, classes = root.shape[1] + 1, len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, moment, number = np.zeros((width, width)), np.zeros((width, classes)), 0
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo in range(0, len(texts), ROWS):
                k, _ = model.kernel(texts[lo: lo + ROWS])
                x = np.concatenate([k @ root, np.ones((len(k), 1))], axis=1)
                y = np.full((len(k), classes), -1.0)
                y[np.arange(len(k)), [model.languages.index(g) for g in langs[lo: lo + ROWS]]] = 1
                gram, moment, number = gram + x.T @ x, moment + x.T @ y, number + len(k)
        yield pa.RecordBatch.from_arrays([pa.array([gram.ravel()]), pa.array([moment.ravel()]), pa.array([number])],
                                         names=["gram", "moment", "number"])

    spread = sample.repartitionByRange(8, "h", "lang").sortWithinPartitions("h", "lang").select("lang", "text")
    parts = spread.mapInArrow(run, "gram array<double>, moment array<double>, number long").collect()
    return (sum(np.array(r["gram"]).reshape(width, width) for r in parts),
            sum(np.array(r["moment"]).reshape(width, classes) for r in parts), sum(r["number"] for r in parts))


def predict(docs: DataFrame, model: KernelModel | None, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns, lang_pred and score of every row."""
    cols = docs.select(*keep, F.col(f"`{text_col}`").alias("_q_text"))
    names = cols.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                lang, score = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                if model is not None:
                    got, letters = model.scores([t or "" for t in part.column(len(names)).to_pylist()])
                    best = got.argmax(axis=1)
                    score = np.where(letters, got.max(axis=1), 0.0)
                    lang = [model.languages[j] if has else UNKNOWN for j, has in zip(best, letters, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(names)], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    names=[*names, "lang_pred", "score"])

    return cols.mapInArrow(run, f"{schema}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score. Rows whose crc32 of the decimal id is
    2 modulo 4 are held out; a null id is not."""
    held = F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs.where(~held), text_col, lang_col)
    return predict(docs, model, [F.col(f"`{id_col}`").alias("doc_id"), held.alias("held_out")], text_col)
