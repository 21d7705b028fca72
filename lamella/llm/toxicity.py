"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words sums, over the subsequences of three letters they share, the decayed widths of
the windows in which the letters stand, so letters may be skipped or inserted. Kernel values to a few landmark
words, whitened by the landmarks' own kernel matrix (Nyström), are the features of a linear
machine with squared hinge loss. A document is a bag of words: its sentences inherit its
label, in a toxic bag the most telling word is the witness, and a document scores as its worst word.
As the kernel is an inner product of explicit subsequence counts, the machine folds into one
table of weights a subsequence, of fixed size, and scoring a word needs no landmarks.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.bpe import slices
from lamella.llm.common import memory, py, settle, table

#: Labelled documents that are learned from, at most: those with the smallest hashes of doc_id.
TRAIN_DOCUMENTS = 20_000
#: Distinct words of toxic and of clean documents that the machine is fitted to, at most, and landmarks.
WITNESSES, CLEAN_WORDS, MINED, LANDMARKS = 1_500, 10_000, 4_000, 240
#: Decay of a skipped letter, and the widest window of a subsequence.
DECAY, WINDOW = 0.7, 6
#: Letters in one scored piece of a word; longer words are scored in pieces that overlap by half.
PIECE = 24
RIDGE = 1e-3
#: Letters of the stretches by which witnesses are found.
GRAM = 5
#: A stretch counts if its evidence exceeds so many times the logarithm of the number of stretches.
SURE = 1.5
HOLD_OUT = 5
MEMORY = 300_000
CLASSES = 64
#: Letters with a class of their own; any other letter shares one of the remaining classes.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâäçèéêëìíîïñòóôöùúûüœæ"
START = CLASSES - 1
GAPS = [(i, j) for i in range(1, WINDOW) for j in range(i + 1, WINDOW)]


class _Classes(dict):
    def __missing__(self, c: str) -> int:
        k = self[c] = (LETTERS.index(c) + 1 if c in LETTERS else len(LETTERS) + 1 + ord(c) % (START - len(LETTERS) - 1)) if c.isalpha() else 0
        return k


@lru_cache(maxsize=1)
def _classes() -> _Classes:
    return _Classes()


def letters(words: list[str]) -> np.ndarray:
    """Letter classes of words, a row each, after a start mark; anything but letters is left out."""
    get = _classes().__getitem__
    rows = [[START, *filter(None, map(get, w[: 4 * PIECE]))][: PIECE + 1] for w in words]
    out = np.zeros((len(rows), max(map(len, rows), default=1) + WINDOW), np.int32)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def pieces(word: str) -> list[str]:
    """A word, or its overlapping pieces if it is long."""
    return [word] if len(word) <= PIECE else [word[i : i + PIECE] for i in range(0, len(word) - PIECE // 2, PIECE // 2)]


def subsequences(rows: np.ndarray):
    """(codes, weights) of the subsequences of each row, by gap pattern; weight 0 where letters lack."""
    n = rows.shape[1] - WINDOW
    for i, j in GAPS:
        a, b, c = rows[:, :n], rows[:, i : i + n], rows[:, j : j + n]
        yield (a * CLASSES + b) * CLASSES + c, ((a > 0) & (b > 0) & (c > 0)) * np.float32(DECAY ** (j - 2))


def dot(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Kernel sums of words with a table of weights a subsequence, over the words' own norms."""
    total, norm = np.zeros(len(rows)), np.zeros(len(rows))
    for codes, w in subsequences(rows):
        total += (weights[codes] * w).sum(axis=1)
        norm += (w * w).sum(axis=1)
    return total / np.sqrt(np.maximum(norm, 1e-9))


def embedding(word: str) -> np.ndarray:
    """The explicit subsequence counts of one word, as a table of CLASSES ** 3."""
    out = np.zeros(CLASSES**3, np.float32)
    norm = 0.0
    for codes, w in subsequences(letters([word])):
        np.add.at(out, codes[0], w[0])
        norm += float((w * w).sum())
    return out / np.sqrt(max(norm, 1e-9))


def fit(positive: list[str], negative: list[str]) -> tuple[np.ndarray, float]:
    """(weights a subsequence, bias) of the machine that tells the words apart."""
    words = [*positive, *negative]
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    half = LANDMARKS // 2
    marks = [*positive[:: max(1, len(positive) // half)][:half], *negative[:: max(1, len(negative) // half)][:half]]
    rows, own = letters(words), letters(marks)
    # one landmark's table at a time: all of them would fill the driver
    k, kk = (np.stack(c, axis=1) for c in zip(*((dot(rows, t), dot(own, t)) for t in map(embedding, marks))))
    vals, vecs = np.linalg.eigh((kk + kk.T) / 2)
    keep = vals > 1e-6 * vals.max()
    white = vecs[:, keep] / np.sqrt(vals[keep])
    z = np.c_[k @ white, np.ones(len(words))]
    cost = np.where(y > 0, len(y) / (2 * max(1, len(positive))), len(y) / (2 * max(1, len(negative))))
    ridge = RIDGE * len(y) * np.eye(z.shape[1])
    ridge[-1, -1] = 1e-9
    w = np.zeros(z.shape[1])
    inside = np.ones(len(y), bool)
    for _ in range(50):
        zi = z[inside] * cost[inside, None]
        w = np.linalg.solve(ridge + zi.T @ z[inside], zi.T @ y[inside])
        now = y * (z @ w) < 1
        if (now == inside).all():
            break
        inside = now
    alpha = white @ w[:-1]
    return sum(np.float32(a) * t for a, t in zip(alpha, map(embedding, marks))).astype(np.float32), float(w[-1])


def words_of(text: str | None) -> set[str]:
    """Distinct lower-case words of a text, and the words that runs of three or more single letters spell."""
    words = (text or "").lower().split()
    out = set(words)
    ones = [i for i, w in enumerate(words) if len(w) == 1 and w.isalpha()]
    run: list[int] = []
    for i in [*ones, -9]:
        if run and i != run[-1] + 1:
            if len(run) > 2:
                out.update(pieces("".join(words[k] for k in run)))
            run = []
        run.append(i)
    return out


def worst(texts: list[str | None], weights: np.ndarray, bias: float, known: dict) -> list[float]:
    """The score of each text's worst word; the machine's bias for a text without words."""
    bags = [words_of(t) for t in texts]
    fresh = list(set().union(*bags).difference(known)) if bags else []
    if len(known) + len(fresh) > MEMORY:
        known.clear()
        fresh = list(set().union(*bags))
    for a in range(0, len(fresh), 20_000):
        part = fresh[a : a + 20_000]
        cut = [(i, p) for i, w in enumerate(part) for p in pieces(w)]
        score = np.full(len(part), -np.inf)
        np.maximum.at(score, [i for i, _ in cut], dot(letters([p for _, p in cut]), weights) + bias)
        known.update(zip(part, score.tolist()))
    return [max(map(known.__getitem__, b), default=bias) for b in bags]


def _sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def calibrate(margins: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from margins to probabilities, by Newton's method on smoothed labels."""
    n1, n0 = toxic.sum(), (~toxic).sum()
    y = np.where(toxic, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.c_[margins, np.ones(len(margins))]
    w = np.array([1.0, 0.0])
    for _ in range(60):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - y))
        w -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def held_out(column: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(HOLD_OUT)) == 0


def _margins(docs: DataFrame, weights, bias: float) -> DataFrame:
    """Each row of ``docs`` with the margin of its ``text``'s worst word."""
    model = uuid.uuid4().hex
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        known = memory(model)
        for part in slices(batches, "text"):
            yield part.append_column("margin", pa.array(worst(part.column("text").to_pylist(), held.value, bias, known), pa.float64()))

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return py(docs.sparkSession, docs, run, f"{names}, margin double")


def train(docs: DataFrame, labels: DataFrame):
    """(weights, bias, slope, offset) from documents (doc_id, text) and labels (doc_id, toxic), or None without both classes.

    Only doc_id's outside the hold-out count, at most TRAIN_DOCUMENTS of them. A doc_id that several
    labels mark is toxic if any says so; null labels are left out.
    """
    marked = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    chosen = settle(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCUMENTS), "chosen")
    bags = settle(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic"), "bags")  # chosen has a bound

    def split(batches):
        for part in slices(batches, "text"):
            each = [[p for w in words_of(t) for p in pieces(w)] for t in part.column("text").to_pylist()]
            n = [len(x) for x in each]
            i = pa.array(np.repeat(np.arange(len(n)), n), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(i), part.column("toxic").take(i), pa.array([w for x in each for w in x], pa.string())], ["doc_id", "toxic", "word"])

    words = settle(py(docs.sparkSession, bags, split, "doc_id long, toxic boolean, word string"), "words")
    sizes = bags.agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c")).first()
    if not sizes.t or not sizes.c:
        return None
    t, c = F.count_if("toxic"), F.count_if(~F.col("toxic"))
    stats = settle(words.groupBy("word").agg(t.alias("t"), c.alias("c")), "stats")
    odds = F.log((F.col("t") + 0.5) / sizes.t) - F.log((F.col("c") + 0.5) / sizes.c)
    marked_word = F.concat(F.lit("^"), F.col("word"))
    grams = stats.where(F.length("word") > 2).select("word", "t", "c", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked_word) - (GRAM - 1), F.lit(1))), lambda i: F.substring(marked_word, i, F.lit(GRAM)))).alias("gram"))
    # how much more often a stretch of letters stands in toxic documents tells more than rare words themselves
    counted = settle(grams.groupBy("gram").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "grams")
    chance = SURE * float(np.log(max(2, counted.count())))  # what the most telling of so many stretches reaches by chance
    signs = counted.where("t > 1").withColumn("told", F.col("t") * odds).where(odds > 1.5).where(F.col("told") > chance).select("gram", "told")
    telling = settle(grams.where("t > 0").join(signs, "gram").groupBy("word").agg(F.max("told").alias("told")), "telling")
    in_bags = settle(words.where("toxic").join(telling, "word").select("doc_id", "word", "told"), "witnesses")
    best = in_bags.groupBy("doc_id").agg(F.max("told").alias("best"))
    witness = in_bags.join(best, "doc_id").where("told >= best * 0.8").groupBy("word").agg(F.max("told").alias("told"))
    positive = [r.word for r in witness.orderBy(F.desc("told"), "word").limit(WITNESSES).collect()]
    clean = stats.where("c > 0").where(odds < 0.5)
    negative = [r.word for r in clean.orderBy(F.xxhash64("word"), "word").limit(CLEAN_WORDS).collect()]
    if not positive or not negative:
        return None
    weights, bias = fit(positive, negative)
    mined = _margins(clean.select(F.col("word").alias("text")), weights, bias)
    negative = list(dict.fromkeys([*negative, *[r.text for r in mined.orderBy(F.desc("margin"), "text").limit(MINED).collect()]]))
    weights, bias = fit(positive, negative)
    seen = _margins(bags.select("text", "toxic"), weights, bias).select("margin", "toxic").collect()  # at most TRAIN_DOCUMENTS numbers
    slope, offset = calibrate(np.array([r.margin for r in seen]), np.array([r.toxic for r in seen]))
    return weights, bias, slope, offset


def classify(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """Score whole texts: every column of ``docs`` with held_out, score and predicted (columns of these names are replaced).

    The model is trained on the labelled rows of ``corpus`` (``docs`` unless given) outside the hold-out. Scores look
    at the text alone. Null and empty texts score as a document without any word;
    rows that repeat a doc_id are scored each; without labels of both classes all scores are 0; an
    empty table gives an empty one.
    """
    docs = docs.drop("held_out", "score", "predicted", "margin")
    model = train(docs if corpus is None else corpus, labels)
    out = docs.withColumn("held_out", held_out())
    if model is None:
        return out.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0))
    weights, bias, slope, offset = model
    scored = _margins(out, weights, bias)
    return scored.withColumn("score", 1 / (1 + F.exp(-(F.col("margin") * slope + offset)))).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop("margin")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document's whole text."""
    out = classify(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return out.select("doc_id", "held_out", "score", "predicted")


