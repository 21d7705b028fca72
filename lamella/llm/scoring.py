"""LM scoring: cross-entropy difference of matched target and background bigram models.

The models are the counts of every word and word pair of the corpus, so they grow with it and stay
distributed. Each slice of texts is stored as indices into its own dictionary. It asks the groups of keys for the
counts of its own distinct keys, each once, which is also how the slice's own counts get there, and is then
scored with the answers. Keys are made anew from the stored slice wherever they are needed, so none are stored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.bpe import slices
from lamella.llm.common import broadcast_if_small, py, settle, table
from lamella.llm.words import M2, M3, hashed_words, mix, narrow, rising, risen, wide

#: Smoothing, the same for both models: pseudo-counts of a word, and of a context's back-off.
ALPHA, MU = 0.5, 8.0
#: Bytes of target ids up to which they are broadcast; beyond, the join is shuffled.
BROADCAST_BYTES = 8 << 20
#: Bytes of text in one slice, and for each group of keys.
SLICE, GROUP_BYTES = 8 << 20, 16 << 20
#: Groups of keys at least.
GROUPS = 16
#: Kinds of keys: a pair of words, and a word (counted by itself and as the context of another one).
PAIR, WORD = range(2)
#: What stands before the first word of a text.
START = np.uint64(1)
HEAD = "slice long, ids array<bigint>, lengths binary, marks binary, dictionary binary, words long, tokens binary, n long, t long"
SCORES = "doc_id long, n_tokens long, loss_target double, loss_background double"


def words(text: str | None) -> list[bytes]:
    """Words are what ASCII white space separates, with A-Z lower-cased."""
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def _slices(docs: DataFrame) -> DataFrame:
    """A row per slice of texts: ids, words and target marks of its texts, its dictionary, and its tokens as places in that."""

    def run(batches):
        for part in slices(batches, "text", SLICE):
            mark = part.column("target").to_numpy(zero_copy_only=False)
            h, n = hashed_words(part.column("text"))
            dictionary, tokens = np.unique(np.r_[START, h], return_inverse=True)
            row = [uuid.uuid4().int >> 65, part.column("doc_id").to_pylist(), narrow(n), mark.tobytes(), rising(dictionary), len(dictionary), narrow(tokens[1:].astype(np.uint32)), int(n.sum()), int(n[mark].sum())]
            kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 3, pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["slice", "ids", "lengths", "marks", "dictionary", "words", "tokens", "n", "t"])

    return py(docs.sparkSession, docs, run, HEAD)


class _Slice:
    """A stored slice: lengths and marks of its texts, places of its tokens and of the words before them, its distinct keys in order."""

    def __init__(self, row: dict):
        self.ids, self.n, self.mark = row["ids"], wide(row["lengths"], len(row["ids"])), np.frombuffer(row["marks"], bool)
        dictionary = risen(row["dictionary"], row["words"])
        now = wide(row["tokens"], row["n"], np.uint32).astype(np.int64)
        before = np.roll(now, 1)
        before[(np.cumsum(self.n) - self.n)[self.n > 0]] = np.searchsorted(dictionary, START)
        pairs, pair = np.unique(before * len(dictionary) + now, return_inverse=True)
        keys = [mix(mix(dictionary[pairs // len(dictionary)]) * M2 + dictionary[pairs % len(dictionary)] ^ M3), mix(dictionary ^ M3)]
        self.keys, places = [], []
        for k in keys:
            order = np.argsort(k)
            place = np.empty(len(k), np.int64)
            place[order] = np.arange(len(k))
            self.keys.append(k[order])
            places.append(place)
        self.places = (places[PAIR][pair], places[WORD][now], places[WORD][before])

    def counts(self) -> list[np.ndarray]:
        """Of pairs: (in all texts, in targets); of words: the same, and the same as contexts."""
        marked = np.repeat(self.mark, self.n)
        tally = lambda place, kind: [np.bincount(place[w], minlength=len(self.keys[kind])).astype(np.uint32) for w in (slice(None), marked)]
        pair, now, before = self.places
        return [np.stack(tally(pair, PAIR)), np.stack(tally(now, WORD) + tally(before, WORD))]


def _cuts(keys: np.ndarray, groups: int):
    """(group, begin, end): groups are ranges of keys."""
    g = ((keys >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
    cut = [*np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)] if len(g) else []
    return [(int(g[a]), int(a), int(b)) for a, b in zip(cut, cut[1:])]


def _answers(held: DataFrame, groups: int) -> DataFrame:
    """The corpus's counts of the keys each slice asked for, in the order of its question; and a row a group with its number of distinct words."""

    def ask(batches):
        for b in batches:
            for row in b.to_pylist():
                own = _Slice(row)
                for kind, counts in enumerate(own.counts()):
                    rows = [(row["slice"], g, kind, z - a, rising(own.keys[kind][a:z]), narrow(counts[:, a:z].ravel())) for g, a, z in _cuts(own.keys[kind], groups)]
                    for at in range(0, len(rows), 1024):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 1024]), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["slice", "grp", "kind", "size", "keys", "counts"])

    def answer(key, batches):
        t = pa.Table.from_batches(list(batches))
        (group, kind), sizes = (k.as_py() for k in key), t.column("size").to_pylist()
        own, inverse = np.unique(np.concatenate([risen(x, n) for x, n in zip(t.column("keys").to_pylist(), sizes)]), return_inverse=True)
        columns = 2 if kind == PAIR else 4
        given = [wide(x, columns * n, np.uint32).reshape(columns, n) for x, n in zip(t.column("counts").to_pylist(), sizes)]
        sums = [np.bincount(inverse, weights=np.concatenate([g[i] for g in given]), minlength=len(own)).astype(np.int64) for i in range(columns)]
        del given
        edges = np.r_[0, np.cumsum(sizes)]
        for a in range(0, len(sizes), 256):
            packed = [narrow(np.stack([c[inverse[edges[i] : edges[i + 1]]] for c in sums]).ravel()) for i in range(a, min(a + 256, len(sizes)))]
            k = len(packed)
            yield pa.RecordBatch.from_arrays([t.column("slice").slice(a, k).combine_chunks(), pa.array([group] * k, pa.int32()), pa.array([kind] * k, pa.int32()), pa.array(sizes[a : a + k], pa.int64()), pa.array(packed, pa.binary()), pa.nulls(k, pa.int64())], ["slice", "grp", "kind", "size", "packed", "words"])
        distinct = len(own) - int(np.isin(mix(START ^ M3), own)) if kind == WORD else 0
        yield pa.RecordBatch.from_arrays([pa.nulls(1, k) for k in (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())] + [pa.array([distinct], pa.int64())], ["slice", "grp", "kind", "size", "packed", "words"])

    answer.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    asked = py(held.sparkSession, held, ask, "slice long, grp int, kind int, size long, keys binary, counts binary")
    return asked.groupBy("grp", "kind").applyInArrow(answer, "slice long, grp int, kind int, size long, packed binary, words long")


def _within(text: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How often each token's key stands in its own text."""
    _, inverse, n = np.unique(text * (int(place.max(initial=0)) + 1) + place, return_inverse=True, return_counts=True)
    return n[inverse]


def losses(own: _Slice, pairs: np.ndarray, single_words: np.ndarray, totals: tuple[int, int], vocabulary: int) -> list[np.ndarray]:
    """Bits a token of each text of a slice under the background and the target model; a text's own counts are left out."""
    text = np.repeat(np.arange(len(own.n)), own.n)
    inside = [_within(text, p) for p in own.places]
    out = []
    for i, mine in enumerate((np.ones(len(own.n), bool), own.mark)):
        found = (pairs[i], single_words[i], single_words[2 + i])
        pair, word, context = (count[p] - o * mine[text] for count, p, o in zip(found, own.places, inside))
        single = (word + ALPHA) / ((totals[i] - own.n * mine)[text] + ALPHA * (vocabulary + 1))
        bits = -np.log2((pair + MU * single) / (context + MU))
        out.append(np.bincount(text, weights=bits, minlength=len(own.n)) / np.maximum(own.n, 1))
    return out


def score(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Cross-entropy difference of whole texts (doc_id, text), given the doc_id's of target documents.

    Background: all documents; target: those in ``targets``. Both bigram models hold every word and pair
    of the corpus, share order, vocabulary and smoothing (a pair backs off to its word, a word to the uniform
    distribution over the vocabulary and one unknown word), and leave the scored row's own counts out, so that
    a target document isn't told by itself. Returns doc_id, n_tokens, loss_target, loss_background (bits a
    token) and score = loss_target - loss_background; the lower, the more target-like. Null and
    empty texts have 0 tokens, losses and score; rows that repeat a doc_id count and are scored each; without
    targets the target model is uniform; an empty table gives an empty one. Words and pairs are told by
    64-bit hashes.
    """
    marks = broadcast_if_small(targets.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("mark")).distinct(), "targets", BROADCAST_BYTES // 8)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(marks, F.col("doc_id") == F.col("mark"), "left").select("doc_id", "text", F.col("mark").isNotNull().alias("target"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    held = settle(_slices(marked), "slices")
    answers = settle(_answers(held, max(GROUPS, size // GROUP_BYTES)), "answers")
    totals = tuple(held.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in "nt"]).first())
    vocabulary = answers.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]

    def run(key, batches):
        rows = pa.Table.from_batches(list(batches)).to_pylist()
        (head,) = [r for r in rows if r["kind"] is None]
        own = _Slice(head)
        found = []
        for kind, columns in ((PAIR, 2), (WORD, 4)):
            parts = [wide(r["packed"], columns * r["size"]).reshape(columns, -1) for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["grp"])]
            found.append(np.concatenate([np.zeros((columns, 0), np.int64), *parts], axis=1))
        background, target = losses(own, *found, totals, vocabulary)
        yield pa.RecordBatch.from_arrays([pa.array(own.ids, pa.int64()), pa.array(own.n), pa.array(target), pa.array(background)], ["doc_id", "n_tokens", "loss_target", "loss_background"])

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    every = held.unionByName(answers.where("slice is not null").drop("words"), allowMissingColumns=True)
    return every.groupBy("slice").applyInArrow(run, SCORES).withColumn("score", F.col("loss_target") - F.col("loss_background"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against a target of the documents labelled as of good quality."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    return score(table(spark, sf_dir, "documents", "doc_id", "text"), labels.where("quality = 1").select("doc_id"))
