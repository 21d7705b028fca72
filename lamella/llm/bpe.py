"""Byte-pair encoding and decoding with a contiguous rank array per word, and token counts from it."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
import uuid
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.common import memory, py, settle, table
from lamella.llm.words import narrow, wide

#: Words above so many pieces are merged with a heap over linked pieces; the result is the same.
SHORT = 128
#: Words that a worker remembers between documents; when full the memory starts anew, results don't depend on it.
MEMORY = 300_000
#: Bytes of text handled at once inside a task.
SLICE = 4 << 20
#: Bytes of text whose distinct pre-tokens ask for their pieces together, and for each group of pre-tokens.
ASKING, GROUP_BYTES = 16 << 20, 32 << 20
NONE = 1 << 60
#: Code points from here up to PRIVATE are unassigned.
UNASSIGNED, PRIVATE = 0x40000, 0xE0000

#: How byte-level vocabularies spell bytes, and the patterns that split text before merging.
PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
def spelled_bytes() -> dict[str, int]:
    """Character to byte: printable bytes stand for themselves, the others for U+0100 and up in order."""
    rest = [b for b in range(256) if b not in set(PLAIN_BYTES)]
    return {chr(b): b for b in PLAIN_BYTES} | {chr(256 + i): b for i, b in enumerate(rest)}


def _assigned() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, UNASSIGNED), *range(PRIVATE, 0x110000)]))


@lru_cache(maxsize=1)
def unicode_classes() -> dict[str, str]:
    r"""What the tokenizer files' own library takes for \p{L}, \p{N} and \s, as ranges of a character class.

    Unicode tables differ between libraries and versions, so the classes are asked for rather than written down.
    """
    from tokenizers import Regex, pre_tokenizers

    every, out = _assigned(), {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        at, ranges = 0, []
        left = pre_tokenizers.Split(Regex(f"{name}+"), "removed").pre_tokenize_str(every)
        for a, b in [x[1] for x in left] + [(len(every), len(every))]:
            if a > at:
                k = at
                for k0, k1 in ((0, 0xD800), (0xD800, len(every))):  # surrogates lie between
                    lo, hi = max(k, k0), min(a, k1)
                    if lo < hi:
                        ranges.append(f"\\U{ord(every[lo]):08x}-\\U{ord(every[hi - 1]):08x}")
            at = b
        out[name] = "".join(ranges)
    return out


@lru_cache(maxsize=4)
def exact_pattern(text: str) -> str:
    """A splitting pattern with its classes spelled out."""
    c = unicode_classes()
    space, letter, digit = c[r"\s"], c[r"\p{L}"], c[r"\p{N}"]
    text = text.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{digit}]").replace(r"\s+(?!\S)", f"[{space}]+(?![^{space}])").replace(r"|\s+", f"|[{space}]+")
    return text.replace(r"[\p{L}]", f"[{letter}]").replace(r"[\p{N}]", f"[{digit}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{digit}]")


@lru_cache(maxsize=1)
def odd_characters() -> str:
    """The characters that this process's regular expressions class otherwise than the library does."""
    every = _assigned()
    theirs, mine = {}, {}
    for name, ranges in unicode_classes().items():
        theirs[name] = {chr(c) for a, b in re.findall(r"\\U(\w{8})-\\U(\w{8})", ranges) for c in range(int(a, 16), int(b, 16) + 1)}
        mine[name] = {c for m in regex.finditer(f"{name}+", every) for c in m[0]}
    return "".join(sorted(set().union(*(theirs[n] ^ mine[n] for n in theirs))))


class Splitter:
    """Pre-tokens of a text: by the plain pattern, or, for a text with odd characters, by the one whose classes are spelled out."""

    def __init__(self, pattern: str, exact: str, odd: str):
        self.plain, self.exact, self.odd = compiled(pattern).findall, compiled(exact).findall, frozenset(odd)

    def __call__(self, text: str) -> list[str]:
        return self.plain(text) if text.isascii() or self.odd.isdisjoint(text) else self.exact(text)


@lru_cache(maxsize=4)
def splitter(pattern: str, exact: str, odd: str) -> Splitter:
    return Splitter(pattern, exact, odd)


def splitting(pattern: str) -> tuple[str, str, str]:
    """What tasks need to split by ``pattern`` as the library does; small constants made on the driver."""
    return pattern, exact_pattern(pattern), odd_characters()


@lru_cache(maxsize=1)
def lower_cases() -> dict[int, str]:
    """How the library lower-cases single characters, wherever it changes them."""
    from tokenizers import normalizers

    low = normalizers.Lowercase()
    return {ord(c): x for c in _assigned() if not c.isascii() or c.isupper() if (x := low.normalize_str(c)) != c}


def odd_cases(table: dict[int, str]) -> str:
    """The characters that Python lower-cases otherwise, alone or at the end of a word, as a pattern."""
    odd = [c for c in _assigned() if table.get(ord(c), c) != c.lower()]
    return "[" + "".join(map(regex.escape, {*odd, "Σ"})) + "]"


class Vocabulary:
    """Pieces, ranks and special strings of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte = spec["model"], spelled_bytes()
        self.suffix = model.get("end_of_word_suffix") or ""
        ids = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.single = [0] * 256
        self.last = [0] * 256
        for c, b in byte.items():
            self.single[b] = ids[c]
            self.last[b] = ids[c + self.suffix]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, (a, b) in enumerate(model["merges"]):
            self.rank[ids[a] << 20 | ids[b]] = rank
            self.merged.append(ids[a + b])
        self.pieces: dict[int, bytes] = {}
        if not self.suffix:
            self.pieces = {i: bytes(byte[c] for c in piece) for piece, i in ids.items()}
            self.pieces |= {i: s.encode() for s, i in self.special.items()}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: scan the ranks of adjacent parts for the least, delete that boundary, renew its neighbours."""
        ids = [self.single[b] for b in word]
        if self.suffix:
            ids[-1] = self.last[word[-1]]
        if len(ids) > SHORT:
            return self._merge_long(ids)
        get, merged = self.rank.get, self.merged
        ranks = [get(a << 20 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            i = ranks.index(least)
            new = ids[i] = merged[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | new, NONE)
            if i < len(ranks):
                ranks[i] = get(new << 20 | ids[i + 1], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.merged[r], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := get(ids[x] << 20 | ids[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def spans(self, text: str) -> Iterable[tuple[str, int | None]]:
        """The text cut at special strings: (stretch, None) or (special string, its id)."""
        if self.cut is None:
            yield text, None
            return
        at = 0
        for m in self.cut.finditer(text):
            yield text[at : m.start()], None
            yield m[0], self.special[m[0]]
            at = m.end()
        yield text[at:], None


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def compiled(pattern: str):
    return regex.compile(pattern)


def slices(batches: Iterable[pa.RecordBatch], column: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that ``column`` holds about ``size`` bytes in each; a longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.diff(np.cumsum(lengths) // size)) + 1
        for a, b in zip([0, *cut], [*cut, batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)


def encode_text(text: str, vocab: Vocabulary, known: dict, split) -> bytes:
    """Ids of a whole text as little-endian unsigned 32-bit integers."""
    out: list[bytes] = []
    for stretch, special in vocab.spans(text):
        if special is not None:
            out.append(special.to_bytes(4, "little"))
            continue
        words = split(stretch)
        fresh = set(words).difference(known)
        if len(known) + len(fresh) > MEMORY:
            known.clear()
            fresh = set(words)
        for w in fresh:
            known[w] = np.array(vocab.merge(w.encode()), "<u4").tobytes()
        out += [known[w] for w in words]
    return b"".join(out)


def decode_ids(ids: bytes, vocab: Vocabulary) -> str:
    """Text of packed ids; bytes that aren't UTF-8 become U+FFFD."""
    return b"".join(map(vocab.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """Encode whole texts (doc_id, text) and decode the ids again.

    Returns doc_id, n_tokens, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded``. Special
    strings in a text become their own ids, as the tokenizer file's library does by default. Null and
    empty texts give no ids and an empty decoded text; rows that repeat a doc_id each give a row; an
    empty table gives an empty one. Every row stands alone, so there is no shuffle, and memory is
    bounded by a slice of texts and the worker's word memory.
    """

    how = splitting(BYTE_PATTERN)

    def run(batches):
        vocab, known, split = vocabulary(path), memory(("ids", path)), splitter(*how)
        for part in slices(batches, "text"):
            ids = [encode_text(t or "", vocab, known, split) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([decode_ids(x, vocab) for x in ids], pa.string())],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    return py(docs.sparkSession, docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids binary, decoded string")


class Normal:
    """Text as the word-level vocabulary reads it: composed, then lower-cased character by character."""

    def __init__(self, table: dict[int, str], odd: str):
        self.table, self.odd = table, compiled(odd)

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return text.translate(self.table) if self.odd.search(text) else text.lower()


def frequencies(text: str, vocab: Vocabulary, normal: Normal, split) -> tuple[Counter, int]:
    """(how often each pre-token stands in a whole text, special strings in it)."""
    count, special = Counter(), 0
    for stretch, own in vocab.spans(text):
        if own is not None:
            special += 1
        else:
            count.update(split(normal(stretch)))
    return count, special


HEAD = "slice long, ids array<bigint>, n_bytes binary, special binary, distinct binary, places binary, counts binary, size long, tokens array<string>"


def _counted(docs: DataFrame, path: str) -> DataFrame:
    """A row per slice of texts: its distinct pre-tokens, and for each text places in them and frequencies."""
    how, lower = splitting(WORD_PATTERN), lower_cases()
    odd = odd_cases(lower)

    def run(batches):
        vocab, normal, split = vocabulary(path), Normal(lower, odd), splitter(*how)
        for part in slices(batches, "text", ASKING):
            known: dict[str, int] = {}
            places, counts, distinct, special, n_bytes = [], [], [], [], []
            for t in part.column("text"):
                t = t.as_py() or ""
                own, k = frequencies(t, vocab, normal, split)
                places.append(np.fromiter((known.setdefault(w, len(known)) for w in own), np.uint32, len(own)))
                counts.append(np.fromiter(own.values(), np.uint32, len(own)))
                distinct.append(len(own))
                special.append(k)
                n_bytes.append(len(t.encode()))
            row = [uuid.uuid4().int >> 65, part.column("doc_id").to_pylist(), *[narrow(np.array(x, np.int64)) for x in (n_bytes, special, distinct)], narrow(np.concatenate(places)), narrow(np.concatenate(counts)), sum(distinct), list(known)]
            kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5, pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], ["slice", "ids", "n_bytes", "special", "distinct", "places", "counts", "size", "tokens"])

    return py(docs.sparkSession, docs, run, HEAD)


def _pieces(held: DataFrame, path: str, groups: int) -> DataFrame:
    """(slice, grp, size, at, pieces): the pieces of each slice's pre-tokens. A group holds all slices' pre-tokens of one hash range and merges each distinct one once."""

    def ask(batches):
        for b in batches:
            for name, tokens in zip(b.column("slice").to_pylist(), b.column("tokens")):
                values = tokens.values
                g = np.fromiter((zlib.crc32(w.encode()) % groups for w in values.to_pylist()), np.int64, len(values))
                order = np.argsort(g, kind="stable")
                cut = [*np.flatnonzero(np.r_[True, np.diff(g[order]) > 0]), len(g)] if len(g) else []
                for a, z in zip(cut, cut[1:]):
                    own = order[a:z]
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([int(g[own[0]])], pa.int32()), pa.array([narrow(own)], pa.binary()), pa.array([values.take(pa.array(own)).to_pylist()], pa.list_(pa.string()))], ["slice", "grp", "at", "tokens"])

    def count(key, batches):
        vocab = vocabulary(path)
        t = pa.Table.from_batches(list(batches))
        sizes = pc.list_value_length(t.column("tokens")).to_pylist()
        every = pc.list_flatten(t.column("tokens")).combine_chunks().dictionary_encode()
        if isinstance(every, pa.ChunkedArray):
            every = every.unify_dictionaries().combine_chunks()
        pieces = np.array([len(vocab.merge(w.encode())) for w in every.dictionary.to_pylist()], np.uint32)[every.indices.to_numpy()]
        at = 0
        for i, n in enumerate(sizes):
            yield pa.RecordBatch.from_arrays([t.column("slice").slice(i, 1).combine_chunks(), pa.array([key[0].as_py()], pa.int32()), pa.array([n], pa.int64()), t.column("at").slice(i, 1).combine_chunks(), pa.array([narrow(pieces[at : at + n])], pa.binary())], ["slice", "grp", "size", "at", "pieces"])
            at += n

    count.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    asked = py(held.sparkSession, held.select("slice", "tokens"), ask, "slice long, grp int, at binary, tokens array<string>")
    return asked.groupBy("grp").applyInArrow(count, "slice long, grp int, size long, at binary, pieces binary")


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Tokens of whole texts (doc_id, text) without materialising ids.

    Pieces are counted once per distinct pre-token of the corpus, joined to the pre-token frequencies of
    documents, and summed. As pairs of document and pre-token outweigh the texts, a slice of
    texts asks once for each of its distinct pre-tokens and is joined to the answers as a whole.
    Returns doc_id, n_bytes, n_tokens and over_limit. Null and empty texts have 0 bytes and tokens; rows
    that repeat a doc_id, tied or not, each give a row; an empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    held = settle(_counted(docs, path), "pre-tokens")
    answers = _pieces(held, path, max(1, size // GROUP_BYTES))

    def total(key, batches):
        rows = pa.Table.from_batches(list(batches)).to_pylist()
        (own,) = [r for r in rows if r["grp"] is None]
        found = [r for r in rows if r["grp"] is not None]
        pieces = np.zeros(sum(r["n"] for r in found), np.int64)
        for r in found:
            pieces[wide(r["at"], r["n"])] = wide(r["pieces"], r["n"], np.uint32)
        n = len(own["ids"])
        n_bytes, special, distinct = (wide(own[c], n) for c in ("n_bytes", "special", "distinct"))
        parts = pieces[wide(own["places"], own["size"], np.uint32)] * wide(own["counts"], own["size"], np.uint32)
        sums = np.r_[0, np.cumsum(parts)]
        edges = np.r_[0, np.cumsum(distinct)]
        yield pa.RecordBatch.from_arrays([pa.array(own["ids"], pa.int64()), pa.array(n_bytes), pa.array(special + sums[edges[1:]] - sums[edges[:-1]])], ["doc_id", "n_bytes", "n_tokens"])

    total.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    every = held.drop("tokens").unionByName(answers.withColumnRenamed("size", "n"), allowMissingColumns=True)
    return every.groupBy("slice").applyInArrow(total, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def public_path(name: str) -> str:
    """Where a public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Token ids of every document and the text decoded from them, as digests."""
    return digests(table(spark, sf_dir, "documents", "doc_id", "text"), path)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``encode_decode`` with ids and decoded text reduced to their SHA-256."""
    out = encode_decode(docs, path or public_path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Token counts of every document."""
    return token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), path or public_path("word_bpe_49k.json"))
