"""Exact n-gram Jaccard join by PartEnum signatures.

Sets are dealt to size bands that double. In a band the domain of shingle hashes is cut into
partitions, and each partition into PARTS second-level parts. Two sets that differ in d elements differ in at
most SPARE elements in all but d // (SPARE + 1) of the partitions, and there agree on some subset of PARTS - SPARE
parts: the content of every such subset is a signature. A set emits its partitions in order until
d // (SPARE + 1) + 1 of them are rich, that is, have a subset left whatever SPARE parts are taken away, so that
a shared signature is never that of an empty subset. Of two linked sets the one that stops first has a rich
partition in which both agree, and the other emits it too. Sets with too few rich partitions, mostly
tiny ones, emit the first elements of their order as well and so meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm.bpe import slices
from lamella.llm.common import broadcast_if_small, discard, memory, py, settle, table
from lamella.llm.components import components
from lamella.llm.words import M1, M2, M3, mix, narrow, rising, risen, shingle_sets, wide

#: Words of a shingle; similarity as a fraction of integers (links: UNION * intersection >= SHARE * union).
WIDTH = 5
SHARE, UNION = 75, 100
#: Second-level parts of a partition, and how many of them a signature leaves out.
PARTS, SPARE = 4, 1
SUBSETS = list(combinations(range(PARTS), PARTS - SPARE))
#: Elements of a partition for the largest set of a size band.
FILL = 6
#: Bytes of text whose signatures are made at once.
SLICE = 3 << 20
#: Signature records in one group of the signature join, on average.
GROUP = 400_000
#: Slots of a parity sketch for an element: the more, the closer the differing bits come to the differing elements.
SPARSE = 4
#: Members of one block when an unresolved bucket is compared in blocks.
BLOCK = 1024
#: Bytes of candidate ids up to which they are broadcast to pick documents from the corpus; beyond, the join is shuffled.
BROADCAST_BYTES = 8 << 20
#: Members of buckets in one group of comparisons, on average.
MEMBERS = 100_000
#: Members in one row of a stored bucket.
ROW = 1 << 16


def most_different(size, other):
    """The most elements in which linked sets of these sizes differ."""
    return (size + other) * (UNION - SHARE) // (UNION + SHARE)


def band_of(sizes: np.ndarray) -> np.ndarray:
    return np.frexp(sizes.astype(np.float64))[1]


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(signatures of some sets, the set of each): those of a set's own band, and of the next where linked larger sets reach it."""
    sizes = np.array([len(s) for s in sets], np.int64)
    largest, own = sizes * UNION // SHARE, band_of(sizes)
    alone = most_different(sizes, largest) == 0  # linked with equal sets only
    sigs, of = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    bare = np.zeros(len(sets), bool)
    for band in range(int(own.max(initial=0)) + 2):
        here = np.flatnonzero(~alone & (sizes > 0) & ((own == band) | (own == band - 1) & (band_of(largest) == band)))
        if not len(here):
            continue
        top = (1 << band) - 1
        parts = top // FILL + 1
        needed = most_different(sizes[here], np.minimum(largest[here], top)) // (SPARE + 1) + 1
        salt = np.uint64(band * int(M3) & (1 << 64) - 1)
        value = mix(np.concatenate([sets[i] for i in here]) ^ M3)
        cell = np.repeat(np.arange(len(here)) * parts, sizes[here]) + ((value >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        cell = cell * PARTS + ((value >> np.uint64(9)) % np.uint64(PARTS)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cell, value = cell[order], value[order]
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        sums = np.zeros((len(here), parts, PARTS), np.uint64)
        sums.ravel()[cell[first]] = np.add.reduceat(value, first)
        held = np.zeros((len(here), parts, PARTS), bool)
        held.ravel()[cell[first]] = True
        rich = np.cumsum(held.sum(axis=2) > SPARE, axis=1)
        enough = rich[:, -1] >= needed
        bare[here] |= ~enough
        stop = np.where(enough, (rich >= needed[:, None]).argmax(axis=1) + 1, parts)
        use = np.arange(parts)[None, :] < stop[:, None]
        for k, subset in enumerate(SUBSETS):
            at = np.nonzero(use & held[:, :, subset].any(axis=2))
            sigs.append(mix(sums[:, :, subset].sum(axis=2)[at] * M1 + (at[1] * len(SUBSETS) + k).astype(np.uint64) * M2 + salt))
            of.append(here[at[0]])
    for i in np.flatnonzero(bare):
        prefix = sets[i][: sizes[i] - -(-sizes[i] * SHARE // UNION) + 1]
        sigs.append(mix(prefix ^ M2))
        of.append(np.full(len(prefix), i))
    return np.concatenate(sigs), np.concatenate(of)


def parity(s: np.ndarray) -> bytes:
    """A bit for the parity of each slot, SPARSE slots an element or more: sets differ in at least as many elements as bits."""
    bits = max(256, SPARSE << (len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(n: int, a: bytes, m: int, b: bytes) -> bool:
    """False only if sets of sizes n and m with these parities can't be linked."""
    if min(n, m) * UNION < SHARE * max(n, m):
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= most_different(n, m)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and UNION * both >= SHARE * (len(a) + len(b) - both)


def _profiles(docs: DataFrame) -> DataFrame:
    """A row per document: size, identity and parity of its set."""

    def run(batches):
        memory("shingles")  # what earlier stages remembered in this worker goes
        for part in slices(batches, "text", SLICE):
            sets = shingle_sets(part.column("text"), WIDTH)
            f1, f2 = identities(sets)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array([parity(s) if len(s) else b"" for s in sets], pa.binary())], ["doc_id", "n", "f1", "f2", "parity"])

    return py(docs.sparkSession, docs, run, "doc_id long, n long, f1 long, f2 long, parity binary")


def identities(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit numbers a set that only equal sets share."""
    out = np.zeros((2, len(sets)), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        every = np.concatenate([sets[i] for i in full])
        at = np.r_[0, np.cumsum([len(sets[i]) for i in full])][:-1]
        out[0, full], out[1, full] = np.add.reduceat(mix(every), at), np.add.reduceat(mix(every ^ M2), at)
    return out


def _signed(docs: DataFrame, groups: int) -> DataFrame:
    """Signatures with the doc_ids of their sets, a row for each slice and group; of equal sets in a slice one is signed. Groups are ranges of signatures."""

    def run(batches):
        memory("shingles")
        for part in slices(batches, "text", SLICE):
            sets = shingle_sets(part.column("text"), WIDTH)
            f1, f2 = identities(sets)
            chosen = list({(f1[i], f2[i], len(s)): i for i, s in enumerate(sets) if len(s)}.values())
            sig, of = signatures([sets[i] for i in chosen])
            if not len(sig):
                continue
            order = np.argsort(sig)
            sig, ids = sig[order], part.column("doc_id").to_numpy()[np.array(chosen)[of[order]]]
            g = ((sig >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
            cut = [*np.flatnonzero(np.r_[True, g[1:] != g[:-1]]), len(g)]
            packed = [(g[a], b - a, rising(sig[a:b]), narrow(ids[a:b])) for a, b in zip(cut, cut[1:])]
            for k in range(0, len(packed), 256):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*packed[k : k + 256]), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["grp", "size", "sigs", "ids"])

    return py(docs.sparkSession, docs, run, "grp int, size long, sigs binary, ids binary")


def _buckets(signed: DataFrame) -> DataFrame:
    """Rows of pairs (a, b), where a is the smallest member of a signature that b has too; and rows of the members of signatures of three documents or more, each list once a group: (who, m, ids)."""

    def run(key, batches):
        read = [(risen(s, n), wide(i, n)) for b in batches for n, s, i in zip(*(b.column(c).to_pylist() for c in ("size", "sigs", "ids")))]
        sig = np.concatenate([s for s, _ in read])
        ids = np.concatenate([i for _, i in read])
        del read
        order = np.lexsort((ids, sig))
        sig, ids = sig[order], ids[order]
        keep = np.r_[True, (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])]  # a doc_id may be repeated
        sig, ids = sig[keep], ids[keep]
        start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        m = np.diff(np.r_[start, len(sig)])
        lead = np.repeat(ids[start], m)
        both = np.unique(np.stack([lead, ids])[:, lead != ids], axis=1)
        for at in range(0, both.shape[1], 100_000):
            a, b = both[:, at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[pa.nulls(len(a), k) for k in (pa.int64(), pa.int64(), pa.binary())]], ["a", "b", "who", "m", "ids"])
        who = np.add.reduceat(mix(ids.view(np.uint64)), start).view(np.int64)
        many = np.flatnonzero(m > 2)
        _, once = np.unique(np.stack([who[many], m[many]]), axis=1, return_index=True)
        lists = [(who[k], m[k], narrow(ids[c : min(c + ROW, start[k] + m[k])]), min(ROW, start[k] + m[k] - c)) for k in many[once] for c in range(start[k], start[k] + m[k], ROW)]
        for at in range(0, len(lists), 4096):
            w, size, packed, n = zip(*lists[at : at + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.nulls(len(w), pa.int64()), pa.array(w, pa.int64()), pa.array(size, pa.int64()), pa.array(packed, pa.binary())], ["a", "b", "who", "m", "ids"])

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return signed.groupBy("grp").applyInArrow(run, "a long, b long, who long, m long, ids binary")


def _opened(lists: DataFrame) -> DataFrame:
    """(who, m, doc_id) of stored buckets."""

    def run(batches):
        for b in batches:
            for who, m, n, ids in zip(*(b.column(c).to_pylist() for c in ("who", "m", "a", "ids"))):
                yield pa.RecordBatch.from_arrays([pa.array([who] * n, pa.int64()), pa.array([m] * n, pa.int64()), pa.array(wide(ids, n))], ["who", "m", "doc_id"])

    return py(lists.sparkSession, lists, run, "who long, m long, doc_id long")


def _verify(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are linked. Parities are compared first, whole sets then."""
    pa_, pb_ = (sets.select(F.col("rep").alias(k), F.col("n").alias(f"n{k}"), F.col("parity").alias(f"p{k}")) for k in "ab")

    def sketch(batches):
        for b in batches:
            c = [b.column(k).to_pylist() for k in ("na", "pa", "nb", "pb")]
            keep = [may_link(*x) for x in zip(*c)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    likely = settle(py(docs.sparkSession, pairs.join(pa_, "a").join(pb_, "b").select("a", "na", "pa", "b", "nb", "pb"), sketch, "a long, b long"), "likely")
    ids = broadcast_if_small(likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids", BROADCAST_BYTES // 8)

    def whole(batches):
        for part in slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(part.column("text"), WIDTH)], pa.binary())], ["doc_id", "elements"])

    found = settle(py(docs.sparkSession, docs.join(ids, "doc_id", "left_semi").select("doc_id", "text"), whole, "doc_id long, elements binary").dropDuplicates(["doc_id"]), "sets")
    sa, sb = (found.select(F.col("doc_id").alias(k), F.col("elements").alias(f"s{k}")) for k in "ab")

    def exact(batches):
        for part in slices(batches, "sa", SLICE):
            keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(part.column("sa").to_pylist(), part.column("sb").to_pylist())]
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = settle(py(docs.sparkSession, likely.join(sb, "b").join(sa, "a").select("a", "b", "sa", "sb"), exact, "a long, b long"), "links")
    discard(likely, found)
    return links


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """A sketch at a smaller width; differing bits of it still differ in an element."""
    return np.bitwise_xor.reduce(bits.reshape(-1, width), axis=0)


def near_in_bucket(rep: np.ndarray, comp: np.ndarray, n: np.ndarray, bits: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i among ``left`` and j among ``right``, of different components whose sizes and parities allow a link."""
    width = min(map(len, bits))
    whole = np.stack([b if len(b) == width else folded(b, width) for b in bits])
    narrow_width = max(32, width // SPARSE)  # narrow sketches tell most pairs apart
    flat = np.bitwise_xor.reduce(whole.reshape(len(whole), -1, narrow_width), axis=1).view(np.uint64)
    out = []
    for a in range(0, len(left), 32):
        i = left[a : a + 32]
        most = most_different(n[i][:, None], n[right][None, :])
        ok = (comp[i][:, None] != comp[right][None, :]) & (np.minimum(n[i][:, None], n[right][None, :]) * UNION >= SHARE * np.maximum(n[i][:, None], n[right][None, :]))
        ok &= np.bitwise_count(flat[i][:, None, :] ^ flat[right][None, :, :]).sum(axis=2, dtype=np.int64) <= most
        x, y = np.nonzero(ok)
        if len(x):
            keep = np.bitwise_count(whole[i[x]] ^ whole[right[y]]).sum(axis=1, dtype=np.int64) <= most[x, y]
            out.append((i[x[keep]], right[y[keep]]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 2


def _unresolved(lists: DataFrame, of: DataFrame, sets: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs of a bucket's members that the first links left in different components and whose parities allow a link.

    Buckets with the same members count once; a bucket of many members is compared in blocks. Comparisons
    are dealt to groups, and a group gets the sketch of each of its members once, however many buckets it is in.
    """
    members = _opened(lists).join(of, "doc_id").join(parts, F.col("rep") == F.col("node"), "left")
    labelled = settle(members.select("who", "m", "rep", F.coalesce("component", "rep").alias("comp")), "bucket-members")
    open_ = labelled.groupBy("who", "m").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("who", "m")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = labelled.join(open_, ["who", "m"]).withColumn("k", F.pmod(F.xxhash64("rep"), blocks.cast("long")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select(F.xxhash64("who", "m", F.least("k", "j"), F.greatest("k", "j")).alias("unit"), (F.col("k") <= F.col("j")).alias("first"), (F.col("k") >= F.col("j")).alias("second"), "rep", "comp")
    compared = settle(dealt, "compared")
    groups = max(1, compared.count() // MEMBERS)
    dealt = compared.withColumn("grp", F.pmod("unit", F.lit(groups)).cast("int"))
    sketches = dealt.select("grp", "rep").distinct().join(sets.select("rep", "n", "parity"), "rep")

    def run(key, batches):
        t = pa.Table.from_batches(list(batches))
        given = t.filter(pc.is_valid(t.column("parity")))
        at = {r: i for i, r in enumerate(given.column("rep").to_pylist())}
        sizes, bits = given.column("n").to_numpy(), [np.frombuffer(b, np.uint8) for b in given.column("parity").to_pylist()]
        t = t.filter(pc.is_null(t.column("parity"))).sort_by("unit")
        unit, rep, comp, first, second = (t.column(c).to_numpy() for c in ("unit", "rep", "comp", "first", "second"))
        cut = [*np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]), len(unit)]
        found = [np.empty((2, 0), np.int64)]
        for a, z in zip(cut, cut[1:]):
            own, where = np.unique(rep[a:z], return_index=True)
            place = [at[r] for r in own.tolist()]
            i, j = near_in_bucket(own, comp[a:z][where], sizes[place], [bits[k] for k in place], np.flatnonzero(first[a:z][where]), np.flatnonzero(second[a:z][where]))
            found.append(np.stack([np.minimum(own[i], own[j]), np.maximum(own[i], own[j])]))
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    every = dealt.unionByName(sketches, allowMissingColumns=True)
    found = settle(every.groupBy("grp").applyInArrow(run, "a long, b long").distinct(), "unresolved")
    discard(labelled, compared)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Link documents (doc_id, text) whose shingle sets have a Jaccard similarity of SHARE / UNION or more.

    Returns a row for each input row: doc_id, n_shingles and component_id, the smallest doc_id
    reachable by links. Words are what ASCII white space separates after lower-casing A-Z. Texts
    without words (null, empty) have no shingles and stand alone; equal sets are always linked; rows that
    repeat a doc_id are one document, each row of which is returned; rows with a null doc_id are returned
    unlinked with a null component. An empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id is not null")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    rows = settle(_profiles(docs), "profiles")
    found = settle(_buckets(_signed(known, max(1, size // (3 * GROUP)))), "buckets")
    identity = ["n", "f1", "f2"]
    sets = settle(rows.where("n > 0 and doc_id is not null").groupBy(*identity, "parity").agg(F.min("doc_id").alias("rep")), "distinct")
    # equal sets are one member
    of = settle(rows.where("n > 0 and doc_id is not null").join(sets.select(*identity, "rep"), identity).select("doc_id", "rep").distinct(), "members")
    pairs = found.where("b is not null").select("a", "b").distinct()
    pairs = pairs.join(of.select(F.col("doc_id").alias("a"), F.col("rep").alias("ra")), "a").join(of.select(F.col("doc_id").alias("b"), F.col("rep").alias("rb")), "b")
    pairs = pairs.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
    # a document of several texts joins their sets
    several = of.join(of.groupBy("doc_id").agg(F.min("rep").alias("lead")), "doc_id").where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b"))
    parts = components(_verify(known, sets, pairs).unionByName(several))
    lists = found.where("who is not null").groupBy("who", "m", "ids").agg(F.first("a").alias("a"))
    rest = _unresolved(lists, of, sets, parts)
    if not rest.isEmpty():
        parts = components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(_verify(known, sets, rest)))
    discard(found)
    labelled = sets.join(parts, F.col("rep") == F.col("node"), "left").select(*identity, F.coalesce("component", "rep").alias("component"))
    return rows.join(labelled, identity, "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-copies over every document's whole text."""
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
