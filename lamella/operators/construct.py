"""From layered candidates to constructed units: normalise, construct both channels, digest, validate, prove again from what was stored."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lamella.functions.arrow import canonical_text
from lamella.functions.text import content_full, json_text, text_digest
from lamella.operators.folds import fold

#: Bytes of a text that is embedded, at most; a longer one is an error and is never cut.
MOST = 8 * 1024 * 1024
#: The closed keys of a layered document and of its blocks.
DOCUMENT, BLOCK, ORIGINAL = {"layered_content"}, {"block_id", "granularity", "original_content", "summary"}, {"title", "body"}


def normalised(blocks: DataFrame, clean: DataFrame, declared: list[int]) -> DataFrame:
    """Blocks (doc_id, granularity, block_id, body) of candidates with ``state`` of their document.

    A candidate has exactly the declared layers, one root, unique blocks and no empty body below the root; an empty root gets the
    clean text (doc_id, clean). States name the first rule that is broken: layers, root, repeated, empty, or valid.
    """
    g = F.col("granularity")
    one = blocks.groupBy("doc_id", "granularity", "block_id").agg(F.count(F.lit(1)).alias("n"), F.count_if((g > 0) & (F.trim(F.coalesce("body", F.lit(""))) == "")).alias("bare"))
    facts = one.groupBy("doc_id").agg(F.array_sort(F.collect_set("granularity")).alias("layers"), F.sum(F.when(g == 0, F.col("n")).otherwise(0)).alias("roots"), F.max("n").alias("most"), F.sum("bare").alias("bare"))
    state = F.when(F.col("layers") != F.array(*map(F.lit, sorted(declared))), "layers").when(F.col("roots") != 1, "root").when(F.col("most") > 1, "repeated").when(F.col("bare") > 0, "empty").otherwise("valid")
    out = blocks.join(facts.select("doc_id", state.alias("state")), "doc_id").join(clean, "doc_id", "left")
    body = F.when((g == 0) & (F.trim(F.coalesce("body", F.lit(""))) == ""), F.col("clean")).otherwise(canonical_text("body"))
    return out.select("doc_id", "granularity", "block_id", body.alias("body"), "state")


def constructed(blocks: DataFrame, summaries: DataFrame, header: Column) -> DataFrame:
    """Units of blocks (doc_id, granularity, block_id, body) and their summaries (doc_id, granularity, block_id, summary).

    A unit has its coordinate (structure, projection, block), and for both channels the text under the metadata header and
    its digest; ``state`` says if the summary lacks.
    """
    return summarised(blocks.join(summaries, ["doc_id", "granularity", "block_id"], "left"), header)


def summarised(blocks: DataFrame, header: Column) -> DataFrame:
    """The units of blocks (doc_id, granularity, block_id, body, summary) that have their summaries with them; nothing is shuffled."""
    u = blocks.withColumn("header", header)
    id_ = F.col("doc_id").cast("string")
    u = u.withColumn("coordinate", F.concat(F.lit("s"), id_, F.lit(":p"), id_, F.lit(":g"), F.col("granularity").cast("string"), F.lit("b"), F.col("block_id").cast("string")))
    for channel, body in (("original", "body"), ("summary", "summary")):
        u = u.withColumn(f"{channel}_full", content_full(F.col("header"), F.col(body))).withColumn(f"{channel}_digest", text_digest(F.col(f"{channel}_full")))
    attached = F.when(F.col("granularity") == 0, "native_full").otherwise("reattached")
    return u.withColumn("attached", attached).withColumn("state", F.when(F.trim(F.coalesce("summary", F.lit(""))) == "", "incomplete").otherwise("constructed"))


def validated(units: DataFrame) -> DataFrame:
    """Per document, whether every channel is filled, its text and digest follow again from its body and header, and the root's original is attached."""
    good = F.lit(True)
    for channel, body in (("original", "body"), ("summary", "summary")):
        again = content_full(F.col("header"), F.col(body))
        good = good & (F.trim(F.coalesce(body, F.lit(""))) != "") & (again == F.col(f"{channel}_full")) & (text_digest(again) == F.col(f"{channel}_digest"))
    root = (F.col("granularity") == 0) & F.col("attached").isin("native_full", "reattached") & (F.trim(F.coalesce("body", F.lit(""))) != "")
    return units.groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"), F.bool_and(F.coalesce(good, F.lit(False))).alias("aligned"), F.bool_or(root).alias("rooted")).withColumn("full_valid", F.col("aligned") & F.col("rooted"))


def domain_digests(units: DataFrame) -> DataFrame:
    """(doc_id, projection, construction): digests of canonical JSON over the blocks and over the units of a document, in their order."""
    q = lambda c: json_text(c)
    block = F.concat(F.lit('{"g":'), F.col("granularity").cast("string"), F.lit(',"id":'), F.col("block_id").cast("string"), F.lit(',"original":'), q(F.sha2("body", 256)), F.lit("}"))
    unit = F.concat(F.lit("["), q(F.col("coordinate")), F.lit(","), F.col("granularity").cast("string"), F.lit(","), q(F.col("original_digest")), F.lit(","), q(F.coalesce("summary_digest", F.lit(""))), F.lit("]"))
    each = units.select("doc_id", F.struct("granularity", "block_id", block.alias("b"), unit.alias("u")).alias("x"))
    listed = each.groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("l"))
    joined = lambda name: F.array_join(F.transform("l", lambda x: x[name]), ",")
    return listed.select("doc_id", F.sha2(F.concat(F.lit('{"blocks":['), joined("b"), F.lit("]}")), 256).alias("projection"), F.sha2(F.concat(F.lit('{"units":['), joined("u"), F.lit("]}")), 256).alias("construction"))


UNIT = "granularity int, block_id long, coordinate string, body string, summary string, header map<string,string>, original_digest string, summary_digest string"


def stored(units: DataFrame) -> DataFrame:
    """(doc_id, granularity, block_id, payload): each unit as JSON."""
    return units.select("doc_id", "granularity", "block_id", F.to_json(F.struct(*[c.strip().split()[0] for c in UNIT.split(", ")])).alias("payload"))


def proven_again(payloads: DataFrame) -> DataFrame:
    """Stored units (doc_id, payload) with whether both digests follow again from what the payload holds; one that can't be read isn't proven."""
    return _opened(payloads).drop("u")


def _opened(payloads: DataFrame) -> DataFrame:
    """Stored units with what they hold, ``u``, and whether it is proven."""
    # an array of one, so that what filters ``u`` isn't pushed below and doesn't read the payload again for each of its fields
    u = payloads.select("doc_id", "granularity", "block_id", F.explode(F.array(F.from_json("payload", UNIT))).alias("u"))
    again = [text_digest(content_full(F.col("u.header"), F.col(f"u.{body}"))) == F.col(f"u.{channel}_digest") for channel, body in (("original", "body"), ("summary", "summary"))]
    return u.select("doc_id", "granularity", "block_id", "u", F.coalesce(again[0] & again[1], F.lit(False)).alias("proven"))


def refreshed(payloads: DataFrame, header: Column) -> DataFrame:
    """Proven units under new metadata headers: bodies and summaries stay, texts and digests are new. A payload is read once, where it is."""
    return summarised(_opened(payloads).where("proven").select("doc_id", "u.granularity", "u.block_id", "u.body", "u.summary"), header)


def planned(units: DataFrame, most: int = MOST) -> DataFrame:
    """What to embed, whole: every unit's summary, and every original but the root's, under its header, with its ``place`` in the document.

    ``state`` names what stands against a document's plan, the first that holds: root_summary_missing, root_original_missing,
    over_budget (one of its texts has more than ``most`` bytes); then for a channel: skipped (its body is blank; it has no place) or planned.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    root = F.col("granularity") == 0
    pair = F.array(*[F.struct(F.lit(c).alias("channel"), keep.alias("keep"), F.when(~blank(F.col(b)), F.col(f"{c}_full")).alias("text")) for c, b, keep in (("original", "body", ~root), ("summary", "summary", F.lit(True)))])
    p = units.select("doc_id", "granularity", "block_id", "coordinate", F.explode(pair).alias("p")).select("doc_id", "granularity", "block_id", "coordinate", "p.*")
    bare = root & F.col("text").isNull()
    facts = p.groupBy("doc_id").agg(
        F.bool_or(bare & (F.col("channel") == "summary")).alias("_s"), F.bool_or(bare & (F.col("channel") == "original")).alias("_o"), F.coalesce(F.bool_or(F.col("keep") & (F.octet_length("text") > most)), F.lit(False)).alias("_b"),
    )
    state = F.when(F.col("_s"), "root_summary_missing").when(F.col("_o"), "root_original_missing").when(F.col("_b"), "over_budget").when(F.col("text").isNull(), "skipped").otherwise("planned")
    order = Window.partitionBy("doc_id", F.col("text").isNull()).orderBy("granularity", "block_id", "channel")
    out = p.where("keep").join(facts, "doc_id").withColumn("state", state)
    return out.withColumn("place", F.when(F.col("text").isNotNull(), F.row_number().over(order) - 1)).select("doc_id", "granularity", "block_id", "coordinate", "channel", "text", "state", "place")


def swept(nodes: DataFrame) -> DataFrame:
    """Nodes (doc_id, granularity, block_id, start_byte, end_byte) with parent, depth, sibling, reading order and ``state``, for any nesting, in one sweep.

    Nodes of a document stream by start, the longer first, then by layer; those still open are held in a stack, as deep as the nesting. A node's parent is the innermost open
    one; ``state`` is crossing if it ends behind that or isn't of a deeper layer, outside if none is open but for the first, else nested.
    """
    columns = ["doc_id", "granularity", "block_id", "start_byte", "end_byte"]
    rows = nodes.select(*columns, (-F.col("end_byte")).alias("_neg"))

    def step(state: dict, r: dict) -> dict:
        stack = state["stack"]
        while stack and stack[-1][1] <= r["start_byte"] and not (r["start_byte"] == r["end_byte"] == stack[-1][1]):
            stack.pop()
        parent = stack[-1] if stack else None
        verdict = "nested" if parent is None and state["reading"] == 0 else "outside" if parent is None else "crossing" if r["end_byte"] > parent[1] or r["granularity"] <= parent[3] else "nested"
        sibling = parent[2] if parent else state["roots"]
        if parent:
            parent[2] += 1
        else:
            state["roots"] += 1
        out = {**{c: r[c] for c in columns}, "parent": parent[0] if parent else None, "depth": len(stack), "sibling": sibling, "reading": state["reading"], "state": verdict}
        stack.append([f"g{r['granularity']}b{r['block_id']}", r["end_byte"], 0, r["granularity"]])
        state["reading"] += 1
        return out

    kinds = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in columns)
    return fold(rows, ["doc_id"], ["start_byte", "_neg", "granularity", "block_id"], lambda: {"stack": [], "reading": 0, "roots": 0}, step, f"{kinds}, parent string, depth int, sibling int, reading int, state string")


def structure_verdict(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, verdict, leaves): the first rule that a document's nodes break: root, crossing, coverage, or valid.

    There is one root and every node lies in its parent; the leaves, in reading order, are a partition of the bytes of the text (doc_id, text): ordered,
    not empty, without gap or overlap from the first byte to the last.
    """
    own = Window.partitionBy("doc_id").orderBy("reading")
    leaf = swept(nodes).withColumn("leaf", F.coalesce(F.lead("depth").over(own) <= F.col("depth"), F.lit(True)))
    before = F.coalesce(F.last(F.when(F.col("leaf"), F.col("end_byte")), True).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    facts = leaf.withColumn("_tiled", ~F.col("leaf") | ((F.col("start_byte") == before) & (F.col("end_byte") > F.col("start_byte")))).groupBy("doc_id").agg(
        F.bool_or(F.col("state") == "outside").alias("_roots"), F.bool_or(F.col("state") == "crossing").alias("_cross"), F.bool_and("_tiled").alias("_tiled"),
        F.max(F.when(F.col("leaf"), F.col("end_byte"))).alias("_end"), F.count_if("leaf").alias("leaves"),
    )
    whole = facts.join(texts.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("_size")), "doc_id")
    verdict = F.when(F.col("_roots"), "root").when(F.col("_cross"), "crossing").when(~F.col("_tiled") | (F.col("_end") != F.col("_size")), "coverage").otherwise("valid")
    return whole.select("doc_id", verdict.alias("verdict"), "leaves")


def structured(blocks: DataFrame, kinds: dict[int, str]) -> DataFrame:
    """Nodes of blocks (doc_id, granularity, block_id, start_byte, end_byte): parent is the smallest block of a lower layer around it, depth its number of ancestors.

    Blocks nest by their byte spans; parents are found per layer by the last start at or before, so no pairs of blocks are made.
    """
    w = Window.partitionBy("doc_id").orderBy("start_byte", "granularity", "block_id").rowsBetween(Window.unboundedPreceding, -1)
    out, layers = blocks, sorted(kinds)
    for g in layers[:-1]:
        out = out.withColumn(f"_p{g}", F.last(F.when(F.col("granularity") == g, F.struct("block_id", "end_byte")), True).over(w))
    parent, depth = F.lit(None).cast("string"), F.lit(0)
    for g in layers[:-1]:
        inside = F.coalesce((F.col("granularity") > g) & (F.col(f"_p{g}.end_byte") >= F.col("end_byte")), F.lit(False))
        parent = F.when(inside, F.concat(F.lit(f"g{g}b"), F.col(f"_p{g}.block_id").cast("string"))).otherwise(parent)
        depth = depth + inside.cast("int")
    kind = F.coalesce(*[F.when(F.col("granularity") == g, k) for g, k in kinds.items()])
    return out.select("doc_id", "granularity", "block_id", kind.alias("kind"), parent.alias("parent"), depth.alias("depth"))


def _once(pairs):
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("repeated")
    return dict(pairs)


def layered_state(text: str | None, summaries: bool) -> str:
    """What is wrong with a layered document: json, keys, block, summary, or valid. Keys are closed; summaries are all null or all filled."""
    try:
        value = json.loads(text or "", object_pairs_hook=_once)
    except (ValueError, RecursionError):
        return "json"
    if not isinstance(value, dict) or set(value) != DOCUMENT or not isinstance(value["layered_content"], list):
        return "keys"
    for b in value["layered_content"]:
        if not isinstance(b, dict) or set(b) != BLOCK or not isinstance(b["original_content"], dict) or set(b["original_content"]) != ORIGINAL:
            return "keys"
        if any(isinstance(b[k], bool) or not isinstance(b[k], int) for k in ("block_id", "granularity")) or b["granularity"] not in (0, 1, 2) or not all(x is None or isinstance(x, str) for x in b["original_content"].values()):
            return "block"
        if (b["summary"] is not None) != summaries or summaries and not (isinstance(b["summary"], str) and b["summary"].strip()):
            return "summary"
    return "valid"


@F.pandas_udf(StringType())
def layered_without_summaries(text: pd.Series) -> pd.Series:
    return text.map(lambda t: layered_state(t, False))


@F.pandas_udf(StringType())
def layered_with_summaries(text: pd.Series) -> pd.Series:
    return text.map(lambda t: layered_state(t, True))


def projection_of(text: str | None) -> str | None:
    """The blocks of a projection in canonical JSON, from either shape ({"blocks": [...]} or {"projection": {"blocks": [...]}}); null if a key repeats or the shape is another."""
    try:
        value = json.loads(text or "", object_pairs_hook=_once)
    except (ValueError, RecursionError):
        return None
    if isinstance(value, dict) and set(value) == {"projection"}:
        value = value["projection"]
    if not isinstance(value, dict) or set(value) != {"blocks"} or not isinstance(value["blocks"], list):
        return None
    return json.dumps(value["blocks"], sort_keys=True, ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(StringType())
def projection_blocks(text: pd.Series) -> pd.Series:
    return text.map(projection_of)


def projection_parsed(rows: DataFrame) -> DataFrame:
    """Projections (doc_id, payload, digest) with their blocks and ``state``: parsed, mismatch (another digest) or invalid."""
    out = rows.withColumn("blocks", projection_blocks("payload"))
    return out.withColumn("state", F.when(F.col("blocks").isNull(), "invalid").when(F.sha2("blocks", 256) == F.col("digest"), "parsed").otherwise("mismatch"))
