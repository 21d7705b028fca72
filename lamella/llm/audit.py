"""Filter interaction audit: what each filter removes in every order of the filters, by part, from one lookup table."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamella.llm.common import py, settle, table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: Rows are counted as a whole, and by label: quality = 1, toxic = 1.
LABELS = ("all", "good", "toxic")
CELLS = len(ORDERS) * (STEPS + 1) * len(LABELS)
#: Parts whose counts a task holds at once (17 KB each); it passes them on beyond that.
PARTS = 1_000
#: Rows looked up at once.
ROWS = 2_000
LAST = (1 << 63) - 1


def first_failures() -> np.ndarray:
    """[failure mask, order]: the step (from 0) at which a row that fails the mask's filters is removed; 5 if none removes it."""
    table_ = np.full((1 << STEPS, len(ORDERS)), STEPS, np.int64)
    for o, order in enumerate(ORDERS):
        for step in reversed(range(STEPS)):
            table_[(np.arange(1 << STEPS) >> FILTERS.index(order[step])) & 1 == 1, o] = step
    return table_


def failures(text: Column) -> Column:
    """Bits 0 to 3: which of the filters A to D a whole text fails."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    conditions = (
        F.size(words) < 200,
        F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        capitals.cast("long") * 100 > F.length(text).cast("long") * 2,
        F.regexp_like(text, F.lit(r"[#$%&*|]")),
    )
    return sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by part, filters failed and labels, one row for each text that occurs in such a class.

    Texts are compared by their SHA-256. Rows of one text are counted before they meet, so a text that fills a third of
    the table reaches its group as a few rows: one a part and label, whatever their number.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), failures(text).alias("mask"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = narrow.join(marks, narrow["id"] == marks["labelled"], "left")
    once = marked.groupBy("id", "part", "digest", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")).agg(F.count(F.lit(1)).alias("n"))
    texts = once.groupBy("digest", "part", "mask", "good", "toxic").agg(F.min("id").alias("least"), F.min_by("n", "id").alias("n_least"), F.sum("n").alias("n"))
    first = F.col("least") == F.min("least").over(Window.partitionBy("digest"))
    texts = texts.withColumn("stand", F.when(first, F.col("n_least")).otherwise(F.lit(0)))
    kept = F.col("stand")
    split = texts.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", kept.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - kept).alias("n")))).alias("x"))
    return split.select("part", "x.mask", "good", "toxic", "x.n").where("n > 0")


def partials(rows: DataFrame) -> DataFrame:
    """(part, counts): arrays of order, step and label, to be summed; a part may come from many tasks, and from one task more than once."""

    def run(batches):
        lookup, held = first_failures(), {}
        at = np.arange(len(ORDERS)) * (STEPS + 1)

        def out():
            parts, counts = list(held), np.concatenate([x.ravel() for x in held.values()]) if held else np.zeros(0, np.int64)
            held.clear()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1) * CELLS, pa.int32()), pa.array(counts, pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), lists], ["part", "counts"])

        for whole in batches:
            for low in range(0, whole.num_rows, ROWS):
                b = whole.slice(low, ROWS)
                names = b.column("part").dictionary_encode()
                cells = lookup[b.column("mask").to_numpy()] + at
                n = b.column("n").to_numpy()
                weights = [n, n * b.column("good").to_numpy(), n * b.column("toxic").to_numpy()]
                width = len(ORDERS) * (STEPS + 1)
                spread = (names.indices.to_numpy()[:, None] * width + cells).ravel()
                # sums of doubles are exact below 2^53
                sums = [np.bincount(spread, np.repeat(w, len(ORDERS)), len(names.dictionary) * width).astype(np.int64).reshape(-1, width) for w in weights]
                for k, part in enumerate(names.dictionary.to_pylist()):
                    found = np.stack([s[k] for s in sums], 1)
                    held[part] = held[part] + found if part in held else found
                if len(held) >= PARTS:
                    yield out()
        if held:
            yield out()

    return py(rows.sparkSession, rows, run, "part string, counts array<long>")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part (source), order of the filters and step: documents kept, removed, redundant, failing this filter only, labelled ones lost, and Shapley sums.

    A document's failures are a mask of five bits; for each of the 120 orders a table gives the step that removes such a mask, so all
    orders are counted in one pass, and everything else follows from the removals: a filter's failures are its removals where it
    comes first, those that fail nothing else its removals where it comes last. Null texts are empty; a null source is the part
    of the empty string; a null doc_id comes after all ids where equal texts are compared; rows that repeat a doc_id count
    each, and equal texts at the smallest id all stand; a doc_id labelled twice has the larger labels, and labels of no document are
    ignored; extra columns are left out, and an empty table gives an empty result.
    """
    counted = settle(masks(docs.select("doc_id", "text", "source"), labels.select("doc_id", "quality", "toxic")), "masks")
    cells = partials(counted).select("part", F.posexplode("counts")).groupBy("part", "pos").agg(F.sum("col").alias("n"))
    step, order = F.expr(f"pos div {len(LABELS)} % {STEPS + 1}"), F.expr(f"pos div {len(LABELS) * (STEPS + 1)}")
    pick = [F.sum(F.when(F.col("pos") % len(LABELS) == i, F.col("n"))).alias(x) for i, x in enumerate(("removed", "good_lost", "toxic_lost"))]
    wide = cells.groupBy("part", order.cast("int").alias("o"), (step + 1).cast("int").alias("step")).agg(*pick)
    names = F.element_at(F.array(*map(F.lit, ORDERS)), F.col("o") + 1)
    wide = wide.withColumn("filter_order", names).withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    so_far, own = Window.partitionBy("part", "o").orderBy("step").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("part", "letter")
    total = F.sum("removed").over(Window.partitionBy("part", "o"))

    def where(s: int) -> Column:
        return F.max(F.when(F.col("step") == s, F.col("removed"))).over(own)

    out = wide.select(
        "part", "filter_order", "step", (total - F.sum("removed").over(so_far)).alias("kept"), "removed", (where(1) - F.col("removed")).alias("redundant"), where(STEPS).alias("unique_fails"), "good_lost", "toxic_lost",
        F.sum("removed").over(own).alias("shapley"),
    )
    return out.where(F.col("step") <= STEPS)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of five filters over all documents, by source."""
    return audit(table(spark, sf_dir, "documents", "doc_id", "text", "source"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


ORACLE_SQL = rf"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
split AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, doc_id > min(doc_id) OVER (PARTITION BY x) AS again FROM texts),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    concat(CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
      CASE WHEN 100 * len(regexp_extract_all(x, '[A-Z]')) > 2 * length(x) THEN 'C' END, CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' END, CASE WHEN again THEN 'E' END) AS mask
  FROM split LEFT JOIN marks USING (doc_id)
),
counted AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, mask),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT a.c || b.c || d.c || e.c || f.c AS filter_order FROM letters a, letters b, letters d, letters e, letters f
  WHERE a.c NOT IN (b.c, d.c, e.c, f.c) AND b.c NOT IN (d.c, e.c, f.c) AND d.c NOT IN (e.c, f.c) AND e.c <> f.c
),
steps AS (SELECT filter_order, s::INT AS step, substr(filter_order, s, 1) AS own, substr(filter_order, 1, s - 1) AS earlier FROM orders, range(1, 6) t(s)),
sums AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE stands AND NOT contains(mask, own)), 0) AS kept, coalesce(sum(n) FILTER (WHERE stands AND contains(mask, own)), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE NOT stands AND contains(mask, own)), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE stands AND contains(mask, own)), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE stands AND contains(mask, own)), 0) AS toxic_lost
  FROM (SELECT *, translate(mask, earlier, '') = mask AS stands FROM counted, steps) GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM sums
"""
