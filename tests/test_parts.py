"""Parts of texts, headers, envelopes and delays on fixed cases."""

import pytest
from pyspark.sql import functions as F

from lamella.functions import text
from lamella.operators import ledger, providers


def cut(t, d):
    """Cut before each delimiter, found from left to right."""
    out, at = [], 0
    while (next_ := t.find(d, at + (len(d) if out or t.startswith(d) else 0))) >= 0:
        if t[at:next_]:
            out.append(t[at:next_])
        at = next_
        out = out or [""]
    return [x for x in [*out, t[at:]] if x]


TEXTS = ["", "a", "ab", "a\n## b\n## c", "## a", "## a## b", "x ## a", "a\n\n\nb", "\n\n\n\n", "\n\na", "a\nb\nc", "\n", "é漢𝔘x", "a\r\nb"]


@pytest.mark.parametrize("granularity", [0, 1, 2])
def test_parts_join_to_the_text_again(spark, granularity):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").select("i", text.level_parts(F.col("t"), F.lit(granularity)).alias("p"))
    for r in rows.collect():
        t = TEXTS[r.i]
        assert "".join(r.p) == t
        if granularity == 0 or not t:
            assert r.p == [t]
        else:
            several = next((p for p in (cut(t, d) for d in text.CUTS[granularity]) if len(p) > 1), None)
            half = max(1, len(t) // 2)
            assert r.p == (several or [x for x in (t[:half], t[half:]) if x]), t


def test_headers_have_closed_keys_and_single_lines(spark):
    cases = [({}, True), (None, True), ({"a.b-c_1": "x y"}, True), ({"A": "x"}, False), ({"1a": "x"}, False), ({"a" * 64: ""}, True), ({"a" * 65: ""}, False), ({"a": None}, False), ({"a": "x\ny"}, False), ({"a": "x\r"}, False), ({"a": "x\0"}, False), ({"a\n": "x"}, False), ({"": "x"}, False)]
    rows = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "i int, m map<string,string>")
    assert [(r.i, r.ok) for r in rows.select("i", text.header_valid(F.col("m")).alias("ok")).orderBy("i").collect()] == [(i, ok) for i, (_, ok) in enumerate(cases)]


def test_envelopes_beyond_the_bound_are_errors(spark):
    rows = [("many", str(i)) for i in range(6)] + [("bare", "a"), ("bare", None), ("twice", " Straße"), ("twice", "STRASSE "), ("good", "a"), ("good", "b")]
    found = {r.envelope_id: (r.n, r.state) for r in providers.envelope_states(spark.createDataFrame(rows, "envelope_id string, key string"), 5).collect()}
    assert found == {"many": (6, "too_many"), "bare": (2, "invalid_record"), "twice": (2, "repeated"), "good": (2, "ok")}
    assert providers.envelope_states(spark.createDataFrame([], "envelope_id string, key string")).count() == 0


def test_delays_stay_below_their_ceiling_and_are_drawn_alike_again(spark):
    rows = spark.range(4_000).select("id", (F.col("id") % 8).cast("int").alias("attempt"), F.expr("timestamp'2024-01-01 00:00:00'").alias("created_at"))
    out = ledger.delayed(rows, "s").withColumn("us", F.unix_micros("due_at") - F.unix_micros("created_at"))
    assert out.where("us <> delay_us or delay_us < 0 or delay_us >= least(5 * pow(2, attempt), 60) * 1000000").count() == 0
    spread = {r.attempt: r.m for r in out.groupBy("attempt").agg((F.avg("delay_us") / 1_000_000).alias("m")).collect()}
    assert all(abs(m / min(5 * 2**a, 60) - 0.5) < 0.06 for a, m in spread.items())
    assert ledger.delayed(rows.repartition(3), "s").exceptAll(out.drop("us")).count() == 0


def test_due_rows_come_oldest_first(spark):
    rows = spark.createDataFrame([(1, 5), (2, 3), (3, 3), (4, None), (5, 9), (6, 8)], "id long, at long")
    due = lambda n: [r.id for r in ledger.due_queue(rows, "at", "id", F.lit(8), n).collect()]
    assert due(10) == [2, 3, 1, 6] and due(2) == [2, 3]
    plan = ledger.due_queue(rows, "at", "id", F.lit(8))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
