"""Conditions that flip results, round trips and cases without SQL twins."""

import datetime
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.functions import arrow, text, vector
from lamella.functions.workers import workers_import
from lamella.operators import construct, dispatch, fence, ledger, providers, publish, retrieve, workflow
from lamella.operators.search import search
from lamella.plans import retrieval, textual
from lamella.sources import ledgers, objects
from lamella.sources.tables import binary_objects, table
from lamella.streaming import windows

SF = "/root/testdata/sf0.001"


RECORD = {"vec_id": 7, "team": 1, "item": 1, "namespace": 0, "generation": 2, "unit": 0, "granularity": 0, "channel": "summary", "deleted_at": None, "state": "indexed", "model": "m", "model_key": "k", "model_version": "1", "adapter": "a", "dimension": 2, "artifact": 12, "artifact_type": "index", "revision": 11, "embedding": [1.0, 0.0]}
LEDGERS = {
    "namespace": {"namespace": 0, "metric": "cosine", "status": "active", "ns_deleted_at": None, "ns_model": "m", "ns_model_key": "k", "ns_model_version": "1", "ns_adapter": "a", "ns_dimension": 2},
    "pointer": {"team": 1, "item": 1, "namespace": 0, "active_generation": 2, "pointer_state": "active", "artifact": 12, "last_proof": 5},
    "proof": {"proof": 5, "proof_type": "publication", "proof_version": "v1", **{k: RECORD[k] for k in fence.SET}, "expected_count": 1, "actual_count": 1, "matched_count": 1},
    "item": {"team": 1, "item": 1, "source": 0, "lifecycle": "active", "item_deleted_at": None, "serving_revision": 11},
    "generation": {"team": 1, "artifact": 12, "artifact_type": "index", "validation": "full_valid", "handle": "h"},
}
KINDS = {str: "string", int: "long", list: "array<float>", type(None): "long"}


def one_row(spark, row, usual):
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {KINDS[type(usual[k])]}" for k in row))


def one_fence(spark, record=(), skip=(), **change):
    frames = {k: one_row(spark, v | change.get(k, {}), v) for k, v in LEDGERS.items()}
    records = one_row(spark, RECORD | dict(record), RECORD)
    sources = spark.createDataFrame([(1, 0, "web")], "team long, source long, source_kind string")
    return fence.serving_fence(records, frames["namespace"], frames["pointer"], frames["proof"], frames["item"], sources, frames["generation"], skip=skip).count()


def test_fence_holds_a_good_record(spark):
    assert one_fence(spark) == 1
    assert one_fence(spark, item={"source": 9}) == 1  # a source that isn't known doesn't matter


@pytest.mark.parametrize("skip, change", [
    (("namespace_status",), {"namespace": {"status": "deleted"}}), (("namespace_deleted",), {"namespace": {"ns_deleted_at": 1}}), (("namespace_model",), {"namespace": {"ns_model": "x"}}), (("namespace_dimension",), {"namespace": {"ns_dimension": 3}}),
    (("pointer_state",), {"pointer": {"pointer_state": "withdrawn"}}), (("pointer_generation",), {"pointer": {"active_generation": 3}}), (("pointer_artifact",), {"pointer": {"artifact": 13}}),
    (("proof_type",), {"proof": {"proof_type": "x"}}), (("proof_version",), {"proof": {"proof_version": "v0"}}), *[((f"proof_{c}", "complete_set"), {"proof": {c: "x" if isinstance(RECORD[c], str) else 99}}) for c in fence.SET if c != "model"],
    (("expected_count",), {"proof": {"expected_count": 2}}), (("matched_count",), {"proof": {"matched_count": 2}}), (("complete_set",), {"proof": {"expected_count": 2, "actual_count": 2, "matched_count": 2}}),
    (("generation_type",), {"generation": {"artifact_type": "x"}}), (("generation_validation",), {"generation": {"validation": "partial"}}),
    (("item_lifecycle",), {"item": {"lifecycle": "deleted"}}), (("item_deleted",), {"item": {"item_deleted_at": 1}}), (("item_revision",), {"item": {"serving_revision": 12}}), (("item_serving", "item_revision"), {"item": {"serving_revision": None}}),
])
def test_every_fence_condition_counts(spark, skip, change):
    assert one_fence(spark, **change) == 0
    assert one_fence(spark, skip=skip, **change) == 1


@pytest.mark.parametrize("skip, change", [(("record_deleted", "complete_set"), {"deleted_at": 1}), (("record_state", "complete_set"), {"state": "withdrawn"})])
def test_every_record_condition_counts(spark, skip, change):
    assert one_fence(spark, record=change) == 0
    assert one_fence(spark, record=change, skip=skip) == 1


def test_counts_must_agree(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (2, 1, 1), (None, 1, 1)], "a long, b long, c long")
    assert [r[0] for r in df.select(fence.counts_consistent(F.col("a"), F.col("b"), F.col("c"))).collect()] == [True, False, False, False]


def test_filters_are_closed(spark):
    df = spark.createDataFrame([(1, "web", "summary")], "item long, source_kind string, channel string")
    assert fence.filtered(df, channel=["summary"], item=None).count() == 1
    with pytest.raises(ValueError):
        fence.filtered(df, color="red")
    with pytest.raises(ValueError):
        fence.within(0, df)


@pytest.mark.parametrize("metric", ["cosine", "l2", "inner_product"])
def test_search_equals_brute_force(spark, metric):
    rng = np.random.default_rng(3)
    r, q = rng.normal(size=(300, 8)), rng.normal(size=(9, 8))
    records = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(r)], "vec_id long, namespace long, embedding array<double>")
    asked = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(q)], "query_id long, namespace long, query_embedding array<double>")
    got = search(asked, records, spark.createDataFrame([(0, metric)], "namespace long, metric string"), 5, None).collect()
    for i, v in enumerate(q):
        s = {"cosine": r @ v / np.linalg.norm(r, axis=1) / np.linalg.norm(v), "l2": 1 / (1 + np.linalg.norm(r - v, axis=1)), "inner_product": r @ v}[metric]
        want = sorted(range(300), key=lambda j: (-round(s[j], 6), j))[:5]
        assert [x.vec_id for x in sorted(got, key=lambda x: x["rank"]) if x.query_id == i] == want


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, namespace long, embedding array<double>")
    asked = spark.createDataFrame([(1, 0, [1.0])], "query_id long, namespace long, query_embedding array<double>")
    assert search(asked, none, ledgers.namespaces(spark)).count() == 0


def test_hash_embedding_of_odd_texts(spark):
    df = spark.createDataFrame([(1, "Straße straße x"), (2, ""), (3, None)], "k long, t string")
    out = {r.k: r.embedding for r in vector.hash_embedding(df, "k", "t").collect()}
    assert out[2] == out[3] == [1.0] + [0.0] * 63
    assert abs(sum(x * x for x in out[1]) - 1) < 1e-12


HITS = "query_id long, position int, item long, generation long, granularity int, text string, root_text string"


def test_pack_clips_and_keeps_a_root_once(spark):
    hits = spark.createDataFrame([(1, 1, 5, 1, 1, "a" * 10, "root"), (1, 2, 5, 1, 1, "b" * 10, "root"), (1, 3, 6, 1, 1, None, None)], HITS)
    row = retrieve.pack(hits, chars=20).first()
    assert row.context == "a" * 10 + "\n\nroot\n\n" + "b" * 6
    assert (row.n_hits, row.n_segments, row.n_chars, row.truncated) == (2, 3, 20, True)


def test_pack_says_what_it_left_out(spark):
    one = lambda rows, **k: retrieve.pack(spark.createDataFrame(rows, HITS), **k).first()
    assert not one([(1, 1, 5, 1, 1, "a", None)]).truncated
    assert one([(1, 1, 5, 1, 1, "a", None), (1, 2, 6, 1, 1, None, None)]).truncated  # a hit without text
    assert one([(1, i, i, 1, 1, "a", None) for i in range(6)]).truncated  # beyond the number of hits
    # a root that is a hit itself isn't packed again
    assert one([(1, 1, 5, 1, 0, "root", None), (1, 2, 5, 1, 1, "part", "root")]).context == "root\n\npart"


def test_dedupe_prefers_resolved_only(spark):
    rows = [(1, 2, 5, 1, 0, 0.5, "not_needed"), (1, 3, 5, 1, 0, 0.5, "resolved")]
    df = spark.createDataFrame(rows, "query_id long, vec_id long, item long, generation long, unit long, score double, trace string")
    assert retrieve.deduped(df).first().vec_id == 3


def test_rerank_keeps_order_when_it_cannot_score(spark):
    hits = spark.createDataFrame([(1, 1, 0.5, "x"), (1, 2, 0.4, None)], "query_id long, vec_id long, score double, text string")
    states = lambda out: [(r.vec_id, r.rerank_status) for r in out.orderBy("position").collect()]
    assert states(retrieve.rerank(hits, lambda df: df.withColumn("rerank_score", -F.col("score")))) == [(1, "skipped"), (2, "skipped")]
    assert states(retrieve.rerank(hits, requested=True)) == [(1, "failed"), (2, "failed")]  # asked for, but there is no scorer
    assert states(retrieve.rerank(hits.limit(1), requested=True)) == [(1, "skipped")]
    assert states(retrieve.rerank(hits)) == [(1, "not_requested"), (2, "not_requested")]
    full = hits.na.fill("y")
    assert states(retrieve.rerank(full, lambda df: df.withColumn("rerank_score", -F.col("score")))) == [(2, "applied"), (1, "applied")]
    assert states(retrieve.rerank(full, lambda df: df.withColumn("rerank_score", F.lit(float("nan"))))) == [(1, "failed"), (2, "failed")]


def test_pages_follow_each_other(spark):
    t = [datetime.datetime(2024, 1, 1, 0, 0, i // 2) for i in range(10)]
    df = spark.createDataFrame(list(zip(range(10), t)), "k long, t timestamp")
    seen, after = [], None
    while True:
        page = ledger.keyset_page(df, "t", "k", 3, after).collect()
        seen += [r.k for r in page[:3]]
        if len(page) < 4:
            break
        after = (page[2].t, page[2].k)
    assert seen == list(range(9, -1, -1))
    cursor = ledger.encode_cursor(t[0], 1, {"a": 1})
    assert ledger.decode_cursor(cursor, {"a": 1}) == (str(t[0]), 1)
    with pytest.raises(ValueError):
        ledger.decode_cursor(cursor, {"a": 2})


def test_budget_batches(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([6, 5, 5, 30, 1])], "g long, k long, s long")
    out = {r.k: r.batch for r in ledger.budget_batches(df, "g", "k", "s", 10).collect()}
    assert out == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3}


def test_overflow_takes_the_next_free_pool(spark):
    df = spark.createDataFrame([(1, i, 0, "local") for i in range(4)], "team long, key long, priority int, pool string")
    out = sorted((r.key, r.pool) for r in ledger.admission_overflow(df, [("local", 1), ("remote", 2)]).collect())
    assert out == [(0, "local"), (1, "remote"), (2, "remote")]


def test_heading_split_keeps_headed_texts(spark, tmp_path):
    texts = ["Intro\n## One\nbody\n\nmore\n## Two\nend", "## First\ntext\n## Next", "a\n\n \t\nb\n \nc", "no break at all", "odd", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def brute(t):
        headed, blank, half = re.split(r"\n(?=## )", t), re.split(r"\n[ \t]*\n", t), -(-len(t) // 2)
        return headed if len(headed) > 1 else [x for x in blank if x.strip(" ")] if len(blank) > 1 else [x for x in (t[:half], t[half:]) if x]

    out = sorted(tuple(r) for r in textual.heading_split(spark, str(tmp_path)).select("doc_id", "ordinal", "section").collect())
    assert out == [(i, k, x) for i, t in enumerate(texts) for k, x in enumerate(brute(t))]


def test_sentences_and_redaction(spark):
    samples = ["One. Two!  Three? four", "mit 3.5 Punkten. 终。 好", "", "no end", "see /etc/app/conf.d and https://x.org/a/b ok", "Authorization: abc Bearer xyz.1 postgres://u:p@h/db"]
    df = spark.createDataFrame(list(enumerate(samples)), "k int, t string").select("k", text.sentences(F.col("t")).alias("s"), text.path_redacted(F.col("t")).alias("p"), text.secret_redacted(F.col("t")).alias("r"))
    out = {r.k: r for r in df.collect()}
    for k, t in enumerate(samples):
        assert out[k].s == [m.rstrip() for m in re.findall(r"\S.*?(?:[.!?。！？](?=\s|$)|$)", t, re.S) if m.strip()]
    assert out[4].p == "see [redacted-path] and https://x.org/a/b ok"
    assert "abc" not in out[5].r and "xyz" not in out[5].r and "u:p" not in out[5].r


def test_redaction_of_single_parts(spark):
    cases = {
        "in /etc now": "in [REDACTED_PATH] now", "file:///a/b": "[REDACTED_CONNECTION]", "redis://host/0": "[REDACTED_CONNECTION]", "token=abc, x": "[REDACTED], x", "Password : p1;": "[REDACTED];",
        "https://s3/x?X-Amz-Credential=1&y": "[REDACTED_URL]", "https://s3/x?a=1&token=2 z": "[REDACTED_URL] z", "bearer ab.c": "Bearer [REDACTED]", "api_key: bearer k": "[REDACTED]", "a/b http://x/y": "a/b http:/[REDACTED_PATH]",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.r for r in df.select("t", text.secret_redacted(F.col("t")).alias("r")).collect()} == cases
    units = {"g0:b1": 0, "x.G2": 2, "g_1/a": 1, "granularity=2:x": 2, "granularity-0": 0, "0_b": 0, "0.b": 0, "1": 1, "g3": 1, "Full-text": 0, "leaf9": 2, "seg": 1, "xg0": 1}
    df = spark.createDataFrame([(k,) for k in units], "u string")
    assert {r.u: r.g for r in df.select("u", text.granularity_of(F.col("u")).alias("g")).collect()} == units


def test_urls_have_one_identity(spark):
    same = ["https://host", "HTTPS://Host./", "https://u:p@host:443/#x"]
    assert {arrow.url_form(u) for u in same} == {"https://host/"}
    assert arrow.url_form("http://bücher.de:8080/a?b#c") == "http://xn--bcher-kva.de:8080/a?b" and arrow.url_form("http://[::1]:80/") == "http://[::1]/" and arrow.url_form("http://h:x/") == "http://h:x/"


def test_pool_choice_by_lane_and_queue(spark):
    d = {"kind": "generate", "priority": "normal", "channel": None, "l": 0, "r": 0, "free": True, "quota": True, "over": False}
    L, R = "local-inference", "non-interactive"
    cases = [
        ({"priority": "urgent"}, R), ({"priority": "urgent", "r": 3}, R), ({"priority": "urgent", "r": 4}, None), ({"priority": "high", "r": 4}, None), ({"l": 5}, L), ({"l": 6}, R), ({"l": 6, "r": 4}, None), ({"free": False}, R), ({"free": False, "r": 4}, None),
        ({"priority": "low"}, L), ({"priority": "low", "l": 6}, None), ({"priority": "low", "free": False}, None), ({"priority": "urgent", "quota": False}, None), ({"quota": False}, L), ({"l": 6, "quota": False}, None),
        ({"over": True}, R), ({"over": True, "r": 4}, None), ({"priority": "low", "over": True}, L), ({"priority": "low", "channel": R}, R), ({"priority": "low", "channel": R, "r": 4}, None), ({"priority": "urgent", "channel": L}, L),
        ({"channel": "other"}, None), ({"kind": "embed"}, "embed"), ({"kind": "unpooled"}, None), ({"priority": "odd"}, None),
    ]
    df = spark.createDataFrame([(i, *(d | c).values()) for i, (c, _) in enumerate(cases)], "i int, kind string, priority string, channel string, l int, r int, free boolean, quota boolean, over boolean")
    got = {r.i: r.p for r in df.select("i", ledger.pool_choice(*[F.col(c) for c in ("kind", "priority", "channel", "l", "r", "free", "quota", "over")]).alias("p")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_sanitiser_and_reader_lists():
    page = "<header>h</header><nav>n</nav><p class=c lang=en>a<img src=x alt='q\"' onload=y><input disabled><time datetime=1>t</time><a href=u rel=r title>l</a><fieldset>f</fieldset><aside>s</aside><form>g</form><template/>z"
    safe, removed, bare = arrow.sanitised(page)
    assert safe == '<p lang="en">a<img src="x" alt="q&quot;"><input><time datetime="1">t</time><a href="u" title>l</a><fieldset>f</fieldset>z'
    assert removed == {"header": 1, "nav": 1, "aside": 1, "form": 1, "template": 1} and bare == {"class": 1, "onload": 1, "disabled": 1, "rel": 1}
    assert arrow.read_text("<fieldset>a</fieldset><p>b<form>c</form><canvas>d</canvas>")[0] == "a\nbc"


def test_dispatch(spark):
    workers_import(spark)
    rows = [("application/pdf", b"%PDF-1 (a) Tj"), ("application/pdf", b"no"), ("image/png", b"x"), ("application/json", b'{"b":1, "a":2}'), ("application/json", b"{"), ("text/csv", "é\r\n".encode()), ("text/plain", b"\xff"), ("application/zip", b"x")]
    out = dispatch.decoded(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, media string, raw binary")).orderBy("i").collect()
    assert [(r.decoded, r.state) for r in out] == [("a", "decoded"), (None, "invalid"), ("", "decoded"), ('{"a":2,"b":1}', "decoded"), (None, "invalid"), ("é\n", "decoded"), (None, "invalid"), (None, "unsupported")]
    docs = spark.createDataFrame([("<nav>n</nav><p>a", "text/html"), ("a  b\n\n\n\nc", "text/markdown"), (" ", "text/plain"), ("x", "image/png")], "text string, media string")
    assert [(r.clean, r.state) for r in dispatch.cleaned(docs).collect()] == [("n\n\na", "clean"), ("a b\n\nc", "clean"), ("", "empty"), (None, "mismatch")]


def test_arrow_functions(spark):
    workers_import(spark)
    df = spark.createDataFrame([("<p>a&amp;b<script>x</script><embed>c<p>d", "é\r\nx", '{"b":1,"a":"é"}', "```json\n{\"x\": 1}\n```"), (None, None, '{"a":1,"a":2}', "none")], "h string, n string, j string, f string")
    a, b = df.select(arrow.html_text("h").alias("h"), arrow.web_clean("h").alias("w"), arrow.canonical_text("n").alias("n"), arrow.canonical_json("j").alias("j"), arrow.fenced_json("f").alias("f")).collect()
    assert a.h.text == "a&bc\n\nd" or a.h.text == "a&bc\nd"
    assert a.w.text == "a&b" and a.w.removed == {"script": 1, "embed": 1}  # an element that never ends takes the rest with it
    assert (a.n, a.j, a.f) == ("é\nx", '{"a":"é","b":1}', '{"x": 1}')
    assert (b.h.text, b.n, b.j, b.f) == (None, None, None, None)
    assert arrow.pdf_literals(b"%PDF-1 BT (a\\)b) Tj [(c) -3 (d)] TJ ET") == "a)b\nc\nd" and arrow.pdf_literals(b"x") is None
    assert arrow.pdf_literals(b"%PDF-1 [(c)] TJ (s\\163\\n) ' (\\050) Tj") == "ss\n\n(\nc" and arrow.pdf_literals(b"%PDF-1 (\xff) Tj") is None and arrow.pdf_literals(b"%PDF-1") is None
    assert arrow.pdf_literals(b"%PDF-1 (" + "\ufeffä".encode("utf-16-be") + b") Tj") == "ä" and arrow.pdf_pages(b"%PDF /Type /Page /Type /Pages /Type/Page>") == 2
    assert [x["start"] for x in arrow.anchored("aä b aä", ["aä", "aä", "zz"])] == [0, 6, None]


def test_providers(spark):
    rows = [(1, json.dumps({"searchResultAll": {"searchTotal": [{"id": " A1", "title": "t", "content": " "}, {"id": "a1", "title": None}]}})), (2, json.dumps({"searchResultAll": {"searchTotal": None}})), (3, "broken")]
    flat = providers.mapped(providers.members(spark.createDataFrame(rows, "envelope_id long, payload string"), "tax"), "tax")
    got = flat.orderBy("ordinal").collect()
    assert [(r.envelope_id, r.key, r.title, r.body) for r in got] == [(1, "a1", "t", None), (1, "a1", None, None)]
    assert providers.repeated_keys(flat).first().n == 2
    one = lambda payload, kind: providers.mapped(providers.members(spark.createDataFrame([(1, json.dumps(payload))], "envelope_id long, payload string"), kind), kind).first()
    tax = one({"searchResultAll": {"searchTotal": {"id": "1", "title": "T", "content": "B", "xxgk_aging": "全文有效", "pubName": "P"}}}, "tax")
    assert tax.is_active and tax.clean_text == "T\n\nB" and tax.tags == ["发布单位: P", "文件时效: 全文有效"] and [t.name for t in tax.semantic_tuples] == ["realm", "type", "channel", "source_name", "title", "tags"]
    assert not one({"searchResultAll": {"searchTotal": {"id": "1", "xxgk_aging": "条款失效"}}}, "tax").is_active and not one({"searchResultAll": {"searchTotal": {"id": "1"}}}, "tax").is_active
    agency = one([{"id": 7, "headline": "H", "status": "archived", "advertiser": {"advertiserId": 12106}, "bedrooms": 3, "carspaces": 0, "propertyTypes": ["house", "x"], "address": {"suburb": "S"}}], "agency")
    assert agency.is_active and "source_name=McGrath Box Hill" in agency.facets and agency.tags == ["S", "3.0 bedrooms", "house"]
    listing = lambda **k: one({"tieredResults": [{"results": [{"listingId": "1", "title": "T"} | k]}]}, "listing")
    assert listing().is_active and not listing(channel="Sold").is_active and not listing(status={"type": "withdrawn"}).is_active


def test_publication_moves_forward_only(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "vec_id long, content_digest string")
    first = publish.publish(rows, root, 0)
    assert (first["generation"], first["members"]) == (1, 2)
    with pytest.raises(ValueError):
        publish.publish(rows, root, 0)
    (tmp_path / "index" / "pointers" / ".staged").write_text("{")  # what a crash leaves is never read
    second = publish.publish(rows.orderBy(F.desc("vec_id")), root, 1)
    assert second["generation"] == 2 and second["digest"] == first["digest"]
    assert publish.published(spark, root).count() == 2
    assert spark.read.parquet(f"{root}/{first['folder']}").count() == 2  # older generations stay


def test_binary_objects_are_verified(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    (tmp_path / "y").write_bytes(b"xyz")
    every = binary_objects(spark, f"file://{tmp_path}")
    assert every.count() == 2
    assert binary_objects(spark, f"file://{tmp_path}", every.where("size_bytes = 3 and path like '%/x'")).count() == 1


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    events = table(spark, SF, "events")
    events.write.parquet(src)
    stream = windows.event_stream(spark, src)
    for i, (df, mode) in enumerate([(windows.window_counts(stream, "1 hour"), "complete"), (windows.rate_limited(stream, 0), "complete"), (windows.leases(stream, 60), "update")]):
        q = df.writeStream.format("memory").queryName(f"s{i}").outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("s0").agg(F.sum("n")).first()[0] == events.count()
    assert spark.table("s1").agg(F.sum("n")).first()[0] == events.count()
    assert spark.table("s2").where("state = 'expired'").count() > 0
    assert spark.table("s2").where("state = 'held'").select("user_id").distinct().count() == events.select("user_id").distinct().count()
    out = str(tmp_path / "out")
    q = windows.deduplicated(stream).writeStream.foreachBatch(windows.appended_by_batch(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.parquet(out).select("event_id").distinct().count() == events.count()


def test_broadcast_sides_and_pushdown(spark):
    plan = retrieval.built_fence(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_layered_documents_are_closed():
    block = {"block_id": 1, "granularity": 0, "original_content": {"title": None, "body": "b"}, "summary": None}
    state = lambda v, s=False: construct.layered_state(v if isinstance(v, str) else json.dumps(v), s)
    assert state({"layered_content": [block]}) == "valid" and state({"layered_content": [block]}, True) == "summary" and state({"layered_content": [block | {"summary": "s"}]}, True) == "valid"
    assert state({"layered_content": [block | {"x": 1}]}) == "keys" and state({"layered_content": [block | {"granularity": True}]}) == "block" and state('{"layered_content": [], "layered_content": []}') == "json" and state([]) == "keys"
    assert construct.projection_of('{"projection": {"blocks": [{"b": 1, "a": 2}]}}') == '[{"a":2,"b":1}]' and construct.projection_of('{"blocks": [], "x": 1}') is None


def test_structure_finds_parents_and_depth(spark):
    rows = [(1, 0, 0, 0, 100), (1, 1, 0, 0, 40), (1, 2, 0, 0, 10), (1, 2, 1, 10, 40), (1, 2, 2, 50, 60), (1, 1, 1, 70, 100), (1, 2, 3, 80, 90)]
    df = spark.createDataFrame(rows, "doc_id long, granularity int, block_id long, start_byte long, end_byte long")
    out = {(r.granularity, r.block_id): (r.kind, r.parent, r.depth) for r in construct.structured(df, {0: "d", 1: "s", 2: "p"}).collect()}
    assert out == {(0, 0): ("d", None, 0), (1, 0): ("s", "g0b0", 1), (1, 1): ("s", "g0b0", 1), (2, 0): ("p", "g1b0", 2), (2, 1): ("p", "g1b0", 2), (2, 2): ("p", "g0b0", 1), (2, 3): ("p", "g1b1", 2)}


def test_times_and_ids(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05.5+02:00",), ("2024-01-02T03:04:05",), ("x",)], "t string")
    assert [r[0] for r in df.select(workflow.rfc3339(F.col("t"))).collect()] == ["2024-01-02T03:04:05.000000Z", "2024-01-02T01:04:05.500000Z", None, None]
    counts = spark.createDataFrame([({"0": 1, "2": 0},), ({"x": 1},), ({"0": -1},), ({"0": None},), (None,)], "m map<string, int>")
    assert [r[0] for r in counts.select(workflow.layer_counts_valid(F.col("m"))).collect()] == [True, False, False, False, False]
    with pytest.raises(ValueError):
        workflow.handler_for(df, "t", {"A": "h"})


def test_objects_are_stored_once_under_their_digest(spark, tmp_path):
    folder = f"file://{tmp_path}/objects"
    df = spark.createDataFrame([(i, f"text {i % 3}".encode() if i < 9 else None) for i in range(10)], "key long, content binary").repartition(4)
    for _ in range(2):
        out = objects.stored_objects(df, folder).collect()
    assert len({r.digest for r in out if r.key < 9}) == 3 and [r.digest for r in out if r.key == 9] == [None]
    held = objects.read_objects(spark, folder).collect()
    assert len(held) == 3 and all(r.verified for r in held)


def test_schema_steps_apply_once_and_in_order(spark, tmp_path):
    root, seen = f"file://{tmp_path}", []
    steps = [(n, f"step {n}", lambda s, r, n=n: seen.append(n)) for n in (1, 2)]
    assert objects.migrated(spark, root, steps[:1]) == [1] and objects.migrated(spark, root, steps) == [2] and objects.migrated(spark, root, steps) == [] and seen == [1, 2]
    with pytest.raises(ValueError):
        objects.migrated(spark, root, [(1, "other", None), steps[1]])
    with pytest.raises(ValueError):
        objects.migrated(spark, root, steps[1:])
