"""The training-data operators against brute force, round trips, SQL twins and odd inputs."""

import hashlib
import re
import struct
import tarfile
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lamella.llm import bpe, gridjoin, licenses, media, mixing, partenum, scoring, toxicity, wrapper
from lamella.llm.common import table

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, rep long, held_out string, n_tokens string, copy_no string, word string"
LONG = "One two three four five six. " * 20_000


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, extra columns with clashing names."""
    more = (0.5, 1, 2, "x", "y", "z", "w")
    rows = [(1, "alpha beta gamma delta epsilon zeta", "en", "a", 35, *more), (1, "alpha beta gamma delta epsilon zeta", "en", "a", 35, *more), (2, "Alpha beta gamma delta epsilon zeta", None, None, None, *[None] * 7), (3, None, "en", "a", 0, *more), (4, "", "en", "b", 0, *more), (5, " \t\n", "en", "b", 3, *more), (None, "mit license", "en", "b", 11, *more), (7, LONG, "en", "a", len(LONG), *more), (8, "𝔘nicode <|endoftext|> 終わり \u0000 é", "ja", "c", 9, *more)]
    return spark.createDataFrame(rows, COLUMNS)


def documents(spark):
    return table(spark, SF, "documents")


def local(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# 1 LM scoring

def test_lm_scoring_prefers_target_like_texts(spark):
    docs = spark.createDataFrame([(i, "red green blue " * 9 if i % 2 else "one two three " * 9) for i in range(60)], "doc_id long, text string")
    targets = docs.where("doc_id % 2 = 1 and doc_id < 40").select("doc_id")
    out = {r.doc_id: r for r in scoring.score(docs, targets).collect()}
    assert out[41].score < 0 < out[40].score and out[41].n_tokens == 27


def test_lm_scoring_equals_brute_force(spark):
    docs = documents(spark).select("doc_id", "text").where("doc_id is not null").collect()
    goal = {d.doc_id for d in docs if d.doc_id % 3 == 0}
    pairs = {d.doc_id: list(zip(["<s>", *(w := scoring.words(d.text))], w)) for d in docs}
    vocabulary = len({b for p in pairs.values() for _, b in p})
    for inside, column in ((set(pairs), "loss_background"), (goal, "loss_target")):
        every = [Counter(k for i in inside for p in pairs[i] for k in (p, p[1], (p[0],))), sum(len(pairs[i]) for i in inside)]
        out = {r.doc_id: r for r in scoring.score(documents(spark), spark.createDataFrame([(i,) for i in goal], "doc_id long")).collect()}
        assert len(out) == len(docs)
        for i, own in pairs.items():
            mine = Counter(k for p in own for k in (p, p[1], (p[0],))) if i in inside else Counter()
            n = every[1] - (len(own) if i in inside else 0)
            loss = 0.0
            for p in own:
                single = (every[0][p[1]] - mine[p[1]] + scoring.ALPHA) / (n + scoring.ALPHA * (vocabulary + 1))
                loss -= np.log2((every[0][p] - mine[p] + scoring.MU * single) / (every[0][p[0],] - mine[p[0],] + scoring.MU))
            assert out[i].n_tokens == len(own) and abs(out[i][column] - loss / max(1, len(own))) < 1e-9


def test_lm_scoring_of_odd_rows(spark, odd):
    out = scoring.score(odd, spark.createDataFrame([(1,), (None,)], "doc_id long")).collect()
    assert len(out) == 9 and all(np.isfinite(r.score) for r in out)
    assert all((r.n_tokens, r.score) == (0, 0.0) for r in out if r.doc_id in (3, 4, 5))
    assert scoring.score(odd.limit(0), spark.createDataFrame([], "doc_id long")).count() == 0


# 2 HTML extraction

PAGE = """<html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><header class="site-header"><h1>Site</h1></header><form id="f"><div class="layout sidebar-right"><div id="cookie-banner">Cookies</div>
<main><nav>x</nav><h1>Title &amp; co {i}</h1><article><header><h2>Head {i}</h2><p>by me</p></header><p>First <b>bold</b><br>line&nbsp;two {i} with a fair number of further words<p>Second <a href="#">link</a> <span class="ad">buy</span> end {i}<div class="share">Share</div><p>Read this on all our sites</p><ul><li>one {i}<li>two</ul><pre>x
 y {i}</pre><script>if(a<b){{"</p>"}}</script><!-- c > d --><section id="comments"><p>reader</p></section></article><aside>side</aside></main></div></form><footer>f</footer>"""
MAIN = "Title & co {i}\nHead {i}\nFirst bold line two {i} with a fair number of further words\nSecond link end {i}\n{t}one {i}\ntwo\nx y {i}"


def test_html_furniture_is_left_out():
    assert wrapper.extract(PAGE.format(i=3), [])[0] == MAIN.format(i=3, t="Read this on all our sites\n")


def test_html_template_of_a_host(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i=i)) for i in range(30)] + [(99, None, None), (100, "http://x", ""), (None, "odd", "<p>a<"), (0, "http://h.example/0", PAGE.format(i=0))]
    out = wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.page_id is not None and r.page_id < 30:
            assert r.text == MAIN.format(i=r.page_id, t="") and r.n_template > 5 and r.n_chars == len(r.text)
    assert {(r.page_id, r.text) for r in out if r.page_id in (99, 100)} == {(99, ""), (100, "")}
    assert [r.text for r in out if r.page_id is None] == ["a<"]
    assert wrapper.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_copies_are_no_template(spark):
    rows = [(i, "http://h/", "<article><h1>Same title</h1><p>The same long paragraph of text here.</p><p>And %s more.</p></article>" % i) for i in range(20)]
    assert all(r.text.startswith("Same title\nThe same long") for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())


def words(*seed, n=30):
    """Words that no other seed gives."""
    return " ".join(hashlib.md5(repr((*seed, k)).encode()).hexdigest()[:6] for k in range(n))


def mains(spark, bodies, host="h"):
    rows = [(i, f"http://{host}/{i}", b) for i, b in enumerate(bodies)]
    return {r.page_id: r.text for r in wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_html_template_is_counted_over_all_pages(spark):
    # two layouts, on half of the host's pages each, with their own boilerplate
    a, b = ("<section>Boilerplate of A</section><p>%s</p>", "<blockquote>Boilerplate of B</blockquote><div><p>%s</p></div>")
    # many hosts: four page hashes never fall well on all of them
    for salt in range(3):
        assert mains(spark, [(a, b)[i % 2] % words(salt, i) for i in range(20)]) == {i: words(salt, i) for i in range(20)}
    # a passage in one place on a third of the pages is content, on any host
    pages = [(f"http://h{h}/{i}", "<p>Head of site</p><p>%s</p><p>%s</p>" % (words(h, i), "A passage often quoted" if i % 3 == 0 else words(h, i, "x"))) for h in range(30) for i in range(12)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    out = wrapper.main_text(df).collect()
    assert len(out) == 360 and all("Head of site" not in r.text for r in out) and sum("often quoted" in r.text for r in out) == 120


def test_html_small_hosts_get_a_template(spark):
    for n in (2, 3, 4):
        assert mains(spark, [f"<div>Welcome to our site</div><p>{words(n, i)}</p>" for i in range(n)]) == {i: words(n, i) for i in range(n)}


def test_html_long_boilerplate_is_no_copy(spark):
    for n in (12, 50, 400):  # words of boilerplate around articles of 20
        pages = [f"<div>{words('a', n=n)}</div><div>{words(n, i, n=20)}</div><div>{words('b', n=n)}</div>" for i in range(12)]
        assert mains(spark, pages) == {i: words(n, i, n=20) for i in range(12)}


def test_html_deep_and_unclosed_pages():
    import time

    deep = "<div>" * 100_000 + "core" + "</div>" * 100_000 + "<p>after</p>"
    assert wrapper.extract(deep, [])[0] == "core\nafter"
    for odd in ("<a " * 300_000, "<p>text</p>" + "<b" * 300_000, "<" * 500_000, "<!--" * 200_000, "<p>x" * 100_000, "<a \"'>" * 100_000):
        began = time.time()
        wrapper.extract(odd, [])
        assert time.time() - began < 20, odd[:10]


def test_html_names_inside_articles_stay(spark):
    page = "<article><div class='promotion-of-staff'>Promoted people</div><section class='legal'>The law</section><fieldset>A field</fieldset><div class='ad-slot'>Buy</div><div class='comments-list'>Reader</div></article>"
    assert wrapper.extract(page, [])[0] == "Promoted people\nThe law\nA field"


def test_html_slots_decide_where_markup_is_silent(spark):
    # one page's advert lost its class: the slot tells
    pages = [f"<div class='ad'>{words('ad', i, n=5)}</div><article><p>{words('art', i)}</p></article>" for i in range(12)]
    pages[5] = pages[5].replace(" class='ad'", "")
    rows = [(i, f"http://h/{i}", p, "x") for i, p in enumerate(pages)]
    out = wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert all(r.text == words("art", r.page_id) and r.n_template == 1 for r in out)


def match_by_hand(a, b):
    """The greatest matching of two trees by trying every order-keeping assignment of children."""
    if a[0] != b[0]:
        return 0
    if not a[2] or not b[2]:
        return 2 if a[1] and a[1] == b[1] else 1

    def best(x, y):
        return max(best(x[1:], y), best(x, y[1:]), best(x[1:], y[1:]) + match_by_hand(x[0], y[0])) if x and y else 0

    return 1 + best(a[2], b[2])


def test_tree_matching_equals_brute_force():
    rng = np.random.default_rng(4)

    def tree(depth):
        kids = [tree(depth - 1) for _ in range(rng.integers(0, 4))] if depth else []
        return ["abc"[rng.integers(0, 3)], 0 if kids else int(rng.integers(0, 3)), kids]

    for _ in range(300):
        a, b = ["r", 0, [tree(2) for _ in range(3)]], ["r", 0, [tree(2) for _ in range(3)]]
        assert wrapper.match(a, b) == match_by_hand(a, b)


def test_simple_tree_matching():
    a = ["r", 0, [["x", 0, []], ["y", 0, [["z", 0, []]]]]]
    b = ["r", 0, [["y", 0, [["z", 0, []]]]]]
    assert wrapper.match(a, a) == 4 and wrapper.match(a, b) == 3 and wrapper.match(a, ["q", 0, []]) == 0


# 3 toxicity

def test_toxicity_held_out(spark):
    docs, labels = documents(spark), table(spark, "/root/testdata/sf0.01", "labels", "doc_id", "toxic")
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = {r.doc_id: r for r in toxicity.classify(docs.select("doc_id", "text"), labels).collect()}
    test = [(out[r.doc_id].score, r.toxic) for r in labels.collect() if out[r.doc_id].held_out]
    pos, neg = ([s for s, y in test if y == k] for k in (1, 0))
    assert np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in out.items())


def kernel_by_hand(a, b):
    """Sum over shared subsequences of three letters of the decayed widths of their windows, over the words' norms."""

    def features(word):
        row, out = [toxicity.START, *[k for c in word if (k := toxicity._classes()[c])]], Counter()
        norm = 0.0
        for i in range(len(row)):
            for j in range(i + 1, min(i + toxicity.WINDOW - 1, len(row))):
                for k in range(j + 1, min(i + toxicity.WINDOW, len(row))):
                    w = toxicity.DECAY ** (k - i - 2)
                    out[row[i], row[j], row[k]] += w
                    norm += w * w
        return out, norm**0.5

    (x, n), (y, m) = features(a), features(b)
    return sum(v * y[k] for k, v in x.items()) / n / m


def test_kernel_equals_a_direct_sum():
    for a, b in (("idiot", "idi0t"), ("idiot", "i-d-i-o-t"), ("worthless", "worthlesss"), ("abc", "xyz"), ("moron", "mormon"), ("straße", "strasse")):
        assert abs(toxicity.dot(toxicity.letters([a]), toxicity.embedding(b))[0] - kernel_by_hand(a, b)) < 1e-5


def test_toxicity_of_odd_rows_with_a_fitted_machine(spark, odd):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("aeiourstnl"), rng.integers(3, 8)))
    rows = [(100 + i, " ".join([word() for _ in range(30)] + (["zzkrumpf" if i % 3 else "zzkr-umpf"] if i % 2 else []))) for i in range(120)]
    docs = odd.select("doc_id", "text", "score", "held_out").unionByName(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit(0.0), "held_out": F.lit("x")}))
    labels = spark.createDataFrame([(i, int(i % 2)) for i, _ in rows] + [(1, 0), (1, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels) is not None
    out = toxicity.classify(docs, labels).collect()
    assert len(out) == 9 + len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.predicted == r.doc_id % 2 for r in out if r.doc_id is not None and r.doc_id >= 100)
    assert len({r.score for r in out if r.doc_id == 1}) == 1 and not any(r.predicted for r in out if r.doc_id in (3, 4, 5))


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.classify(odd, labels)
    assert out.count() == 9 and out.where("score between 0 and 1").count() == 9
    assert toxicity.classify(odd.limit(0), labels.limit(0)).count() == 0


# 4 mixing

def test_mixing_matches_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = mixing.op4_mix_sources(spark, SF)
    other = c.sql(mixing.ORACLE_SQL)
    names = sorted(df.columns)
    assert sorted(map(repr, local(df, *names))) == sorted(repr(tuple(r[other.columns.index(n)] for n in names)) for r in other.fetchall())


def test_mixing_meets_weights(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("source"))
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 9.0)], "source string, weight double").where("source <> 'c'")
    n = {r.source: r["count"] for r in mixing.replicate(docs, weights).groupBy("source").count().collect()}
    assert abs(n["a"] / 3000 - 1) < 0.1 and abs(n["b"] / 1000 - 1) < 0.1


def test_mixing_of_odd_rows(spark, odd):
    out = mixing.replicate(odd).collect()
    assert [r.shuffle_key for r in out] == sorted(r.shuffle_key for r in out)
    assert len({(r.n_copies) for r in out if r.doc_id == 1}) <= 1
    assert mixing.replicate(odd.limit(0)).count() == 0


# 5 media columns

def check_media(docs, out):
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    payload = lambda t: (raw := (t or "").encode()) + bytes(-len(raw) % 64 or (0 if raw else 64))
    want = sorted((repr(i), len((t or "").encode()), len(p := payload(t)), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for i, t in ((r.doc_id, r.text) for r in docs.collect()))
    assert sorted((repr(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == want
    by_digest = {hashlib.sha256(payload(t)).hexdigest(): payload(t) for _, t in texts}
    for r in out:
        p = by_digest[r.digest]
        x = np.frombuffer(p, np.uint8).astype(float)
        with tarfile.open(r.shard.removeprefix("file://")) as tar:
            member = tar.getmember(f"{r.digest}.png")
            image = tar.extractfile(member).read()
        assert (member.offset_data, member.size) == (r.offset, r.length) and (len(image), hashlib.sha256(image).hexdigest()) == (r.media_bytes, r.media_sha256)
        assert (r.width, r.height) == (64, len(p) // 64) == struct.unpack(">II", image[16:24])
        # a decoder of its own: the chunks' checksums, the scan lines
        at, data = 8, b""
        while at < len(image):
            n, kind = struct.unpack(">I4s", image[at : at + 8])
            assert zlib.crc32(image[at + 4 : at + 8 + n]) == struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]
            data += image[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
            at += n + 12
        lines = zlib.decompress(data)
        assert b"".join(lines[i + 1 : i + 65] for i in range(0, len(lines), 65)) == p
        mean, deviation, _ = r.feature.split("-")
        assert abs(int(mean) - x.mean() * 100) < 1 and abs(int(deviation) - x.std() * 100) < 1
    for values in ({(r.feature, r.media_sha256, r.shard, r.offset) for r in out if r.digest == d} for d in by_digest):
        assert len(values) == 1


def test_media_round_trip(spark, odd):
    check_media(documents(spark).select("doc_id", "text").limit(60), media.media_columns(documents(spark).select("doc_id", "text").limit(60)).collect())
    check_media(odd, media.media_columns(odd).collect())
    assert media.media_columns(odd.limit(0)).count() == 0
    assert media.op5_media_columns(spark, SF).count() == documents(spark).count()


# 6 n-gram Jaccard join

def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components(pairs, ids):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def jaccard_links(sets):
    ids = sorted(sets)
    return [(a, b) for i, a in enumerate(ids) for b in ids[:i] if 100 * (k := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - k) and k]


def check_join(docs):
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    want = components(jaccard_links(sets), sets)
    assert sorted(local(partenum.near_duplicates(docs), "doc_id", "n_shingles", "component_id")) == sorted((d, len(s), want[d]) for d, s in sets.items())


def test_jaccard_join_equals_brute_force(spark):
    check_join(documents(spark))


def test_jaccard_join_of_close_sets(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 500, 120)]
    rows = []
    for i in range(150):
        w = list(base)
        for j in rng.integers(0, 120, i % 6):
            w[j] = f"x{rng.integers(0, 50)}"
        rows.append((i, " ".join(w[: 120 - i % 9])))
    rows += [(200 + i, t) for i, t in enumerate(["a b c", "A b\tc", "a b", "", "   ", "a b c d e"])]
    check_join(spark.createDataFrame(rows, "doc_id long, text string"))


def test_jaccard_join_of_odd_rows(spark, odd):
    out = partenum.near_duplicates(odd).collect()
    assert len(out) == 9
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in out}
    assert got[1] == (2, 1) and got[2] == (2, 1) and got[3] == (0, 3) and got[5] == (0, 5) and got[None][1] is None
    assert partenum.near_duplicates(odd.limit(0)).count() == 0


# 7 and 8 byte-pair encoding

def tokenizer(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.public_path(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(spark, odd):
    t = tokenizer("byte_bpe_50k.json")
    for docs in (documents(spark).select("doc_id", "text"), odd.select("doc_id", "text")):
        texts = docs.collect()
        want = [(r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids) for r in texts]
        want = [(d, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(i, skip_special_tokens=False).encode()).hexdigest()) for d, i in want]
        assert sorted(map(repr, local(bpe.digests(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))) == sorted(map(repr, want))


def test_token_counts_equal_the_library(spark, odd):
    t = tokenizer("word_bpe_49k.json")
    for docs in (documents(spark).select("doc_id", "text"), odd.select("doc_id", "text")):
        want = [(r.doc_id, len((r.text or "").encode()), n := len(t.encode(r.text or "", add_special_tokens=False).ids), n > 2048) for r in docs.collect()]
        assert sorted(map(repr, local(bpe.token_counts(docs, bpe.public_path("word_bpe_49k.json")), "doc_id", "n_bytes", "n_tokens", "over_limit"))) == sorted(map(repr, want))


def test_every_code_point_splits_as_in_the_library():
    word, byte = (tokenizer(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    vw, vb = (bpe.vocabulary(bpe.public_path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    lower = bpe.lower_cases()
    normal, split = bpe.Normal(lower, bpe.odd_cases(lower)), bpe.splitter(*bpe.splitting(bpe.WORD_PATTERN))
    bytes_ = bpe.splitter(*bpe.splitting(bpe.BYTE_PATTERN))
    for a in [*range(0, 0xD800, 64), *range(0xE000, 0x34000, 64), *range(0xE0000, 0xE0200, 64)]:
        text = " ".join(f"ab{chr(c)}c1{chr(c)} d{chr(c)}{chr(c)}" for c in range(a, min(a + 64, 0x110000)))
        count, special = bpe.frequencies(text, vw, normal, split)
        assert special + sum(n * len(vw.merge(w.encode())) for w, n in count.items()) == len(word.encode(text, add_special_tokens=False).ids), hex(a)
        assert np.frombuffer(bpe.encode_text(text, vb, {}, bytes_), "<u4").tolist() == byte.encode(text, add_special_tokens=False).ids, hex(a)


def test_encoding_of_an_empty_table(spark, odd):
    assert bpe.digests(odd.limit(0)).count() == 0 and bpe.token_counts(odd.limit(0), bpe.public_path("word_bpe_49k.json")).count() == 0


def test_long_words_merge_alike():
    v = bpe.vocabulary(bpe.public_path("byte_bpe_50k.json"))
    word = ("abcabdxyz" * 60).encode()
    ids = [v.single[b] for b in word]
    short, bpe.SHORT = bpe.SHORT, 10**9
    try:
        plain = v.merge(word)
    finally:
        bpe.SHORT = short
    assert v._merge_long(ids) == plain


# 9 embeddings

def check_vectors(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, n long, rep long" if len(rows[0]) > 2 else f"vec_id long, embedding array<{kind}>")
    good = {r[0]: np.array(r[1], np.float32 if kind == "float" else float).astype(float) for r in rows if r[0] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])}
    pairs = [(a, b) for a in good for b in good if b < a and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.9]
    ids = [r[0] for r in rows if r[0] is not None]
    want, n = components(pairs, ids), {i: 0 for i in ids}
    for p in pairs:
        for i in p:
            n[i] += 1
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in gridjoin.near_vectors(df).collect() if r.vec_id is not None}
    assert got == {i: (n[i], want[i], want[i] == i) for i in ids}


def test_grid_join_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * (0.1 + 0.03 * (i % 13))).tolist()) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(20)]
    block, part, fan = gridjoin.BLOCK, gridjoin.PART, gridjoin.FAN
    gridjoin.BLOCK, gridjoin.PART, gridjoin.FAN = 32, 8, 3
    try:
        check_vectors(spark, rows)
        check_vectors(spark, rows, "double")
    finally:
        gridjoin.BLOCK, gridjoin.PART, gridjoin.FAN = block, part, fan


def test_grid_join_of_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [-1.0, 0.0]), (1, [1.0, 0.0])]
    out = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in gridjoin.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    # vector 1 stands for two directions, which its id joins into one component
    assert [(v, c, k) for v, _, c, k in out] == [(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (4, 4, True)]
    assert {v: n for v, n, _, _ in out if v > 1} == {2: 2, 3: 1, 4: 0}


def test_grid_join_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1, 1), (2, [0.0, 0.0], 1, 1), (3, None, 1, 1), (4, [], 1, 1), (5, [1.0, None], 1, 1), (6, [float("nan"), 1.0], 1, 1), (7, [float("inf"), 1.0], 1, 1), (8, [2.0, 0.01], None, None), (9, [1.0, 0.0, 0.0], 1, 1), (None, [1.0, 0.0], 1, 1)]
    check_vectors(spark, rows)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert gridjoin.near_vectors(empty).count() == 0


# 10 licenses

def test_licenses_base_and_suppression(spark):
    texts = ["Under the GNU General Public License, version 3 and the MIT-License.", "SPDX-License-Identifier: Apache-2.0 (Apache License 2.0)", "permit licensed", "CC BY-SA 4.0 cc by", "mit license mit license", None, ""]
    out = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (out[0].n_base, out[0].first_word, out[0].last_word, out[0].base_labels) == (2, 2, 10, "gpl,mit")
    assert "apache-2.0" in out[1].labels and out[1].base_labels == "apache"
    assert (out[2].n_base, out[2].labels, out[2].first_word) == (0, "", None)
    assert out[3].labels == "cc-by,cc-by-sa" and out[4].n_base == 2
    assert (out[5].n_words, out[6].n_words, out[5].score) == (0, 0, 0.0)


def examples(pattern):
    """Every string that a rule's regex of literals, classes, options and alternatives matches."""
    out = [""]
    for op, arg in pattern:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "IN":
            more = [c for o, a in arg for c in ([chr(a)] if str(o) == "LITERAL" else map(chr, range(a[0], a[1] + 1)))]
        elif name == "MAX_REPEAT":
            assert arg[:2] == (0, 1)
            more = ["", *examples(arg[2])]
        elif name == "SUBPATTERN":
            more = examples(arg[3])
        else:
            assert name == "BRANCH", name
            more = [x for b in arg[1] for x in examples(b)]
        out = [a + b for a in out for b in more]
    return out


def test_license_keywords_and_gates_pass_every_example(spark):
    rows = [(label, keyword, x) for label, keyword, name in licenses.FAMILIES for x in examples(re._parser.parse(name))]
    written = [(label, keyword, re.sub(r"\.\{\d+,\d+\}", "mit", name).replace(r"\d", "1")) for label, keyword, name, _ in licenses.NOTICES]
    rows += [(label, keyword, x) for label, keyword, name in written for x in examples(re._parser.parse(name))]
    assert len(licenses.signature_rules()) > 300 and len({r[3] for r in licenses.signature_rules()}) == len(licenses.signature_rules())
    assert [r for r in rows if r[1] not in r[2]] == []
    gated = spark.createDataFrame(rows, "label string, keyword string, text string").where(~licenses._gate(F.col("text")))
    assert gated.collect() == []
    out = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(0, "GNU Library General Public License"), (1, "Expat License")], "doc_id long, text string")).collect()}
    assert "lgpl" in out[0].labels.split(",") and out[1].labels == "mit" and out[1].score == 0.5


def scan_by_hand(text):
    """Base places and standing detections of one text, by Python's regexes over its words."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    base = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    joined, found = " ".join(words), []
    for rule, label, keyword, pattern, weight in licenses.signature_rules():
        if keyword not in joined:
            continue
        for i in range(len(words)):
            if m := re.match(f"(?:{pattern})(?= |$)", " ".join(words[i:])):
                found.append((i, -(i + len(m[0].split())), rule, label, weight))
    labels, reach, score = {label for _, label in base}, -1, 0.5 if base else 0.0
    for start, end, _, label, weight in sorted(found):
        if -end > reach:
            reach, score = -end, max(score, weight)
            labels.add(label)
    places = [i for i, _ in base]
    return len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score


def test_licenses_equal_brute_force(spark, odd):
    texts = [r.text for r in documents(spark).select("text").collect()] + [r.text for r in odd.collect() if r.text != LONG]
    texts += ["x " + name.replace(r"(?:", "").replace(")?", "").replace(")", "") + " y" for _, _, name, _ in licenses.NOTICES]
    texts += ["Licensed under the Apache License, Version 2.0 and released under the MIT license; see gnu.org/licenses/gpl-3.0.html", "GNU Lesser General Public License v2.1 or later; GPL-2.0-only; cc by cc by-nc 4.0"]
    out = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == scan_by_hand(t), t


def test_licenses_of_odd_rows(spark, odd):
    out = licenses.scan(odd).collect()
    assert len(out) == 9 and [r.labels for r in out if r.doc_id is None] == ["mit"]
    assert licenses.scan(odd.limit(0)).count() == 0


# the pipeline

def test_pipeline_equals_its_parts(spark):
    out = sorted(local(corpus_pipeline.run(spark, SF), "doc_id", "ids_sha256", "decoded_sha256"))
    docs = documents(spark)
    bad = {r.doc_id for r in toxicity.classify(docs.select("doc_id", "text"), table(spark, SF, "labels", "doc_id", "toxic")).where("predicted = 1").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in bad}
    sets = {d: shingles(t) for d, t in texts.items()}
    first = components(jaccard_links(sets), sets)
    kept = {d for d in sets if first[d] == d}
    copies = mixing.replicate(docs.where(F.col("doc_id").isin(list(kept)))).collect()
    t = tokenizer("byte_bpe_50k.json")
    want = []
    for r in copies:
        ids = t.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert out == sorted(want)


def test_stages_of_odd_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0, name
        assert stage(spark, odd, SF).count() > 0, name
        assert name == "encoding" or tuple(stage(spark, odd, SF).columns) == corpus_pipeline.COLUMNS


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf"), -1.0, None])
def test_weights_that_are_no_numbers_count_for_nothing(spark, bad):
    docs = spark.range(200).selectExpr("id AS doc_id", "'t' AS text", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS source")
    weights = spark.createDataFrame([("a", 1.0), ("b", bad)], "source string, weight double")
    assert {r.source for r in mixing.replicate(docs, weights).select("source").distinct().collect()} == {"a"}
    assert mixing.replicate(docs, weights.where("source = 'b'")).count() == 0
