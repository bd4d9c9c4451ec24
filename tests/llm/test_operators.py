"""The other training-data operators against libraries, brute force and chosen cases."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from public_tokenizers import path
from pyspark.sql import functions as F

from lexframe.llm import queries
from lexframe.llm.bpe import Codec, bpe_roundtrip, safe_pieces, unpack_ids
from lexframe.llm.decontam import contamination, drop_contaminated, hit_words
from lexframe.llm.quality import fit_quality, held_out, keep_quality, score_quality
from lexframe.llm.search import search
from lexframe.llm.sharding import Node, assign_shards, even_tree, shard_table, with_region
from lexframe.llm.token_counts import count_tokens
from lexframe.llm.urlfilter import judge_urls, url_host, url_path
from lexframe.llm.warc import canonical_url, http_headers, resolve_revisits

ODD = [None, "", " \n\t ", "a", "don't  stop <|endoftext|> now<|endoftext|>", "é中🙂  \x85x\x1cy 12３ ²", "ab" * 3000, "word " * 4000, "\n\n\nx\r\n", "It's we'll THEY'RE"]


def table(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path(name))


def test_bpe_as_the_library(spark):
    lib, rng = library("byte_bpe_50k.json"), random.Random(1)
    letters = [chr(i) for i in range(0x250)] + list("  \n\t'sdtrem\x1c\x85　中🙂é<|endoftext|>") * 3
    values = ODD + ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(600)]
    for r in bpe_roundtrip(table(spark, values).withColumn("ids", F.lit(1)), path("byte_bpe_50k.json")).collect():
        want = lib.encode(r.text or "", add_special_tokens=False).ids
        assert unpack_ids(r.ids) == want and r.n_tokens == len(want) and r.decoded == lib.decode(want, skip_special_tokens=False) == (r.text or "")


def test_long_words_and_short_words_agree():
    with open(path("byte_bpe_50k.json"), encoding="utf-8") as f:
        codec = Codec(f.read())
    for word in ("th", "internationalisation", "aaaaaaaaaaaaaaaa", "!?!?!?", "é" * 9):
        raw = word.encode()
        import numpy as np

        assert codec.short_words(np.frombuffer(raw, np.uint8)[None, :])[0] == codec.long_word(raw)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_as_the_library(spark, name):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(table(spark, ODD), path(name)).collect()}
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path(name))
        want = [len(model.encode(v or "")) for v in ODD]
    else:
        lib = library(name)
        want = [len(lib.encode(v or "", add_special_tokens=False).ids) for v in ODD]
    assert got == {i: (len((v or "").encode()), n, n > 512) for i, (v, n) in enumerate(zip(ODD, want))}


def test_safe_pieces():
    text = "one two  three\nfour " * 50
    assert "".join(safe_pieces(text, 7)) == text and len(list(safe_pieces(text, 7))) > 50 and list(safe_pieces("x" * 99, 7)) == ["x" * 99]


def test_sharding(spark):
    docs = table(spark, [f"text {i % 700}" for i in range(3000)] + ODD).withColumn("shard", F.lit("x"))
    tree = even_tree(16)
    rows = shard_table(docs, tree, with_region(tree, 16)).collect()
    slots = collections.defaultdict(list)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        body = (text[r.doc_id] or "").encode()
        slots[r.shard].append(r.slot)
        assert r.size == len(body) + 1 and r.text_crc32 == zlib.crc32(body) and r.law == "key" and r.grown_shard in (r.shard, 16)
    assert sorted(slots) == list(range(16)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(100 < len(v) < 300 for v in slots.values()) and 100 < sum(r.grown_shard == 16 for r in rows) < 260
    heavier = Node("root", (Node("region-0", (tree.children[0].children[0], Node("rack-1", tree.children[0].children[1].children + (Node("shard-16", shard=16, own_weight=3.0),)))), tree.children[1]))
    a, b = ({r.doc_id: r.shard for r in assign_shards(docs, t).collect()} for t in (tree, heavier))
    moved = [(a[i], b[i]) for i in a if a[i] != b[i]]
    # Into the region whose weight grew, and inside it into the rack whose weight grew; nowhere else.
    assert moved and {y for _, y in moved} <= {*range(8), 16} and {y for x, y in moved if x < 8} <= {4, 5, 6, 7, 16}


def test_sharding_of_repeats_nulls_and_none(spark):
    rows = spark.createDataFrame([(1, "a")] * 5 + [(None, "a"), (None, None)], "doc_id long, text string")
    got = shard_table(rows, even_tree(3)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == 7 and all(sorted(v) == list(range(len(v))) for v in by.values()) and {r.grown_shard for r in got} == {None}
    assert shard_table(rows.limit(0), even_tree(3)).count() == 0


def plain_hits(docs, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    runs = collections.defaultdict(set)
    for name, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            runs[tuple(w[i : i + n])].add(str(name))
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(r) for r in runs}:
            for k in range(len(w) - n + 1):
                if (names := runs.get(tuple(w[k : k + n]))) is not None:
                    found |= names
                    hit.update(range(k, k + n))
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 22, 300])
def test_decontamination(spark, block_bytes):
    rng = random.Random(3)
    item = lambda n: " ".join(rng.choice(["alpha", "Beta", "c3", "dé", "e"]) for _ in range(n))
    items = [(i, item(n)) for i, n in enumerate([25, 10, 9, 3, 1, 0, 40, 12])] + [(0, item(11)), (90, None), (91, "...")]
    docs = [(i, v) for i, v in enumerate(ODD)] + [(100 + i, item(rng.randint(1, 60)) + ", " + (rng.choice(items)[1] or "") * (i % 2) if i % 3 else "x-" + (items[i % 8][1] or "") + "!y") for i in range(60) if items[i % 8][1] is not None]
    docs = [(i, v) for i, v in docs]
    frame, marks = spark.createDataFrame(docs, "doc_id long, text string").withColumn("items", F.lit("mine")), spark.createDataFrame(items, "item_id long, text string")
    found = contamination(frame, marks, block_bytes=block_bytes).withColumn("n_hit", hit_words())
    want = plain_hits(docs, items, 10)
    assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in found.collect()} == want
    kept = drop_contaminated(frame, marks, block_bytes=block_bytes)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i, x in want.items() if not x[1]} and {r["items"] for r in kept.collect()} <= {"mine"}
    assert contamination(frame, marks.limit(0)).filter("size(hit_spans) > 0").count() == 0 and contamination(frame.limit(0), marks).count() == 0


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = score_quality(docs.withColumn("score", F.lit("x")), labels).join(labels, "doc_id").filter("held_out").collect()
    good = [r.score >= 0.7 for r in got if r.quality == 1]
    bad = [r.score < 0.7 for r in got if r.quality == 0]
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) > 0.8 and all((r.score >= 0.7) == (r.predicted == 1) for r in got)
    assert {r.doc_id: r.held_out for r in got} == {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got}


def test_quality_of_odd_tables(spark):
    docs = table(spark, ODD).union(spark.createDataFrame([(None, "x")], "doc_id long, text string"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in score_quality(docs, none).collect()} == {1.0} and keep_quality(docs, none).count() == docs.count()
    few = spark.createDataFrame([(0, 1), (3, 0), (3, None), (None, 1), (7, 0), (7, 0)], "doc_id long, quality int")
    scored = score_quality(docs, few).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert score_quality(docs.limit(0), few).count() == 0 and docs.select(held_out(F.col("doc_id")).alias("h")).filter("h is null").count() == 0
    assert fit_quality(docs, few, train_rows=1).network.constant is not None


def test_search_finds_the_greatest_scores(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["ab", "cd", "ef", "gh", "x1", "Zz", "q"] + [f"w{i}" for i in range(40)], k=rng.randint(0, 30))) for _ in range(300)] + ODD
    docs = spark.createDataFrame([(None if i == 5 else i // 2 * 2 if i < 20 else i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "ab CD w3 w3"), (2, None), (3, texts[50]), (None, "ab"), (4, "nowhere")], "doc_id long, text string")
    import math

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = [(r.doc_id, collections.Counter(words(r.text)), len(words(r.text))) for r in docs.collect()]
    mean = sum(n for *_, n in held) / len(held)
    df = collections.Counter(w for _, c, _ in held for w in c)
    got = collections.defaultdict(list)
    for r in search(docs, asked, k=7).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.doc_id))
    for q, text in ((1, "ab CD w3 w3"), (3, texts[50])):
        scores = []
        for i, c, n in held:
            s = sum(m * math.log(1 + (len(held) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * n / mean)) for w, m in collections.Counter(words(text)).items() if c[w])
            if s > 0:
                scores.append((-round(s, 6), i is not None, i or 0, i))
        assert [(pytest.approx(-s, abs=2e-6), i) for s, _, _, i in sorted(scores)[:7]] == got[q]
    assert set(got) == {1, 3} and search(docs.limit(0), asked).count() == 0


def test_canonical_urls(spark):
    urls = {"HTTP://User@Ex.com:80/a//?b=2&a=1&utm_source=x#f": "http://ex.com/a?a=1&b=2", "https://e.com": "https://e.com/", "no scheme": "no scheme", "https://e.com:443/?": "https://e.com/", None: None}
    rows = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.c for r in rows.withColumn("c", canonical_url(F.col("u"))).collect()} == urls
    block = "HTTP/1.1 200 OK\r\nA: 1\r\na:2 \r\nbroken\r\nB:\r\n"
    assert spark.createDataFrame([(block,)], "b string").select(http_headers(F.col("b"))).first()[0] == {"a": "1, 2", "b": ""}


def test_revisits_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        kind = rng.choice(["response", "revisit"])
        tag = rng.choice(['ETag: "a"', 'ETag: W/"a"', 'ETag: "b"', "Last-Modified: x", "X: y"])
        status = rng.choice(["200 OK", "200 OK", "404 No"]) if kind == "response" else "304 Not Modified"
        rows.append((i, rng.choice(["http://h/", "http://h/#x", "http://H/?utm_source=1", "http://h/2", None]), rng.choice([None, *range(0, 300000, 9000)]), kind, f"HTTP/1.1 {status}\r\n{tag}\r\nContent-Length: {i}\r\nN: {i}\r\n"))
    got = {r.record_id: r for r in resolve_revisits(spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, block string")).collect()}
    page = lambda u: u and ("http://h/2" if u.endswith("2") else "http://h/")
    fields = lambda b: {k.lower(): v for k, v in (x.split(": ") for x in b.split("\r\n")[1:-1])}
    assert set(got) == {r[0] for r in rows if r[3] == "revisit"}
    for i, url, ts, kind, block in rows:
        if kind != "revisit":
            continue
        older = [(t, j, b) for j, u, t, k, b in rows if k == "response" and " 200 " in b and url and page(u) == page(url) and t is not None and ts is not None and t < ts]
        best, own = max(older, default=None), fields(block)
        if best is None:
            assert (got[i].response_id, got[i].outcome, got[i].headers) == (None, "no_response", own)
            continue
        theirs = fields(best[2])
        strip = lambda x: x and x.removeprefix("W/")
        if "etag" in own and "etag" in theirs:
            outcome = "matched" if strip(own["etag"]) == strip(theirs["etag"]) else "mismatch"
        elif "last-modified" in own and "last-modified" in theirs:
            outcome = "matched"
        else:
            outcome = "unchecked"
        merged = own if outcome == "mismatch" else theirs | {k: v for k, v in own.items() if k != "content-length"}
        assert (got[i].response_id, got[i].outcome, got[i].headers) == (best[1], outcome, merged)


def test_urls_and_rules(spark):
    urls = ["HTTP://A.Net/x", "a.net/x", None, "http://b.net", "x://m.example.net/en/1?q#f", "http://example.net/enx", "http://notnet/", "http://example.com/de/2", "http://org/fr/", "y://z.org/fr/1#", "http://e.com/\nz"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = [(r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, queries.URL_RULES, none).orderBy("page_id").collect()]
    assert got == [
        ("a.net", "/x", "net/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("b.net", "", None, "allow"), ("m.example.net", "/en/1", "example.net/en/", "allow"),
        ("example.net", "/enx", "net/", "block"), ("notnet", "/", None, "allow"), ("example.com", "/de/2", "example.com/de/", "block"), ("org", "/fr/", "org/fr/", "allow"), ("z.org", "/fr/1", "org/fr/", "allow"), ("e.com", "/\nz", None, "allow"),
    ]
    assert pages.select(url_host(F.col("url")).alias("h"), url_path(F.col("url")).alias("p")).filter("h is null or p is null").count() == 0


def test_templates_of_bad_pages_are_blocked(spark):
    rows = [(i, f"http://shop.com/{'spam' if i % 2 else 'fine'}/{i}.html") for i in range(400)] + [(1000 + i, f"http://wide.com/tag{i}/x") for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labelled = spark.createDataFrame([(i, i % 2) for i in range(0, 100)], "page_id long, bad int")
    got = {r.page_id: r for r in judge_urls(pages, [], labelled).collect()}
    assert all((got[i].verdict == "block") == bool(i % 2) for i in range(400)) and got[1].template == "/spam/<n>.html"
    assert {got[1000 + i].template for i in range(200)} == {"/*/x"} and {got[1000 + i].verdict for i in range(200)} == {"allow"}
    assert judge_urls(pages.limit(0), [], labelled).count() == 0


def test_deep_branches_and_alike_siblings(spark):
    rows = [(i, f"http://deep.com/a/b/c/d/{'spam' if i % 2 else 'fine'}/{i}") for i in range(400)]
    rows += [(1000 + i, f"http://many.com/{'bad' if i % 2 else 'good'}{'abcdefgh'[i % 16 // 2]}/{i}") for i in range(480)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("x")).withColumn("form", F.lit(1))
    labelled = spark.createDataFrame([(i, i % 2) for i in [*range(200), *range(1000, 1480)]], "page_id long, bad int")
    got = {r.page_id: r for r in judge_urls(pages, [], labelled).collect()}
    assert all((got[i].verdict == "block") == bool(i % 2) for i in [*range(400), *range(1000, 1480)])
    assert got[1].template == "/a/b/c/d/spam/<n>" and {got[i].template for i in range(1000, 1480)} == {"/*+/<n>", "/*-/<n>"}


def plain_tree(urls, prior=0.1, strength=5.0, z=1.96):
    """The template tree by plain loops: (host, form) -> (template, rate)."""
    leaves = collections.defaultdict(lambda: [0, 0])
    for host, path, bad in urls:
        form = tuple(re.sub(r"^[0-9a-f-]{8,}(?=$|\.)", "/<x>", re.sub(r"^[0-9]+(?=$|\.)", "/<n>", s)) for s in path.split("/") if s)
        leaves[host, form][0] += bad is not None
        leaves[host, form][1] += bad or 0
    smooth = lambda n, b, above: (b + strength * above) / (n + strength)
    total = [sum(x[i] for x in leaves.values()) for i in (0, 1)]
    out = {}

    def side(n, b, alln, allb):
        if n == 0 or alln == n:
            return 0
        share = (allb + 0.5) / (alln + 1)
        error = (share * (1 - share) * (1 / n + 1 / (alln - n))) ** 0.5
        gap = b / n - (allb - b) / (alln - n)
        return 1 if gap >= z * error else -1 if gap <= -z * error else 0

    def walk(host, mine, depth, rate):
        """mine: (form, template so far) of a branch."""
        for form, template in mine:
            if len(form) <= depth:
                out[host, form] = (template, rate)
        kids = collections.defaultdict(list)
        for form, template in mine:
            if len(form) > depth:
                kids[form[depth]].append((form, template))
        counts = {s: [sum(leaves[host, f][i] for f, _ in x) for i in (0, 1)] for s, x in kids.items()}
        every = [sum(c[i] for c in counts.values()) for i in (0, 1)]
        sides = {s: side(*c, *every) for s, c in counts.items()}
        branches = collections.defaultdict(list)
        for s, c in counts.items():
            alike = [counts[x] for x in counts if sides[x] == sides[s]]
            pool = [sum(x[i] for x in alike) for i in (0, 1)]
            own = len(alike) == 1 or (sides[s] and side(*c, *pool))
            branches[s if own else {0: "/*", 1: "/*+", -1: "/*-"}[sides[s]]].append(s)
        for name, segments in branches.items():
            n, b = (sum(counts[s][i] for s in segments) for i in (0, 1))
            walk(host, [(f, (*t, name)) for s in segments for f, t in kids[s]], depth + 1, smooth(n, b, rate))

    root = smooth(*total, prior)
    for host in {h for h, _ in leaves}:
        forms = [f for h, f in leaves if h == host]
        n, b = (sum(leaves[host, f][i] for f in forms) for i in (0, 1))
        walk(host, [(f, ()) for f in forms], 0, smooth(n, b, root))
    return out


def test_a_segment_spelled_like_a_wildcard(spark):
    for name in ("*", "*+", "*-", "<n>", "<x>"):
        rows = [(i, f"http://h.com/{name if i < 20 else f'clean{i % 50}'}/p{i}") for i in range(2000)]
        labelled = spark.createDataFrame([(i, int(i < 20)) for i in range(2000)], "page_id long, bad int")
        got = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string"), [], labelled).collect()}
        assert {i for i, v in got.items() if v == "block"} == set(range(20))


def test_template_tree_against_brute_force(spark):
    from lexframe.llm.urlfilter import template_tree

    rng = random.Random(8)
    urls = []
    for _ in range(3000):
        path = "/".join(rng.choice(["a", "bad", "ok", "x1", "12", "deadbeef", "*", "*+", "*-", "<n>", "u" + str(rng.randrange(40))]) for _ in range(rng.randint(0, 6)))
        chance = 0.8 if "bad" in path else 0.1
        urls.append((rng.choice(["h1", "h1", "h2", "", "h3"]), "/" + path, rng.choice([None, int(rng.random() < chance), int(rng.random() < chance)])))
    got = {(r.host, tuple(r.form)): (tuple(r.template), r.bad_rate) for r in template_tree(spark.createDataFrame(urls, "host string, path string, bad int")).collect()}
    want = plain_tree(urls)
    assert set(got) == set(want)
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_benchmark_of_repeats_and_of_one_large_item(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(20000)]
    long_item = " ".join(words)
    docs = [(i, " ".join(words[i * 50 : i * 50 + 12])) for i in range(400)] + [(900, "none of it"), (901, None), (901, None), (902, "x y z")]
    items = [(5, "x Y z")] * 2000 + [(6, long_item), (7, " ".join(rng.sample(words, 30)))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_found", F.lit(3)).withColumn("_k1", F.lit(4))
    marks = spark.createDataFrame(items, "item_id long, text string")
    want = plain_hits(docs, items, 10)
    for size in (1000, 1 << 22):
        rows = contamination(frame, marks, block_bytes=size).withColumn("n_hit", hit_words()).collect()
        assert len(rows) == len(docs) and {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in rows} == want and {(r._found, r._k1) for r in rows} == {(3, 4)}
    kept = drop_contaminated(frame, marks, block_bytes=1000)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [900, 901, 901]


def test_ids_that_are_no_numbers(spark):
    from lexframe.llm.simhash import drop_near_duplicates, near_duplicates
    from lexframe.llm.substring import remove_repeats

    body = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([("a-1", body), ("b", body), (None, "short"), ("7", body + " more")], "doc_id string, text string").withColumns({c: F.lit(c) for c in ("_k1", "_k2", "blocks", "label", "fp", "_row")})
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == {"a-1": "7", "b": "7", "7": "7", None: None}
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {(r.doc_id, r._k1, r.label) for r in kept.collect()} == {("7", "_k1", "label"), (None, "_k1", "label")}
    cut = remove_repeats(docs)
    assert cut.columns == [*docs.columns, "n_words", "n_removed", "kept"] and {(r.doc_id, r.n_removed, r.blocks) for r in cut.collect()} == {("a-1", 60, "blocks"), ("b", 60, "blocks"), (None, 0, "blocks"), ("7", 60, "blocks")}
    got = shard_table(docs, even_tree(4)).collect()
    assert {r.doc_id for r in got} == {"a-1", "b", "7", None}
    with pytest.raises(ValueError):
        search(docs, docs)


def test_draws_of_shards_by_a_second_version(spark):
    """The hash tree with draws in plain Python, over Spark's own hashes of (node name, key)."""
    import math

    tree = Node("root", (Node("r0", (Node("s0", shard=0, own_weight=3.0), Node("s1", shard=1))), Node("r1", (Node("s2", shard=2), Node("s3", shard=3, own_weight=0.0))), Node("r2", (Node("s4", shard=4),))))
    names = [n.name for n in (*tree.children, *(c for r in tree.children for c in r.children))]
    docs = table(spark, [f"t{i}" for i in range(800)])
    hashed = {r.doc_id: r for r in docs.select("doc_id", *(F.xxhash64(F.lit(n), F.col("doc_id")).alias(n) for n in names)).collect()}

    def shard(doc, node):
        while node.children:
            draw = lambda c: -math.log((((hashed[doc][c.name] & (1 << 64) - 1) >> 11) + 0.5) / (1 << 53)) / c.weight
            node = min((c for c in node.children if c.weight > 0), key=draw)
        return node.shard

    assert {r.doc_id: r.shard for r in assign_shards(docs, tree).collect()} == {i: shard(i, tree) for i in range(800)}


def test_search_skips_postings_and_takes_odd_tables(spark):
    from lexframe.llm import search as module

    rng = random.Random(11)
    texts = [" ".join([*rng.choices([f"t{i * 8 // 600}x{j}" for j in range(30)], k=40), f"of{i % 7}"]) for i in range(600)]  # eight subjects
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({c: F.lit(0) for c in ("term", "score", "query_id", "_n", "ids")}).coalesce(1)
    asked = docs.filter("doc_id % 20 = 0")
    first = search(docs, asked, k=3).collect()
    assert len(first) == 90 and {r.query_id for r in first if r["rank"] == 1 and r.doc_id == r.query_id} == set(range(0, 600, 20))
    assert 0 < module.LAST_TALLY[1] < module.LAST_TALLY[0]
    assert search(docs, asked.limit(0)).count() == 0


def test_search_holds_alike_queries_together_and_scores_exactly(monkeypatch):
    import numpy as np
    from lexframe.llm import search as module

    rng = np.random.default_rng(5)
    n, queries, words = 700, 90, 40
    # Three languages in turn; documents 2j and 2j + 1 differ in length by one word in thousands, so their scores nearly agree.
    counts = np.zeros((n, 3 * words), dtype=np.int64)
    for i in range(n):
        lang = i // 2 % 3
        counts[i, lang * words : (lang + 1) * words] = counts[i - 1, lang * words : (lang + 1) * words] if i % 2 else rng.integers(0, 4, words)
    lengths = counts.sum(axis=1) + 10_000_000 + np.arange(n) % 2
    doc, term = np.nonzero(counts)
    by = np.lexsort((doc, term))
    starts = np.searchsorted(term[by], np.arange(3 * words + 1))
    shard = module.Shard(np.arange(n), lengths, np.arange(1, 3 * words + 1), starts, doc[by].astype(np.int16), counts[doc, term][by].astype(np.int32), float(lengths.mean()))
    query = np.repeat(np.arange(queries), 30)
    asked = np.concatenate([q % 3 * words + rng.permutation(words)[:30] for q in range(queries)])
    weight = rng.random(len(query)) * 1e5
    monkeypatch.setattr(module, "CHUNK", 30)
    block = module.Queries(np.arange(queries) * 10, query, (asked + 1).astype(np.uint64), weight)
    assert sorted(block.ids.tolist()) == list(range(0, queries * 10, 10))
    assert all(len({i // 10 % 3 for i in block.ids[lo:hi].tolist()}) == 1 for lo, hi, *_ in block.chunks)
    best = module.Best(queries, 5)
    seen, read = module.search_shard(shard, block, best)
    assert 0 < read <= seen
    impact = counts * 2.2 / (counts + 1.2 * (0.25 + 0.75 * lengths[:, None] / lengths.mean()))
    for row, q in enumerate((block.ids // 10).tolist()):
        scores = np.round(impact[:, asked[query == q]] @ weight[query == q], 6)
        order = np.lexsort((np.arange(n), -scores))[:5]
        assert np.allclose(best.score[row], scores[order], rtol=0, atol=3e-6) and set(best.doc[row].tolist()) == set(order.tolist())


def test_revisits_without_url_or_time(spark):
    rows = [(1, None, 5, "revisit", "HTTP/1.1 304 N\r\nA: 1\r\n"), (2, "http://h/", None, "revisit", "HTTP/1.1 304 N\r\n"), (3, None, 1, "response", "HTTP/1.1 200 OK\r\n"), (1, None, 5, "revisit", "HTTP/1.1 304 N\r\nA: 1\r\n")]
    frame = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, block string").withColumns({c: F.lit(1) for c in ("bucket", "late", "found", "response")})
    got = [(r.record_id, r.response_id, r.outcome, r.headers) for r in resolve_revisits(frame).orderBy("record_id").collect()]
    assert got == [(1, None, "no_response", {"a": "1"}), (1, None, "no_response", {"a": "1"}), (2, None, "no_response", {})]
    assert resolve_revisits(frame.limit(0)).count() == 0


def test_words_of_any_length():
    with open(path("byte_bpe_50k.json"), encoding="utf-8") as f:
        codec = Codec(f.read())
    rng = random.Random(12)
    for word in ["".join(rng.choices("aabcdeéthingré", k=rng.randint(2, 500))) for _ in range(60)] + ["a" * 999, "ab" * 400, "!" * 70]:
        assert codec.huge_word(word.encode()) == codec.long_word(word.encode())
    lib = library("byte_bpe_50k.json")
    word = "".join(rng.choices("etaoinshrdlu", k=90_000))
    assert unpack_ids(codec.batch([word])[0]) == lib.encode(word, add_special_tokens=False).ids


def test_batches_count_bytes():
    from lexframe.llm.bpe import byte_batches

    sizes = [sum(len(p.encode()) for _, p in b) for b in byte_batches(enumerate(["中文 " * 50] * 20), 64, 1000)]
    assert all(1000 <= s < 1300 for s in sizes[:-1])


def test_queries_have_the_agreed_columns(spark, sf_dir):
    known = queries.queries()
    row = known["op3_bpe"](spark, sf_dir).orderBy("doc_id").first()
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").first().text
    ids = library("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids
    assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest() and row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert sorted(int(n[2:].split("_")[0]) for n in known) == list(range(1, 11))
