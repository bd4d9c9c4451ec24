"""Conversations, pages and periodic runs against exhaustive searches, plain versions and chosen cases."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest
from compare import of_duckdb, of_spark

from lexframe.llm import repair, structure_queries, wrappers
from lexframe.llm.repair import repair_conversations, repair_segment, repaired_turns, transfer
from lexframe.llm.runs import Grammar, periodic_runs
from lexframe.llm.structure_queries import damaged, periodic_documents
from lexframe.llm.wrappers import Page, aligned, extract_text, infer_wrappers, pattern


def cheapest(letters):
    """(cost, audit) by trying everything."""
    goes = {0: {0: 1}, 1: {0: 2, 1: 2, 3: 2}, 2: {2: 3}, 3: {}}
    after = (2, 2, 3, 2)

    @lru_cache(None)
    def best(i, s, inserted):
        out = [(0, "")] if i == len(letters) and s in (0, 3) else [(10**9, "")]

        def take(cost, edit, rest):
            out.append((cost + rest[0], edit + rest[1]))

        if inserted < 3:
            take(5, "I", best(i, after[s], inserted + 1))
        if i < len(letters):
            role, fault = divmod(ord(letters[i]) - 65, 4)
            take(2, "D", best(i + 1, s, 0))
            if fault in (0, 3):
                if s in goes[role]:
                    take(5 * (fault == 3), "K", best(i + 1, goes[role][s], 0))
                take(1 + 5 * (fault == 3), "R", best(i + 1, after[s], 0))
        return min(out)

    return best(0, 0, 0)


def test_branch_and_bound_finds_the_least_of_all():
    rng = random.Random(5)
    after = repair._NEXT
    for t in range(1500):
        letters = "".join(rng.choice("ABCDEFGHIJKLMNOP" if t % 2 else "EEEIIIAHLMP") for _ in range(rng.randint(0, 9)))
        cost, audit, _ = repair_segment(letters, 0, repair._LEGAL_END, True)
        assert (cost, audit) == cheapest(letters)
        cut = rng.randint(0, len(letters))
        if 0 < cut < len(letters):  # two segments: the table of the second gives the first one's ends
            ends = [min(repair._LEGAL_END[s], 5 + repair._LEGAL_END[after[s]], 10 + repair._LEGAL_END[after[after[s]]]) for s in range(4)]
            table = transfer(letters[cut:])
            one = repair_segment(letters[:cut], 0, tuple(min(table[4 * s + e] + ends[e] for e in range(4)) for s in range(4)), False)
            two = repair_segment(letters[cut:], one[2], repair._LEGAL_END, True)
            assert (one[0] + two[0], one[1] + two[1]) == (cost, audit)


ODD_TALKS = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 5, "assistant", "x."), (2, None, "user", "no end"), (2, 5, "user", "x."), (2, 5, "user", "x."),
    (None, 1, None, None), (None, None, "user", "A?"), (None, 3, "system", "S."), (3, 0, "", " \n"), (4, 9, "tool", "t."), (4, 2, "user", "t."), (5, 1, "user", "long " * 5000 + "!"),
]


def plain_repair(rows):
    """What repair_conversations() gives for one conversation, row by row."""
    rows = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    seen, letters, counts = set(), "", [0] * 4
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = 1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0
        seen.add((role, text))
        counts[fault] += 1
        letters += chr(65 + 4 * ("sua".find(role[:1]) if role[:1] and role[0] in "sua" else 3) + fault)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    cost, audit = cheapest(letters)
    out, at, state = [], 0, 0
    for edit in audit:
        if edit == "I":
            state = repair._NEXT[state]
            out.append(("I", "user" if state == 2 else "assistant", ""))
            continue
        _, role, text = rows[at]
        at += 1
        if edit == "K":
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
        elif edit == "R":
            state = repair._NEXT[state]
            role = "user" if state == 2 else "assistant"
        if edit != "D":
            out.append((edit, role, text))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{x}" for _, r, x in out).encode()).hexdigest()
    return (gaps, *counts[1:], illegal, cost, audit, digest), out


@pytest.mark.parametrize("shift", [14, 1])
def test_conversations_as_row_by_row(spark, monkeypatch, shift):
    monkeypatch.setattr(repair, "_SHIFT", shift)  # 1: segments of two rows
    rng = random.Random(9)
    talks = ODD_TALKS + [(10 + rng.randrange(6), rng.randrange(12), rng.choice(["user", "assistant", "system", "uu", None]), rng.choice(["a.", "b!", "c", "", " ", None, "d?"])) for _ in range(60)]
    df = spark.createDataFrame([(*r, 7, "z") for r in talks], "conv_id long, turn long, role string, text string, _c int, audit string")
    by = {}
    for c, *rest in talks:
        by.setdefault(c, []).append(tuple(rest))
    want = {c: plain_repair(rows) for c, rows in by.items()}
    got = {r.conv_id: tuple(r)[1:] for r in repair_conversations(df).collect()}
    assert got == {c: x for c, (x, _) in want.items()}
    turns = {}
    for r in sorted(repaired_turns(df).collect(), key=lambda r: (str(r.conv_id), r.position)):
        turns.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    assert turns == {c: out for c, (_, out) in want.items() if out}


def test_conversations_of_an_empty_table(spark):
    df = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert repair_conversations(df).collect() == [] and repaired_turns(df).collect() == []


def test_one_conversation_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(repair, "_SHIFT", 8)
    rows = spark.range(5000).selectExpr("1L AS conv_id", "id AS turn", "CASE WHEN id % 7 = 3 THEN 'user' WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('t', id, '.') AS text")
    letters = "".join("E" if i % 7 == 3 or i % 2 == 0 else "I" for i in range(5000))
    cost, audit, _ = repair_segment(letters, 0, repair._LEGAL_END, True)
    (r,) = repair_conversations(rows).collect()
    assert (r.cost, r.audit, r.gaps) == (cost, audit, 0)


def test_damage(spark):
    df = spark.createDataFrame([(i % 40, i, "assistant", f"Text {i}. More!") for i in range(400)], "conv_id long, turn long, role string, text string")
    want = []
    for i in range(400):
        kind, text, role = zlib.crc32(f"{i % 40}:{i}".encode()) % 20, f"Text {i}. More!", "assistant"
        text = "" if kind == 1 else f"Text {i} More" if kind == 2 else text
        want += [] if kind == 0 else [(i % 40, i, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    assert sorted(tuple(r) for r in damaged(df).collect()) == sorted(want)


@pytest.mark.parametrize("name", ["op11_repair", "op12_html"])
def test_sql_of_structure_queries(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(repair, "_SHIFT", 2)
    monkeypatch.setattr(wrappers, "_BUCKET", 2)
    assert of_spark(structure_queries.queries()[name](spark, sf_dir)) == of_duckdb(structure_queries.oracle_sql()[name], sf_dir)


# ---- periodic runs


def plain_runs(words, shortest=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(shortest, 2 * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_runs_as_a_plain_search(spark):
    rng = random.Random(3)
    texts = [None, "", " \n", "a", "a " * 11, "a " * 12, "a b " * 6, "x " + "a b c " * 5 + "y", "é\x85 \x0b" * 20, "ab ab\tab\r\n" * 9, "w " * 3000]
    for _ in range(250):
        n, kinds = rng.choice([13, 30, 80, 200]), rng.choice([1, 2, 2, 3, 5, 50])
        words = [str(rng.randrange(kinds)) for _ in range(n)]
        if rng.random() < 0.5:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 2))
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        texts.append(rng.choice(["", "\t"]) + " ".join(words))
    rows = [(None if i == 3 else i, t, "x") for i, t in enumerate(texts)] * 2
    got = periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        words = words_of(texts[3 if r.doc_id is None else r.doc_id])
        want = plain_runs(words)
        assert ([tuple(x) for x in r.runs], r.n_words, r.collapsed) == (want, len(words), collapsed(words, want))
    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_of_runs_as_a_plain_search(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    seen = 0
    for r in structure_queries.op13_runs(spark, sf_dir).collect():
        words = words_of(docs[r.doc_id])
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 4000:
            continue  # quadratic
        runs = plain_runs(words)
        top = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        want = (len(runs), *top, 1000 * top[1] // top[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest())
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) == want
        seen += bool(runs)
    assert seen > 5


def test_planted_documents_with_null_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (5, None), (6, "")], "doc_id long, text string")
    assert sorted(map(tuple, periodic_documents(df).collect()), key=str) == sorted([(None, "a b"), (5, None), (6, "")], key=str)


def test_grammar_extends_as_far_as_words_agree():
    import numpy as np

    rng = random.Random(8)
    for _ in range(40):
        row = np.array([-1, *[rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randint(2, 300))], -2])
        grammar = Grammar(row)
        a, b = (np.array([rng.randrange(1, len(row) - 1) for _ in range(50)]) for _ in range(2))
        b = np.where(a == b, np.maximum(1, b - 1), b)
        a, b = a[a != b], b[a != b]
        for side, step in ((grammar.right, 1), (grammar.left, -1)):
            for x, y, got in zip(a, b, grammar.extend(a, b, side, step), strict=True):
                n = 0
                while step == 1 and row[x + n] == row[y + n] >= 0 or step == -1 and row[x - 1 - n] == row[y - 1 - n] >= 0:
                    n += 1
                assert n == got


# ---- pages


def page(body):
    return f'<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body class="has-sidebar">{body}</body></html>'


SHAPES = {
    "article": ('<header><h1>Site</h1></header><nav><ul><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul></nav><article><header><h1>Title {i}</h1></header><p>One &amp; {i}<br>two</p>'
                '<div class="ad-slot">Buy!</div><ul><li>x<li>y {i}</ul><form><label>Mail</label><input><p>Send</p></form><section id="comments"><h2>Comments</h2><p>me too</p></section></article>'
                '<aside>Side</aside><footer>&copy; s</footer>', "Title {i}\nOne & {i} two\nx\ny {i}"),
    "main": ('<div class="cookie-notice">We use cookies</div><main><h1>Head {i}</h1><p>Text\n of <b>{i}</b>.</p><blockquote>quoted</blockquote><button>Go</button></main><div class="sidebar"><p>more</p></div>', "Head {i}\nText of {i}.\nquoted"),
    "named": ('<div id="menu"><a href=/>Home</a></div><div class="page-header">Name</div><h1>Top {i}</h1><div class="post-content"><p>Body {i} of it</p><p>and more</p></div><div id="footer">end</div>', "Top {i}\nBody {i} of it\nand more"),
    "plain": ('<div class="x1"><a href=/>Home</a> <a href=/b>Other</a></div><div class="x2">Welcome to the site</div><div class="x3"><p>Story {i} is told</p><p>here {i}</p></div><div class="x4">All rights</div>', "Story {i} is told\nhere {i}"),
}


@pytest.mark.parametrize("bucket", [64, 2])
def test_shapes_of_pages(spark, monkeypatch, bucket):
    monkeypatch.setattr(wrappers, "_BUCKET", bucket)
    rows, want = [], {}
    for kind, (body, text) in SHAPES.items():
        for i in range(5):
            extra = "<p>An extra paragraph</p>" if i == 2 and kind == "main" else ""
            rows.append((len(rows), f"http://{kind}.example/{i}", page(body.replace("{i}", str(i)).replace("<blockquote>", extra + "<blockquote>"))))
            want[rows[-1][0]] = text.replace("{i}", str(i)).replace("\nquoted", ("\nAn extra paragraph" if extra else "") + "\nquoted")
    odd = [(100, None, None), (101, "nohost", ""), (102, "http://one.example/", "just text &lt; <b>bold"), (103, "http://two.example/", "<p>a<p>b<div>" * 40), (104, "http://x.example", "<div>" * 3000 + "deep")]
    want |= {100: "", 101: "", 102: "just text < bold", 103: "\n".join(["a", "b"] * 40), 104: "deep"}
    df = spark.createDataFrame([(*r, "w", "h") for r in rows + odd + odd[:3]], "page_id long, url string, html string, wrapper string, _host string")
    got = extract_text(df).collect()
    assert len(got) == len(rows) + 8 and {r.page_id: r.main_text for r in got} == want
    assert all(r.n_chars == len(r.main_text) and (r.wrapper, r._host) == ("w", "h") for r in got)
    patterns = {r.host: r.pattern for r in infer_wrappers(df).collect()}
    assert "blockquote" in patterns["main.example"] and "p{#}+" in patterns["main.example"]


def test_one_host_of_many_pages(spark):
    rows = [(i, "http://big.example/p", page(f"<nav>m</nav><article><h1>T{i}</h1>{'<p>t</p>' * (i % 5)}{'<h2>s</h2><p>u</p>' * (i % 3)}</article>")) for i in range(400)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()
    assert all(r.main_text == "\n".join([f"T{r.page_id}"] + ["t"] * (r.page_id % 5) + ["s", "u"] * (r.page_id % 3)) for r in got) and len(got) == 400
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_alignment_keeps_what_either_has():
    join = list.__add__
    one, two = Page("<h1>a</h1><p>b</p><dl><dt>c<dd>d<dt>e<dd>f</dl>").items, Page("<h1>a</h1><div>x</div><p>b</p><p>c</p><dl><dt>c<dd>d</dl>").items
    assert pattern(aligned(one, two, join)) == "h1{#} div{#}? p{#}+ dl{(dt{#} dd{#})+}"
    many = Page("".join(f"<p class='{'abcdefghij'[i // 10]}{'klmnopqrst'[i % 10]}'>x</p>" for i in range(100))).items
    assert len(many) == 1 and many[0][0] == wrappers.ANY and len(list(wrappers.slots(many))) == 1
