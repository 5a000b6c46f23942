"""Release of dependent turns, main text of pages, and the conversation trie."""

import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.llm import main_text, queries, ranges, release, trie
from lodestone.llm.workspace import Workspace

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


def same(got, want):
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("name", ["op11_release", "op13_trie"])
def test_query_matches_duckdb(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    same([tuple(r) for r in got.select(want.columns).collect()], want.fetchall())


# 11 release


def brute_release(rows):
    """Rows (conv, turn, text) with distinct turns -> conv, turn, status, attempts, first, last, number, state."""
    conversations, out = defaultdict(list), []
    for c, t, x in rows:
        conversations[c].append((-1 if t is None else t, zlib.crc32((x or "").encode()), t))
    for c, turns in conversations.items():
        done = []
        for p, (_, _, t) in enumerate(sorted(turns)):
            h = [zlib.crc32(f"{k}:{'' if c is None else c}:{'' if t is None else t}".encode()) for k in range(7)]
            parent, at = (p - h[0] % 7 if 0 < h[0] % 7 <= p else None), 7 * p
            if parent is not None and done[parent][0] != "delivered":
                done.append(("blocked", 0, None, None))
                continue
            at = first = at if parent is None else max(at, done[parent][3])
            status = "dead"
            for a in range(1, 5):
                last = at
                if h[1] % 101 >= 20 or (at >= 7 * p + h[2] % 101 and h[a + 2] % 3):
                    status = "delivered"
                    break
                at += 20 * 2 ** (a - 1)
            done.append((status, a, first, last))
        order = sorted((d[3], *turns[0:0], *sorted(turns)[k][:1], k) for k, d in enumerate(done) if d[0] == "delivered")
        state, numbers = 0, {}
        for n, (*_, k) in enumerate(order, 1):
            state += n * sorted(turns)[k][1]
            numbers[k] = n, (state + 2**63) % 2**64 - 2**63
        out += [(c, sorted(turns)[k][2], *d, *numbers.get(k, (None, None))) for k, d in enumerate(done)]
    return out


RELEASED = ("conv_id", "turn", "status", "attempts", "first_at", "last_at", "release_no", "state")


@pytest.mark.parametrize("most_rows", [release.MOST_ROWS, 4, 1])
def test_release_matches_brute_force(spark, most_rows):
    rows = [(7, t, f"text {t % 13}") for t in range(900)] + [(c, t, None if (t or 0) % 5 == 0 else "y" * t) for c in [*range(40), None] for t in [None, *range(3, 30, 2)] if c != 7]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], TURNS).withColumn("key", F.lit(1)).withColumn("place", F.lit("x")).repartition(3)
    got = [tuple(r) for r in release.replay(df, most_rows=most_rows).select(*RELEASED).collect()]
    want = brute_release(rows)
    assert {"delivered", "dead", "blocked"} == {x[2] for x in want}
    same(got, want)


def test_release_of_chains_wide_trees_and_repeats(spark):
    # A chain, a star, and a dead root above them; policies come as columns.
    def node(key, place, parent, faulty=False, unlucky=0):
        return key, place, parent, place, faulty, place, unlucky

    rows = [node("chain", p, p - 1 if p else None) for p in range(300)] + [node("star", p, 0 if p else None) for p in range(300)]
    rows += [node("dead", 0, None, True, 15), *(node("dead", p, p - 1) for p in range(1, 200)), node("dead", 200, None), node("dead", 201, 200)]
    df = spark.createDataFrame(rows, "key string, place long, parent long, arrival long, faulty boolean, repair long, unlucky long")
    for most in (10, release.MOST_ROWS):
        got = release.outcomes(df, Workspace(spark, "release"), most_rows=most).collect()
        assert len(got) == len(rows) == len({(r.key, r.place) for r in got})
        assert Counter((r.key, r.status) for r in got) == {("chain", 0): 300, ("star", 0): 300, ("dead", 1): 1, ("dead", 2): 199, ("dead", 0): 2}
        dead = next(r for r in got if r.status == 1)
        assert (dead.attempts, dead.first_at, dead.last_at) == (4, 0, 140)
    twice = spark.createDataFrame([(1, 2, "user", "a")] * 3, TURNS)
    assert release.replay(twice).count() == 3 and release.replay(twice.limit(0)).count() == 0


def test_places_and_sums_across_ranges(spark):
    rows = spark.createDataFrame([("a" if k % 3 else "b", k, k * k) for k in range(2000)], "key string, n long, x long")
    got = ranges.running(ranges.in_order(rows, "key", [F.col("n")], Workspace(spark, "ranges"), parts=9), "key", {"place": F.lit(1), "total": F.col("x")}).collect()
    assert len({r._part for r in got}) == 9
    for key in "ab":
        place = total = 0
        for r in sorted((r for r in got if r.key == key), key=lambda r: r.n):
            place, total = place + 1, total + r.x
            assert (r.place, r.total) == (place, total)


# 12 main text


def plain_article(page):
    """What the test pages' article says, by splitting its paragraphs."""
    article = re.search(r"<article>(.*)</article>", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)>|<br>", article[1]) if article else []
    return "\n\n".join(filter(None, (" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in parts)))


def test_main_text_of_all_pages(spark):
    got = {r.page_id: r for r in queries.op12_main_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        text = plain_article(r.html)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (text, len(text), r.url)


LONG = "This is the story of a house that was built by the sea, and of the people who have lived in it for all of their lives, with what they had and with what they were. "
PAGES = {
    "no article": (
        "<body><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul><h1>The house</h1><p>" + LONG * 2 + "</p><p>Short one.</p><p>" + LONG * 2 + "</p>"
        "<p><a href=a>More about</a> <a href=b>the sea</a></p><p>Copyright 2024</p></body>",
        f"The house\n\n{(LONG * 2).strip()}\n\nShort one.\n\n{(LONG * 2).strip()}",
    ),
    "parts that go": (
        "<header><h1>Site</h1></header><article><header><h1>Title</h1><p>By A. Writer</p></header><p>One &amp; two &lt;b&gt; &eacute;&nbsp;x &#169; &amp;amp;</p>"
        f"<aside><p>{LONG * 3}</p></aside><form><p>{LONG * 3}</p></form><div class='ad-box'><p>{LONG * 3}</p></div><script>x='<p>{LONG}</p>'</script><style>p{{}}</style>"
        f"<!-- <p>no</p> --><p>Two\n\t lines<br>here <i>bold</i>er</p></article><section id=comments><article><p>{LONG * 3}</p></article></section><div class=cookie-notice>{LONG * 2}</div><footer>{LONG * 2}</footer>",
        "Title\n\nOne & two <b> é x © &amp;\n\nTwo lines here bolder",
    ),
    "unclosed": ("<article><p>Alpha<p>Beta <b>x<p title='a>b'>Gamma", "Alpha\n\nBeta x\n\nGamma"),
    "unfinished tag": ("<article><p>Alpha 1 < 2 and 3</p><p class=\"x", "Alpha 1 < 2 and 3"),
    "menu only": ("<nav><a href=/>Home</a></nav>", ""),
    "words without stop words": ("<article><p>" + "xq zv " * 60 + "</p></article>", ("xq zv " * 60).strip()),
    "hidden": (f"<main><p>Seen</p><div hidden><p>{LONG}</p></div><div style='display: none'>{LONG}</div></main>", "Seen"),
    "plain": ("", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text_of(name):
    page, text = PAGES[name]
    assert main_text.main_text(page) == text


def test_main_text_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "<p>" * 30_000, "c"), (4, "<article>" + "<p>the word</p>" * 20_000, "d"), (4, "<article>" + "<p>the word</p>" * 20_000, "d"), (None, "<a '>" * 3000, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, main_text string")
    got = main_text.extract_main_text(pages).collect()
    assert got[0].__fields__ == ["page_id", "html", "main_text", "_main_text"] and len(got) == 6
    assert [len(r._main_text) for r in sorted(got, key=lambda r: str(r.main_text))] == [0, 0, 0, 0, 20_000 * 10 - 2, 20_000 * 10 - 2]
    assert main_text.extract_main_text(pages.limit(0)).count() == 0
    parts = main_text.page_blocks(spark.createDataFrame([(9, PAGES["no article"][0])], "page_id long, html string")).orderBy("block").collect()
    assert [r.first for r in parts] == ["bad", "bad", "short", "good", "short", "good", "bad", "short"]
    assert [r.label for r in parts] == ["bad", "bad", "good", "good", "good", "good", "bad", "bad"]


# 13 trie


def brute_trie(conversations):
    """conv -> [(role, text)] -> rows as of op13."""
    nodes = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    out = []
    for node, members in nodes.items():
        below = [x for x in nodes if x[: len(node)] == node]
        leaves = sum(not any(len(y) > len(x) and y[: len(x)] == x for y in nodes) for x in below)
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in members if c is not None and len(conversations[c]) == len(node))))
        low = lambda cs: min((c for c in cs if c is not None), default=None)
        out.append((low(members), len(node), low(nodes[node[:-1]]) if node else None, len(members), sum(len(x) == len(node) + 1 for x in below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("small", [False, True])
def test_trie_matches_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(trie, "DIGESTED", 2)
        monkeypatch.setattr(trie, "BLOCK", 3)
    rows = []
    for c in [*range(40), None]:
        n = 0 if c is None else c
        rows += [(c, None if t == 0 else t, "user" if t % 2 else None, None if t == 3 else "ab"[(n >> t) % 2] * (1 + n % 3)) for t in range(n % 11)]
    rows += [(41, t, "user", f"é{t}") for t in range(70)] + [(42, t, "user", f"é{t}") for t in range(66)] + [(None, 5, "user", "x")]
    df = spark.createDataFrame(rows, TURNS).withColumn("node", F.lit(1)).withColumn("key", F.lit("k")).repartition(3)
    plain = defaultdict(list)
    for c, t, r, x in rows:
        plain[c].append((-1 if t is None else t, r or "", x or ""))
    plain = {c: [x[1:] for x in sorted(turns)] for c, turns in plain.items()}
    same([tuple(r) for r in trie.conversation_trie(df).select(*NODE).collect()], brute_trie(plain))
    rebuilt = {}
    for c, turns in plain.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = (plain.get(c - c % 5, []) if c is not None else [])[:h] + turns[h:]
    got = trie.rebuilt_trie(df).collect()
    same([tuple(r[c] for c in NODE) for r in got], brute_trie(rebuilt))
    by = {r.node: r for r in got}
    for r in got:  # a path goes on in at most one child, and its level counts light steps
        assert r.parent is None or r.level == by[r.parent].level + (r.path != by[r.parent].path)
    assert max(Counter((r.path, r.depth) for r in got).values()) == 1


def test_trie_edges(spark):
    none = spark.createDataFrame([], TURNS)
    assert trie.rebuilt_trie(none).count() == 0
    copies = spark.createDataFrame([(c, t, "user", "same") for c in range(300) for t in (1, 1)], TURNS)
    got = sorted((r.depth, r.n_convs, r.n_children, r.n_leaves) for r in trie.conversation_trie(copies).collect())
    assert got == [(0, 300, 1, 1), (1, 300, 1, 1), (2, 300, 0, 1)]
