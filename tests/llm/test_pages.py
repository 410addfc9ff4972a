import random
import re

import numpy as np
import pytest

from cairn.llm import pages
from cairn.llm.shared import Scratch

CASES = [
    (None, [], []),
    ("", [], []),
    ("plain &amp; text", None, ["plain & text"]),
    ("<p class='ad'>x<p>Hello &lt;b&gt; a\n b<br>c</p><ul><li>one<li>two</ul>", None, ["Hello <b> a b c", "one", "two"]),
    ("<div id='comments'><p>zz</p></div><table><tr><td>1<td>2</table>", None, ["1", "2"]),
    ("<main>m1<article>a1</article><aside>q</aside>m2</main>x", ["a1"], ["m1", "q", "m2", "x"]),
    ("<main>m1<nav>n</nav>m2</main>x", ["m1", "m2"], ["n", "x"]),
    ("<article class='comment'>no</article><article>yes<header>h</header><form>f</form></article>", ["yes"], ["no", "h", "f"]),
    ("<p>unclosed <nav>menu", None, ["unclosed"]),
    ("<script>var a='<p>x</p>'</script>ok<style>p{}</style>", None, ["ok"]),
    ("<article><h1>T</h1><p><b>x.<br><p>y&nbsp;z</article>", ["T", "x.", "y z"], []),
    ("<article></article><nav>n</nav>", [], ["n"]),
    ("<div hidden>a</div><div style='display: none'>b</div><div role='navigation'>c</div>d", None, ["d"]),
    ("</p></div><<p>>&#x1F600;", None, ["<", ">😀"]),
    ("<div class='layout has-sidebar'><article>a</article></div><div class='sidebar'>s</div>", ["a"], ["s"]),
    ("<div class='sidebar'><article>a</article><p>s</div>", ["a"], ["s"]),
    ("<div id='page' class='no-header'><p>text</div>", None, ["text"]),
    ("<article class='post category-social'>a</article>", ["a"], []),
    ("<article class='promo'>a<p class='ad'>buy</article>", ["a"], ["buy"]),
    ("<form id='aspnetForm'><div class='menu'>m</div><article>a</article></form>", ["a"], ["m"]),
    ("<form id='aspnetForm'><div class='menu'>m</div><p>text of the page</form>", None, ["text of the page"]),
    ("<article><div class='content with-sidebar nav-left'><p>long text</p></div><p>x</article>", ["long text", "x"], []),
    ("<div class='sidebar'><article>a</article><section id='comments'><article class='comment'>c</article></section></div>", ["a"], ["c"]),
    ("<article>a<section class='comments'><article>c</article></section></article>", ["a"], ["c"]),
    ("<aside><article>teaser</article></aside><p>text", None, ["text"]),
]


@pytest.mark.parametrize("html,main,outside", CASES)
def test_parsed(html, main, outside):
    assert pages.parsed(html) == (main, outside)


def test_deep_and_long():
    assert pages.parsed("<div>" * 20_000 + "x")[0] is None
    assert pages.parsed("<article>" + "<p>word</p>" * 50_000 + "</article>")[0] == ["word"] * 50_000


@pytest.mark.parametrize("tag", ["a", "span", "font", "div", "li"])
def test_end_tags_beyond_many_open_elements(tag):
    many = f"<{tag}>" * 300
    assert pages.parsed(f"<nav>{many}menu</nav><article>text</article>") == (["text"], ["menu"])
    assert pages.parsed(f"<article>{many}text</article>after") == (["text"], ["after"])
    assert pages.parsed(f"<div class='ad'>x</div><footer>{many}y</footer><p>text") == (None, ["text"])
    assert pages.parsed(f"<p>one<ul><li>{'<b>' * 300}two<li>three</ul><p>four") == (None, ["one", "two", "three", "four"])


def covered_by_loops(streams, run):
    """(host, page key) -> tokens; every stretch of run tokens compared with those of other pages."""
    seen = {}
    for (host, key), tokens in streams.items():
        for i in range(len(tokens) - run + 1):
            seen.setdefault((host, tuple(tokens[i : i + run])), set()).add(key)
    out = {}
    for (host, key), tokens in streams.items():
        marks = set()
        for i in range(len(tokens) - run + 1):
            if len(seen[host, tuple(tokens[i : i + run])]) > 1:
                marks |= set(range(i, i + run))
        if marks:
            out[key] = sorted(marks)
    return out


def streams_of(rnd, kinds):
    """Streams of a few hosts with stretches in common; (host, key) -> (kind, tokens)."""
    common = [[rnd.choice("abcdefghij") + str(k) for _ in range(rnd.randrange(3, 20))] for k in range(6)]
    out = {}
    for key in range(120):
        host = rnd.choice(["", "x.org", "x.org", "y.net", f"only{key}"])
        tokens = []
        for _ in range(rnd.randrange(6)):
            tokens += rnd.choice([rnd.choice(common), [rnd.choice("pqrs") for _ in range(rnd.randrange(9))], ["\x1e"]])
        if tokens:
            out[host, key] = rnd.choice(kinds), tokens
    return out


def frame_of(spark, streams, copies=1):
    rows = [(k, f"{k}", h, k, kind, k, " ".join(t), len(t)) for (h, k), (kind, t) in streams.items() for _ in range(copies if k % 7 == 0 else 1)]
    return spark.createDataFrame(rows, "page_id bigint, url string, host string, key bigint, kind int, group bigint, text string, size int").repartition(3)


def left(tokens, gone):
    blocks = " ".join(t for i, t in enumerate(tokens) if t == "\x1e" or i not in gone).split("\x1e")
    return "\n\n".join(b.strip() for b in blocks if b.strip())


@pytest.mark.parametrize("chunk", [1 << 20, 100])
def test_array_against_loops(spark, chunk):
    streams = streams_of(random.Random(7), [pages.OPEN])
    covered = covered_by_loops({k: t for k, (_, t) in streams.items()}, 8)
    want = {key: left(t, set(covered.get(key, ()))) for (_, key), (_, t) in streams.items()}
    found = pages.cleaned(frame_of(spark, streams, 40), Scratch(spark, "test"), 8, chunk).collect()
    assert {r.page_id: r.text for r in found} == want and len(found) == sum(40 if k % 7 == 0 else 1 for _, k in streams)


@pytest.mark.parametrize("chunk", [1 << 20, 200])
def test_main_parts_against_loops(spark, chunk):
    """Stretches of half of a host's main parts go, and of SITE at least, unless they are most of it."""
    rnd = random.Random(5)
    line, rare = [f"n{i}" for i in range(12)], [f"r{i}" for i in range(10)]
    streams = {}
    for key in range(160):
        host = rnd.choice(["x.org", "x.org", "y.net", f"few{key % 30}"])
        tokens = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([5, 30, 60]))]
        for part in [line] * (rnd.random() < 0.7) + [rare] * (rnd.random() < 0.2):
            at = rnd.randrange(len(tokens))
            tokens[at:at] = part
        streams[host, key] = rnd.choice([pages.MAIN, pages.MAIN, pages.MAIN, pages.BESIDE]), tokens
    want = {}
    for (host, key), (kind, tokens) in streams.items():
        if kind != pages.MAIN:
            continue
        mains = [t for (h, _), (k, t) in streams.items() if h == host and k == pages.MAIN]
        gone = set()
        for i in range(len(tokens) - 7):
            have = sum(any(t[j : j + 8] == tokens[i : i + 8] for j in range(len(t) - 7)) for t in mains)
            if have >= max(pages.SITE, len(mains) / 2):
                gone |= set(range(i, i + 8))
        want[key] = left(tokens, gone if 2 * len(gone) <= len(tokens) else set())
    found = {r.page_id: r.text for r in pages.cleaned(frame_of(spark, streams, 20), Scratch(spark, "test"), 8, chunk).collect()}
    assert found == want and 0 < sum(t != " ".join(streams[h, k][1]) for (h, k) in streams if k in want for t in [want[k]])


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array(seed):
    rnd = np.random.default_rng(seed)
    tokens = rnd.integers(0, 3, rnd.integers(1, 300)).astype(np.uint64)
    if seed == 3:
        tokens[:] = 1
    order = pages.suffix_array(tokens)
    texts = [tuple(tokens[i:]) for i in order]
    assert texts == sorted(texts) and sorted(order) == list(range(len(tokens)))
    want = [0] + [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(texts, texts[1:])]
    assert pages.common_prefixes(tokens, order).tolist() == want


def test_frame(spark):
    menu = "<ul><li>Home</li><li>News of the day</li><li>All about us</li><li>Contact and help</li></ul>"
    rows = [(1, "http://a.org/1", f"{menu}<p>First page text here</p>", 9), (2, "http://A.org/2?x", f"{menu}<p>Second one</p>", 9), (3, "http://b.org/", f"{menu}<p>Other host</p>", 9)]
    rows += [(4, "http://a.org/4", "<article>Main</article>" + menu, 9), (None, None, None, 9), (5, "", "", 9), (1, "http://a.org/1", f"{menu}<p>First page text here</p>", 9)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    found = sorted((r.page_id or 0, r.text) for r in pages.main_text(frame).collect())
    whole = "Home\n\nNews of the day\n\nAll about us\n\nContact and help\n\n"
    assert found == [(0, ""), (1, "First page text here"), (1, "First page text here"), (2, "Second one"), (3, whole + "Other host"), (4, "Main"), (5, "")]
    assert pages.main_text(frame.limit(0)).count() == 0


def test_copies_without_a_main_part(spark):
    """Copies under other ids and urls of a host, exact and near, keep their text and lose the menu."""
    rnd = random.Random(3)
    prose = lambda n: " ".join(f"w{rnd.randrange(9999)}" for _ in range(n))
    menu = "<ul><li>Home</li><li>News of the day</li><li>All about us</li><li>Contact and help</li></ul>"
    exact, near, alone = prose(60), prose(200), prose(50)
    bodies = [exact] * 5 + [f"{near} seen {k} times" for k in range(4)] + [alone]
    rows = [(k, f"http://a.org/{k}", f"<div>{menu}<div>{b}</div></div>") for k, b in enumerate(bodies)]
    few = {100: exact, 101: exact, 102: "other words"}  # one chunk; the host above is dealt into several
    rows += [(k, f"http://b.org/{k}", f"{menu}<p>{b}</p>") for k, b in few.items()]
    rows += [(200 + k, f"http://c.org/{k}", f"<p>{exact}</p>") for k in range(2)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = dict(enumerate(bodies)) | few | {200: exact, 201: exact}
    assert {r.page_id: r.text for r in pages.main_text(frame, chunk=150).collect()} == want


def test_query_against_patterns(spark):
    """The articles of the synthetic pages, taken by regular expressions."""
    import html

    sf = "/root/testdata/sf0.01"
    truth = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        truth[r.page_id] = "\n\n".join(b for b in blocks if b)
    rows = pages.op4(spark, sf).collect()
    assert {r.page_id: r.text for r in rows} == truth and all(r.n_chars == len(r.text) for r in rows)


def test_boilerplate_that_only_the_array_finds(spark, tmp_path):
    """Lines without any mark inside articles, and menus of pages without one: the query with and without
    the array."""
    rnd = random.Random(4)
    prose = lambda n: " ".join(f"w{rnd.randrange(9999)}" for _ in range(n))
    line = "Read all our stories on any device you like today"
    quoted, copied = prose(12), prose(90)
    body = {k: (f"{prose(30)} {quoted}" if k < 3 else copied if k < 9 else prose(40)) for k in range(14)}
    rows = [(k, f"http://a.org/{k}", f"<nav>n</nav><article><p>{b}</p><p>{line}</p></article>") for k, b in body.items()]
    bare = {100 + k: prose(30) for k in range(3)}
    rows += [(k, f"http://b.org/{k}", f"<div>{line}</div><div>{b}</div>") for k, b in bare.items()]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.page_id: r.text for r in pages.op4(spark, str(tmp_path)).collect()} == body | bare
    off = {r.page_id: r.text for r in pages.main_text(spark.read.parquet(f"{tmp_path}/pages.parquet"), array=False).collect()}
    assert off == {k: f"{b}\n\n{line}" for k, b in body.items()} | {k: f"{line}\n\n{b}" for k, b in bare.items()}
