"""Main text of HTML pages.

A page is parsed into blocks (paragraphs, headings, list items and the like), each with what the markup
says of it: whether it stands in an article or a main element, and whether in an element that is a menu,
header, footer, sidebar, form, advert, notice, comment, script or style by its tag, role, class or id.
Classes are only hints: they never discard an article, or what holds one. If a page has articles, its
text comes from those under the fewest hints; a block inside them is left out if its tag or a hint says
so, except that hints at layout (a sidebar, a header) don't count where most of the text would go by
them. The same goes for main elements, and for pages with neither.

What the markup leaves is judged by a suffix array of the host. The token streams of its pages, main
parts included, with marks between blocks, are put one after the other; their suffixes are sorted by
prefix doubling, and runs of suffixes with RUN or more tokens in common (by the array of longest common
prefixes) are stretches that repeat. Covered tokens go, the unique runs stay:

* Inside a main part a stretch is boilerplate of the site if at least half of the host's different main
  parts have it, and SITE of them; passages that some articles quote from one another stay. Equal main
  parts count once, so copied articles don't make their text boilerplate. If most of a main part would
  go by this, it is a near copy of the others and stays whole.
* On pages without a main part a stretch goes if two different pages have it. What stands beside main
  parts of other pages counts as well. Pages that are copies of one another count as one, whatever their
  ids and urls: equal streams, and near copies as op10 finds them (ALIKE of their shingles of SHINGLE
  words in common, directly or by pages in between). A passage of RUN or more words that otherwise
  different pages share is covered, whether a menu or a quotation.

A host beyond CHUNK tokens is dealt into chunks by stream, the rows of a stream with very many copies into
several. Each chunk sorts the suffixes of its different streams. Of pages without a main part what a chunk
finds is counted over all chunks; of main parts only what a good part of those in some chunk have can be in
half of all, and these candidates are counted in every chunk. So the same stretches are covered as in one
array, and no task holds much more than a chunk.

Null and empty pages have an empty text. Rows whose streams are equal have the same text. Pages without
a url have the host ''.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.minhash import near_duplicates
from cairn.llm.shared import Scratch, join_counted
from cairn.llm.words import U, between, mix, slices, sums, utf8, words

#: Tokens of the shortest stretch that counts as repeated; tokens of a chunk; least main parts of a site.
RUN, CHUNK, SITE = 8, 1 << 17, 4
#: Words of a shingle, and least part of two pages' shingles in common that makes them near copies.
SHINGLE, ALIKE = 5, "0.8"
#: What is known of hosts (some numbers each) is broadcast up to this number of hosts, else joined in a shuffle.
BROADCAST = 100_000
_DROP = frozenset("head title script style noscript template nav header footer aside button select textarea iframe svg math canvas object embed video audio dialog menu map datalist".split())
#: Names of classes and ids that hint at boilerplate, and those of them that hint at layout.
_LAYOUT = frozenset("alert foot footer header masthead menu nav navbar navigation pager search side sidebar skip social toolbar widget".split())
_HINTS = _LAYOUT | frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay breadcrumb breadcrumbs pagination comment comments respond reply replies disqus share sharing related recommended newsletter subscribe subscription signup login".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: First parts of class names that say something else about the page.
_ABOUT = frozenset("category format has no tag type with without".split())
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_WHOLE = frozenset("html body main".split())
#: What a start tag ends if it is open, and what keeps it from looking further out.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_BOUNDS = frozenset("article aside body div footer form header html li main nav section table td th".split())
_BETWEEN = "\x1e"
#: Kinds of streams: a main part, the blocks of a page without one, and blocks that only count for others.
MAIN, OPEN, BESIDE = 0, 1, 2


class _Page(HTMLParser):
    """Blocks as (part, hints above the part, layout hints inside, left out, text)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        #: part, hints above it, layout hints, other hints, dropped by a tag
        self.state = ("", 0, 0, 0, False)
        self.open: list[tuple[str, tuple]] = []
        #: Where the open elements of each name stand in open, innermost last.
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.text: list[str] = []
        self.blocks: list[tuple[str, int, int, bool, str]] = []

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            self.text.clear()
            if text:
                part, above, layout, other, dropped = self.state
                self.blocks.append((part, above, layout, dropped or other > 0, text))

    def handle_starttag(self, tag, attrs):
        block = tag in _BLOCKS
        if block or tag in _DROP:
            self.flush()
        if block:
            if tag in _ENDS:
                self._end(*_ENDS[tag])
            self._end({"p"}, _BOUNDS)
        if tag in _VOID:
            if tag == "br":
                self.text.append(" ")
            return
        part, above, layout, other, dropped = before = self.state
        layout_hint, other_hint = _hints(attrs) if attrs and tag not in _WHOLE else (False, False)
        # a form may hold a whole page
        layout, other, dropped = layout + (layout_hint or tag == "form"), other + other_hint, dropped or tag in _DROP
        named = "article" if tag == "article" else "main" if tag == "main" or (attrs and ("role", "main") in attrs) else ""
        if named and not dropped and (not part or (part == "main" and named == "article")):
            part, above, layout, other = named, above + layout + other, 0, 0
        self.places[tag].append(len(self.open))
        self.open.append((tag, before))
        self._go((part, above, layout, other, dropped))

    def handle_endtag(self, tag):
        if tag in _BLOCKS or tag in _DROP:
            self.flush()
        if places := self.places.get(tag):
            self._close(places[-1])

    def _go(self, state) -> None:
        if state != self.state:
            self.flush()
            self.state = state

    def _last(self, tags) -> int:
        return max((places[-1] for tag in tags if (places := self.places.get(tag))), default=-1)

    def _end(self, tags, bounds):
        i = self._last(tags)
        if i >= 0 and i > self._last(bounds):
            self._close(i)

    def _close(self, i: int) -> None:
        _, state = self.open[i]
        for tag, _ in self.open[i:]:
            self.places[tag].pop()
        del self.open[i:]
        self._go(state)

    def handle_data(self, data):
        if not self.cdata_elem:
            self.text.append(data)


def _hints(attrs) -> tuple[bool, bool]:
    """Whether an element's attributes hint at layout, and at other boilerplate."""
    layout = other = False
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            other = True
        elif value and name in ("class", "id"):
            for word in value.lower().split():
                parts = [p for p in re.split(r"[^a-z]+", word) if p]
                if parts and parts[0] not in _ABOUT and (found := _HINTS.intersection(parts)):
                    layout, other = layout or bool(found & _LAYOUT), other or bool(found - _LAYOUT)
        elif value and name == "role" and value.lower() in _ROLES:
            layout = True
        elif value and name == "style" and re.search(r"display\s*:\s*none", value):
            other = True
    return layout, other


def parsed(html: str | None) -> tuple[list[str] | None, list[str]]:
    """The blocks of the main part and those beside it; of a page without one, None and the blocks that
    may be its text. A page that has neither has an empty main part."""
    if not html:
        return [], []
    page = _Page()
    page.feed(html)
    page.close()
    page.flush()
    blocks = page.blocks
    for named in ("article", "main"):
        if hints := [b[1] for b in blocks if b[0] == named and not b[3]]:
            least = min(hints)
            taken = _without_layout(blocks, [b[0] == named and b[1] == least for b in blocks])
            return [b[4] for b, t in zip(blocks, taken) if t], [b[4] for b, t in zip(blocks, taken) if not t]
    taken = _without_layout(blocks, [not b[0] for b in blocks])
    text = [b[4] for b, t in zip(blocks, taken) if t]
    return (None, text) if text else ([], [b[4] for b in blocks])


def _without_layout(blocks, here: list[bool]) -> list[bool]:
    """Of the blocks here those that are text: with no more hints at layout than it takes to keep half of
    what isn't left out for other reasons."""
    sizes: defaultdict[int, int] = defaultdict(int)
    for b, h in zip(blocks, here):
        if h and not b[3]:
            sizes[b[2]] += len(b[4])
    half, most, most_size = sum(sizes.values()) / 2, -1, 0
    for level in sorted(sizes):
        most, most_size = level, most_size + sizes[level]
        if most_size >= half:
            break
    return [h and not b[3] and b[2] <= most for b, h in zip(blocks, here)]


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Where the suffixes of tokens start, in order, by prefix doubling; suffixes that are told apart
    already aren't sorted again. The order of tokens is that of their numbers."""
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(tokens, kind="stable")
    new = np.ones(n, bool)
    new[1:] = tokens[order[1:]] != tokens[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    span = 1
    while True:
        # places in the order whose suffix shares its rank with a neighbour
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, n))
        left = np.flatnonzero(np.repeat(size > 1, size))
        if not len(left):
            return order
        at = order[left]
        after = np.where(at + span < n, rank[np.minimum(at + span, n - 1)], -1)
        inner = np.lexsort((after, rank[at]))
        at, after, group = at[inner], after[inner], rank[at][inner]
        order[left] = at
        split = np.ones(len(left), bool)
        split[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        new[left] = split
        rank[at] = left[split][np.cumsum(split) - 1]
        span *= 2


def common_prefixes(tokens: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Tokens that each suffix in the order has in common with the one before it; 0 for the first. By
    hashes of prefixes: lengths are doubled while these agree, then halved."""
    n = len(order)
    if n < 2:
        return np.zeros(n, np.int64)
    prefix, a, b = sums(tokens), order[:-1], order[1:]
    low = (tokens[a] == tokens[b]).astype(np.int64)
    high = np.where(low, n - np.maximum(a, b), 0)

    def tried(at, length):
        same = between(prefix, a[at], a[at] + length) == between(prefix, b[at], b[at] + length)
        low[at[same]], high[at[~same]] = length[same], length[~same] - 1
        return same

    at = np.flatnonzero(low < high)
    while len(at):
        at = at[tried(at, np.minimum(2 * low[at], high[at]))]
        at = at[low[at] < high[at]]
    at = np.flatnonzero(low < high)
    while len(at):
        tried(at, (low[at] + high[at] + 1) // 2)
        at = at[low[at] < high[at]]
    return np.concatenate(([0], low))


def _hashed(text) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of a column of texts, one text after the other, and where each text's end."""
    data, at = utf8(text)
    found, ends, base = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0
    for i, j in slices(at):
        _, _, hashes, begin = words(data, at[i : j + 1])
        found.append((hashes >> U(40)).astype(np.uint32))
        ends.append(begin[1:] + base)
        base += len(hashes)
    return np.concatenate(found), np.concatenate(ends)


def _tokens(column) -> tuple[np.ndarray, np.ndarray]:
    data, at = utf8(column)
    three = data[at[0] : at[-1]].reshape(-1, 3).astype(np.uint32)
    return three[:, 0] | three[:, 1] << 8 | three[:, 2] << 16, (at - at[0]) // 3


def _with_tokens(batches):
    """Rows with the tokens of their text instead of it."""
    for batch in batches:
        tokens, ends = _hashed(batch.column("text"))
        data, at = tokens.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes(), (3 * ends).tolist()
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array([data[a:b] for a, b in zip(at, at[1:])], pa.binary())], [*names, "tokens"])


class _Streams:
    """The different streams of a table (key, kind, group and text or tokens) as one text of tokens, with
    the stretches that repeat. A token is 24 bits of its word's hash, and a stretch has RUN of them. Each
    stream ends with a token that no other has, so nothing reaches beyond its end."""

    def __init__(self, table: pa.Table, run: int):
        keys = np.array(table["key"], np.int64)
        self.lead, self.row = np.unique(keys, return_index=True, return_inverse=True)[1:]
        table = table.take(pa.array(self.lead))
        self.keys, self.kinds, self.groups = (np.array(table[c], np.int64) for c in ("key", "kind", "group"))
        tokens, ends = _tokens(table["tokens"]) if "tokens" in table.column_names else _hashed(table["text"])
        own = mix(np.arange(len(ends) - 1, dtype=U)) | U(1 << 63)
        self.tokens, self.first = np.insert(tokens.astype(U), ends[1:], own), ends + np.arange(len(ends))
        self.owner = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self.run = run

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """Where stretches that occur more than once start, and a number for each, in order of it."""
        order = suffix_array(self.tokens)
        alike = common_prefixes(self.tokens, order) >= self.run
        inside = alike.copy()
        inside[:-1] |= alike[1:]
        return order[inside], np.cumsum(~alike)[inside]

    def names(self, start: np.ndarray) -> np.ndarray:
        return between(sums(self.tokens), start, start + self.run).view(np.int64)

    def windows(self) -> np.ndarray:
        """Where stretches of RUN tokens start that stay inside their stream."""
        end = self.first[1:][self.owner] - 1  # the last token is the stream's end
        return np.flatnonzero(np.arange(len(self.tokens)) + self.run <= end)

    def covered(self, start: np.ndarray) -> np.ndarray:
        change = np.zeros(len(self.tokens) + self.run + 1, np.int64)
        np.add.at(change, start, 1)
        np.add.at(change, start + self.run, -1)
        return np.cumsum(change)[: len(self.tokens)] > 0

    def counted(self, start: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each stretch (in order of number): the first place in start, how many main parts have it,
        and the smallest and largest group of other streams that have it (largest < smallest: none)."""
        owner = self.owner[start]
        lead = np.flatnonzero(np.diff(number, prepend=-1))
        which = np.cumsum(np.diff(number, prepend=-1) != 0) - 1
        main = self.kinds[owner] == MAIN
        pairs = np.unique(which[main] * len(self.keys) + owner[main])
        mains = np.bincount(pairs // max(1, len(self.keys)), minlength=len(lead))
        low, high = np.full(len(lead), np.iinfo(np.int64).max), np.full(len(lead), np.iinfo(np.int64).min)
        np.minimum.at(low, which[~main], self.groups[owner[~main]])
        np.maximum.at(high, which[~main], self.groups[owner[~main]])
        return lead, mains, low, high

    def texts(self, site: np.ndarray, several: np.ndarray, table: pa.Table) -> list[str | None]:
        """The texts of the table's rows, without the covered tokens; site and several: starts of stretches
        that are boilerplate in main parts, and on pages without one."""
        gone = np.where(self.kinds[self.owner] == MAIN, self.covered(site), self.covered(several)) if len(self.owner) else np.zeros(0, bool)
        many = np.add.reduceat(gone.astype(np.int64), self.first[:-1]) if len(self.owner) else np.zeros(0, int)
        out = []
        for i, text in enumerate(table["text"].take(pa.array(self.lead)).to_pylist()):
            a, b = self.first[i], self.first[i + 1] - 1
            if self.kinds[i] == BESIDE:
                out.append(None)
            elif not many[i] or (self.kinds[i] == MAIN and 2 * many[i] > b - a):
                out.append(_blocks(text))
            else:
                tokens = np.array(text.encode().split(), object)
                keep = ~gone[a:b] | (tokens == _BETWEEN.encode())
                out.append(_blocks(b" ".join(tokens[keep]).decode()))
        return [out[i] for i in self.row]


def _blocks(text: str) -> str:
    return "\n\n".join(t for x in text.split(_BETWEEN) if (t := x.strip(" ")))


def site_share(mains: int) -> int:
    """How many of a host's different main parts make a stretch boilerplate."""
    return max(SITE, -(-mains // 2))


_OUT = "page_id bigint, url string, text string"


def _written(table: pa.Table, texts: list[str | None]) -> pa.Table:
    kept = pa.array([t is not None for t in texts], pa.bool_())
    return pa.table({"page_id": table["page_id"], "url": table["url"], "text": pa.array(texts, pa.string())}).filter(kept)


def _known(run: int):
    """The stretches of a whole host that cover what they cover, in main parts (site) or on other pages."""

    def go(table: pa.Table) -> pa.Table:
        streams = _Streams(table, run)
        start, number = streams.repeats()
        lead, mains, low, high = streams.counted(start, number)
        site, several = mains >= site_share(int((streams.kinds == MAIN).sum())), low < high
        names = np.concatenate((streams.names(start[lead[site]]), streams.names(start[lead[several]])))
        host = pa.array([table["host"][0].as_py()] * len(names), pa.string())
        return pa.table({"host": host, "stretch": pa.array(names), "site": pa.array(np.arange(len(names)) < site.sum())})

    return go


def _stretches(run: int):
    """Of a chunk: the stretches on pages without a main part or beside one, with their smallest and
    largest group; and, as candidates, those that so many of the chunk's main parts have that they may be
    in half of the host's. A stream may be in `salts` chunks."""

    def go(table: pa.Table) -> pa.Table:
        streams = _Streams(table, run)
        mains_here = int((streams.kinds == MAIN).sum())
        start, number = streams.repeats()
        lead, mains, low, high = streams.counted(start, number)
        salts = table["salts"][0].as_py()
        site = (2 * salts * mains >= mains_here) & (mains > 0)
        # a stretch that is here once may be in another chunk too
        once = np.setdiff1d(streams.windows(), start, assume_unique=True)
        owner = streams.owner[once]
        free = streams.kinds[owner] != MAIN
        alone = once[~free] if mains_here <= 2 * salts else once[:0]
        names = np.concatenate((streams.names(start[lead[low <= high]]), streams.names(once[free]), streams.names(start[lead[site]]), streams.names(alone)))
        groups = streams.groups[owner[free]]
        n, m = int((low <= high).sum()) + len(groups), int(site.sum()) + len(alone)
        none = np.zeros(m, np.int64)
        out = {"host": pa.array([table["host"][0].as_py()] * (n + m), pa.string()), "stretch": pa.array(names), "candidate": pa.array(np.arange(n + m) >= n)}
        out |= {"low": pa.array(np.concatenate((low[low <= high], groups, none))), "high": pa.array(np.concatenate((high[low <= high], groups, none)))}
        return pa.table(out)

    return go


def _holders(run: int):
    """The main parts of a chunk that have each candidate."""

    def go(table: pa.Table, candidates: pa.Table) -> pa.Table:
        names = keys = np.zeros(0, np.int64)
        if table.num_rows and candidates.num_rows:
            streams = _Streams(table, run)
            start = streams.windows()
            start = start[streams.kinds[streams.owner[start]] == MAIN]
            found = streams.names(start)
            hit = np.isin(found, np.array(candidates["stretch"], np.int64))
            names, keys = np.unique(np.stack((found[hit], streams.keys[streams.owner[start[hit]]])), axis=1)
        host = table["host"][0].as_py() if table.num_rows else None
        return pa.table({"host": pa.array([host] * len(names), pa.string()), "stretch": pa.array(names), "key": pa.array(keys)})

    return go


def _chunk(run: int):
    def go(table: pa.Table, known: pa.Table) -> pa.Table:
        streams = _Streams(table, run)
        start = streams.windows()
        names, site = streams.names(start), np.array(known["site"], bool)
        stretch = np.array(known["stretch"], np.int64)
        return _written(table, streams.texts(start[np.isin(names, stretch[site])], start[np.isin(names, stretch[~site])], table))

    def run_if_any(table: pa.Table, known: pa.Table) -> pa.Table:
        if table.num_rows:
            return go(table, known)
        return pa.table({"page_id": pa.array([], pa.int64()), "url": pa.array([], pa.string()), "text": pa.array([], pa.string())})

    return run_if_any


def cleaned(streams: DataFrame, scratch: Scratch, run: int = RUN, chunk: int = CHUNK, array: bool = True) -> DataFrame:
    """page_id, url and text of the rows of streams (page_id, url, host, key, kind, group, text, size, cheap
    to read again; rows of one key are alike but for page_id and url) that aren't of kind BESIDE."""
    by_key = streams.groupBy("host", "key", "kind").agg(F.sum("size").alias("size"))
    chunks, salts = F.ceil(F.sum("size") / chunk).cast("int"), F.ceil(4 * F.max("size") / chunk).cast("int")
    of_kind = lambda kind: F.sum((F.col("kind") == kind).cast("int"))
    hosts = by_key.groupBy("host").agg(chunks.alias("chunks"), salts.alias("salts"), of_kind(MAIN).alias("mains"), of_kind(OPEN).alias("opened"))
    # hosts left out have neither pages without a main part nor main parts enough for SITE, so nothing to cover
    hosts = scratch.keep(hosts.where((F.col("opened") > 0) | (F.col("mains") >= SITE)), "hosts")
    n_hosts = hosts.count()
    joined = lambda rows, of, how: rows.join(F.broadcast(of) if n_hosts <= BROADCAST else of, "host", how)
    dealt = joined(streams.drop("size"), hosts, "left").where((F.col("kind") != BESIDE) | (F.col("opened") > 0))
    # which chunk a copy is in matters to nothing but size
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("salts"))
    at = F.when(F.col("chunks") > 1, F.pmod(F.xxhash64("key") + salt, F.col("chunks"))).otherwise(0).cast("int")
    dealt = dealt.withColumn("chunk", at)
    by = ["host", "chunk"]
    plain = F.array_join(F.filter(F.transform(F.split("text", _BETWEEN), lambda t: F.trim(t)), lambda t: t != ""), "\n\n")
    as_is = lambda rows: rows.where(F.col("kind") != BESIDE).select("page_id", "url", plain.alias("text"))
    if not array or not n_hosts:
        return as_is(dealt)
    # tokens are less than half of what texts are; texts are shuffled for hosts with something to cover only
    columns, kinds = ["host", "chunk", "salts", "key", "kind", "group"], "host string, chunk int, salts int, key bigint, kind int, group bigint, tokens binary"
    tokens = lambda rows: rows.select(*columns, "text").mapInArrow(_with_tokens, kinds)
    known = tokens(dealt.where("chunks = 1")).groupBy("host").applyInArrow(_known(run), "host string, stretch bigint, site boolean")
    large = dealt.where("chunks > 1")
    found = tokens(large).groupBy(*by).applyInArrow(_stretches(run), "host string, stretch bigint, candidate boolean, low bigint, high bigint")
    found = scratch.keep(found, "stretches")
    several = found.where("not candidate").groupBy("host", "stretch").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    every = hosts.select("host", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    candidates = scratch.keep(found.where("candidate").select("host", "stretch").distinct(), "candidates")
    share = F.greatest(F.lit(SITE), F.ceil(F.col("mains") / 2))
    of = lambda rows: rows.select("host").distinct()
    again = tokens(joined(large, of(candidates), "left_semi")).groupBy(*by).cogroup(candidates.join(every, "host").groupBy(*by))
    holders = again.applyInArrow(_holders(run), "host string, stretch bigint, key bigint")
    have = holders.distinct().groupBy("host", "stretch").agg(F.count("*").alias("have"))
    site = have.join(hosts, "host").where(F.col("have") >= share)
    known = known.union(several.select("host", "stretch", F.lit(False).alias("site"))).union(site.select("host", "stretch", F.lit(True)))
    known = scratch.keep(known, "known")
    marked = joined(dealt, of(known), "left_semi").groupBy(*by).cogroup(known.join(every, "host").groupBy(*by)).applyInArrow(_chunk(run), _OUT)
    return as_is(joined(dealt, of(known), "left_anti")).union(marked)


_STREAMS = "page_id bigint, url string, host string, kind int, text string"


def _read(batches):
    """A row for each page's text, and one for what stands beside it, if anything does."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            rows, kinds, texts = [], [], []
            for k, html in enumerate(part.column("html").to_pylist()):
                main, others = parsed(html)
                for kind, found in [(OPEN, others)] if main is None else [(MAIN, main), (BESIDE, others)]:
                    if kind != BESIDE or found:
                        rows.append(k), kinds.append(kind), texts.append(f" {_BETWEEN} ".join(found))
            others = [part.column(n).take(pa.array(rows, pa.int64())) for n in ("page_id", "url", "host")]
            yield pa.RecordBatch.from_arrays([*others, pa.array(kinds, pa.int32()), pa.array(texts, pa.string())], ["page_id", "url", "host", "kind", "text"])


def main_text(pages: DataFrame, run: int = RUN, chunk: int = CHUNK, array: bool = True) -> DataFrame:
    """page_id, url and text of each row of pages (page_id, url, html). array=False: by the markup alone."""
    scratch = Scratch(pages.sparkSession, "pages")
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), "html")
    streams = rows.mapInArrow(_read, _STREAMS).withColumn("key", F.xxhash64("host", "kind", "text")).withColumn("size", F.size(F.split("text", " ")))
    streams = scratch.keep(streams, "streams")
    empty = streams.where((F.col("kind") != BESIDE) & (F.col("text") == "")).select("page_id", "url", "text")
    streams = streams.where("text <> ''")
    opened, settled = streams.where(F.col("kind") == OPEN), streams.where(F.col("kind") != OPEN).withColumn("group", F.col("key"))
    once = scratch.keep(opened.groupBy("key").agg(F.any_value("text").alias("text"), F.count("*").alias("many")), "open")
    if once.isEmpty():
        return cleaned(settled, scratch, run, chunk, array).union(empty)
    near = near_duplicates(once.select(F.col("key").alias("doc_id"), "text"), SHINGLE, ALIKE).select(F.col("doc_id").alias("key"), F.col("component_id").alias("group"))
    groups = scratch.keep(near.join(once.select("key", "many"), "key"), "groups")
    grouped = join_counted(opened, groups, ["key"], "many", opened.count()).drop("many")
    return cleaned(scratch.keep(settled.unionByName(grouped), "grouped"), scratch, run, chunk, array).union(empty)


def op4(spark, sf_dir: str) -> DataFrame:
    found = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
