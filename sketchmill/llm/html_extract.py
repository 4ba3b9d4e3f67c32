"""Main text of web pages by consensus host paths.

1. Each page's containers are scored by the text of the blocks they hold (links count against it, distance from the block fades
   it), and the page votes for the path of its best container: tags and classes from the root, with digits generalised. A path goes
   by a 128-bit digest of all its steps, so it is whole at any depth. A vote weighs the square root of the container's score.
2. Votes are summed by host and path (map-side first, so a hot host sends a row a path and task); each host's heaviest path wins,
   of equals the larger digest. The same rows tell which paths hold the same text on different pages of the host: its boilerplate.
3. Every page is read again and the text under the winning path is taken; a page without it falls back on its own best container.

Menus, headers, footers, sidebars, adverts, forms, scripts and styles are left out by tag and role. Elsewhere nothing goes by one word:
an element's name, the share of links in it, how little of the page's text it holds and the host's boilerplate each count for
leaving it out (`noise`), within an article more of it is asked for, and what holds much of the page's text stays. Character references
are decoded, white space inside a block becomes one space, blocks are trimmed and joined by one space.

Defined results: null or empty html gives an empty text; a page without a host (null url) votes for none and uses its own best
container; pages without any container that holds text give the text of their body; repeated rows are extracted alike and vote
each; an empty table gives no rows; extra columns are ignored. Whole pages are read.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections import Counter
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import extended, materialize, table

#: Winning paths are broadcast up to so many hosts and paths of boilerplate; beyond, pages and paths meet in a shuffle whose skewed hosts
#: Spark splits.
BROADCAST_HOSTS, BROADCAST_PATHS = 50_000, 500_000
FADE = 0.8
#: A path is boilerplate where it holds one text on at least so many pages, and a share of the host's pages, that are not all the same.
REPEATS, REPEAT_SHARE = 3, 0.1
#: An element with this share of the page's text stays; one with less than the second counts as little.
MUCH, LITTLE = 0.4, 0.1

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?][^>]*>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")

#: Elements whose content is skipped whole: scripts, styles, inert markup, form fields and the page's title.
RAW = frozenset("script style template textarea iframe title select".split())
DROPPED = frozenset("head nav footer aside form button menu dialog fieldset".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: Elements that begin and end a block.
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption pre blockquote figure figcaption header hgroup address details summary hr center".split()
) | DROPPED
CONTAINER = frozenset("body main article section div td blockquote center".split())
ARTICLE = frozenset(("article", "main"))
#: An opening tag of the left closes an open one of the right, up to the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "body": {"head"}}
#: Blocks of running text.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt pre blockquote td th figcaption".split())
#: Words of a class or id that speak for leaving an element out, and words beside them that change nothing.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion banner banners cookie cookies consent gdpr notice notices popup popover modal overlay"
    " sidebar sidebars rail widget widgets share sharing social related recommended recommendations newsletter subscribe subscription signup login breadcrumb breadcrumbs menu menus nav navbar navigation footer"
    " masthead topbar toolbar pagination pager skip disclaimer copyright paywall teaser alert alerts discussion reply".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond responses replies".split())
NEUTRAL = frozenset("area bar block box buttons container content form group holder inner item items left right links list main module outer panel posts articles stories section site slot thread top bottom unit wrap wrapper".split())


def name_points(names: list[str]) -> int:
    """What class or id names say: 3 a reader's comments, 2 another name of NOISE and NEUTRAL words alone, 1 a word of NOISE among others."""
    best = 0
    for name in names:
        words = {w.lower() for w in WORDS.findall(name)}
        if words and not (NOISE | COMMENTS).isdisjoint(words):
            whole = words <= NOISE | COMMENTS | NEUTRAL
            best = max(best, 1 if not whole else 2 if COMMENTS.isdisjoint(words) else 3)
    return best


class Page:
    """The containers and text blocks of a page, in order."""

    def __init__(self, source: str):
        # containers, and other elements whose names speak against them: parent, step, tag, points of its name, within an article
        self.parent, self.step, self.tag, self.points, self.within = [-1], ["#"], ["#"], [0], [False]
        self.blocks: list[tuple[int, str, int]] = []  # container, text, linked characters
        self._read(source)
        self._measure()
        self.left_out = self.noise(frozenset())

    def _read(self, source: str) -> None:
        stack: list[tuple[str, int, bool, bool]] = [("#", 0, False, False)]  # tag, container, dropped from here on, within an article
        opened: Counter = Counter()  # tags on the stack
        held: list[str] = []
        linked, in_link, at, n = 0, False, 0, len(source)

        def flush() -> None:
            nonlocal linked
            if held:
                text = " ".join("".join(held).split())
                if text and not stack[-1][2]:
                    self.blocks.append((stack[-1][1], text, min(linked, len(text))))
                held.clear()
            linked = 0

        def add(text: str) -> None:
            nonlocal linked
            if text and not stack[-1][2]:
                if "&" in text:
                    text = html_lib.unescape(text)
                held.append(text)
                if in_link:
                    linked += len(text)

        def shut_from(k: int) -> None:
            opened.subtract(x[0] for x in stack[k:])
            del stack[k:]

        last = source.rfind(">")
        while at < n:
            m = TOKEN.search(source, at) if at <= last or source.find("<!--", at) >= 0 else None  # no tag ends behind the last >
            if m is None:
                add(source[at:])
                break
            add(source[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["end"]:
                if tag == "a":
                    in_link = False
                elif tag in BLOCK and opened[tag]:
                    flush()
                    in_link = False
                    k = len(stack) - 1
                    while stack[k][0] != tag:
                        k -= 1
                    shut_from(k)
                elif tag == "p":
                    flush()
                elif tag == "br":
                    held.append(" ")
                continue
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                if not m["attrs"].endswith("/") or tag != "iframe":
                    at = close.end() if close else (n if tag in ("script", "style", "template", "textarea", "title") else at)
                continue
            if tag == "a":
                in_link = True
            elif tag == "br":
                held.append(" ")
            elif tag == "hr":
                flush()
            elif tag in BLOCK:
                flush()
                in_link = False
                shut = CLOSES.get(tag, ())
                for k in range(len(stack) - 1, 0, -1) if opened["p"] or any(opened[x] for x in shut) else ():
                    if stack[k][0] in shut or stack[k][0] == "p":
                        shut_from(k)
                        if not shut or stack[-1][0] not in shut:
                            break
                    elif stack[k][0] in ("table", "ul", "ol", "dl") or stack[k][0] in CONTAINER:
                        break
                self._open(stack, tag, m["attrs"])
                opened[tag] += 1
        flush()

    def _open(self, stack: list, tag: str, attrs: str) -> None:
        _, container, dropped, within = stack[-1]
        classes, names, role = "", "", ""
        if "=" in attrs:
            for name, a, b, c in ATTRIBUTE.findall(attrs):
                name = name.lower()
                if name == "class":
                    classes = a or b or c
                elif name == "id":
                    names = a or b or c
                elif name == "role":
                    role = (a or b or c).lower()
        dropped = dropped or tag in DROPPED or tag == "header" and not within or role in DROPPED_ROLES
        points = 0
        if (classes or names) and not dropped and tag not in ("html", "body") and tag not in ARTICLE:
            points = max(name_points(classes.split()), min(name_points([names]), 1 if within else 3))
        if tag in CONTAINER or points:
            self.parent.append(container)
            named = ".".join(sorted({DIGITS.sub("0", c) for c in f"{classes} {names}".split()}))
            self.step.append(f"{tag}.{named}" if named else tag)
            self.tag.append(tag)
            self.points.append(points)
            self.within.append(within)
            container = len(self.parent) - 1
        stack.append((tag, container, dropped, within or tag in ARTICLE))

    def _measure(self) -> None:
        """Of each node: characters, linked characters, a number that equal texts share, and characters of articles."""
        n = len(self.parent)
        self.size, self.linked, self.print, self.article = [0] * n, [0] * n, [0] * n, [0] * n
        for k, (node, text, linked) in enumerate(self.blocks):
            self.size[node] += len(text)
            self.linked[node] += linked
            self.print[node] += crc32(text.encode("utf-8", "replace"))
        for node in range(n - 1, 0, -1):  # nodes come after the ones they are in
            up = self.parent[node]
            if self.tag[node] in ARTICLE:
                self.article[node] = self.size[node]
            self.article[up] += self.article[node]
            self.size[up] += self.size[node]
            self.linked[up] += self.linked[node]
            self.print[up] += self.print[node]

    def noise(self, boilerplate) -> list[bool]:
        """Whether each node is left out, with all it holds. boilerplate: paths that hold one text on different pages of the host.

        Points: of the name; one where links are half of the text, one where the element holds little of the page; two for boilerplate.
        An element that a whole name speaks against needs two of them, others three; within an article one more, blocks of running text two
        more. What holds much of the page stays (half of it, if a whole name speaks against it), but not beside an article
        that it isn't part of; nor do readers' comments beside any other text."""
        out = [False] * len(self.parent)
        paths = self.paths() if boilerplate else None
        whole = self.size[0]
        for node in range(1, len(out)):
            if out[self.parent[node]]:
                out[node] = True
                continue
            repeated = bool(paths) and paths[node] in boilerplate
            points, size = self.points[node], self.size[node]
            if not size or not (points or repeated):
                continue
            beside = not self.within[node] and self.article[0] > self.article[node]
            much = size >= (0.5 if points == 2 else MUCH) * whole and not beside
            if much and not (points == 3 and size < whole):
                continue
            need = (2 if points > 1 else 3) + (2 if self.tag[node] in PROSE else self.within[node])
            out[node] = points + (2 * self.linked[node] >= size) + (size < LITTLE * whole) + 2 * repeated >= need
        return out

    def paths(self) -> list[str]:
        """The digest of each container's whole path."""
        out = [""]
        for node in range(1, len(self.parent)):
            out.append(hashlib.blake2b(f"{out[self.parent[node]]}>{self.step[node]}".encode("utf-8", "replace"), digest_size=16).hexdigest())
        return out

    def best(self) -> tuple[int, float]:
        """The best container and its score; (0, 0) where no block has text of its own."""
        score = [0.0] * len(self.parent)
        for node, text, linked in self.blocks:
            if not self.left_out[node]:
                score[node] += max(len(text) - 2 * linked, 0)
        for node in range(len(score) - 1, 0, -1):  # containers come after the ones they are in
            score[self.parent[node]] += (FADE if self.tag[node] in CONTAINER else 1.0) * score[node]
        top = max((k for k in range(len(score)) if not k or self.tag[k] in CONTAINER), key=lambda k: (score[k], k))
        if score[top] <= 0:
            return 0, 0.0
        node = top
        while node > 0:  # an article that holds the best container is the better cut
            if self.tag[node] in ARTICLE:
                top = node
                break
            node = self.parent[node]
        return top, score[top]

    def text(self, path: str | None, boilerplate=frozenset()) -> str:
        """The text under the containers with that path, or else under the page's own best container."""
        if boilerplate:
            self.left_out = self.noise(boilerplate)
        chosen = {k for k, own in enumerate(self.paths()) if own == path} if path else set()
        if chosen:
            got = self._under(chosen)
            if got:
                return got
        return self._under({self.best()[0]})

    def _under(self, chosen: set[int]) -> str:
        inside = [False] * len(self.parent)
        for k in range(len(self.parent)):
            inside[k] = k in chosen or self.parent[k] >= 0 and inside[self.parent[k]]
        return " ".join(text for node, text, _ in self.blocks if inside[node] and not self.left_out[node])


def host_of(url: Column) -> Column:
    """The host in lower case, null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def weight(score: float) -> int:
    """Of a page's vote, in thousandths, so that sums don't depend on their order."""
    return round(score**0.5 * 1000)


def vote(pages: DataFrame) -> DataFrame:
    """pages: url, html -> host, path (the winning one, null if none), boilerplate array<string>: paths that hold one text on different pages."""

    def votes(batches):
        import pyarrow as pa

        for batch in batches:
            # host, path -> votes, pages, least and largest number of the path's text and of the page's
            sums: dict[tuple[str, str], list[int]] = {}

            def add(key, *row):
                got = sums.setdefault(key, [0, 0, *row[2:]])
                got[:] = got[0] + row[0], got[1] + row[1], min(got[2], row[2]), max(got[3], row[3]), min(got[4], row[4]), max(got[5], row[5])

            for host, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = Page(source.as_py() or "")
                paths, (node, score) = page.paths(), page.best()
                own = page.print[0]
                add((host, ""), 0, 1, own, own, own, own)
                seen = {}
                for k in range(1, len(paths)):
                    seen[paths[k]] = seen.get(paths[k], 0) + page.print[k]
                for path, text in seen.items():
                    add((host, path), weight(score) if node > 0 and path == paths[node] else 0, 1, text, text, own, own)
            cols = list(zip(*sums.values())) if sums else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in sums], pa.string()), pa.array([p for _, p in sums], pa.string()), *[pa.array(c, pa.int64()) for c in cols]], ["host", "path", "votes", "n", "t0", "t1", "p0", "p1"])

    schema = "host string, path string, " + ", ".join(f"{c} long" for c in ("votes", "n", "t0", "t1", "p0", "p1"))
    cast = pages.select(host_of(F.col("url")).alias("host"), "html").where("host IS NOT NULL").mapInArrow(votes, schema)
    summed = cast.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("n").alias("n"), F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.min("p0").alias("p0"), F.max("p1").alias("p1"))
    # a host's boilerplate paths are at most 1 / REPEAT_SHARE times the containers of a page
    all_pages = F.sum(F.when(F.col("path") == "", F.col("n"))).over(Window.partitionBy("host"))
    same = F.expr(f"path <> '' AND t0 = t1 AND p0 <> p1 AND n >= {REPEATS}") & (F.col("n") >= REPEAT_SHARE * F.col("pages"))
    won = F.max(F.when(F.col("votes") > 0, F.struct("votes", "path")))["path"]
    return summed.withColumn("pages", all_pages).groupBy("host").agg(won.alias("path"), F.sort_array(F.collect_list(F.when(same, F.col("path")))).alias("boilerplate"))


def extract(pages: DataFrame, winners: DataFrame) -> DataFrame:
    """page_id, url, text string, n_chars long."""
    rows = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    much = winners.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("boilerplate")), F.lit(0)).alias("paths")).first()  # the size is checked
    few = much["n"] <= BROADCAST_HOSTS and much["paths"] <= BROADCAST_PATHS
    joined = rows.join(F.broadcast(winners) if few else winners, "host", "left").select("page_id", "url", "html", "path", "boilerplate")

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            told = zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist())
            texts = [Page(h.as_py() or "").text(p, frozenset(b or ())) for h, p, b in told]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(read, extended(pages.select("page_id", "url"), "text string, n_chars long"))


def op3_consensus_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, materialize(vote(pages), "host-paths"))
