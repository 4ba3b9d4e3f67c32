import pytest

from sketchmill.llm import html_extract
from sketchmill.llm.html_extract import Page

PROSE = "This is a sentence of the article that goes on for some time, as articles do. " * 3


@pytest.mark.parametrize(
    "source, want",
    [
        ("", ""),
        ("plain text &amp; more", "plain text & more"),
        ("<body><article><p>a  b\n c</p><p>d<b>e</b>f<br>g</p></article></body>", "a b c def g"),
        ("<body><article>x &lt;p&gt; &#233;&nbsp;y</article></body>", "x <p> é y"),
        ("<nav>menu</nav><article><p>one<p>two</article><footer>foot</footer>", "one two"),
        ("<article><script>var a='<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes</p></article>", "yes"),
        ("<article><h1>T</h1><aside>no</aside><form>no<input></form><p>yes</p></article>", "T yes"),
        ("<div class='sidebar'>no</div><div id=main><p>yes it is</p></div><div id=comments><p>" + PROSE + "</p></div>", "yes it is"),
        ("<div><p>unclosed <b>bold<p>next</div>", "unclosed bold next"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>", "a b c d"),
        ("<article><p>a < b and c > d</p></article>", "a < b and c > d"),
        ("<ARTICLE><P>Case</P></ARTICLE>", "Case"),
        ("<article><p hidden>this</p><p style='display: none'>that</p><svg><text>too</text></svg><p>yes</p></article>", "this that too yes"),
    ],
)
def test_pages(source, want):
    assert Page(source).text(None) == want


def test_consensus(spark, tables):
    page = lambda body, extra="": f"<html><body><div class='top'><p>{extra}</p></div><div class='post-12 body'><p>{body}</p></div></body></html>"
    pages = [(k, f"http://h.example/{k}", page(PROSE)) for k in range(8)]
    pages += [(20, "http://H.example/short", page("Short.", "An introduction that is much longer than the text of this one page. " * 2)), (21, None, page("alone here")), (22, "nonsense", ""), (23, "http://h.example/n", None), (0, "http://h.example/0", page(PROSE))]
    got = {r["page_id"]: r for r in html_extract.op3_consensus_extraction(spark, tables(pages=pages)).collect()}
    assert len(got) == 12
    assert got[0]["text"] == PROSE.strip() and got[0]["n_chars"] == len(PROSE.strip())
    assert got[20]["text"] == "Short."  # by itself it would have taken the longer box
    assert got[21]["text"].endswith("alone here") and got[22]["text"] == "" and got[23]["n_chars"] == 0


def test_both_joins_agree(spark, tables, monkeypatch):
    pages = [(k, f"http://h{k % 3}.example/{k}", f"<div class=a{k}><p>{PROSE} {k}</p></div>") for k in range(12)]
    d = tables(pages=pages)
    rows = lambda: sorted(map(tuple, html_extract.op3_consensus_extraction(spark, d).collect()))
    first = rows()
    monkeypatch.setattr(html_extract, "BROADCAST_HOSTS", 0)
    assert rows() == first


def test_long_and_empty(spark, tables):
    assert html_extract.op3_consensus_extraction(spark, tables()).count() == 0
    assert len(Page("<p>" * 50_000 + "x").text(None)) == 1
    assert Page("<" * 100_000).text(None).startswith("<")
    assert Page('<a "' * 2000).text(None) != ""


def host_pages(seed=4):
    """Pages of a few hosts: most hold the article where their host has it, some elsewhere; depths differ."""
    import random

    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for k in range(120):
        host = k % 7
        depth = (3, 30, 60, 5, 2, 40, 1)[host]
        classes = [f"c{host}-{d}" for d in range(depth)]
        body = f"<p>{prose(rng.randrange(1, 60))}</p><p>{prose(rng.randrange(1, 60))}</p>"
        beside = f"<div class=x{rng.randrange(3)}><p>{prose(rng.randrange(1, 40))}</p></div>"
        inner = f"<div class=post{k}>{body}</div>{beside}" if rng.random() < 0.8 else f"<div class=other>{beside}</div>{body}"
        rows.append((k, None if k % 31 == 30 else f"https://h{host}.example/{k}", "<html><body>" + "".join(f"<div class='{c}'>" for c in classes) + inner + "</div>" * depth + "</body></html>"))
    return rows + [(500, "https://h1.example/empty", ""), (501, "https://h9.example/", None)]


def test_consensus_by_brute_force(spark, tables):
    """The votes counted one by one, and every page read under its host's winner."""
    import re
    from collections import defaultdict

    rows = host_pages()
    votes = defaultdict(lambda: defaultdict(int))
    for _, url, source in rows:
        page = html_extract.Page(source or "")
        node, score = page.best()
        if url and node > 0:
            steps, at = [], node
            while at > 0:
                steps.append(page.step[at])
                at = page.parent[at]
            votes[re.sub("https://([^/]*)/.*", r"\1", url)][tuple(steps[::-1]), page.paths()[node]] += html_extract.weight(score)
    winner = {h: max(v.items(), key=lambda x: (x[1], x[0][1]))[0][0] for h, v in votes.items()}
    want = []
    for page_id, url, source in rows:
        page, host = html_extract.Page(source or ""), re.sub("https://([^/]*)/.*", r"\1", url) if url else None

        def path_of(node, page=page):
            out = []
            while node > 0:
                out.append(page.step[node])
                node = page.parent[node]
            return tuple(out[::-1])

        chosen = {k for k in range(1, len(page.parent)) if path_of(k) == winner.get(host)}

        def text_under(nodes, page=page):
            def within(k):
                while k >= 0:
                    if k in nodes:
                        return True
                    k = page.parent[k]
                return False

            return " ".join(t for k, t, _ in page.blocks if within(k))

        text = (text_under(chosen) if chosen else "") or text_under({page.best()[0]})
        want.append((page_id, url, text, len(text)))
    got = [tuple(r[c] for c in ("page_id", "url", "text", "n_chars")) for r in html_extract.op3_consensus_extraction(spark, tables(pages=rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len({len(w) for w in winner.values()}) > 3 and max(map(len, winner.values())) > 40


def test_deep_container_is_told_apart():
    """The best container of a page that is 60 containers deep, not what stands beside it."""
    source = "<body>" + "<div>" * 60 + "<div class=main><p>" + "the story goes on " * 20 + "</p></div><div class=x><p>beside</p></div>" + "</div>" * 60
    page = html_extract.Page(source)
    path = page.paths()[page.best()[0]]
    assert page.text(path) == ("the story goes on " * 20).strip()


def test_only_what_is_named_is_left_out():
    kept = "<p>a <math><mi>x</mi></math> b</p><noscript>c</noscript><canvas>d</canvas><object>e</object>"
    page = html_extract.Page(f"<body><article>{kept}<script>no</script><style>no</style><select><option>no</select><textarea>no</textarea></article></body>")
    assert page.text(None).replace(" ", "") == "axbcde"


FIVE = "".join(f"<p>Paragraph {k} of the article that says something about it.</p>" for k in range(5))
TEXT = " ".join(f"Paragraph {k} of the article that says something about it." for k in range(5))


@pytest.mark.parametrize(
    "source, want",
    [
        (f'<div class="layout with-sidebar">{FIVE}</div>', TEXT),
        (f'<div id="page" class="no-sidebar">{FIVE}</div>', TEXT),
        (f'<div class="post hentry comments-open">{FIVE}</div>', TEXT),
        (f'<div class="recipe cookie-recipe">{FIVE}</div>', TEXT),
        (f'<article><section id="related-work">{FIVE}</section></article>', TEXT),
        (f'<article><h1>Title</h1><section id="discussion">{FIVE}</section></article>', "Title " + TEXT),
        (f'<article>{FIVE}<p class="alert">Mind the gap.</p></article>', TEXT + " Mind the gap."),
        (f'<article>{FIVE}<div class="ad">Buy</div></article>', TEXT),
        (f'<article>{FIVE}<section class="comments">{FIVE}</section></article>', TEXT),
        (f'<div class="post">{FIVE}</div><div id="comments">{FIVE}{FIVE}</div>', TEXT),
        (f'<div class="post">{FIVE}</div><div class="related-posts"><ul><li><a>One</a></ul></div>', TEXT),
        (f'<div class="ad">{FIVE}</div><article><p>A short article.</p></article>', "A short article."),
    ],
)
def test_names_alone_decide_nothing(source, want):
    assert Page(f"<html><body>{source}</body></html>").text(None) == want


def test_linear_in_depth():
    import time

    for source in ("<div>" * 100_000 + "x", "<a " * 100_000, "<div></section>" * 100_000, "<figure>" * 100_000 + "<p>x", '<div class="ad">' * 100_000 + "x"):
        began = time.process_time()
        Page(source).text(None)
        assert time.process_time() - began < 15


def made_pages(n=200, seed=9):
    """Pages of five hosts with every kind of noise; what belongs to the article is marked by an attribute that nothing else reads."""
    import random

    draw = random.Random(seed)
    sentence = lambda: " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(draw.randint(6, 16))) + "."
    block = lambda tag="p", extra="": f"<{tag}{extra} data-own>{sentence()} &amp; {sentence()}</{tag}>"
    link = lambda: f"<li><a href='/x'>{sentence()[:12]}</a></li>"
    notes = [f"<div class='strip-{h}'><p>{sentence()}</p></div>" for h in range(5)]  # no word names it: only its repetition tells
    rows = []
    for k in range(n):
        h = k % 5
        inside = [block(draw.choice(["p", "p", "blockquote", "li"])) for _ in range(draw.randint(4, 9))]
        inside.insert(2, draw.choice(["", "<div class='ad-slot'>buy this</div>", "<aside>beside</aside>", block("p", " class='alert'"), "<form>name<input></form>", "<script>if (a < b) document.write('<p>no</p>')</script>"]))
        body = "".join(inside)
        wrap = [f"<article>{block('h1')}{body}</article>", f"<main><div class='content with-sidebar'>{body}</div></main>", f"<div id='main' class='post-{k} no-sidebar'>{body}</div>", f"<div class='entry comments-open'>{body}</div>", f"<article><section id='discussion'>{body}</section></article>"][h]
        before = f"<header>{sentence()}</header><nav><ul>{link()}{link()}</ul></nav>" + draw.choice(["", "<!-- <p>no</p> -->"]) + notes[h]
        after = f"<div class='related-posts'><ul>{link()}{link()}{link()}</ul></div>" + draw.choice(["", f"<div id='comments'><p>{sentence()}</p><p>{sentence()}</p></div>"]) + f"<div class='cookie-notice'>{sentence()[:20]}</div><footer>{sentence()}</footer>"
        rows.append((k, f"https://site{h}.example/{k}", f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>{before}{wrap}{after}</body></html>"))
    return rows


def test_made_pages_against_an_independent_parser(spark, tables):
    from html.parser import HTMLParser

    class Marked(HTMLParser):
        def __init__(self):
            super().__init__()
            self.own, self.texts = None, []

        def handle_starttag(self, tag, attrs):
            if ("data-own", None) in attrs:
                self.own, self.texts = tag, [*self.texts, ""]

        def handle_endtag(self, tag):
            self.own = None if tag == self.own else self.own

        def handle_data(self, data):
            if self.own:
                self.texts[-1] += data

    rows, want = made_pages(), {}
    for page_id, _, source in rows:
        parser = Marked()
        parser.feed(source)
        want[page_id] = " ".join(" ".join(t.split()) for t in parser.texts)
    got = {r["page_id"]: r["text"] for r in html_extract.op3_consensus_extraction(spark, tables(pages=rows)).collect()}
    wrong = [k for k in want if got[k] != want[k]]
    assert not wrong, (len(wrong), want[wrong[0]], got[wrong[0]])


def test_boilerplate_is_told_by_its_host(spark, tables):
    """A box without a telling name is left out where it repeats over different pages; copies of one page are no evidence."""
    page = lambda k, box: f"<body><div class=post><p>{PROSE} {k}</p><div class=box><p>{box}</p></div></div></body>"
    pages = [(k, "http://a.example/", page(k, "The same box.")) for k in range(6)]
    pages += [(10 + k, "http://b.example/", page(1, "A box of its own.")) for k in range(6)]
    got = {r["page_id"]: r["text"] for r in html_extract.op3_consensus_extraction(spark, tables(pages=pages)).collect()}
    assert all("box" not in got[k] for k in range(6)) and all("box" in got[10 + k] for k in range(6))
