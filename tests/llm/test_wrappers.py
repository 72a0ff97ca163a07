import html as H
import json
import random
import re
from collections import Counter
from html.parser import HTMLParser
from itertools import combinations

import pytest

from cohortlens.llm import wrappers as W
from cohortlens.llm.markup import parse

SCHEMA = "page_id long, url string, html string, host string, wrapper string, text string, `row` int, of int"


def texts(page):
    return [t.joined() for t in parse(page)[1]]


def article(page):
    return W.Page(page).content(None, {}, 0)


# -- parsing ---------------------------------------------------------------

@pytest.mark.parametrize("page, blocks", [
    ("<p>a<p>b", ["a", "b"]),
    ("<p><b>a.<br><p>b</p>c", ["a.", "b", "c"]),
    ("a<br>b  \n\t c", ["a b c"]),
    ("x &amp;amp; &lt;p&gt; &eacute;&#233;&nbsp;y", ["x &amp; <p> éé y"]),
    ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
    ("<p title='a > b' class=x>t</p>", ["t"]),
    ("<!-- <p>no</p> -->yes<!-->and<!-- cut", ["yesand"]),
    ("a <b>b</b>c <i>d</i>", ["a bc d"]),
    ("1 < 2 and 3 > 2", ["1 < 2 and 3 > 2"]),
    ("a<script>var t=\"</p><p>\";</script>b", ["a", "b"]),
    ("<title>x</title><p>a", ["a"]),
    ("</div></p>a</b>", ["a"]),
    ("text <a href=/x", ["text"]),
    ("", []), ("   \n ", []), ("<p> </p>", []),
    ("<div>a<div>b</div>c</div>d", ["a", "b", "c", "d"]),
    ("<td>a</div>b", ["ab"]),
    ("<p>a<!DOCTYPE x>b<?php echo 1 ?>c", ["abc"]),
])
def test_blocks_of_text(page, blocks):
    assert texts(page) == blocks


def test_hostile_markup_is_read_in_linear_time():
    for page in ("<div>" * 60_000 + "x", "<a" * 200_000, "<a b='" * 100_000, "<p" * 100_000 + ">", "<li>" * 60_000, "&" * 200_000, "<!--" * 100_000,
                 "<table><td>" * 20_000 + "</p>" * 20_000, "<b>" * 100_000 + "y", "<a href=x>" * 50_000, "<div class=a><div class=b></div></div>" * 20_000):
        W.Page(page)


class Reference(HTMLParser):
    """Text of well-formed pages, for comparison: blocks by the standard library's parser."""

    def __init__(self, block):
        super().__init__(convert_charrefs=True)
        self.block, self.out, self.now = block, [], ""

    def handle_starttag(self, tag, attrs):
        self.cut() if tag in self.block else None

    def handle_endtag(self, tag):
        self.cut() if tag in self.block else None

    def handle_data(self, data):
        self.now += data

    def cut(self):
        if self.now.split():
            self.out.append(" ".join(self.now.split()))
        self.now = ""


def test_well_formed_pages_like_the_standard_parser():
    rng = random.Random(3)

    def tree(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            tag = rng.choice(["div", "section", "b", "em", "span", "blockquote"])
            out.append(rng.choice(["x ", "a&amp;b", " y", "&#8212;", "z\n"]) if depth == 0 or rng.random() < 0.4 else f"<{tag} data-x=\"1>2\">{tree(depth - 1)}</{tag}>")
        return "".join(out)

    for _ in range(300):
        page = tree(4)
        ref = Reference({"div", "section", "blockquote"})
        ref.feed(page)
        ref.close()
        ref.cut()
        assert texts(page) == ref.out


# -- surroundings ----------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><a href=/>Site</a></header><nav><ul><li><a href=/a>A</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="wrap content-sidebar"><article class=post><header><h1>Title &amp; more</h1></header><p>One <a href=x>link</a>.
<div class="ad-slot">Buy</div><p>Two <span class="ad">spam </span>end.<form><label>Mail</label><input></form><ul><li>Item<li>Other</ul>
<aside>Aside</aside><footer>Tags</footer></article><section id="comments"><article class=comment><p>Nice!</article></section></div>
<aside class=sidebar>Popular</aside><footer>&copy; x</footer><script>x()</script></body></html>"""


def test_surroundings_are_left_out():
    assert article(PAGE) == "Title & more\nOne link.\nTwo end.\nItem\nOther"
    assert article("<form id=f><main><p>a</p><div role=navigation>b</div></main><p>c</form>") == "a"
    assert article("<div class=menu><a href=1>a</a></div><p>body") == "body"
    assert article("<div itemprop=articleBody><p>a</div><p>b") == "a"
    assert article("<p>x</p><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul><p>y") == "x\ny"
    assert article("<article>a</article><article>b</article>c") == "a\nb"


def test_given_pages_whole(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in W.page_texts(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S).group(1)
        blocks = (" ".join(H.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", body))
        assert got[r.page_id].text == "\n".join(b for b in blocks if b), r.page_id
        assert got[r.page_id].url == r.url and got[r.page_id].n_chars == len(got[r.page_id].text)


# -- trees -----------------------------------------------------------------

def brute_match(a, b):
    """Size of the largest matching, by trying all order-preserving choices."""
    if a[0] != b[0]:
        return 0
    best = 0
    for k in range(min(len(a[1]), len(b[1])) + 1):
        for i in combinations(range(len(a[1])), k):
            for j in combinations(range(len(b[1])), k):
                parts = [brute_match(a[1][x], b[1][y]) for x, y in zip(i, j)]
                best = max(best, sum(parts)) if all(parts) else best
    return 1 + best


def random_tree(rng, depth=3):
    return [rng.choice("ab") if depth < 3 else "r", [random_tree(rng, depth - 1) for _ in range(rng.randint(0, 3))] if depth else []]


def test_simple_tree_matching_against_all_matchings():
    rng = random.Random(1)
    for _ in range(150):
        a, b = random_tree(rng), random_tree(rng)
        pairs = W.match(a, b)
        assert len(pairs) == brute_match(a, b)
        nodes = {}
        for side, tree in ((0, a), (1, b)):
            at = W._numbers(tree)
            todo = [(tree, None)]
            while todo:
                x, up = todo.pop()
                nodes[side, at[id(x)]] = x[0], up
                todo += [(c, at[id(x)]) for c in x[1]]
        for x, y in pairs.items():
            (la, ua), (lb, ub) = nodes[0, x], nodes[1, y]
            assert la == lb and (ua is None) == (ub is None) and (ua is None or pairs[ua] == ub)
        assert sorted(pairs) == [x for x, _ in sorted(pairs.items(), key=lambda p: p[1])]


def test_wrapper_holds_every_shape_it_was_made_of():
    rng = random.Random(2)
    for _ in range(60):
        trees = [random_tree(rng) for _ in range(4)]
        wrapper = json.loads(W.induce([json.dumps(t) for t in trees]))
        assert len(W.match(trees[0], wrapper)) == len(W._numbers(trees[0]))


def test_shape_is_the_same_for_any_length_and_maps_every_block():
    one, two = (W.Page(f"<body><div class='post-{n}'>{'<p>a<h2>b</h2><ul><li>c</ul>' * n}</div><div>x</div></body>") for n in (1, 40))
    assert one.shape == two.shape
    assert len(set(two.places())) == 2 and -1 not in two.places()
    wide = W.Page("<body>" + "".join(f"<div class='{chr(97 + i % 26)}{chr(97 + i // 26)}'>t</div>" for i in range(400)) + "</body>")
    assert len(json.loads(wide.shape)[1][0][1]) <= W.WIDE and len(wide.texts) == 399  # class "ad" is an advert


# -- wrappers of hosts -----------------------------------------------------

def site(n, rng, host="s.example"):
    """Pages whose surroundings no element or name tells: only alignment does."""
    out = []
    for i in range(n):
        words = lambda k: " ".join(rng.choice(["vel", "tor", "mun", "sa", "qui", "ber"]) + str(rng.randint(0, 999)) for _ in range(k))
        paragraphs = [words(rng.randint(3, 30)) for _ in range(rng.randint(1, 6))]
        extra = "<div class=q>Read our rules</div>" if rng.random() < 0.3 else ""
        page = (f"<body><div class=t1>Welcome to the site</div><div><p>Follow us</div>{extra}<div class=x9><h1>{words(2)}</h1>"
                + "".join(f"<p>{p}" for p in paragraphs) + "<p>Was this useful to you?</div><div>All rights reserved</div></body>")
        out.append((f"https://{host}/{i}", page, "\n".join([re.search("<h1>(.*?)</h1>", page).group(1), *paragraphs])))
    return out


def found(spark, rows, parts=4):
    df = spark.createDataFrame([(i, u, h, "h", "w", "t", 1, 2) for i, (u, h) in enumerate(rows)], SCHEMA).repartition(parts)
    got = W.page_texts(df).collect()
    return {r.page_id: r.text for r in got}


def test_template_without_marks_is_found_by_alignment(spark):
    rng = random.Random(7)
    pages = site(40, rng)
    got = found(spark, [(u, h) for u, h, _ in pages])
    assert Counter(got[i] == t or got[i].replace("Read our rules\n", "") == t for i, (_, _, t) in enumerate(pages)) == {True: 40}
    # The same pages dealt otherwise, and with other hosts beside them, read the same.
    other = [(u, h) for u, h, _ in pages] + [(u, h) for u, h, _ in site(5, rng, "t.example:81")] + [(None, pages[0][1]), ("no address", pages[1][1])]
    again = found(spark, other, 9)
    assert {i: again[i] for i in got} == got
    assert all("Follow us" not in again[i] for i in range(40, 45)) and "Follow us" in again[45] and "Follow us" in again[46]


def test_article_keeps_passages_that_pages_share(spark):
    rng = random.Random(8)
    shared = "A passage that many pages of this host have in common, word by word."
    rows, want = [], []
    for i in range(30):
        own = f"own {rng.random()}"
        rows.append((f"http://a.example/{i}", f"<article><h1>{own}</h1><p>{shared if i % 2 else own}<p>Like it? Tell your friends!</article><p>foot {i}"))
        want.append(f"{own}\n{shared if i % 2 else own}")
    got = found(spark, rows)
    assert [got[i] for i in range(30)] == want


def test_copies_stay_whole(spark):
    page = "<article><h1>Title</h1><p>Body one.<p>Body two.</article>"
    plain = "<body><div>Head</div><div class=c>Text</div></body>"
    rows = [(f"http://c.example/{i}", page + " " * i) for i in range(20)] + [(f"http://d.example/{i}", plain) for i in range(20)]
    rows += [(f"http://e.example/{i}", page.replace("Title", f"Title {i}")) for i in range(20)]
    got = found(spark, rows)
    assert {got[i] for i in range(20)} == {"Title\nBody one.\nBody two."} and {got[i] for i in range(20, 40)} == {"Head\nText"}
    assert all(got[i] == f"Title {i - 40}\nBody one.\nBody two." for i in range(40, 60))


def test_odd_rows(spark):
    rows = [("http://x.example/1", None), ("http://x.example/2", ""), (None, "<p>a"), ("http://x.example/3", "no markup at all"), ("http://x.example/4", "<script>a</script>"),
            ("http://x.example/5", "<p>" + "long " * 300_000), ("http://user:pw@[::1]:80/", "<p>v6"), ("http://x.example./6", "<p>b")]
    got = found(spark, rows + rows[3:4])
    assert got[0] == got[1] == got[4] == "" and got[2] == "a" and got[3] == got[8] == "no markup at all"
    assert len(got[5]) == 300_000 * 5 - 1 and got[6] == "v6" and got[7] == "b"
    assert W.page_texts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_real_outputs_keep_the_other_columns(spark):
    df = spark.createDataFrame([(1, "http://k.example/", "<p>a", 5)], "id long, url string, html string, text int")
    assert [r.asDict() for r in W.extract(df).collect()] == [{"id": 1, "url": "http://k.example/", "text": "a"}]


def test_template_of_rare_shapes_is_found(spark):
    """Sixteen shapes of two pages each lack the box that most pages have, each of which has a shape of its own."""
    name = lambda i: "z" + "bcdfghjklm"[i // 10] + "bcdfghjklm"[i % 10]
    plain = [f"<html><body><section class={name(i)}><p>own {i} {j}</p></section></body></html>" for i in range(16) for j in range(2)]
    boxed = [f"<html><body><section class={name(i)}><p>own {i}</p></section><div class=zbox><p>all the same</p></div></body></html>" for i in range(16, 76)]
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(plain + boxed)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in W.page_texts(pages).collect()}
    assert got == {i: f"own {i // 2} {i % 2}" for i in range(32)} | {32 + i: f"own {16 + i}" for i in range(60)}


def test_pruning_keeps_common_paths():
    a, b = ["html", [["x", [["p", []]]], ["y", []]]], ["html", [["x", [["q", []], ["p", []]]]]]
    keep = W.paths(a) & W.paths(b)
    assert W.pruned(a, keep) == W.pruned(b, keep) == ["html", [["x", [["p", []]]]]] and W.pruned(a, set()) == ["html", []]
