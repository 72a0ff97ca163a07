"""Main text of pages by wrapper induction: DOM trees of a host are aligned,
what is constant is template, what varies is content."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import frugal
from .common import discard, stored, url_host
from .markup import SILENT, Node, Text, parse

#: Trees that merge at a time: the shapes of most pages of a host as they are, then all others in rounds.
SHAPES = 16
#: A text is template if it stands at one place of the wrapper on more than this share of a host's pages ...
TEMPLATE = 0.5
#: ... or, inside the article, on more than this share, one page counted as lacking it.
TEMPLATE_INSIDE = 0.9
#: Children of a node and levels that shapes tell apart; beyond, children of one kind count as one.
WIDE, DEEP = 64, 64

# What elements and names say about their part of a page.
PARTS = frozenset("nav footer aside form menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar status".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot alert alerts aside banner breadcrumb breadcrumbs comment commentlist comments "
    "consent cookie cookies discussion disqus footer gdpr login menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo "
    "promotion recommendations recommended related replies reply respond responses search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe "
    "subscription toolbar widget widgets".split())
#: Names of a page's head; inside the article they may hold its title.
HEADS = frozenset("header masthead topbar".split())
#: Names that tell an article element of its own from the article.
MINOR = frozenset("ad ads advert advertisement comment comments promo related replies reply response sponsored teaser".split())
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table tbody thead tfoot tr td th caption hr br address details summary center".split())
LISTS = frozenset("ul ol dl menu dir".split())

_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@lru_cache(1 << 14)
def tokens(names: str) -> frozenset[str]:
    """Lower-case words of class and id names: mainNav and main-nav are main, nav."""
    return frozenset(t.lower() for t in _TOKENS.findall(names))


def regions(nodes: list[Node]) -> tuple[list[bool], list[bool]]:
    """For every element whether it is part of what surrounds an article, and
    whether it is inside the article (or, without one, the main part)."""
    n = len(nodes)
    minor = [x.tag == "article" and bool(tokens(x.names) & MINOR) for x in nodes]
    article = [x.tag == "article" and not m for x, m in zip(nodes, minor)]
    main = [x.tag == "main" or "main" in x.words.split() or "articleBody" in x.words for x in nodes]
    holds = [a or m for a, m in zip(article, main)]
    for i in range(n - 1, 0, -1):
        if holds[i]:
            holds[nodes[i].parent] = True
    out, in_article, in_main = [False] * n, [False] * n, [False] * n
    for i, x in enumerate(nodes):
        up = x.parent
        if up >= 0:
            out[i], in_article[i], in_main[i] = out[up], in_article[up], in_main[up]
        if not out[i]:
            named = tokens(x.names)
            if x.tag in SILENT or x.tag in ("nav", "footer", "aside") or minor[i]:
                out[i] = True
            elif not holds[i] and x.tag not in ("html", "body"):
                inside = in_article[i] or in_main[i]
                out[i] = x.tag in PARTS or bool(named & NAMES) or bool(ROLES & set(x.words.split())) or (not inside and (x.tag == "header" or bool(named & HEADS)))
        if not out[i]:
            in_article[i] |= article[i]
            in_main[i] |= main[i]
    return out, in_article if any(in_article) else in_main


def shape(nodes: list[Node]) -> tuple[list, list[int]]:
    """The page's tree without its repetitions, as [label, children], and the
    node of it (in pre-order) of every element, -1 if none.

    Siblings of one form in a row count once, and paragraphs, headings, lists
    and tables without names of their own are one flow: so pages of one
    layout have one shape whatever their length."""
    n = len(nodes)
    depth = [0] * n
    for i in range(1, n):
        depth[i] = depth[nodes[i].parent] + 1
    form: list = [None] * n
    place: list[dict] = [{} for _ in range(n)]
    known: dict = {}
    for i in range(n - 1, -1, -1):
        x = nodes[i]
        own: list = []
        if depth[i] < DEEP:
            kids = [c for c in x.children if nodes[c].block and nodes[c].tag not in SILENT]
            for c in kids:
                if not own or own[-1] is not form[c]:
                    own.append(form[c])
                place[i][c] = len(own) - 1
            for key in (lambda f: id(f), lambda f: f[0], lambda f: f[0].split(".")[0]):
                if len(own) <= WIDE:
                    break
                first: dict = {}
                kept, own = own, []
                for f in kept:
                    if key(f) not in first:
                        first[key(f)] = len(own)
                        own.append(f)
                # A child that only shares its kind with the first has a place, its own children have none.
                place[i] = {c: first[key(kept[at])] for c, at in place[i].items()}
        names = ".".join(sorted(tokens(x.names)))
        label = x.tag if x.tag in ("html", "body") else f"{x.tag}.{names}" if names else x.tag
        if x.tag in FLOW and not names and all(f[0] == "flow" for f in own):
            label, own = "flow", []
        key = (label, tuple(id(f) for f in own))
        if key not in known:
            known[key] = (label, own)
        form[i] = known[key]

    number = [-1] * n
    sizes: dict[int, int] = {}

    def size(f) -> int:
        if id(f) not in sizes:
            sizes[id(f)] = 1 + sum(size(c) for c in f[1])
        return sizes[id(f)]

    number[0] = 0
    for i in range(1, n):
        x, up = nodes[i], nodes[i].parent
        if number[up] < 0:
            continue
        if not x.block or x.tag in SILENT or depth[i] > DEEP or form[up][0] == "flow":
            number[i] = number[up]
        elif i in place[up]:
            at = place[up][i]
            if form[up][1][at] is form[i]:
                number[i] = number[up] + 1 + sum(size(f) for f in form[up][1][:at])

    def plain(f) -> list:
        return [f[0], [plain(c) for c in f[1]]]

    return plain(form[0]), number


def match(a: list, b: list) -> dict[int, int]:
    """Simple tree matching: the largest set of pairs of nodes (in pre-order
    of a and of b) with equal labels, that keeps ancestors and the order of
    siblings, roots matched with roots."""
    weights: dict[tuple[int, int], tuple[int, list]] = {}

    def weigh(x: list, y: list) -> int:
        if x[0] != y[0]:
            return 0
        key = id(x), id(y)
        if key not in weights:
            m, n = len(x[1]), len(y[1])
            best = [[0] * (n + 1) for _ in range(m + 1)]
            for i in range(m):
                for j in range(n):
                    w = weigh(x[1][i], y[1][j])
                    best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + w if w else 0)
            kept, i, j = [], m, n
            while i and j:
                if best[i][j] == best[i - 1][j]:
                    i -= 1
                elif best[i][j] == best[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    kept.append((i, j))
            weights[key] = 1 + best[m][n], kept[::-1]
        return weights[key][0]

    found: dict[int, int] = {}
    if not weigh(a, b):
        return found
    first_a, first_b = _numbers(a), _numbers(b)
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        found[first_a[id(x)]] = first_b[id(y)]
        todo += [(x[1][i], y[1][j]) for i, j in weights[id(x), id(y)][1]]
    return found


def _numbers(tree: list) -> dict[int, int]:
    out, todo = {}, [tree]
    while todo:
        x = todo.pop()
        out[id(x)] = len(out)
        todo += reversed(x[1])
    return out


def merged(wrapper: list, page: list) -> list:
    """``wrapper`` with the nodes of a page's shape that it lacks, each after its neighbour's partner."""
    at = {v: k for k, v in match(wrapper, page).items()}
    number_w, number_p = _numbers(wrapper), _numbers(page)

    def join(w: list, p: list) -> list:
        partner = {number_w[id(c)]: c for c in w[1]}
        out, done = [], 0
        mine = list(w[1])
        for c in p[1]:
            other = partner.get(at.get(number_p[id(c)], -1))
            if other is None:
                out.append(c)
            else:
                stop = next(i for i in range(done, len(mine)) if mine[i] is other)
                out += mine[done:stop]
                out.append(join(other, c))
                done = stop + 1
        return [w[0], out + mine[done:]]

    return join(wrapper, page) if at else wrapper


def induce(shapes: list[str]) -> str:
    """The wrapper of a host from its shapes, the most frequent first."""
    wrapper = json.loads(shapes[0])
    for s in shapes[1:]:
        wrapper = merged(wrapper, json.loads(s))
    return json.dumps(wrapper, separators=(",", ":"))


def paths(tree: list) -> set[int]:
    """Hashes of the labels from the root to every node."""
    out, todo = set(), [(tree, 0)]
    while todo:
        x, above = todo.pop()
        path = _mark(f"{above}/{x[0]}")
        out.add(path)
        todo += [(c, path) for c in x[1]]
    return out


def pruned(tree: list, keep: set[int], above: int = 0) -> list:
    """``tree`` without the nodes whose paths are not in ``keep``; the root stays."""
    path = _mark(f"{above}/{tree[0]}")
    return [tree[0], [pruned(c, keep, path) for c in tree[1] if _mark(f"{path}/{c[0]}") in keep]]


@lru_cache(4096)
def aligned(page: str, wrapper: str) -> dict[int, int]:
    """Nodes of a page's shape to nodes of its host's wrapper."""
    return match(json.loads(page), json.loads(wrapper))


def _mark(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class Page:
    """A parsed page: its blocks of text outside of marked surroundings."""

    def __init__(self, html: str | None):
        nodes, texts = parse(html or "")
        self.out, self.inside = regions(nodes)
        self.nodes, tree = nodes, None
        tree, self.number = shape(nodes)
        self.shape = json.dumps(tree, separators=(",", ":"))
        drop = frozenset(i for i, o in enumerate(self.out) if o)
        self.texts: list[tuple[Text, str]] = [(t, s) for t in texts if not self.out[t.node] and (s := t.joined(drop))]

    def places(self) -> list[int]:
        return [self.number[t.node] for t, _ in self.texts]

    def menus(self) -> set[int]:
        """Blocks that are menus by their links: most of a list's text, or most of a block of three links and more."""
        share: dict[int, list[int]] = {}
        lists: list[int | None] = []
        for t, _ in self.texts:
            at: int | None = t.node
            while at is not None and self.nodes[at].tag not in LISTS:
                at = self.nodes[at].parent if self.nodes[at].parent >= 0 else None
            lists.append(at)
            linked = sum(len(s.strip()) for _, s, link in t.pieces if link)
            parts = len({n for n, s, link in t.pieces if link and s.strip()})
            whole = sum(len(s.strip()) for _, s, _ in t.pieces)
            total = share.setdefault(-1 - len(lists) if at is None else at, [0, 0, 0])
            for i, v in enumerate((linked, whole, parts)):
                total[i] += v
        menu = {k for k, (linked, whole, parts) in share.items() if parts >= 3 and 2 * linked > whole}
        return {i for i, at in enumerate(lists) if (-2 - i if at is None else at) in menu}

    def content(self, wrapper: str | None, constant: dict[tuple[int, int], int], pages: int) -> str:
        """The blocks that are content, given the host's wrapper and how many
        of its pages have which text at which place of the wrapper."""
        scoped = any(self.inside)
        blocks = [i for i, (t, _) in enumerate(self.texts) if not scoped or self.inside[t.node]]
        if wrapper is not None and constant:
            at = aligned(self.shape, wrapper)
            limit = TEMPLATE_INSIDE if scoped else TEMPLATE
            places = self.places()
            fixed = {i for i in blocks if constant.get((at.get(places[i], -1), _mark(self.texts[i][1])), 0) > limit * (pages + 1)}
            size = lambda own: sum(len(self.texts[i][1]) for i in own)
            # Where most of the article, or the whole page, is the same the pages are copies, not a template.
            if (2 * size(fixed) < size(blocks)) if scoped else len(fixed) < len(blocks):
                blocks = [i for i in blocks if i not in fixed]
        if not scoped:
            menus = self.menus()
            blocks = [i for i in blocks if i not in menus]
        return "\n".join(self.texts[i][1] for i in blocks)


_SEEN = "host string, shape string, kind long, page long, places array<int>, marks array<long>"


@frugal
def _read(batches):
    """Pages to what wrappers are made of: (host, shape, places and hashes of texts)."""
    for batch in batches:
        out: list[tuple] = []
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html")):
            p = Page(html.as_py())
            marks = [_mark(s) for _, s in p.texts]
            out.append((host, p.shape, _mark(p.shape), _mark(p.shape + ",".join(map(str, marks))), p.places(), marks))
        columns = list(zip(*out)) if out else [[]] * 6
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["host", "shape", "kind", "page", "places", "marks"])


@frugal
def _induce(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([induce(s) for s in batch.column("shapes").to_pylist()], pa.string())], names=["host", "wrapper"])


@frugal
def _merge(batches):
    for batch in batches:
        merged_of = pa.array([induce(s) for s in batch.column("shapes").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("host", "id", "parts")] + [merged_of], names=["host", "id", "parts", "tree"])


@frugal
def _paths(batches):
    for batch in batches:
        found = [list(paths(json.loads(s))) for s in batch.column("shape").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("n"), pa.array(found, pa.list_(pa.int64()))], names=["host", "n", "paths"])


@frugal
def _prune(batches):
    for batch in batches:
        trees = [json.dumps(pruned(json.loads(s), set(k or ())), separators=(",", ":")) for s, k in zip(batch.column("shape").to_pylist(), batch.column("keep").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(map(_mark, trees), pa.int64()), pa.array(trees, pa.string())], names=["host", "id", "tree"])


def _others(shapes: DataFrame, frequent: DataFrame) -> DataFrame | None:
    """(host, others): the shapes that are not among a host's ``frequent``
    ones, merged into one tree for each host; None if there are none.

    Partners have the same labels up to the root, so a text can only be
    constant under a path of labels that more than ``TEMPLATE`` of the host's
    pages have: other nodes are left out first, which loses no template and
    bounds the tree by the size of the pages. Trees merge ``SHAPES`` at a
    time, in rounds."""
    many = shapes.groupBy("host").agg(F.count("*").alias("kinds"), F.sum("n").alias("pages")).where(F.col("kinds") > SHAPES)
    if many.isEmpty():
        return None
    wide = shapes.join(many.select("host", "pages"), "host")
    counts = wide.select("host", "n", "shape").mapInArrow(_paths, "host string, n long, paths array<long>").select("host", "n", F.explode("paths").alias("path")).groupBy("host", "path").agg(F.sum("n").alias("n"))
    keep = counts.join(many, "host").where(F.col("n") > TEMPLATE * (F.col("pages") + 1)).groupBy("host").agg(F.collect_list("path").alias("keep"))
    rest = wide.join(frequent.select("host", "kind"), ["host", "kind"], "left_anti").join(keep, "host", "left")
    trees = rest.select("host", "shape", "keep").mapInArrow(_prune, "host string, id long, tree string").dropDuplicates(["host", "id"])
    trees = stored(trees, "trees")
    left = stored(trees.join(trees.groupBy("host").agg(F.count("*").alias("parts")), "host"), "parts")
    discard(trees)
    most = left.agg(F.max("parts")).first()[0]
    while most > 1:
        parts = F.ceil(F.col("parts") / SHAPES).cast("long")
        groups = left.select("host", F.pmod("id", parts).alias("id"), parts.alias("parts"), F.struct("id", "tree").alias("x")).groupBy("host", "id", "parts")
        lists = groups.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["tree"]).alias("shapes"))
        done, left = left, stored(lists.mapInArrow(_merge, "host string, id long, parts long, tree string"), "parts")
        discard(done)
        most = -(-most // SHAPES)
    return left.select("host", F.col("tree").alias("others"))


@frugal
def _align(batches):
    for batch in batches:
        nodes = []
        for s, w in zip(batch.column("shape").to_pylist(), batch.column("wrapper").to_pylist()):
            at = aligned(s, w)
            nodes.append([at.get(i, -1) for i in range(max(at, default=-1) + 1)])
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("kind"), pa.array(nodes, pa.list_(pa.int32()))], names=["host", "kind", "nodes"])


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, pages, constant) of the hosts of ``pages`` (host, html):
    constant lists (place, mark, n) of the texts on more than ``TEMPLATE`` of
    the host's pages, at most mean blocks / ``TEMPLATE`` of them.

    Every page is read once into a narrow table (its shape, a place and a
    hash per block of text); copies of a page on a host count once. Shapes
    are counted over all pages, and the ``SHAPES`` most frequent of a host
    merge into its wrapper, then what ``_others`` makes of all others; the alignment is a matter of (host, shape), so it
    is computed once for each. Counts meet in partial sums: no host's pages
    come together in a task."""
    read = stored(pages.where("host is not null").select("host", "html").mapInArrow(_read, _SEEN), "shapes")
    seen = read.dropDuplicates(["host", "page"])
    shapes = stored(seen.groupBy("host", "kind").agg(F.count("*").alias("n"), F.min("shape").alias("shape")), "kinds")
    order = Window.partitionBy("host").orderBy(F.desc("n"), "kind")
    frequent = shapes.withColumn("i", F.row_number().over(order)).where(F.col("i") <= SHAPES)
    lists = frequent.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "shape"))), lambda x: x["shape"]).alias("shapes"))
    others = _others(shapes, frequent)
    if others is not None:
        lists = lists.join(others, "host", "left").select("host", F.concat("shapes", F.array_compact(F.array("others"))).alias("shapes"))
    found = stored(lists.mapInArrow(_induce, "host string, wrapper string"), "wrappers")
    places = stored(shapes.select("host", "kind", "shape").join(found, "host").select("host", "kind", "shape", "wrapper").mapInArrow(_align, "host string, kind long, nodes array<int>"), "places")
    # A shape's node without a partner in the wrapper is at no place.
    at = F.transform("places", lambda p: F.when(p >= 0, F.get("nodes", p)))
    texts = seen.join(places, ["host", "kind"]).select("host", F.explode(F.array_distinct(F.arrays_zip(at.alias("place"), F.col("marks").alias("mark")))).alias("x"))
    texts = texts.select("host", F.col("x.place").alias("place"), F.col("x.mark").alias("mark")).where("place >= 0")
    totals = seen.groupBy("host").agg(F.count("*").alias("pages"))
    common = texts.groupBy("host", "place", "mark").agg(F.count("*").alias("n")).where("n > 1").join(totals, "host").where(F.col("n") > TEMPLATE * (F.col("pages") + 1))
    constant = common.groupBy("host").agg(F.collect_list(F.struct("place", "mark", F.col("n").cast("int").alias("n"))).alias("constant"))
    templates = stored(found.join(totals, "host").join(constant, "host", "left"), "templates")
    for table in (read, shapes, found, places) + (() if others is None else (others,)):
        discard(table)
    return templates


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", out_col: str = "text") -> DataFrame:
    """``pages`` with the main text of the html in ``out_col`` in place of the html.

    Elements that HTML or their names mark as surroundings (navigation,
    headers, footers, sidebars, notices, adverts, forms, comments; scripts
    and styles) are left out, and so is all that lies outside the article, if
    the page marks one. Of the rest, texts that are constant at one place of
    the host's wrapper are template; what varies is content. Blocks keep page
    order, one a line, white space in them is one space.

    A null or empty html, or a page without text: an empty text. Pages
    without a host (null or odd url) are not compared with others, nor is the
    only page of a host: the marks alone decide. Repeated pages give a row
    each but count once; pages that are mostly the same as their host's
    others are copies, and keep their article. An empty table gives an empty
    result; a column named ``out_col`` is replaced. Broken markup never
    fails; a page of any length is read whole."""
    spark = pages.sparkSession
    keep = [c for c in pages.columns if c not in (html_col, out_col)]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(html_col).cast("string").alias("html"), url_host(F.col(url_col)).alias("host"))
    known = wrappers(rows).select(F.col("host").alias("of"), "wrapper", "pages", F.transform("constant", lambda x: x["place"]).alias("place"),
                                  F.transform("constant", lambda x: x["mark"]).alias("mark"), F.transform("constant", lambda x: x["n"]).alias("n"))

    @frugal
    def read(batches):
        last = None
        constant: dict = {}
        for batch in batches:
            texts = []
            column = {c: batch.column(c) for c in ("html", "of", "wrapper", "pages", "place", "mark", "n")}
            for i in range(batch.num_rows):
                host = column["of"][i].as_py()
                if last != host or host is None:
                    last, constant = host, {}
                    if host is not None and column["place"][i].is_valid:
                        constant = dict(zip(zip(column["place"][i].as_py(), column["mark"][i].as_py()), column["n"][i].as_py()))
                texts.append(Page(column["html"][i].as_py()).content(column["wrapper"][i].as_py(), constant, column["pages"][i].as_py() or 0))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    kind = rows.schema["row"].dataType.simpleString()
    out = rows.join(known, F.col("host") == F.col("of"), "left").drop("host").mapInArrow(read, f"row {kind}, text string")
    return out.select(*[F.col("row")[c].alias(c) for c in keep], F.col("text").alias(out_col))


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of crawled pages (page_id, url, html)."""
    return extract(pages.select("page_id", "url", "html", F.col("url").alias("address")), url_col="address").select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
