"""Main text of web pages by consensus host paths.

Each page is parsed and its containers scored; its best containers vote for
their generalised paths (tags and classes from the body down, digits and hashes
taken out). Votes are added up by host and path in Spark, and every page is
extracted again from all its containers on the first of its host's winning paths
that holds half of its running text, or from its own best where none does. For a
vote, the containers of one name that hold seven tenths of the text around them
are gone down into; a page's own best is its articles (or main) of one path with
half of the text, or what holds all of it. A path wins with two pages' votes, if
that is one in a thousand of its host's. What a page has beside its host's path, or its articles, is not main text.

Menus, headers, footers, sidebars, notices, adverts, forms, comments and the
like are told by tag, role and the words of class and id, and are left out
wherever they stand; a header inside an article is part of it. Words alone don't
leave out what holds most of the page's running text or its only h1, nor an
article on a page without another, unless they never name one (adverts, comments,
notices); where nothing would be left, they don't count at all. Classes like
category-x and tag-x beside others say what a page is about and don't count.

Defined cases: null and empty pages give the empty text; a null or odd url
belongs to one host without a name; repeated rows are pages like any other;
unclosed and crossed tags are closed as browsers do for the common cases; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common

MARK = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|[!?])")
#: Where a tag may end, or a quoted value begin.
TURN = re.compile(r"=\s*[\"']|>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

RAW = frozenset("script style noscript template textarea title iframe svg math object canvas video audio select xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body main article section div td center table tbody tr blockquote".split())
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr blockquote pre figure figcaption address details summary hr header footer nav aside form fieldset center hgroup search dialog menu".split())
SPACED = frozenset("br td th".split())
CLOSES_P = BLOCKS - {"tr", "tbody", "thead", "tfoot", "caption"}
#: Start tags that end an open element of the second set, not beyond one of the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
OUT_TAGS = frozenset("head nav footer aside form button label fieldset dialog menu search".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
OUT_WORDS = frozenset(
    "ad ads adbanner adbox adsbygoogle adsense adslot adunit adv advert adverts advertisement advertising alert alerts announcement announcements aside banner breadcrumb breadcrumbs colophon comment commentlist comments consent cookie cookies copyright crumbs cta disclaimer discussion discussions disqus drawer footer gdpr googleads login masthead menu modal nav navbar navi navigation newsletter notice notices notification notifications offcanvas offer offers outbrain overlay pager pagination paywall popular popup promo promoted promotion rail recommendations recommended related replies reply respond responses share sharebar sharing sidebar sidenav signin signup skyscraper social sponsor sponsored sponsors subscribe subscription taboola tagline teaser teasers thread threads toolbar topbar trending ugc widget widgets werbung anzeige anzeigen kommentar kommentare fusszeile seitenleiste publicite commentaire commentaires publicidad comentario comentarios pubblicita commenti".split()
)
#: Of these, words that never name an article: what they mark is kept only where a page has no running text besides.
NEVER_WORDS = frozenset(
    "ad ads adbanner adbox adsbygoogle adsense adslot adunit adv advert adverts advertisement advertising breadcrumb breadcrumbs comment commentlist comments consent cookie cookies copyright crumbs cta disclaimer discussion discussions disqus footer gdpr googleads login masthead newsletter notice notices notification notifications outbrain pager pagination paywall popup replies reply respond responses signin signup skyscraper subscribe subscription taboola ugc werbung anzeige anzeigen kommentar kommentare publicite commentaire commentaires publicidad comentario comentarios pubblicita commenti".split()
)
#: Classes that name what an article is about; they stand beside other classes.
SUBJECT = re.compile(r"(?:category|categories|cat|tag|tags|topic|term)[-_]", re.I)
#: A class or id with one of these is a page's header, unless it also has one of the second set or stands in an article.
HEAD_WORDS, OWN_HEAD = frozenset("header hdr".split()), frozenset("article content entry post section story".split())
NOT_OUT = frozenset("has with no without enabled page main content wrapper container".split())
WHOLE = frozenset("html body main".split())
LINKED = 0.6
HOLDS = 0.7


def marks(source: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, past the end, "/" or "", tag or "", attributes) of tags, comments and declarations; every character is looked at a few times at most."""
    at, unclosed = 0, set()  # quotes that don't come again
    while m := MARK.search(source, at):
        begin, at = m.start(), m.end()
        if m[2] is None:
            comment = source.startswith("<!--", begin)
            end = source.find("-->" if comment else ">", at)
            if end < 0 and not comment:
                return
            at = len(source) if end < 0 else end + (3 if comment else 1)
            yield begin, at, "", "", ""
            continue
        look = at
        while (turn := TURN.search(source, look)) and (quote := turn[0][-1]) != ">":
            close = -1 if quote in unclosed else source.find(quote, turn.end())
            if close < 0:
                unclosed.add(quote)
            look = turn.end() if close < 0 else close + 1
        if not turn:
            return
        at = turn.end()
        yield begin, at, m[1], m[2].lower(), source[m.end() : at - 1]


class Page:
    """Nodes as parallel lists, blocks of text in page order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.name, self.out, self.title = ["#"], [-1], [""], [False], [False]
        self.marked: dict[int, bool] = {}  # left out by a word of class or id alone; whether the word never names an article
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters in links
        self.text: list[str] = []
        self.link = 0
        self.linked = 0
        self.aside: dict[int, tuple[list[str], int]] = {}  # text before an element inside a block that is left out
        self.depths: dict[str, list[int]] = {}  # of the open elements of a tag
        self.blocks_at: list[int] = []  # depths of the open blocks
        self.key = [0]  # of the path of containers down to the node
        stack, endless = [0], set()  # tags of raw text without an end from here on
        at = 0
        for begin, end, slash, tag, attributes in marks(source):
            if begin < at:
                continue
            if begin > at:
                self.say(source[at:begin])
            at = end
            if not tag:
                continue
            if slash:
                self.close(tag, stack)
            else:
                self.open(tag, attributes, stack)
                if tag in RAW and not attributes.endswith("/") and tag not in endless:
                    close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
                    if not close:
                        endless.add(tag)
                    at = close.start() if close else len(source) if tag in ("script", "style") else at
        if at < len(source):
            self.say(source[at:])
        while len(stack) > 1:
            self.pop_to(len(stack) - 1, stack)
        self.flush(0)
        self.judge()

    def say(self, text: str) -> None:
        self.text.append(text)
        if self.link:
            self.linked += len(text)

    def flush(self, node: int) -> None:
        if self.text:
            text = " ".join(references.unescape("".join(self.text)).split())
            if text:
                self.blocks.append((node, text, min(self.linked, len(text))))
            self.text, self.linked = [], 0

    def pop_to(self, depth: int, stack: list[int]) -> None:
        self.pop_inline(depth + 1, stack)
        self.flush(stack[-1])
        self.pop_inline(depth, stack)

    def open(self, tag: str, attributes: str, stack: list[int]) -> None:
        if tag in SPACED:
            self.text.append(" ")
        if tag in VOID:
            if tag == "hr":
                self.flush(stack[-1])
            return
        ends, beyond = IMPLIED.get(tag, ((), ()))
        if tag in CLOSES_P:
            ends, beyond = {*ends, "p"}, {*beyond, "td", "th", "button", "div", "section", "article", "li", "body"} - {tag if tag == "li" else ""}
        if ends:
            wall = max((self.depths[t][-1] for t in beyond if self.depths.get(t)), default=0)
            open_ = [d[-1] for t in ends if t not in beyond and (d := self.depths.get(t)) and d[-1] > wall]
            if open_:  # a row ends its cell, and an item its paragraph, with the row or the item around
                depth = min(open_) if tag in ("tr", "li") else max(open_)
                self.pop_inline(depth, stack) if tag in SPACED else self.pop_to(depth, stack)
        if tag in BLOCKS:
            self.flush(stack[-1])
        elif tag == "a":
            self.link = 1
        parent, node = stack[-1], len(self.tag)
        name, out = tag, self.out[parent] or tag in RAW or tag in OUT_TAGS
        within = bool(self.depths.get("article") or self.depths.get("main"))
        if tag == "header" and not within:
            out = True
        if attributes and (tag in BLOCKS or not out):
            got = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
            classes = got.get("class", "").split()
            if not out and tag not in WHOLE:
                role = got.get("role", "").lower()
                style = got.get("style", "").replace(" ", "").lower()
                out = role in OUT_ROLES or "hidden" in got or got.get("aria-hidden") == "true" or "display:none" in style
                about = [c for c in classes if SUBJECT.match(c)] if tag == "article" or not all(SUBJECT.match(c) for c in classes) else []
                for label in (*(c for c in classes if c not in about), got.get("id", "")) if not out else ():
                    words = {w.lower() for w in WORDS.findall(label)}
                    if words & OUT_WORDS and not words & NOT_OUT or words & HEAD_WORDS and not words & (OWN_HEAD | NOT_OUT) and not within:
                        self.marked[len(self.tag)] = self.marked.get(len(self.tag), False) or not words.isdisjoint(NEVER_WORDS | HEAD_WORDS)
            if tag in CONTAINERS and classes:
                name += "." + ".".join(sorted(re.sub(r"[0-9]+|[-_][a-zA-Z]*[0-9][a-zA-Z0-9]*$", "", c) for c in classes))
        self.tag.append(tag)
        self.parent.append(parent)
        self.name.append(name)
        self.out.append(out)
        self.title.append(tag == "h1" and not out)
        own = tag in CONTAINERS and tag != "html"
        self.key.append(xxhash.xxh64_intdigest(name.encode(), self.key[parent]) if own else self.key[parent])
        self.depths.setdefault(tag, []).append(len(stack))
        if tag in BLOCKS:
            self.blocks_at.append(len(stack))
        stack.append(node)
        if (out and not self.out[parent] or node in self.marked) and tag not in BLOCKS:
            self.aside[node] = self.text, self.linked
            self.text, self.linked = [], 0

    def close(self, tag: str, stack: list[int]) -> None:
        if tag in VOID:
            return
        block, open_ = tag in BLOCKS, self.depths.get(tag)
        if open_ and (block or open_[-1] > (self.blocks_at[-1] if self.blocks_at else 0)):  # an inline end tag doesn't reach beyond its block
            self.pop_to(open_[-1], stack) if block else self.pop_inline(open_[-1], stack)
        elif block:
            self.flush(stack[-1])

    def pop_inline(self, depth: int, stack: list[int]) -> None:
        """Leaves elements without ending the block; the text before one that is left out goes on after it."""
        while len(stack) > depth:
            node = stack.pop()
            self.depths[self.tag[node]].pop()
            if self.tag[node] in BLOCKS:
                self.blocks_at.pop()
            if self.tag[node] == "a":
                self.link = 0
            if node in self.aside:
                self.flush(node)
                self.text, self.linked = self.aside.pop(node)

    def judge(self) -> None:
        """Leaves out what a word of class or id marks, but not a page's article or what holds it."""
        if not self.marked:
            return
        hard, kept, titles = self.out, *self.weigh()
        most = frozenset(i for i, never in self.marked.items() if not never and 2 * kept[i] > kept[0])
        for lift in (frozenset(), frozenset(i for i, never in self.marked.items() if not never), frozenset(self.marked)):
            free = set(lift | most)  # marked nodes that stay
            while True:
                self.out = list(hard)
                top = []  # of marked nodes, the outermost
                for node in range(1, len(self.tag)):
                    if self.out[self.parent[node]]:
                        self.out[node] = True
                    elif node in self.marked and node not in free and not self.out[node]:
                        self.out[node] = True
                        top.append(node)
                rest, left = self.weigh()
                articles = any(self.tag[i] == "article" and not self.out[i] and rest[i] for i in range(1, len(self.tag)))
                stay = [i for i in top if not self.marked[i] and self.tag[i] == "article" and not articles and not self.within(i)]
                if not left[0]:  # with all that hold the title
                    stay += [i for i, never in self.marked.items() if not never and i not in free and titles[i] and kept[i] > titles[i]]
                if not stay:
                    break
                free.update(stay)
            if rest[0]:
                break
        self.title = [t and not o for t, o in zip(self.title, self.out, strict=True)]

    def within(self, node: int) -> bool:
        while (node := self.parent[node]) > 0:
            if self.tag[node] == "article":
                return True
        return False

    def path(self, node: int) -> str:
        names = []
        while node > 0:
            if self.tag[node] in CONTAINERS and self.tag[node] != "html":
                names.append(self.name[node])
            node = self.parent[node]
        return ">".join(reversed(names))

    def weigh(self) -> tuple[list[int], list[int]]:
        """For each node: characters of running text in it, and h1 titles in it."""
        kept, titles = [0] * len(self.tag), [int(t and not o) for t, o in zip(self.title, self.out, strict=True)]
        for node, text, linked in self.blocks:
            if not self.out[node]:
                kept[node] += max(0, len(text) - (linked if linked < LINKED * len(text) else len(text)))
        for node in range(len(self.tag) - 1, 0, -1):
            kept[self.parent[node]] += kept[node]
            titles[self.parent[node]] += titles[node]
        return kept, titles

    def best(self, hold: float = 1.0) -> list[tuple[tuple[int, ...], float]]:
        """Containers (all on one path) that may hold the article, the likeliest first, with their scores; below the best lies `hold` of the text around."""
        kept, titles = self.weigh()
        if not kept[0]:
            return [((0,), 0.0)]
        children: dict[int, list[int]] = {}
        for node in range(1, len(self.tag)):
            if not self.out[node]:
                children.setdefault(self.parent[node], []).append(node)
        found = {}
        for weight, tags in ((1.0, ("article",)), (0.9, ("main",))):
            paths: dict[int, list[int]] = {}
            for i in range(1, len(self.tag)):
                if self.tag[i] in tags and kept[i] and not self.out[i]:
                    paths.setdefault(self.key[i], []).append(i)
            if paths:
                group, inside = max(((tuple(g), sum(kept[i] for i in g)) for g in paths.values()), key=lambda x: (x[1], -x[0][0]))
                if 2 * inside >= kept[0]:
                    found.setdefault(group, weight * inside / kept[0])
        node, group = 0, (0,)
        while True:  # down to the containers of one name that hold the text, unless a title would be lost
            names: dict[str, list[int]] = {}
            for i in children.get(node, ()):
                if kept[i] or titles[i]:
                    names.setdefault(self.name[i], []).append(i)
            below = [g for g in names.values() if sum(kept[i] for i in g) >= hold * kept[node] and (sum(titles[i] for i in g) == titles[node] or titles[node] > 1 and hold < 1)]
            if not below:
                break
            if len(below[0]) > 1:
                if self.tag[below[0][0]] in CONTAINERS:
                    group = tuple(below[0])
                break
            node = below[0][0]
            if self.tag[node] in CONTAINERS:
                group = (node,)
        found.setdefault(group, 0.8)
        return sorted(found.items(), key=lambda x: (-x[1], x[0]))

    def on(self, keys: list[int]) -> tuple[int, ...] | None:
        """All nodes on the first path that holds half of the running text."""
        found: dict[int, list[int]] = {key: [] for key in keys}
        for i in range(1, len(self.tag)):
            if not self.out[i] and self.key[i] in found and self.tag[i] in CONTAINERS and self.tag[i] != "html":
                found[self.key[i]].append(i)
        kept = self.weigh()[0]
        for key in keys:
            inside = sum(kept[i] for i in found[key])
            if inside and 2 * inside >= kept[0]:
                return tuple(found[key])
        return None

    def main_text(self, nodes: tuple[int, ...]) -> str:
        inside, tops = [False] * len(self.tag), set(nodes)
        for i in range(len(self.tag)):
            inside[i] = not self.out[i] and (i in tops or (i > 0 and inside[self.parent[i]]))
        return "\n".join(text for i, text, linked in self.blocks if inside[i])


def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        host, key, vote = [], [], []
        for h, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = Page(source or "")
            for one, score in {page.key[nodes[0]]: score for nodes, score in reversed(page.best(HOLDS))}.items():
                host.append(h)
                key.append(one - (1 << 64) if one >> 63 else one)
                vote.append(round(1000 * score))
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(key, pa.int64()), pa.array(vote, pa.int64())], ["host", "key", "vote"])


def extractor(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, used = [], []
            for source, paths in zip(batch.column("_html").to_pylist(), batch.column("_paths").to_pylist(), strict=True):
                page = Page(source or "")
                nodes = page.on([p % (1 << 64) for p in paths or ()])
                nodes = page.best()[0][0] if nodes is None else nodes
                texts.append(page.main_text(nodes))
                used.append(page.path(nodes[0]))
            out = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*out, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(used, pa.string())], [*keep, "text", "n_chars", "path"])

    return run


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), url_col: str = "url", html_col: str = "html") -> DataFrame:
    """keep, text, n_chars, path: one row a page."""
    common.bounded(pages)
    keep = list(keep)
    host = F.lower(F.regexp_replace(F.coalesce(F.regexp_extract(url_col, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)", 1), F.lit("")), r"^www\.", ""))
    rows = pages.select(*keep, host.alias("host"), F.col(html_col).alias("_html"))
    counted = rows.select("host", F.col("_html").alias("html")).mapInArrow(votes, "host string, key long, vote long")
    sums = counted.groupBy("host", "key").agg(F.sum("vote").alias("vote"), F.count(F.lit(1)).alias("voters"))
    # one page is no consensus; nor is, on a large host, one in a thousand, so a host has some thousand templates at most
    big = sums.groupBy("host").agg(F.sum("voters").alias("all"))
    won = sums.where("voters > 1").join(big, "host").where("voters * 1000 >= all").groupBy("host").agg(F.expr("transform(array_sort(collect_list(struct(-vote, key))), x -> x.key)").alias("_paths"))
    sizes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    hosts = common.checkpointed(sizes.join(won, "host", "left"))
    total = hosts.agg(F.sum("pages")).first()[0] or 0
    ready = common.lookup(rows, hosts, ["host"], "pages", total).select(*keep, "_html", "_paths")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema)
    return ready.mapInArrow(extractor(keep), f"{schema}, text string, n_chars long, path string")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
