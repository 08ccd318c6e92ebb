"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of element paths, branches with the
names of boilerplate included. Each path has its presentation (the sequences of child
elements it has on the pages) and its content (the texts right in it). Entropies over
the host's pages give importances: a path that looks and reads the same everywhere has
little. A branch is removed from each page if its path and all paths below it have
little. Only what HTML itself declares to be something else (menus, forms, hidden
elements ...) has no importance to begin with and is not merged.

Names are a prior. A whole class or id of a known name takes its branch, a part of a
longer name does so too, unless the branch holds most of the page. Inside an article or
the main part, a part of a name counts only where the tree shows the path to belong to
the host's template. A branch inside an ``article`` has that article's weight: it goes
only under half of the threshold, and only as long as a quarter of the articles' text stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import full_text
from tracewright.llm.hosts import host_of
from tracewright.scale import broadcast_if_small, checkpoint

TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|[!?/][^>]*>?)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template svg".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr "
    "math mi mo mn ms mtext mspace mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded "
    "mfenced menclose semantics annotation".split())
# Without importance by tag, role or name. A page's own header goes; an article's stays.
DROPPED = frozenset("head nav footer aside form button select option menu dialog object canvas audio video fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar "
    "navigation topnav subnav breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended recommendations comment comments disqus respond replies pagination pager widget widgets toolbar skip".split())
# Inside an article or the main part a name counts only as a whole class, or a whole id of these.
WHOLE_CLASSES = NAMES | frozenset(
    "related-posts related-articles related-links share-buttons share-bar social-share social-links ad-slot ad-container "
    "ad-banner ad-unit cookie-banner cookie-notice newsletter-signup comment-list comments-area post-comments post-navigation".split())
WHOLE_IDS = frozenset("comments disqus disqus_thread respond sidebar breadcrumb breadcrumbs newsletter-signup cookie-banner".split())
WORDING = frozenset("h1 h2 h3 h4 h5 h6 p".split())
COMMENTS = frozenset("comment comments disqus respond replies".split())
# Inside an article or the main part these count as parts of a longer name, if the path is one of the template.
SUSPECT = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion newsletter subscribe signup "
    "share sharing recommended recommendations stories".split())
INLINE_NAMES = frozenset("ad ads advert advertisement sponsored skip skip-link skip-to-content breadcrumb".split())
MARKED = re.compile(r"hidden|style|class|role", re.I)  # attributes by which an inline element may go
LANDMARKS = {"main": 1, "article": 2}

GAMMA = 0.9  # how fast many children make presentation count
THRESHOLD = 0.2  # importance under which a branch goes
IN_ARTICLE = 0.5  # of the threshold, for a branch inside an article
MIN_PAGES = 8  # of a host that have a path, before it is judged
LEAST_SHARE = 0.25  # of the important text, to be the landmark that holds the main text; of the articles' text, to stay
MAX_DEPTH = 64  # of a path; an element further down has the path of its ancestor there, so no page costs more than its length
MAX_NAMED = 16  # named branches that are told apart around a text, from the outside


@dataclass
class Node:
    tag: str
    ups: tuple[int, ...]  # hashes of the paths from the root to this element
    dropped: bool
    level: int  # 2 in an article, 1 in the main part, else 0
    named: tuple[int, ...] = ()  # branches around it that bear a name of boilerplate
    inside: int = 0  # how many of ups lead to the article


@dataclass
class Block:
    ups: tuple[int, ...]
    text: str
    level: int
    named: tuple[int, ...]
    inside: int


@dataclass
class Path:
    ups: tuple[int, ...]
    judged: bool  # html and body are not
    inside: bool  # below an article
    suspect: bool
    children: list[str]


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), unescape(a or b or c))
    return found


def _label(tag: str, attributes: dict[str, str]) -> str:
    """Tag with id and classes, numbers made alike, so that pages of one template agree."""
    names = attributes.get("class", "").split()
    label = tag + ("#" + attributes["id"] if attributes.get("id") else "") + "".join("." + n for n in sorted(names))
    return re.sub(r"\d+", "0", label.replace(">", ""))


def _declared(tag: str, attributes: dict[str, str], level: int) -> bool:
    """Whether HTML itself says that the element is no part of the text."""
    if tag in DROPPED or (tag == "header" and not level):
        return True
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    return attributes.get("role", "").lower() in ROLES or bool(re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I))


NO_NAME, SUSPECTED, PART, WHOLE = range(4)


def _name(tag: str, attributes: dict[str, str], level: int) -> int:
    """How much the class and the id of an element speak for boilerplate."""
    if tag in ("html", "body"):
        return NO_NAME
    classes, own_id = attributes.get("class", "").lower(), attributes.get("id", "").lower()
    if tag in WORDING:
        if level:
            return NO_NAME
        own_id = ""  # often made from the text of the heading
    whole, parts = set(classes.split()), set(re.split(r"[^a-z0-9]+", f"{classes} {own_id}"))
    if level and tag not in LANDMARKS:
        if own_id in WHOLE_IDS or not WHOLE_CLASSES.isdisjoint(whole):
            return WHOLE
        return NO_NAME if parts.isdisjoint(SUSPECT) else SUSPECTED
    names = COMMENTS if tag in LANDMARKS else NAMES
    if not names.isdisjoint(whole | {own_id}):
        return WHOLE
    return NO_NAME if parts.isdisjoint(names) else PART


class Page:
    """Blocks of a page in order, and its paths with the child elements they have there."""

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.paths: dict[int, Path] = {}
        self.names: list[int] = []
        self.stack: list[Node] = [Node("", (), False, 0)]
        self.said: list[str] = []
        self.svg_ends: dict[int, int] = {}
        self.svg_read = 0
        at, end = 0, len(html)
        while at < end:
            m = TAG.search(html, at)
            if not m:
                break
            self._text(html[at: m.start()])
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if m[1]:
                    self._close(tag)
                elif tag == "svg":
                    at = self._after_svg(html, m)
                elif tag in RAW:
                    shut = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                    at = shut.end() if shut else end
                elif tag == "math" and (m[3] or "").endswith("/"):
                    pass
                else:
                    self._open(tag, m[3] or "")
        if at < end:
            self._text(html[at:])
        self._flush()

    def _after_svg(self, html: str, m: re.Match[str]) -> int:
        """Where the text goes on behind an svg start tag: behind its own end, or behind the tag if it has none.

        The ends of all svg elements from here on are found in one go. Scripts may hide
        tags from a later start; then they are looked for again, but in four times the
        length of the page at most.
        """
        start = m.end()
        if (m[3] or "").endswith("/"):
            return start
        if start not in self.svg_ends and self.svg_read <= 4 * len(html):
            self.svg_read += len(html) - start
            ends, open_at = {start: start}, [start]
            for t in TAG.finditer(html, start):
                if t[2] and t[2].lower() == "svg" and not (t[3] or "").endswith("/"):
                    if not t[1]:
                        open_at.append(t.end())
                        ends[t.end()] = t.end()
                    elif open_at:
                        ends[open_at.pop()] = t.end()
            self.svg_ends = ends
        return self.svg_ends.get(start, start)

    def _text(self, text: str) -> None:
        if text and not self.stack[-1].dropped:
            self.said.append(text)

    def _flush(self) -> None:
        if self.said:
            text = " ".join(unescape("".join(self.said)).split())
            self.said = []
            if text:
                top = next(n for n in reversed(self.stack) if n.tag not in INLINE)
                self.blocks.append(Block(top.ups, text, top.level, top.named, top.inside))

    def _open(self, tag: str, raw: str) -> None:
        if tag == "br":
            self.said.append(" ")
            return
        if tag in ("td", "th"):
            self._pop_to(tag, ("tr", "table"))
            self.said.append(" ")
        elif tag not in INLINE:
            self._flush()
            if tag in ("li", "dd", "dt", "tr", "option"):
                self._pop_to(tag, ("ul", "ol", "dl", "table"))
            else:
                self._pop_to("p", ("article", "section", "div", "td", "li", "main", "body"))
        if tag in VOID:
            return
        top = self.stack[-1]
        attributes = _attributes(raw) if raw and (tag not in INLINE or MARKED.search(raw)) else {}
        if tag in INLINE:
            gone = bool(attributes) and (
                _declared(tag, attributes, 1) or not INLINE_NAMES.isdisjoint(attributes.get("class", "").lower().split()))
            self.stack.append(Node(tag, top.ups, top.dropped or gone, top.level, top.named, top.inside))
            return
        own = LANDMARKS.get(tag, 1 if attributes.get("role", "").lower() == "main" else 0)
        level = max(top.level, own)
        gone = _declared(tag, attributes, level)
        name = _name(tag, attributes, level)
        # A wrapper named after its sidebar is no reason to lose the article in it.
        wrapped = own and not gone and all(n.tag not in DROPPED for n in self.stack)
        dropped = gone or (top.dropped and not wrapped)
        named = () if wrapped else top.named
        if name in (PART, WHOLE) and len(named) < MAX_NAMED:
            self.names.append(name)
            named = (*named, len(self.names) - 1)
        ups, inside = top.ups, top.inside
        if not dropped and len(ups) < MAX_DEPTH:
            label = _label(tag, attributes)
            path = _hash(f"{ups[-1] if ups else ''}>{label}")
            if ups:
                self.paths[ups[-1]].children.append(label)
            ups = (*ups, path)
            if path not in self.paths:
                self.paths[path] = Path(ups, tag not in ("html", "body"), top.inside > 0, name == SUSPECTED, [])
        if tag == "article" and not inside:
            inside = len(ups)
        self.stack.append(Node(tag, ups, dropped, level, named, inside))

    def _pop_to(self, tag: str, limits: tuple[str, ...]) -> None:
        """Closes an open ``tag`` whose end is implied, not beyond the limits."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return
            if self.stack[i].tag in limits:
                return

    def _close(self, tag: str) -> None:
        if tag == "br" or tag in VOID:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                if tag not in INLINE and tag not in ("td", "th"):
                    self._flush()
                del self.stack[i:]
                return
            if tag in INLINE and self.stack[i].tag not in INLINE:
                return  # an inline end does not close blocks

    def _named(self) -> set[int]:
        """Named branches that go: all, but not those that the page is made of.

        With text in an article or the main part outside of them, all go. Else one that
        bears a name only in part stays if it holds most of the text, and one with a
        whole name if nothing else is left.
        """
        gone = set(range(len(self.names)))
        free = [b for b in self.blocks if not b.named]
        if not gone or any(b.level for b in free):
            return gone
        for kind, blocks in ((PART, [b for b in self.blocks if all(self.names[k] == PART for k in b.named)]), (WHOLE, self.blocks)):
            if kind == WHOLE and any(gone.isdisjoint(b.named) for b in blocks):
                break
            held: dict[int, int] = {}
            for b in blocks:
                for k in b.named:
                    held[k] = held.get(k, 0) + len(b.text)
            gone -= {k for k, n in held.items() if 2 * n > _size(blocks)}
        return gone

    def main_text(self, low: frozenset[int] = frozenset()) -> str:
        """Important blocks of the articles, else of the main part, else of the body.

        A landmark is passed over if it holds less than a quarter of the important text.
        """
        gone = self._named()
        blocks = [b for b in self.blocks if gone.isdisjoint(b.named)]
        kept = [b for b in blocks if not _under(b, low)]
        inside = [b for b in blocks if b.level == 2]
        if _size(b for b in kept if b.level == 2) < LEAST_SHARE * _size(inside):
            kept = [b for b in blocks if b.level == 2 or not _under(b, low)]
        for level in (2, 1):
            part = [b for b in kept if b.level >= level]
            if part and _size(part) >= LEAST_SHARE * _size(kept):
                kept = part
                break
        return "\n\n".join(b.text for b in kept)


def _size(blocks: Iterable[Block]) -> int:
    return sum(len(b.text) for b in blocks)


def _under(block: Block, low: frozenset[int]) -> bool:
    """Whether a branch around the block is low; in an article, only a branch within it counts."""
    return bool(low) and not low.isdisjoint(block.ups[block.inside if block.level == 2 else 0:])


Feature = tuple[int, list[int], bool, bool, bool, int, int, list[int]]


def _features(html: str) -> list[Feature]:
    """(path, paths down to it, judged, inside, suspect, hash of its presentation, children, hashes of its own texts) per path.

    Runs of like children count once, so that longer pages look alike.
    """
    page = Page(html)
    texts: dict[int, set[int]] = {}
    for b in page.blocks:
        if b.ups:
            texts.setdefault(b.ups[-1], set()).add(_hash(b.text))
    out = []
    for path, p in page.paths.items():
        runs = [x for i, x in enumerate(p.children) if not i or p.children[i - 1] != x]
        out.append((path, list(p.ups), p.judged, p.inside, p.suspect, _hash("\n".join(runs)), len(runs), sorted(texts.get(path, ()))))
    return out


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def page_paths(pages: DataFrame) -> DataFrame:
    """host, page (digest of the html) and the features of each path of each page."""
    shape = ("host string, page string, path long, ups array<long>, judged boolean, inside boolean, suspect boolean, "
             "style long, children int, texts array<long>")
    kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.bool_(), pa.bool_(),
             pa.int64(), pa.int32(), pa.list_(pa.int64()))
    names = [part.split()[0] for part in shape.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 512):
                part = b.slice(low, 512)
                rows = [(host, page, *f) for host, html, page in zip(*(c.to_pylist() for c in part.columns)) for f in _features(html)]
                if rows:
                    columns = [list(c) for c in zip(*rows)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return pages.select("host", "html", F.md5("html").alias("page")).mapInArrow(run, shape)


def style_tree(found: DataFrame) -> DataFrame:
    """host, path, ups, judged, inside, suspect, pages, presentation, content, importance from the paths of pages.

    presentation: entropy of the child sequences of a path, to the base of the pages
    that have it. content: mean over the texts of the whole branch of one minus the
    entropy of a text over these pages. importance weighs them by the number of
    children, as the composite importance of a style tree does. Counts are combined
    before they are shuffled, so a hot host is spread over its paths and texts.
    """
    styles = found.groupBy("host", "path", "style").agg(
        F.count("*").alias("n"), F.sum("children").alias("c"), F.max("ups").alias("ups"), F.max("judged").alias("judged"),
        F.max("inside").alias("inside"), F.max("suspect").alias("suspect"))
    looks = styles.groupBy("host", "path").agg(
        F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.sum("c").alias("c"), F.max("ups").alias("ups"),
        F.max("judged").alias("judged"), F.max("inside").alias("inside"), F.max("suspect").alias("suspect"))
    texts = found.select("host", "path", F.explode("texts").alias("text")).groupBy("host", "path", "text").agg(F.count("*").alias("n"))
    reads = texts.groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("t"))
    # Each path's texts also count for the branches above it.
    own = looks.select(F.col("host").alias("h"), F.col("path").alias("p"), "ups")
    reads = reads.join(own, F.col("host").eqNullSafe(F.col("h")) & (F.col("path") == F.col("p")))
    reads = reads.select("host", F.explode("ups").alias("path"), "n", "t").groupBy("host", "path").agg(
        F.sum("n").alias("texts"), F.sum("t").alias("t"))
    reads = reads.withColumnsRenamed({"host": "h", "path": "p"})
    tree = looks.join(reads, F.col("host").eqNullSafe(F.col("h")) & (F.col("path") == F.col("p")), "left")
    n = F.col("pages")
    base = F.log(F.greatest(n, F.lit(2)))
    share = F.pow(F.lit(GAMMA), F.col("c") / n)
    tree = tree.select(
        "host", "path", "ups", "judged", "inside", "suspect", "pages",
        ((F.log(n) - F.col("nlogn") / n) / base).alias("presentation"),
        F.coalesce(1 - F.col("t") / F.col("texts") / base, F.lit(0.0)).alias("content"),
        F.col("texts").isNotNull().alias("says"), share.alias("share"),
    )
    comp = (1 - F.col("share")) * F.col("presentation") + F.col("share") * F.col("content")
    return tree.select(*[c for c in tree.columns if c != "share"], comp.alias("importance"))


def low_paths(tree: DataFrame) -> DataFrame:
    """host, path of the branches to remove: low themselves, without anything important below them.

    A path is judged if ``MIN_PAGES`` pages of the host have it; a path on fewer is
    important if it holds text. A suspect name inside an article or the main part is
    low as soon as it is judged: so many pages have it that it belongs to the template.
    """
    many = F.col("judged") & (F.col("pages") >= MIN_PAGES)
    bound = F.when(F.col("inside"), THRESHOLD * IN_ARTICLE).otherwise(THRESHOLD)
    low = many & (F.col("suspect") | (F.col("importance") < bound))
    told = tree.select("host", "path", "ups", "suspect", low.alias("low"), (~low & F.col("says")).alias("important"))
    above = told.where("important").select(
        F.col("host").alias("h"), F.explode(F.slice("ups", 1, F.greatest(F.size("ups") - 1, F.lit(0)))).alias("p")).distinct()
    met = told.where("low").join(above, F.col("host").eqNullSafe(F.col("h")) & (F.col("path") == F.col("p")), "left")
    return met.where(F.col("suspect") | F.col("p").isNull()).select("host", "path")


def main_texts(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """All rows and columns of ``pages`` but the html, with ``text`` and ``n_chars`` of the main text.

    An own text or n_chars column is overwritten. Null or empty html gives empty text;
    a null url is a host of its own; repeated rows count as pages and get the same
    text; pages of any length and depth are read whole. An empty table gives an empty one.

    A path is judged if eight pages of the host or more have it. The low paths are joined
    to the paths of the pages and gathered per page, so no list is longer than a page
    has paths, however many the host has.
    """
    rows = pages.select(F.struct("*").alias("page"), host_of(pages[url_col].cast("string")).alias("host"), full_text(pages[html_col]).alias("html"))
    found = checkpoint(page_paths(rows.select("host", "html")))
    low = checkpoint(low_paths(checkpoint(style_tree(found))).toDF("low_host", "low_path"))
    low = broadcast_if_small(low, max_bytes=8 << 20)
    met = found.select("host", "page", "path").join(low, F.col("host").eqNullSafe(F.col("low_host")) & (F.col("path") == F.col("low_path")))
    met = checkpoint(met.groupBy(F.col("host").alias("low_host"), F.col("page").alias("digest")).agg(F.sort_array(F.collect_set("path")).alias("low")))
    met = broadcast_if_small(met, max_bytes=8 << 20)
    joined = rows.join(met, F.col("host").eqNullSafe(F.col("low_host")) & (F.md5("html") == F.col("digest")), "left").select("page", "html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 512):
                part = b.slice(start, 512)
                found = [Page(h).main_text(frozenset(l or ())) for h, l in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(found, pa.string())], ["page", "main"])

    kept = joined.select(F.struct(*[F.col("page")[c].alias(c) for c in pages.columns if c != html_col]).alias("page"), "html", "low")
    out = kept.mapInArrow(run, kept.select("page").schema.add("main", "string"))
    row = F.col("page").withField("text", F.col("main")).withField("n_chars", F.char_length("main").cast("long"))
    return out.select(row.alias("page")).select("page.*")
