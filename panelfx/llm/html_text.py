"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelfx.llm.texts import slices

# Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp", "template")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
# What they hold is not text of the page, or speaks of other things than its article.
NO_TEXT = frozenset("head button select option datalist object svg canvas".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
NOT_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form".split())
NOT_CONTENT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side-bar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice alert popup modal newsletter "
    "subscribe subscription signup share sharing social related recommended recommendations comment comments respond reply "
    "replies disqus discussion widget toolbar pagination pager login search skip".split()
)
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PUNCTUATION = frozenset(".,;:!?…。，、；：！？¿¡«»\"'()")
# An opening tag of the first kind closes an open element of the second.
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
}
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section summary table ul".split()
)
TEXT_BLOCKS = frozenset("p li td th pre dd dt h1 h2 h3 h4 h5 h6 blockquote figcaption caption".split())
# Their ids are anchors made from titles.
ANCHORS = TEXT_BLOCKS | INLINE | {"section"}
SCOPES = frozenset("html body table td th ul ol dl div article main section blockquote".split())

# An attribute: its name, and its value in double quotes, in single quotes or without; an open quote goes on to the end.
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
GAP = re.compile(r"[\s/]*")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
# Names such as with-sidebar speak of the layout and not of the element itself.
LAYOUT = frozenset("with has no without".split())
PAGE_HEADER = frozenset("header masthead banner title".split())
SPACE = re.compile(r"\s+")


@dataclass(frozen=True)
class RatioOptions:
    """How tag paths are judged; see path_scores.

    `radius` is the number of nodes smoothed over on either side, `length` and `pauses` the ratios at which
    they have half of their weight. The priors multiply a path's score: of text within articles (in
    proportion to their share of the page's text), of text blocks, of elements that a name calls
    boilerplate or may call it (`doubt`), and of elements whose role says so. A path is content if its score
    reaches `threshold` of the page's best one.
    """

    radius: int = 2
    length: float = 80.0
    pauses: float = 2.0
    article: float = 32.0
    block: float = 16.0
    doubt: float = 0.3
    name: float = 1e-3
    role: float = 1e-6
    threshold: float = 0.04


# What an element's attributes say: nothing, perhaps not content, not content by name, by role, or not shown at all.
KEEP, DOUBT, DROP, ROLE, HIDE = range(5)


def marks(tag: str, attributes: list[tuple[str, str]], within: bool) -> int:
    """What an element's class, id, role or visibility says about it.

    Within an article, names of page headers do not count. There ids of headings, sections, text blocks
    and inline elements are not looked at and other ids leave a doubt; classes of headings, sections and
    text blocks have to be a name as a whole, part of one leaves a doubt (on headings, nothing). Ids of
    headings are not looked at anywhere.
    """
    said = KEEP
    for name, value in attributes:
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return HIDE
        if name == "style" and HIDDEN.search(value):
            return HIDE
        if name == "role" and value.lower() in NOT_CONTENT_ROLES:
            said = max(said, ROLE)
        if name == "id" and tag in (ANCHORS if within else HEADINGS):
            continue
        if name in ("class", "id"):
            for one in value.split():
                parts = [p.lower() for p in NAME_PART.findall(one)]
                if parts and parts[0] not in LAYOUT:
                    named = NOT_CONTENT_WORDS.intersection([*parts, one.lower()])
                    if within:
                        named = named - PAGE_HEADER
                    if not named:
                        continue
                    if not within or (name == "class" and (tag not in ANCHORS - INLINE or one.lower() in named)):
                        said = max(said, DROP)
                    elif tag not in HEADINGS:
                        said = max(said, DOUBT)
    return said


@dataclass
class Paths:
    """The tag paths of a page, each as its last element and the path above it.

    Elements whose marks differ are different paths, so that a marked element does not share its
    ratios with an unmarked one of the same tags. Inline elements leave the path as it is.
    """

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: [""])
    mark: list[int] = field(default_factory=lambda: [KEEP])
    within: list[bool] = field(default_factory=lambda: [False])
    number: dict[tuple[int, str, int], int] = field(default_factory=dict)

    def below(self, path: int, tag: str, mark: int) -> int:
        found = self.number.get((path, tag, mark))
        if found is None:
            found = self.number[path, tag, mark] = len(self.tag)
            self.parent.append(path)
            self.tag.append(tag)
            self.mark.append(max(mark, self.mark[path]))
            self.within.append(self.within[path] or tag in CONTENT)
        return found


@dataclass
class Node:
    """The text of one block, its path, and how many of its characters are links."""

    path: int
    block: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


class Page:
    """Reads a page into text nodes in one pass: every character is looked at a bounded number of times.

    Open elements are a stack; for each tag, for blocks and for scopes their places on it are kept, so an end
    tag finds its element without a search, however deep the page is nested.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.paths = Paths()
        self.nodes: list[Node] = []
        self.stack: list[tuple[str, int]] = []  # element and path
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.scopes: list[int] = []
        self.hidden = 0
        self.links = 0
        self.block = 0
        self.hiding: list[bool] = []
        self.read()
        for node in self.nodes:
            node.text = SPACE.sub(" ", "".join(node.parts)).strip()
        self.nodes = [node for node in self.nodes if node.text]

    def say(self, text: str) -> None:
        if not text or self.hidden:
            return
        path = self.stack[-1][1] if self.stack else 0
        if not self.nodes or self.nodes[-1].block != self.block or self.nodes[-1].path != path:
            # a marked inline element is a node of its own, and the block goes on after it
            self.nodes.append(Node(path, self.block))
        text = html.unescape(text)
        self.nodes[-1].parts.append(text)
        if self.links:
            self.nodes[-1].linked += len(text)

    def push(self, tag: str, path: int, hide: bool) -> None:
        at = len(self.stack)
        self.stack.append((tag, path))
        self.hiding.append(hide)
        self.places.setdefault(tag, []).append(at)
        if tag not in INLINE:
            self.blocks.append(at)
        if tag in SCOPES:
            self.scopes.append(at)
        self.hidden += hide
        self.links += tag == "a"

    def pop_to(self, depth: int) -> None:
        """End all open elements from this place of the stack on."""
        while len(self.stack) > depth:
            tag, _ = self.stack.pop()
            self.hidden -= self.hiding.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.blocks.pop()
            if tag in SCOPES:
                self.scopes.pop()
            self.links -= tag == "a"

    def last(self, tag: str) -> int:
        found = self.places.get(tag)
        return found[-1] if found else -1

    def end(self, tag: str) -> None:
        depth = self.last(tag)
        if tag in INLINE:
            # a misnested inline end does not close the block around it
            if depth >= 0 and depth > (self.blocks[-1] if self.blocks else -1):
                self.pop_to(depth)
            return
        if depth >= 0:
            self.pop_to(depth)
        self.block += 1

    def close(self, ends: frozenset[str]) -> None:
        """End the innermost open element of these kinds, unless the scope around it is reached first."""
        depth = max(map(self.last, ends))
        if depth >= 0 and depth >= (self.scopes[-1] if self.scopes else -1):
            self.pop_to(depth)

    def attributes(self, at: int) -> tuple[list[tuple[str, str]], int]:
        """Attributes from here on, and the place after the tag; -1 where the page ends within the tag."""
        found: list[tuple[str, str]] = []
        while True:
            at = GAP.match(self.page, at).end()
            if at >= len(self.page):
                return found, -1
            if self.page[at] == ">":
                return found, at + 1
            one = ATTRIBUTE.match(self.page, at)
            found.append((one[1].lower(), html.unescape(next((v for v in one.groups()[1:] if v is not None), ""))))
            at = one.end()

    def start(self, tag: str, attributes: list[tuple[str, str]], at: int) -> int:
        """Open an element; returns the place to go on at, which is after the element if its content is no markup."""
        if tag == "br":
            self.say(" ")
            return at
        if tag in CLOSES:
            self.close(CLOSES[tag])
        elif tag in CLOSES_P:
            self.close(frozenset(["p"]))
        if tag not in INLINE:
            self.block += 1
        if tag in VOID:
            return at
        if tag in RAW:
            found = re.compile(f"</{re.escape(tag)}[^>]*(?:>|\\Z)", re.I | re.A).search(self.page, at)
            return found.end() if found else len(self.page)
        path = self.stack[-1][1] if self.stack else 0
        within = self.paths.within[path]
        said = marks(tag, attributes, within) if attributes and tag not in ("html", "body", "main") else KEEP
        if tag in BOILERPLATE or (tag == "header" and not within):
            said = max(said, ROLE)
        if tag not in INLINE or said != KEEP:
            path = self.paths.below(path, tag, said)
        self.push(tag, path, said == HIDE or tag in NO_TEXT)
        return at

    def read(self) -> None:
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            begin = page.find("<", at)
            if begin < 0:
                self.say(page[at:])
                return
            after = page[begin + 1 : begin + 2]
            closing = after == "/"
            name = NAME.match(page, begin + 1 + closing)
            if name is None and after not in ("!", "?", "/"):
                # a sign, not a tag
                self.say(page[at : begin + 1])
                at = begin + 1
                continue
            self.say(page[at:begin])
            if name is None:
                mark, skip = ("-->", 4) if page.startswith("<!--", begin) else ("]]>", 9) if page.startswith("<![CDATA[", begin) else (">", 1)
                found = page.find(mark, begin + skip)
                at = n if found < 0 else found + len(mark)
                continue
            attributes, at = self.attributes(name.end())
            if at < 0:
                return
            if closing:
                self.end(name[0].lower())
            else:
                at = self.start(name[0].lower(), attributes, at)


def smooth(values: np.ndarray, radius: int) -> np.ndarray:
    """Weighted mean with a Gaussian of the neighbours on either side."""
    if not len(values) or radius < 1:
        return values
    reach = np.arange(-radius, radius + 1)
    weight = np.exp(-0.5 * (reach / max(radius / 2, 0.5)) ** 2)
    total = np.convolve(values, weight, "full")[radius : radius + len(values)]
    return total / np.convolve(np.ones(len(values)), weight, "full")[radius : radius + len(values)]


def path_scores(nodes: list[Node], paths: Paths, options: RatioOptions) -> np.ndarray:
    """The score of every tag path of a page.

    Length of text outside links and punctuation are added up per path over all its nodes and divided by
    their number. Both ratios are brought to 0 to 1 (long texts differ little) and fused to
    `length * (1 + 3 * punctuation)`; given back to the nodes, the fused ratio is smoothed in page order, and
    the geometric mean of the two, averaged over a path's nodes, is what the path's text says. It is
    multiplied by the path's priors and by the square of the share of its text outside links.
    """
    path = np.array([n.path for n in nodes])
    size = np.array([len(n.text) for n in nodes], float)
    linked = np.minimum([n.linked for n in nodes], size)
    pauses = np.array([sum(map(n.text.count, PUNCTUATION)) for n in nodes], float)
    many = len(paths.tag)
    count = np.maximum(np.bincount(path, minlength=many), 1)
    total = np.bincount(path, size, many)
    plain = np.bincount(path, size - linked, many)
    length, pause = plain / count, np.bincount(path, pauses, many) / count
    own = length / (length + options.length) * (1.0 + 3.0 * pause / (pause + options.pauses))
    spread = smooth(own[path], options.radius)
    says = np.bincount(path, np.sqrt(own[path] * spread), many) / count
    within, mark = np.array(paths.within), np.array(paths.mark)
    seen = total * (mark < DROP)
    share = seen[within].sum() / max(seen.sum(), 1.0)
    prior = np.where(within, 1.0 + (options.article - 1.0) * share, 1.0)
    prior = prior * np.where([t in TEXT_BLOCKS for t in paths.tag], options.block, 1.0)
    prior = prior * np.array([1.0, options.doubt, options.name, options.role, 0.0])[mark]
    return says * prior * (plain / np.maximum(total, 1.0)) ** 2


def content_nodes(page: Page, options: RatioOptions) -> list[Node]:
    """The nodes whose path reaches the threshold, in page order."""
    if not page.nodes:
        return []
    scores = path_scores(page.nodes, page.paths, options)
    cut = options.threshold * scores.max()
    return [node for node in page.nodes if scores[node.path] >= cut and scores[node.path] > 0]


def main_text(page: str, options: RatioOptions = RatioOptions()) -> str:
    """Blocks of the main text, in page order, joined by an empty line.

    What remains of a block around a dropped inline element is one block.
    """
    blocks: dict[int, list[str]] = {}
    for node in content_nodes(Page(page), options):
        blocks.setdefault(node.block, []).extend(node.parts)
    return "\n\n".join(SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())


def extract_text(pages: DataFrame, options: RatioOptions = RatioOptions(), source: str = "html") -> DataFrame:
    """`pages` with columns text and n_chars (its code points); the page itself is left out.

    One pass without a shuffle, page by page and whole pages. A null or empty page, and one without
    content, gives an empty text. All rows are kept, repeated ones too; columns named text or n_chars
    are replaced.
    """
    kept = [c for c in pages.columns if c not in (source, "text", "n_chars")]
    read = pages.select(*kept, source)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, source):
                texts = [main_text(page or "", options) for page in part.column(source).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    [*kept, "text", "n_chars"],
                )

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in read.schema.fields if f.name != source)
    return read.mapInArrow(extract, f"{schema}text string, n_chars bigint")
