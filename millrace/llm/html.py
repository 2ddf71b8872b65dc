"""HTML extraction: flat text blocks, word count and link density of neighbours, a small decision tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of the HTML standard and usual names of page parts.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre section summary table tbody td tfoot th thead title tr ul".split()
)
SILENT_TAGS = frozenset("script style noscript template svg iframe canvas select button textarea head title audio video map datalist".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
FRAME_TAGS = frozenset("nav footer aside header form menu dialog address".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A tag that closes an open one of these kinds: the standard's optional end tags.
IMPLIED_END = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"),
}
_FRAME_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|"
    r"menu\w*|nav\w*|breadcrumbs?|pagination|pager|toc|sidebar\w*|side|aside|widget\w*|footer\w*|foot|header|masthead|topbar|toolbar|"
    r"share\w*|sharing|social\w*|follow|related\w*|recommend\w*|newsletter|subscribe\w*|signup|login|search\w*|form|"
    r"comments?|comment-\w+|commentlist|respond|reply|replies|discussion|disqus\w*|copyright|legal|skip|hidden|tags|metadata|byline)(?=$|[\s_-])", re.I)
#: Names that say outright what the contract leaves out: menus, headers, footers, sidebars, notices, adverts, forms, comments. A class or
#: an id counts as a whole, with usual additions; names that only hold such a word (``_FRAME_NAME``) are left to the tree.
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_OUTRIGHT = re.compile(
    r"(?:(?:site|page|main|top|global|post|entry|article|user|reader|left|right)[_-]?)?"
    r"(?:ads?|adsense|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice\w*|popup|modal|menu\w*|nav\w*|breadcrumbs?|pagination|sidebar\w*|"
    r"footer\w*|header|masthead|topbar|toolbar|share\w*|sharing|social\w*|newsletter|subscribe\w*|signup|login|comments?|commentlist|disqus\w*|copyright|form)"
    r"(?:[_-]?(?:container|wrapper|wrap|box|block|bar|list|section|area|links?|buttons?|banner|notice|top|bottom|left|right|inner|form|menu|nav|widget|item|body|text|author|meta|\d+))*", re.I)
_MAIN_NAME = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main|body|entry\w*|post|post-body|post-content|story\w*|text)(?=$|[\s_-])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_NAME = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_FRAME_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

FEATURES = ("words", "links", "before_words", "before_links", "after_words", "after_links", "frame", "named", "outside", "inside", "heading")


@dataclass
class Block:
    """One flat block: text, its share of linked words, and what encloses it."""

    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    frame: bool = False
    named: bool = False
    inside: bool = False
    heading: bool = False

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order; scripts, styles, comments and markup hold none.

    Markup may be broken: an end tag closes up to its latest start, or nothing; open tags end with the page.
    """
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # tag, frame, named, inside, silent
    current: Block | None = None
    links = 0

    def flush() -> None:
        nonlocal current
        if current is not None and current.text:
            out.append(current)
        current = None

    def say(raw: str) -> None:
        nonlocal current
        if not raw or (stack and stack[-1][4]):
            return
        if current is None:
            frame, named, inside = stack[-1][1:4] if stack else (False, False, False)
            current = Block(frame=frame, named=named, inside=inside, heading=any(t[0] in _HEADINGS for t in stack[-3:]))
        text = html.unescape(raw) if "&" in raw else raw
        current.parts.append(text)
        if links:
            current.linked.append(text)

    def close(tag: str) -> None:
        nonlocal links
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                links -= sum(t[0] == "a" for t in stack[i:])
                del stack[i:]
                return

    def pop_implied(kinds: tuple[str, ...]) -> None:
        """End open elements of these kinds, as far as the nearest other block."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in kinds:
                close(stack[i][0])
                return
            if stack[i][0] in BLOCK_TAGS:
                return

    pos, size = 0, len(page)
    while pos < size:
        m = _TOKEN.search(page, pos)
        if not m:
            say(page[pos:])
            break
        say(page[pos:m.start()])
        pos = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK_TAGS:
                flush()
            close(tag)
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
            pop_implied(IMPLIED_END.get(tag, ("p",)))
        if tag in VOID_TAGS or m[3].rstrip().endswith("/") and tag not in BLOCK_TAGS and tag != "a":
            continue
        frame, named, inside, silent = stack[-1][1:] if stack else (False, False, False, False)
        # Only a block element says what its text is for; a link's class or a heading's id doesn't.
        if tag in BLOCK_TAGS and tag not in _HEADINGS:
            names = {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(m[3])}
            own = [*names.get("class", "").split(), *names.get("id", "").split()] if tag not in ("html", "body") else []
            role = names.get("role", "").lower()
            main = tag in ("article", "main") or role in ("main", "article")
            if not main:
                if inside:
                    own = [n for n in own if not n.lower().endswith("header")]
                frame = frame or (tag in FRAME_TAGS and not (tag == "header" and inside)) or role in _FRAME_ROLE or any(map(_OUTRIGHT.fullmatch, own))
                named = named or any(map(_FRAME_NAME.search, own))
            inside = inside or main or any(map(_MAIN_NAME.search, own))
        silent = silent or tag in SILENT_TAGS or any(k.lower() == "hidden" for k in _NAME.findall(m[3]))
        if tag in RAW_TAGS:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, pos)
            pos = end.end() if end else size
            if tag in BLOCK_TAGS:
                flush()
            continue
        stack.append((tag, frame, named, inside, silent))
        links += tag == "a"
    flush()
    return out


def describe(found: list[Block]) -> np.ndarray:
    """The features of a page's blocks: own and neighbours' word counts and link densities, enclosure."""
    n = len(found)
    words = np.array([len(b.text.split()) for b in found], float)
    linked = np.array([len("".join(b.linked).split()) for b in found], float)
    density = np.minimum(linked / np.maximum(words, 1), 1)
    side = lambda x, k: np.concatenate([[0.0], x[:-1]]) if k < 0 else np.concatenate([x[1:], [0.0]])
    marked = any(b.inside for b in found)
    flags = np.array([(b.frame, b.named and not b.frame, marked and not b.inside, b.inside, b.heading) for b in found], float).reshape(n, 5)
    if not n:
        return np.zeros((0, len(FEATURES)))
    return np.column_stack([words, density, side(words, -1), side(density, -1), side(words, 1), side(density, 1), flags])


#: The labelled table: pages written for this purpose, every block marked + (main text) or - (anything else).
LABELLED = (
    '<body><nav><a href=1>-Home</a> <a href=2>News</a></nav><div class="ad">-Buy two, get one free until Sunday evening.</div><article><h1>+A river returns</h1>'
    "<p>+The river had been dry for eleven years when the first water came back down the valley.<p>+Nobody spoke.<p>+Then the bells rang in three villages at once, "
    'and people walked out to see it.</article><footer>-&copy; Valley Times. All rights reserved, terms apply.</footer>',
    '<body><header>-Garden Weekly</header><ul class="menu"><li><a>-Roses</a><li><a>-Tools</a></ul><main><h2>+Pruning in spring</h2><p>+Cut above an outward bud.</p>'
    '<p>+Read <a>our note on old roses</a> before you start, and keep the blade clean between two plants.</p><ul><li>+Gloves</li><li>+A sharp saw</li></ul></main>'
    '<aside>-Most read: ten plants for shade, a gardener tells her story and much more in this issue.</aside><div id="comments"><p>-Great article, I tried it last '
    "week and my roses look better than ever, thank you so much!</p><p>-Same here.</p></div>",
    '<body><div class="cookie-notice">-We use cookies to make this site better. By staying you agree to our use of them.</div><div id="content"><h1>+Minutes</h1>'
    "<p>+Present were nine members.</p><p>+The chair opened the meeting and read the report of the last session, which was accepted without changes.</p>"
    '<table><tr><td>+Income<td>+4,200<tr><td>+Costs<td>+3,950</table></div><form>-Search this site <input></form><div class="sidebar">-Next meeting in March.</div>',
    "<body><h1>+Old page</h1><p>+This page has no article element, only paragraphs that follow one another and tell the whole story in plain words.<p>+It is short."
    '<p><a>-Home</a> <a>-Up</a> <a>-Next</a></p><div class="footer">-Made by hand.</div>',
    '<body><p><a>-Index</a> | <a>-Archive</a> | <a>-Contact us today</a></p><div><p>+The committee found that the bridge was sound, although its paint was not, and asked '
    'for a new coat before winter.</p><p>+Work begins in May.</p></div><div><a>-Previous story about roads</a></div><div><a>-Next story</a></div>',
    '<body><article><header><h1>+On salt</h1></header><p>+Salt was money once.</p><blockquote>+No salt, no supper.</blockquote><div class="share">-Share this with friends</div>'
    '<p>+Today it lies on every table, and nobody counts the grains.</p><div class="related"><a>-More on pepper</a></div><section class="comments"><p>-First!</p></section></article>',
    '<body><article><p>+See <a>the list</a>.</p><p><a>+A linked title inside the story</a></p><p>+End.</p></article><div class="newsletter">-Subscribe for more letters like this one, every week, free of charge.</div>'
    '<nav><p>-You are reading the archive of the year nineteen ninety, kept by volunteers and friends of the paper.</p></nav>',
    '<body><div>-Hill Gazette, since 1889</div><article><p>+The mill closed in autumn.</p><p>+It had ground flour for two hundred years, and its wheel still turns when the stream is high.</p></article>'
    '<div>-Write to the office by letter, or come in between nine and noon on any working day except in August.</div><p>-Printed on the hill.</p>',
    '<body><div>-Today: rain, then sun over the whole of the valley, with wind from the west.</div><main><p>+Short.</p><p>+Rain fell for nine days before the dam was opened by two men and a boy.</p></main><p>-Late edition</p>',
    "<body><h2>+How to keep bees</h2><p>+Start with one hive and a good book.</p><p>+In the first summer the bees need little help, only shade and water near the hive.</p><p>+Be patient.</p>"
    '<p><a>-Part one</a> <a>-Part two</a> <a>-All parts</a></p><p><a>-Print</a></p>',
    '<body><p><a>-Start</a> <a>-Sitemap</a></p><p>+The tower is forty metres high and leans a little to the south, as towers on clay do.</p><ol><li>+Climb the stair.</li><li>+Ring the bell.</li></ol>'
    '<p>+See <a>the plan</a> for the rooms above the second floor.</p><ul><li><a>-Towers of the north</a></li><li><a>-Towers of the south</a></li></ul>',
    '<body><div class="nav-top"><a>-A</a></div><div>+Dear readers, this letter comes late because the press was broken for a week.</div><div>+It is mended now.</div><div class="foot">-Page four</div>',
    '<body><article><h1>+Wool</h1><p>+A good fleece weighs three kilos.</p><dl><dt>+Staple</dt><dd>+The length of the fibre.</dd></dl></article><div>-Sheep, goats and more every month in your letter box.</div>'
    '<div class="banner">-Wool sale!</div>',
    # Names that only hold a word of the frame: sections of the story, and small parts around it.
    '<body><article><h1>+Wells</h1><p>+A well is dug by hand until water stands in it, and it is lined with stone from the bottom up.</p><section id="discussion"><h2 id="related-work">+Earlier wells</h2>'
    '<p>+The oldest well of the district is said to be nine hundred years old, though nobody has found a stone that proves it.</p><p>+It never failed.</p><p>+Three others were filled in when the pipe came from the hills, and their places are forgotten.</p></section>'
    '<section class="search-methods"><p>+We walked every lane with the old map in hand and asked at each door whether anybody remembered a well.</p><p>+Many did, and the list grew to forty names before the end of the week.</p></section></article>'
    '<div class="reply-to">-Answer</div><div class="tag-cloud">-Water, stone</div>',
    '<body><article><h1>+Bread</h1><p>+Good bread needs flour, water, salt and most of all the time of a whole night.</p><p>+Bake it hot and let it cool on a rack before you cut the first slice.</p>'
    '<div class="related-posts">-<a>On flour</a></div><div class="follow-us">-Follow the baker</div><div class="legal-line">-No liability</div><div class="tags-line">-Bread, ovens</div></article>',
    '<body><article><div class="side-story"><p>+A second story ran beside the first one for years, and in the end it was the better of the two by far.</p><p>+It was told by the miller, who had seen the flood from his own roof and never spoke of it before.</p></div>'
    '<p>+So it ends.</p><div class="toc-line">-Contents</div><div class="skip-line">-Up</div></article>',
    # Short lines of a marked story stay, whatever stands beside them.
    "<body><nav><a>-Home</a></nav><article><h1>+Tin</h1><p>+One.</p><p>+Two words.</p><p>+Here are three.</p><p>+Now four stand here.</p><ul><li>+Ore</li><li>+Slag</li><li>+Ash</li></ul>"
    "<p>+Tin was dug on this hill long before anybody wrote down who owned it, and the pits are still there.</p><p>+Six.</p><p>+Seven lines.</p></article><footer>-Hill works</footer>",
    "<body><header>-Dale News</header><main><p>+Rain.</p><h2>+Wind</h2><p>+Hail.</p><table><tr><td>+May<td>+9<tr><td>+June<td>+4</table><p>+The year was wet, and the hay was late in every field of the lower dale.</p>"
    '<p>+Snow.</p><ol><li>+First</li><li>+Second one</li></ol><p>+<a>+Fog</a></p></main><div class="ad">-Buy boots now at the shop by the bridge, and get a second pair of laces for nothing.</div>'
    "<aside>-Also</aside>",
    '<body><div class="ad">-Salt.</div><article><h1>+Ice</h1><p>+Thaw.</p></article><footer>-End</footer>',
    '<body><nav><ul><li><a>-One</a><li><a>-Two</a></ul></nav><div class="ad">-Coal and wood, delivered free of charge to any house in the town.</div><article><h1>+Coal</h1><p>+Dust.</p><p>+Smoke.</p><p>+Soot.</p></article><footer>-Fin</footer>',
    # Stories that end the page.
    "<article><p>+Only one line.</p></article>", "<article><h1>+Moss</h1><p>+Moss grows on the north side of most walls in this town, whatever the weather does.</p></article>",
    "<main><p>+Fern and heather cover the whole slope above the church, down to the stream.</p><ul><li>+Fern</li><li>+Heather</li></ul></main>", "<article><p>+Gorse.</p><p>+<a>+Broom</a></p></article>",
    "<article><table><tr><td>+Rye<td>+7</table></article>", "<nav>-Up</nav><article><p>+Peat burns slowly, and its smoke can be smelled a mile away on still days.</p></article>",
    # Parts of the frame on pages without a marked story, however long they are.
    "<body><nav><a>-Towns</a> <a>of the coast and of the lower river, with all harbours</a></nav><p>+The harbour was built by monks, who needed stone from the other side of the bay.</p><p>+It silted up.</p>"
    "<p>+Today a dredger comes twice a year, and three boats still land their catch on the old quay.</p><footer>-All rights to these pages are with the harbour office, which may be reached in the morning.</footer>",
    '<body><div class="ad">-Sail with us to the islands this summer and pay for one child only, with meals on board.</div><p>+The lighthouse has a keeper again, after twenty years in which nobody lived on the rock.</p>'
    '<p>+She likes it.</p><p>+Her lamp is lit by a switch on land, but she cleans the glass by hand every Friday.</p><div id="comments"><p>-I was there last year and the keeper let us climb up to the lamp, it was great.</p><p>-Nice.</p></div>',
    "<body><p><a>-Ports and harbours of the north coast</a> <a>Ferries and their times</a> <a>Weather for the next nine days</a></p><p>+No ferry ran on Sunday, since the wind had torn the roof off the ticket office.</p><p>+Calm.</p>"
    "<p>+By Tuesday a tent stood in its place, and the first boat left with forty people on board.</p><div><a>-Read on: what the ferry company says about the roof</a></div><div><a>-All reports on the weather of this and the last winter</a></div>",
    # No mark and no name at all: short lines among short lines surround the story.
    "<body><div>-Hill Post</div><div>-Monday edition</div><div>-Two pence</div><p>+The old bridge was closed on Sunday after a crack had been found in its second arch by a passing fisherman.</p><p>+It held.</p>"
    "<p>+Engineers will look at every stone before the winter floods, and until then the ferry runs twice in an hour.</p><div>-Page four</div><div>-Set by hand</div><div>-Hill Press</div>",
    "<body><div>-Letters</div><div>-Third column</div><p>+Sir, I read with some surprise that the town has no money for a new pump, though it found enough for a clock.</p><p>+Who decides?</p>"
    "<p>+I should like an answer in your pages before the next meeting of the council, if that can be had.</p><div>-Price as marked</div><div>-Sold at inns</div>",
)


def labelled_table() -> pd.DataFrame:
    """Features and labels of the labelled pages' blocks; a block's first + or - is its label."""
    rows = []
    for page in LABELLED:
        found = blocks(page)
        labels = [b.text[0] == "+" for b in found]
        for b in found:
            b.parts = [re.sub(r"[+-](?=[A-Z&©\d])", "", "".join(b.parts))]
        for x, y in zip(describe(found), labels, strict=True):
            rows.append([*x, float(y)])
    return pd.DataFrame(rows, columns=[*FEATURES, "label"])


@dataclass(frozen=True)
class Tree:
    """A trained tree as arrays: inner nodes have a feature, leaves the label."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    label: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return self.label[at]
            go = np.flatnonzero(inner)
            node = at[go]
            low = x[go, self.feature[node]] <= self.threshold[node]
            at[go] = np.where(low, self.left[node], self.right[node])


def train(table: pd.DataFrame, depth: int = 12) -> Tree:
    """A binary decision tree over the labelled table, by Gini impurity, until leaves are pure."""
    x, y = table[list(FEATURES)].to_numpy(float), table["label"].to_numpy(float)
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, left: int) -> int:
        at, share = len(nodes), y[rows].mean()
        nodes.append([-1, 0, 0, 0, share >= 0.5])
        best = None
        if left and 0 < share < 1:
            for f in range(x.shape[1]):
                values = np.unique(x[rows, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    low = x[rows, f] <= cut
                    parts = [y[rows[low]], y[rows[~low]]]
                    cost = sum(len(p) * p.mean() * (1 - p.mean()) for p in parts)
                    if best is None or cost < best[0] - 1e-12:
                        best = (cost, f, cut, low)
        if best:
            _, f, cut, low = best
            nodes[at][:4] = [f, cut, grow(rows[low], left - 1), grow(rows[~low], left - 1)]
        return at

    grow(np.arange(len(y)), depth)
    cols = np.array(nodes, float).T
    return Tree(cols[0].astype(int), cols[1], cols[2].astype(int), cols[3].astype(int), cols[4].astype(bool))


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page)
    keep = tree.predict(describe(found)) if found else []
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``.

    Blocks that the tree calls main text, in page order, each with single spaces, joined by an
    empty line. Character references are decoded once. A null or empty page, and one without a
    main block, gives the empty text. Whole pages are read; repeated rows give repeated results;
    an empty table gives no rows; only ``page_id``, ``url`` and ``html`` are read.
    """
    tree = train(labelled_table())

    @F.pandas_udf("string")
    def text_of(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in pages:
            yield part.map(lambda p: main_text(p, tree))

    out = pages.select("page_id", "url", text_of("html").alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
