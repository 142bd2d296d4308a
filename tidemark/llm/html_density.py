"""HTML extraction by composite text density.

Each page is parsed into a DOM. Subtrees that the markup itself names as furniture (menus, page headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments, hidden nodes) are left out.
Every other node gets its composite density: characters per tag, adjusted by the share of its characters
and tags in links and by the page's own share. The density sum of a block adds up the densities of its
child blocks and of the text that lies in it directly; the block with the largest sum is the core of the
article, and the lowest density on the way from it to the body is the threshold: from the body down, each
subtree that stays at or above it gives its largest-sum block. A block of which the chosen ones hold
`LIFT` of the text or more, while the rest is not mostly links, is taken whole with its headings and short
paragraphs, up to the body. No element is chosen by its name.

Null or empty html gives the empty text. Unclosed, misnested or truncated markup is closed as a browser
would; a page without markup is one text. Rows are independent and kept as they are, repeated ones too.
"""

import html as entities
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption html legend optgroup option tbody td tfoot th thead tr".split())
# An open element of the value closes before the key opens, unless one of the bounds lies between.
IMPLIED_END = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"),
    "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"),
}
BOUNDS = frozenset("ul ol menu dl table select article body html".split())

# What is never part of an article: by element, by ARIA role, by words of class and id.
DROP_TAGS = frozenset(
    "head nav footer aside form script style noscript template svg iframe object canvas audio video button select "
    "textarea input menu dialog title datalist map noembed noframes xmp".split()
)
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar side aside widget widgets footer masthead cookie cookies consent "
    "gdpr notice notices disclaimer alert popup modal overlay newsletter subscribe subscription signup login share "
    "sharing social related recommended recommendations comment comments commentlist disqus respond replies pagination "
    "pager toolbar skip copyright".split()
)
KEEP_TAGS = frozenset("html body article main".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]|=\s*+\"[^\"]*\"|=\s*+'[^']*'|=|[\"'])*+)(?:>|\Z)",
    re.S,
)
#: Of these words, some name parts of articles too: inside an article they drop only what is thin or mostly links.
UNSURE_WORDS = frozenset(
    "side sidebar aside notice notices disclaimer alert related recommended recommendations share sharing social promo "
    "banner overlay modal popup skip toolbar copyright sponsor sponsored widget widgets consent subscription".split()
)
#: Words that only say where or how, so that a name made of them and words of furniture is one of furniture.
NEUTRAL_WORDS = frozenset(
    "area bar block bottom box button center column container content fixed global group header home inner item items left "
    "link links list main mobile outer page panel post primary right row secondary section site small sticky text the title top wrap wrapper".split()
)
#: A named subtree with this share of the page's text stays; one is mostly links, or thin, from here.
HOLDS_MOST, LINKED, THIN = 0.5, 0.3, 12.0
#: A block is taken whole from this share of its text in what was chosen.
LIFT = 0.75
#: Parts of one article differ in density: the threshold is this share of the lowest on the path.
SLACK = 0.6
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NO_DISPLAY = re.compile(r"(?i)display\s*:\s*none")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _attributes(attrs: str) -> dict[str, str]:
    """Names in lower case and values; the first of a repeated name holds."""
    found: dict[str, str] = {}
    if attrs.strip():
        for name, *values in _ATTR.findall(attrs):
            found.setdefault(name.lower(), next((v for v in values if v), ""))
    return found


def _is_hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true" or bool(_NO_DISPLAY.search(attrs.get("style", "")))


def _named(attrs: dict[str, str]) -> int:
    """How far class and id name furniture: 3 surely, 2 by an unsure word, 1 by a word among other words, 0 not."""
    level = 0
    for token in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = {w.lower() for w in _WORDS.findall(token)}
        named = words & DROP_WORDS
        if named:
            plain = words <= DROP_WORDS | NEUTRAL_WORDS
            level = max(level, (3 if named - UNSURE_WORDS else 2) if plain else 1)
    return level


def _has_drop_role(attrs: dict[str, str]) -> bool:
    return not DROP_ROLES.isdisjoint(w.lower() for w in _WORDS.findall(attrs.get("role", "")))


class Dom:
    """Parallel lists over the nodes in page order (a parent comes before its children), and the texts."""

    def __init__(self, page: str) -> None:
        self.tag, self.parent, self.dropped = ["#root"], [-1], [False]
        self.named = [0]  # by class and id; dropped has all else
        self.texts: list[tuple[int, int, str]] = []  # node, block, text
        self.block = 0
        stack = [0]
        at, n = 0, len(page)
        while at < n:
            m = _TAG.search(page, at)
            if m is None:
                self._text(stack[-1], page[at:])
                break
            if m.start() > at:
                self._text(stack[-1], page[at : m.start()])
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                self._close(stack, name)
                continue
            self._open(stack, name, m[3])
            if name in RAW_TEXT and not m[3].endswith("/"):
                end = re.compile(rf"(?i)</{name}(?=[\s/>]|\Z)").search(page, at)
                if name == "textarea":
                    self._text(stack[-1], page[at : end.start() if end else n])
                at = end.start() if end else n

    def _text(self, node: int, text: str) -> None:
        self.texts.append((node, self.block, text))

    def _open(self, stack: list[int], name: str, attrs: str) -> None:
        if name in CLOSES_P:
            self._imply(stack, ("p",))
        if name in IMPLIED_END:
            self._imply(stack, IMPLIED_END[name], all_of_them=True)
        if name in BLOCK:
            self.block += 1
        top = stack[-1]
        if name == "br":
            self._text(top, " ")
        drop = self.dropped[top] or name in DROP_TAGS
        if not drop and name == "header":
            drop = not any(self.tag[i] in ("article", "main") for i in stack)
        named = 0
        if not drop:
            have = _attributes(attrs)
            drop = name not in ("html", "body") and _is_hidden(have)
            if not drop and name not in KEEP_TAGS:
                drop, named = _has_drop_role(have), _named(have)
        self.tag.append(name)
        self.parent.append(top)
        self.named.append(named)
        self.dropped.append(drop)
        if name not in VOID:
            stack.append(len(self.tag) - 1)

    def _imply(self, stack: list[int], names: tuple[str, ...], all_of_them: bool = False) -> None:
        cut = None
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag in names:
                cut = k
                if not all_of_them:
                    break
            elif tag in BOUNDS or (names == ("p",) and tag in BLOCK):
                break
        if cut is not None:
            del stack[cut:]

    def _close(self, stack: list[int], name: str) -> None:
        if name in BLOCK:
            self.block += 1
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag == name:
                del stack[k:]
                return
            if tag in ("table", "td", "th", "article", "main") and name in ("p", "li", "span", "b", "i", "a", "em", "strong"):
                return


def _log_ratio(c: float, t: float, lc: float, lt: float, body_ratio: float) -> float:
    """Composite density of a node with c characters, t tags, lc and lt of them in links."""
    lc1, lt1, other = max(lc, 1.0), max(lt, 1.0), max(c - lc, 1.0)
    base = math.log(c / other * lc1 + body_ratio * c + math.e)
    return c / t * math.log(max(c / lc1 * t / lt1, 1.0)) / math.log(base)


def _without_named(dom: Dom) -> list[bool]:
    """What is dropped, with the subtrees that their class or id names as furniture.

    A name is only a sign: what holds most of the page's text stays, and so does what is neither thin nor
    mostly links where the word is one among others, or an unsure one inside an article.
    """
    n, parent, dropped = len(dom.tag), dom.parent, dom.dropped
    if not any(dom.named):
        return dropped
    chars, link_chars, tags, linked, inside = [0] * n, [0] * n, [1] * n, [False] * n, [False] * n
    for i in range(1, n):
        linked[i] = linked[parent[i]] or dom.tag[i] == "a"
        inside[i] = inside[parent[i]] or dom.tag[i] in ("article", "main")
    for node, _, raw in dom.texts:
        if not dropped[node]:
            size = len(" ".join(raw.split()))
            chars[node] += size
            link_chars[node] += size * linked[node]
    for i in range(n - 1, 0, -1):
        if not dropped[i]:
            chars[parent[i]] += chars[i]
            link_chars[parent[i]] += link_chars[i]
            tags[parent[i]] += tags[i]
    out = list(dropped)
    for i in range(1, n):
        out[i] = out[i] or out[parent[i]]
        if out[i] or not dom.named[i]:
            continue
        few_links = link_chars[i] < LINKED * chars[i]
        stays = few_links and chars[i] >= HOLDS_MOST * chars[0]
        maybe = dom.named[i] == 1 or (dom.named[i] == 2 and inside[i])
        stays = stays or (few_links and maybe and chars[i] >= THIN * tags[i])
        out[i] = not stays
    return out


def _chosen(dom: Dom, dropped: list[bool], texts: list[tuple[int, int, str]], density_of: Callable[..., float]) -> list[bool]:
    """The nodes of the subtrees that the densities choose."""
    n, tag, parent = len(dom.tag), dom.tag, dom.parent
    is_block = [i == 0 or tag[i] in BLOCK for i in range(n)]
    linked, owner = [False] * n, list(range(n))  # the block in which a node's text lies directly
    # of whole subtrees: characters, tags, and both in links; the same of what lies in a block directly
    total, own = [[0] * 4 for _ in range(n)], [[0] * 4 for _ in range(n)]
    for i in range(n):
        if i:
            linked[i] = linked[parent[i]] or tag[i] == "a"
            owner[i] = i if is_block[i] else owner[parent[i]]
        total[i][1] = 1
        if tag[i] == "a":
            total[i][3] = 1
        if not dropped[i]:
            own[owner[i]][1] += 1
            own[owner[i]][3] += tag[i] == "a"
    for node, _, text in texts:
        size = len(" ".join(text.split()))
        for counts in (total[node], own[owner[node]]):
            counts[0] += size
            counts[2] += size * linked[node]
    for i in range(n - 1, 0, -1):
        if not dropped[i]:
            into = total[parent[i]]
            for k in range(4):
                into[k] += total[i][k]
    root = next((i for i in range(n) if tag[i] == "body"), 0)
    ratio = max(total[root][2], 1) / max(total[root][0], 1)
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if dropped[i] or not is_block[i] or not total[i][0]:
            continue
        density[i] = density_of(*total[i], ratio)
        if own[i][0]:
            sums[i] += density_of(*own[i], ratio)
        if i:
            sums[owner[parent[i]]] += density[i]
    best = list(range(n))
    for i in range(n - 1, root, -1):
        above = owner[parent[i]]
        if not dropped[i] and is_block[i] and sums[best[i]] > sums[best[above]]:
            best[above] = best[i]
    path, i = [], best[root]
    while i > root:
        path.append(i)
        i = owner[parent[i]]
    threshold = SLACK * min((density[i] for i in path), default=density[root]) - 1e-9
    taken, reached = [False] * n, [False] * n
    for i in range(root, n):
        if dropped[i] or not is_block[i]:
            continue
        reached[i] = i == root or (density[i] >= threshold and reached[owner[parent[i]]])
        if reached[i] and total[i][0] and density[i] >= threshold:
            taken[best[i]] = True
    taken[best[root]] = True
    # what the chosen ones hold of each block: characters, and those in links
    held = [[0, 0] for _ in range(n)]
    for i in range(n - 1, root, -1):
        if dropped[i]:
            continue
        rest, links = total[i][0] - held[i][0], total[i][2] - held[i][1]
        if not taken[i] and is_block[i] and total[i][0] and held[i][0] >= LIFT * total[i][0] and links <= LINKED * rest:
            taken[i] = True
        if taken[i]:
            held[i] = [total[i][0], total[i][2]]
        held[parent[i]][0] += held[i][0]
        held[parent[i]][1] += held[i][1]
    for i in range(1, n):
        taken[i] = taken[i] or taken[parent[i]]
    return taken


def main_text(page: str | None, density_of: Callable[..., float] = _log_ratio) -> tuple[str, int]:
    """The article's text and its number of blocks."""
    if not page:
        return "", 0
    dom = Dom(page)
    n, tag, parent, dropped = len(dom.tag), dom.tag, dom.parent, _without_named(dom)
    holds = [False] * n  # a node that holds the article is no furniture, whatever it is called
    for i in range(n - 1, 0, -1):
        if tag[i] in ("article", "main") or holds[i]:
            holds[parent[i]] = True
    if any(holds[i] and dropped[i] and tag[i] not in DROP_TAGS for i in range(n)):
        named, dropped = dropped, [False] * n
        for i in range(1, n):
            own = named[i] and not named[parent[i]]
            dropped[i] = dropped[parent[i]] or (tag[i] in DROP_TAGS) or (own and not holds[i])
    texts = [(node, block, entities.unescape(raw) if "&" in raw else raw) for node, block, raw in dom.texts if not dropped[node]]
    taken = _chosen(dom, dropped, texts, density_of)
    blocks: dict[int, list[str]] = {}
    for node, block, text in texts:
        if taken[node]:
            blocks.setdefault(block, []).append(text)
    lines = [x for b in blocks.values() if (x := " ".join("".join(b).split()))]
    return "\n".join(lines), len(lines)


def extract_text(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The `keep` columns with text, n_chars (code points) and n_blocks of the article of each page."""
    kept = df.select(*keep).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                found = [main_text(page) for page in part.column(part.num_columns - 1).to_pylist()]
                texts = [t for t, _ in found]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                     pa.array([b for _, b in found], pa.int64())],
                    [*kept.names, "text", "n_chars", "n_blocks"],
                )

    source = df.select(*keep, F.col(html_col).cast("string").alias("_html"))
    return source.mapInArrow(extract, f"{ddl}, text string, n_chars long, n_blocks long")


def op1_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page of `pages`."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
