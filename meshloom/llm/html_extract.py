"""Main text of HTML pages by a tree-structured graphical model over the DOM.

Each block element of a page is a node with a hidden state, content or not. Node potentials come from what is
seen of it (kind of tag, length of its own text, share of linked text below it, whether it lies in an article and in a
marked part, and the words of its names, hashed), parent-child potentials from the kind and mark of the child. Sum-product
messages pass once from the leaves to the root and once back, which gives the exact marginal of each node; texts of
nodes above one half are the page's text.

Potentials are smoothed relative frequencies from labelled pages: pages with an ``article`` or ``main`` element,
whose blocks inside it and outside marked parts are content. A page is counted three times: as it is, with those
elements hidden, and with all names and marks hidden too, so that other pages are judged by the rest. Known marks
have prior counts for what no labelled page shows. At most ``TRAIN_PAGES`` labelled pages are used.

Defined results: a null or empty html gives an empty text; repeated rows are separate rows; an empty table gives
no rows; unclosed and stray tags are repaired as browsers do for blocks; other columns are ignored. Scripts and the
like end at their literal end tag, or with the page without one; other elements that are no text and lack their end tag end
at the first block that starts in them or at their parent's end. A head needs no end tag.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.llm import common

#: Labelled pages that are used for training at most.
TRAIN_PAGES = 2000
#: Kinds that words of names are hashed to.
NAME_KINDS = 1 << 10
BATCH = 128

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
#: Elements whose content is no text of the page.
SKIPPED = frozenset("script style noscript template textarea select svg iframe object title button canvas audio video annotation annotation-xml".split())
#: Those of them whose content has no tags, by the pattern of their end tag.
RAW_END = {k: re.compile(rf"</{k}(?=[\s/>])", re.I) for k in "script style noscript textarea title iframe".split()}
KIND = {
    **dict.fromkeys("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption".split(), "text"),
    **dict.fromkeys("ul ol dl menu".split(), "list"), **dict.fromkeys("li dt dd".split(), "item"),
    **dict.fromkeys("table thead tbody tfoot tr td th caption".split(), "table"),
    **dict.fromkeys("div section article main body html center figure address details summary fieldset hgroup".split(), "box"),
    **dict.fromkeys("nav header footer aside form dialog".split(), "part"),
}
MARKED_TAGS = frozenset("nav header footer aside form dialog menu".split())
MARKED = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menubar|header|masthead|footer|sidebar|side|aside|complementary|ads?|advert\w*|advertisement|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal"
    r"|comments?|commentlist|respond|reply|replies|disqus|share|sharing|social|related(?![_-](?:work|research|literature))|recommend\w*|subscribe|subscription|newsletter|signup|login|search|breadcrumbs?|pagination|pager|widget|contentinfo|copyright|toolbar|skip)(?:$|[\s_-])",
    re.I,
)
#: Names of an article that is none, names that tell of a page's layout, and tags whose names mark nothing.
REMARK = re.compile(r"(?:^|[\s_-])(?:comments?|reply|related(?![_-](?:work|research|literature))|promo\w*|sponsor\w*|ads?|advert\w*)(?:$|[\s_-])", re.I)
LAYOUT = re.compile(r"\b(?:has|with|without|no|js)-[\w-]+")
#: An article's own header holds its title.
OWN_HEADER = re.compile(r"(?:^|(?<=[\s_-]))(?:header|masthead)(?=$|[\s_-])", re.I)
UNNAMED = frozenset("main body html h1 h2 h3 h4 h5 h6".split())
WORD = re.compile(r"[a-z]+")
#: An open element of the key's kind is closed by the start of the named ones.
CLOSED_BY = {"p": frozenset(k for k, v in KIND.items() if v != "box" or k in ("div", "section", "article", "main", "center", "figure", "address", "details", "fieldset")), "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
#: What a list item, cell or row does not close beyond.
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}}


class Node:
    __slots__ = ("parent", "tag", "marked", "inside", "names", "own", "linked", "all", "all_linked")

    def __init__(self, parent: int, tag: str, marked: bool, inside: bool, names: tuple[str, ...]):
        self.parent, self.tag, self.marked, self.inside, self.names = parent, tag, marked, inside, names
        self.own = self.linked = self.all = self.all_linked = 0


def _after(page: str, at: int, tag: str, around: set[str]) -> int:
    """Where the page goes on after a skipped element whose start tag ends at ``at``; ``around``: the blocks that it lies in."""
    if tag in RAW_END:
        end = RAW_END[tag].search(page, at)
        return end.start() if end else at if tag == "noscript" else len(page)
    depth, block, inside = 1, -1, Counter()
    while True:
        for m in TOKEN.finditer(page, at):
            if m[2] is None:
                continue
            name, closing = m[2].lower(), bool(m[1])
            if name == tag:
                if closing:
                    depth -= 1
                    if not depth:
                        return m.end()
                elif tag in ("button", "select"):  # these do not nest
                    return block if block >= 0 else m.start()
                elif not m[3].endswith("/"):
                    depth += 1
            elif name in RAW_END:
                end = None if closing or m[3].endswith("/") else RAW_END[name].search(page, m.end())
                if end:
                    at = end.start()
                    break
            elif name in KIND:
                if not closing:
                    inside[name] += 1
                    block = m.start() if block < 0 else block
                elif inside[name]:
                    inside[name] -= 1
                elif name in around:
                    return block if block >= 0 else m.start()
        else:
            return block if block >= 0 else len(page)


def _tokens(page: str, around: Callable[[], set[str]]) -> Iterator[re.Match]:
    """The tokens of a page outside skipped elements."""
    at = 0
    while at < len(page):
        for m in TOKEN.finditer(page, at):
            if m[2] is None or (tag := m[2].lower()) not in SKIPPED:
                yield m
            elif not m[1] and not m[3].endswith("/"):
                at = _after(page, m.end(), tag, around())
                break
        else:
            return


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes in page order, and (node, raw text) runs; a run starts a new block where its node or a break says so."""
    nodes = [Node(-1, "html", False, False, ())]
    runs: list[tuple[int, str]] = []
    stack, links, head = [0], 0, False
    for m in _tokens(page, lambda: {nodes[s].tag for s in stack}):
        tag = m[2]
        if tag is None:
            raw = m[0]
            if raw.startswith(("<!", "<?")) or (head and not raw.strip()):
                continue
            head = False
            runs.append((stack[-1], raw))
            node = nodes[stack[-1]]
            n = len(raw) - raw.count(" ") - raw.count("\n")
            node.own += n
            if links:
                node.linked += n
            continue
        tag, closing = tag.lower(), bool(m[1])
        if tag == "head":
            head = not closing and len(nodes) == 1
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag not in KIND:
            if tag in ("br", "hr"):
                runs.append((stack[-1], " "))
            continue
        if closing:
            for at in range(len(stack) - 1, 0, -1):
                if nodes[stack[at]].tag == tag:
                    del stack[at:]
                    links = 0
                    break
            runs.append((-1, ""))
            continue
        if tag in ("html", "body") and any(nodes[s].tag == tag for s in stack):
            continue
        for old, new in CLOSED_BY.items():
            if tag in new:
                stop = SCOPE.get(old, KIND.keys() - {"p"} if old == "p" else ())
                for at in range(len(stack) - 1, 0, -1):
                    name = nodes[stack[at]].tag
                    if name == old:
                        del stack[at:]
                        break
                    if name in stop:
                        break
        up = nodes[stack[-1]]
        names = " ".join(x for t in NAMES.findall(m[3]) for x in t if x)
        own = REMARK.search if tag == "article" else None if tag in UNNAMED else MARKED.search
        told = LAYOUT.sub(" ", names)
        if up.inside:
            told = OWN_HEADER.sub(" ", told)
        part = tag in MARKED_TAGS and not (tag == "header" and up.inside)
        marked = up.marked or part or bool(told and own and own(told)) or bool(HIDDEN.search(m[3]))
        article = tag in ("article", "main") and not marked
        nodes.append(Node(stack[-1], tag, marked, up.inside or article, name_kinds(names) if names else ()))
        stack.append(len(nodes) - 1)
        runs.append((-1, ""))
    for node in nodes:
        node.all, node.all_linked = node.own, node.linked
    for node in reversed(nodes[1:]):
        up = nodes[node.parent]
        up.all += node.all
        up.all_linked += node.all_linked
    return nodes, runs


@lru_cache(4096)
def name_kinds(names: str) -> tuple[str, ...]:
    """The words of an element's names as feature names, of NAME_KINDS kinds."""
    return tuple(sorted({f"h{zlib.crc32(w.encode()) % NAME_KINDS}" for w in WORD.findall(names.lower())}))


def features(node: Node, labelled: bool, named: bool = True) -> tuple[str, ...]:
    """What is seen of a node; ``labelled``: the page has an article, so blocks outside are seen to be outside; ``named``: names and marks are seen.

    A seen mark or article tells enough: what kind of block it is, how long and how much linked says nothing more there, so a paragraph
    of comments is judged as comments, and a list of links in an article as part of it.
    """
    place = ("in" if node.inside else "out") if labelled else "any"
    if named and (node.marked or place == "in"):
        return (f"i{place}{node.marked:d}", *node.names)
    share = "none" if not node.all else "0" if not node.all_linked else "low" if node.all_linked < 0.3 * node.all else "high"
    size = "0" if not node.own else "s" if node.own < 25 else "m" if node.own < 80 else "l" if node.own < 250 else "x"
    kind = KIND[node.tag] if named or KIND[node.tag] != "part" else "box"
    return (f"i{place}{node.marked:d}" if named else "i", f"l{share}", f"n{size}", f"k{kind}", *(node.names if named else ()))


def pair_kind(node: Node, named: bool = True) -> str:
    """The kind of a child for its potential with its parent; marked parts, where marks are seen, have their own."""
    return KIND[node.tag] + "!" * (named and node.marked)


def states_of(nodes: list[Node]) -> list[bool] | None:
    """The labels of a page's nodes; None for a page that has none."""
    return [n.inside and not n.marked for n in nodes] if any(n.inside for n in nodes) else None


def counts_of(page: str) -> Counter:
    """Counts of (feature, state) and (kind, parent's state, state) of a labelled page; nothing for an unlabelled one."""
    nodes, _ = parse(page)
    out: Counter = Counter()
    states = states_of(nodes)
    if states is None:
        return out
    for labelled, named in ((True, True), (False, True), (False, False)):
        for node, y in zip(nodes, states, strict=True):
            out.update((f, y) for f in features(node, labelled, named))
            if node.parent >= 0:
                out[pair_kind(node, named), states[node.parent], y] += 1
    return out


class Model:
    """Potentials from counts: {"f:<feature>:<state>" or "t:<kind>:<parent>:<state>": n}."""

    #: Added to each count, and to those of a name's word in the shares of the states.
    ALPHA, ALPHA_NAME = 0.1, 2.0
    #: Counts that are there before any page: marked nodes are no content, those inside an article are; links are none, long text is.
    PRIOR = {"iin0": (0, 5), "iin1": (50, 0), "iout0": (5, 0), "iout1": (50, 0), "iany0": (3, 5), "iany1": (50, 0), "lhigh": (4, 0.2), "nl": (0.5, 3), "nx": (0.3, 6), "kpart": (2, 0.1)}

    def __init__(self, counts: dict[str, int]):
        self.node: dict[str, tuple[float, float]] = {}
        self.pair: dict[str, tuple[float, float, float, float]] = {}
        groups = [[f"i{p}{m}" for p in ("in", "out") for m in (0, 1)], ["iany0", "iany1"], ["lnone", "l0", "llow", "lhigh"], ["n0", "ns", "nm", "nl", "nx"], [f"k{k}" for k in sorted(set(KIND.values()))]]
        seen = lambda f: [counts.get(f"f:{f}:{y}", 0) for y in (0, 1)]
        for names in groups:
            n = {f: [k + p + self.ALPHA for k, p in zip(seen(f), self.PRIOR.get(f, (1, 1)), strict=True)] for f in names}
            total = [sum(v[y] for v in n.values()) for y in (0, 1)]
            self.node |= {f: (v[0] / total[0], v[1] / total[1]) for f, v in n.items()}
        everything = [k + 1 for k in seen("i")]
        share = [k / sum(everything) for k in everything]
        for h in range(NAME_KINDS):
            n = seen(f"h{h}")
            if any(n):
                self.node[f"h{h}"] = tuple((n[y] / share[y] + self.ALPHA_NAME) / (sum(n) + self.ALPHA_NAME) for y in (0, 1))
        for kind in [k + mark for k in set(KIND.values()) for mark in ("", "!")]:
            # a child is as its parent; a marked one is no content under any
            n = {(a, b): counts.get(f"t:{kind}:{a}:{b}", 0) + ((0.5 if b else 50) if kind[-1] == "!" else 4 if a == b else 1) for a in (0, 1) for b in (0, 1)}
            self.pair[kind] = tuple(n[a, b] / (n[a, 0] + n[a, 1]) for a in (0, 1) for b in (0, 1))

    def marginals(self, nodes: list[Node], labelled: bool | None = None, named: bool = True) -> list[float]:
        """Probability of content for each node, by one upward and one downward pass; ``labelled`` and ``named`` as for ``features``."""
        n = len(nodes)
        b0, b1 = [1.0] * n, [1.0] * n
        b0[0], b1[0] = 0.7, 0.3
        labelled = any(node.inside for node in nodes) if labelled is None else labelled
        for i, node in enumerate(nodes):
            for f in features(node, labelled, named):
                p = self.node.get(f)
                if p:
                    b0[i] *= p[0]
                    b1[i] *= p[1]
        m0, m1 = [1.0] * n, [1.0] * n
        for i in range(n - 1, 0, -1):  # children come after their parents
            z = b0[i] + b1[i]
            x0, x1 = b0[i] / z, b1[i] / z
            p = self.pair[pair_kind(nodes[i], named)]
            u0, u1 = p[0] * x0 + p[1] * x1, p[2] * x0 + p[3] * x1
            m0[i], m1[i] = u0 / (u0 + u1), u1 / (u0 + u1)
            j = nodes[i].parent
            v0, v1 = b0[j] * m0[i], b1[j] * m1[i]
            b0[j], b1[j] = v0 / (v0 + v1), v1 / (v0 + v1)
        out = [0.0] * n
        out[0] = b1[0] / (b0[0] + b1[0])
        for i in range(1, n):
            q = out[nodes[i].parent]
            c0, c1 = (1 - q) / max(m0[i], 1e-300), q / max(m1[i], 1e-300)  # the parent without this child's message
            p = self.pair[pair_kind(nodes[i], named)]
            d0, d1 = (c0 * p[0] + c1 * p[2]) * b0[i], (c0 * p[1] + c1 * p[3]) * b1[i]
            out[i] = d1 / (d0 + d1) if d0 + d1 > 0 else 0.0
        return out

    def text(self, page: str | None) -> str:
        nodes, runs = parse(page or "")
        content = [p > 0.5 for p in self.marginals(nodes)]
        parts: list[str] = []
        for i, raw in runs:
            if i < 0:
                parts.append(" ")
            elif content[i]:
                parts.append(entities.unescape(raw) if "&" in raw else raw)
        return " ".join("".join(parts).split())


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        for page in batch.column(0):
            total.update(counts_of(page.as_py() or ""))
    keys = ["f:{}:{:d}".format(*k) if len(k) == 2 else "t:{}:{:d}:{:d}".format(*k) for k in total]
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(list(total.values()), pa.int64())], names=["key", "n"])


def train(pages: DataFrame, most: int = TRAIN_PAGES) -> Model:
    """A model from at most ``most`` pages that label themselves; the counts that come back are of no more than NAME_KINDS + 60 features and states."""
    labelled = pages.filter(F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
    chosen = labelled.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(most)
    rows = labelled.join(F.broadcast(chosen), "page_id").select("html")
    found = rows.mapInArrow(_counter, "key string, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    return Model({r.key: r.n for r in found})


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text, n_chars of each of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                texts = [model.text(x.as_py()) for x in batch.column("html")]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return extract(pages, train(pages))
