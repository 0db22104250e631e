"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged: a node of the tree is a chain of element names with their classes, ids and roles, from the root. Over the m
distinct pages that have a node,

    presentation(E) = entropy of its child sequences / log m
    H(a)            = entropy of a feature's spread over those pages / log m; features are the words, links and images of E's own text
    content(E)      = 1 - mean of H(a) over all features of E's branch, each as often as it occurs
    share(E)        = sum of 1 - H(a) over E's branch / that over whole pages: E's part of what the site says
    importance(E)   = 1 - (1 - presentation(E)) (1 - share(E))

A feature that every page repeats has H = 1 and says nothing; one of a single page has H = 0. On a host of ``MIN_PAGES`` or more distinct
pages the tree decides, from the root down, over the nodes that ``MIN_PAGES`` pages have:

* a branch whose content is under ``STALE`` reads the same all over the site and is removed;
* a node whose presentation is ``VARIED`` or more, and that isn't of low importance, holds what differs from page to page. Above such nodes, where the layout is the
  template's, a branch whose importance is under ``THRESHOLD`` is removed: menus, adverts and footers, even where their words differ on
  each page. A heading whose own content is ``OWN`` or more is a title and stays;
* names add to it: a branch whose element, role, class or id says it is furniture (reader comments, say) is removed unless its share is ``HEAVY`` or
  more, and so is a block outside article and main elements where those remain, but for a title.

On a smaller host, which has no statistics, names alone decide, but a branch with a name that an article may have too (``MILD_NAMES``) stays if it holds ``HEAVY`` of the
page's words or more in blocks of ``PROSE`` words or more. If article or main elements remain, only what they hold is kept, with an
h1 outside if there is none inside. What the page itself hides (hidden, aria-hidden, display:none) is never text.

Words are told apart by 32-bit hashes where their counts are summed, so two words of one node can rarely share a value, and entropies of nodes with very many words come out slightly low.
Counts are summed by (host, node, value) in each task before they are shuffled, so the pages of a large host are never gathered. Equal pages of a host count
once: each weighs one over the number of its copies.

Defined results: null html, empty html or a page of nothing but furniture gives an empty string; pages of null or unparsable url are those of one host;
rows with equal ids are pages each; an empty table gives no row. Extra columns pass through; a column named text is an error.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import written

MIN_PAGES, THRESHOLD, STALE, VARIED, OWN, HEAVY = 8, 0.1, 0.12, 0.2, 0.5, 0.5
#: Words of a block, on average, from which a branch is prose and no list of links.
PROSE = 8
#: A node is furniture by its element or role or by a plain name, or only by a name that an article may have.
SURE, MILD = 1, 2
#: Node of the whole page, in the tree only: its pages are the distinct pages of the host.
WHOLE = 0
#: What the tree says of a node, as bits of one number.
IS_STALE, IS_LOW, IS_VARIED, IS_OWN, IS_HEAVY = 1, 2, 4, 8, 16
#: Judged nodes that are sent to every task; with more, pages are joined with those of their host.
BROADCAST_RULES = 200_000
#: Copied pages that are sent to every task; with more, pages are joined with their number of copies.
BROADCAST_COPIES = 200_000
#: Features, and child sequences, counted in a task before their counts are passed on.
HELD = 300_000

# HTML's own vocabulary.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg canvas annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
OWN_CLOSE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol table dl body article section div".split())
FURNITURE = frozenset("nav aside footer form button select menu dialog head fieldset label input".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar dialog alert alertdialog form".split())
# Words that name furniture in classes and ids. In a name of several words the last one counts, but for those that say nothing.
NAMES = frozenset("""ad ads adv advert adverts advertisement advertising adsense adslot banner banners breadcrumb breadcrumbs byline-share comment comments commentlist cookie cookies consent disqus
footer foot gdpr header masthead menu menus modal nav navbar navigation navi newsletter notice notices notification overlay pager pagination popup promo promos promotion recommend recommended related replies reply respond share sharing
shares sidebar sidebars sidenav signup skip social sponsor sponsored sponsors subscribe subscription tagcloud tags toolbar topbar trending widget widgets login search disclaimer paywall responses discussion reviews""".split())
#: Of these, what an article may be called too: such a block stays if it holds a page's prose and its host has no statistics to say so.
MILD_NAMES = frozenset("notice notices related reviews search social".split())
EMPTY_NAMES = frozenset("area bar block box btn button buttons col container content form group holder icons inner items left links list module outer panel right row section slot top bottom wrap wrapper unit zone".split())
MAIN_NAMES = frozenset("article main content post entry story".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_LINK = re.compile(r"\b(?:href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_HUMP = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _named(value: str) -> set[str]:
    """The word that says what a thing is, of each name in a class or id."""
    out = set()
    for name in value.split():
        words = [w.lower() for w in _HUMP.findall(name)]
        while len(words) > 1 and words[-1] in EMPTY_NAMES:
            words.pop()
        out.update(words[-1:])
    return out


class Page:
    """A page as text blocks, each with the chain of nodes it stands in; and for each node its child sequence and texts."""

    __slots__ = ("nodes", "blocks", "links")

    def __init__(self, source: str):
        #: node: (parent, chain hash, furniture by its own name, main, children, hidden by itself, element name)
        self.nodes: list[list] = []
        self.blocks: list[tuple[int, str]] = []
        #: (node, address) of links and images
        self.links: list[tuple[int, str]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        nodes, blocks = self.nodes, self.blocks
        stack: list[tuple[str, int]] = []
        here, parts, at, size = -1, [], 0, len(source)

        def flush() -> None:
            if parts:
                if text := " ".join(_html.unescape("".join(parts)).split()):
                    blocks.append((here, text))
                parts.clear()

        def pop(k: int) -> None:
            nonlocal here
            del stack[k:]
            here = stack[-1][1] if stack else -1

        while at < size:
            m = _TAG.search(source, at)
            if m is None:
                parts.append(source[at:])
                break
            if m.start() > at:
                parts.append(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                if m[0].startswith("<![CDATA["):
                    parts.append(_html.escape(m[0][9:].removesuffix("]]>")))
                continue
            name, close = name.lower(), (m[1] or m[4])
            if name == "br":
                parts.append(" ")
                continue
            if name in RAW and not close:
                if m[0].endswith("/>") and name == "svg":
                    continue
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
                at = end.end() if end else size
                continue
            if close:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        flush()
                        pop(k)
                        break
                continue
            if name not in BLOCK and name not in FURNITURE:
                if not m[3] and not m[6]:
                    continue
                if name in ("a", "img"):
                    if at_ := _LINK.search(m[3] or m[6]):
                        self.links.append((here, at_[1] or at_[2] or at_[3] or ""))
                    continue
            attrs = {k.lower(): (a or b or c or "") for k, a, b, c in _ATTR.findall(m[3] or m[6] or "")} if (m[3] or m[6]) else {}
            if name not in BLOCK and name not in FURNITURE:
                if not ("hidden" in attrs and name == "span"):
                    continue
            flush()
            if name in CLOSES_P:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        pop(k)
                        break
                    if stack[k][0] in SCOPE:
                        break
            if name in OWN_CLOSE:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in OWN_CLOSE[name]:
                        pop(k)
                        break
                    if stack[k][0] in SCOPE:
                        break
            if name in VOID or name == "html":
                continue
            label = name + "." + re.sub(r"\d+", "0", " ".join(sorted((attrs.get("class", "") + " #" + attrs.get("id", "") + " @" + attrs.get("role", "")).lower().split())))
            up = nodes[here] if here >= 0 else None
            chain = xxhash.xxh64_intdigest(label, up[1] if up else 0)
            words = _named(attrs.get("class", "")) | _named(attrs.get("id", ""))
            inside = bool(up and up[3])
            bad = name in FURNITURE or attrs.get("role", "").lower() in ROLES
            hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
            if name == "header" and not inside:
                bad = True
            if not bad and words & NAMES and name not in ("html", "body"):
                bad = not (words & MAIN_NAMES and not words & {"comment", "comments", "reply", "replies", "sidebar", "nav", "menu", "footer", "ad", "ads", "related"})
                if inside and words <= {"header", "article", "post", "entry", "main", "content"}:
                    bad = False
                if bad and words & NAMES <= MILD_NAMES:
                    bad = MILD
            nodes.append([here, chain, bad, inside or name in ("article", "main") or attrs.get("role", "").lower() == "main", [], hidden, name])
            if up:
                up[4].append(name)
            here = len(nodes) - 1
            stack.append((name, here))
        flush()

    def looks(self) -> dict[int, int]:
        """Child sequences of each chain, hashed; a chain that occurs more than once in the page gives one value of all its places."""
        look: dict[int, list] = {}
        for n in self.nodes:
            look.setdefault(n[1], []).append(tuple(n[4]))
        return {chain: xxhash.xxh64_intdigest(repr(shapes)) for chain, shapes in look.items()}

    def features(self) -> dict[int, Counter]:
        """Words, links and images of each chain's own text, but for what is hidden, and how often they occur in the page."""
        found: dict[int, list] = {}
        hidden: list[bool] = []
        for n in self.nodes:
            hidden.append(n[5] or n[0] >= 0 and hidden[n[0]])
        for k, some in (*((k, t.lower().split()) for k, t in self.blocks), *((k, [f"\0{address}"]) for k, address in self.links)):
            if k < 0 or not hidden[k]:
                found.setdefault(self.nodes[k][1] if k >= 0 else WHOLE, []).extend(some)
        return {chain: Counter(words) for chain, words in found.items()}

    def paths(self) -> dict[int, list[int]]:
        """The chains above each chain, from its parent to the whole page."""
        out: dict[int, list[int]] = {WHOLE: []}
        for n in self.nodes:
            if n[1] not in out:
                up = self.nodes[n[0]][1] if n[0] >= 0 else WHOLE
                out[n[1]] = [up, *out[up]]
        return out

    def prose(self) -> set[int]:
        """Mildly named nodes that hold at least half of the page's words outside of what is surely furniture, in blocks of some length."""
        gone: list[bool] = []
        for n in self.nodes:
            gone.append(n[5] or n[2] == SURE or n[0] >= 0 and gone[n[0]])
        total, held = 0, {}
        for k, t in self.blocks:
            if k >= 0 and gone[k]:
                continue
            n = len(t.split())
            total += n
            while k >= 0:
                if self.nodes[k][2] == MILD:
                    words, blocks = held.get(k, (0, 0))
                    held[k] = words + n, blocks + 1
                k = self.nodes[k][0]
        return {k for k, (words, blocks) in held.items() if words >= HEAVY * total and words >= PROSE * blocks}

    def text(self, judged: Callable[[int], int] | None) -> str:
        """judged: what the tree of a host with statistics says of a chain."""
        nodes, state = self.nodes, []
        excused = self.prose() if judged is None and any(n[2] == MILD for n in nodes) else ()
        for k, (up, chain, named, _, _, hidden, name) in enumerate(nodes):
            kept, varied = state[up] if up >= 0 else (True, False)
            says = judged(chain) if judged is not None else 0
            title = says & IS_OWN and len(name) == 2 and name[0] == "h"
            gone = hidden or says & IS_STALE or named and not says & IS_HEAVY and k not in excused or not varied and says & IS_LOW and not title
            state.append((kept and not gone, varied or bool(says & IS_VARIED)))
        keep = [(k, t) for k, t in self.blocks if k < 0 or state[k][0]]
        if any(k >= 0 and nodes[k][3] for k, _ in keep):
            headed = any(k >= 0 and nodes[k][3] and nodes[k][6] == "h1" for k, _ in keep)

            def stays(k: int) -> bool:
                if k < 0 or nodes[k][3]:
                    return k >= 0
                says = judged(nodes[k][1]) if judged is not None else IS_OWN
                return bool(says & IS_HEAVY) or nodes[k][6] == "h1" and not headed and bool(says & IS_OWN)

            keep = [x for x in keep if stays(x[0])]
        return "\n\n".join(t for _, t in keep)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def host(url: F.Column) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def _key(site: str, chain: int) -> int:
    """A node of a site's tree; for the whole page it is what Spark's xxhash64 gives for the host."""
    return _signed(xxhash.xxh64_intdigest(site, chain if chain != WHOLE else 42))


#: Child sequences, features, and the nodes above a node, of which the whole page is marked.
LOOK, FEATURE, ABOVE = 0, 1, 2


def tree(pages: DataFrame) -> DataFrame:
    """(node, site, pages, presentation, content, share, importance) of the site style trees of all hosts; node and site are keys, equal for the whole page."""
    schema = pa.schema([("kind", pa.int8()), ("node", pa.int64()), ("value", pa.int64()), ("n", pa.float64()), ("s", pa.float64())])
    rows = pages.select(host(F.col("url")).alias("host"), "html").where("html <> ''").withColumn("page", F.xxhash64("html"))
    copied = written(rows.groupBy("host", "page").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    few = copied.limit(BROADCAST_COPIES + 1).count() <= BROADCAST_COPIES
    rows = rows.join(F.broadcast(copied) if few else copied, ["host", "page"], "left").select("host", "html", F.coalesce("copies", F.lit(1)).alias("copies"))

    def run(batches):
        # (kind, node, value): [sum of weights, sum of weighted c log c].
        held: dict[tuple, list[float]] = {}
        known: dict[tuple[str, int], int] = {}

        def counted():
            k, v = list(held), list(held.values())
            # 32 bits tell the words of one node apart, and are half of what is shuffled.
            value = [xxhash.xxh32_intdigest(x) if q == FEATURE else x for q, _, x in k]
            columns = [[x[0] for x in k], [x[1] for x in k], value, [x[0] for x in v], [x[1] for x in v]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        def add(kind, node, value, n, s=0.0):
            cell = held.get((kind, node, value))
            if cell is None:
                held[kind, node, value] = [n, s]
            else:
                cell[0] += n
                cell[1] += s

        for b in batches:
            for site, source, copies in zip(*(b.column(c).to_pylist() for c in ("host", "html", "copies")), strict=True):
                p, weight = Page(source), 1.0 / copies
                paths = p.paths()
                for chain, above in paths.items():
                    if (site, chain) not in known:
                        known[site, chain] = _key(site, chain)
                        for up in (chain, *above):
                            add(ABOVE, known[site, chain], _key(site, up), 1.0, float(up == WHOLE))
                add(LOOK, known[site, WHOLE], 0, weight)
                for chain, look in p.looks().items():
                    add(LOOK, known[site, chain], _signed(look), weight)
                for chain, words in p.features().items():
                    node = known[site, chain]
                    for w, c in words.items():
                        add(FEATURE, node, w, weight * c, weight * c * math.log(c) if c > 1 else 0.0)
                if len(held) > HELD:
                    yield counted()
                if len(known) > HELD:
                    known.clear()
        if held:
            yield counted()

    n_log_n = F.when(F.col("n") > 0, F.col("n") * F.log("n")).otherwise(0.0)
    each = rows.mapInArrow(run, "kind byte, node long, value long, n double, s double").groupBy("kind", "node", "value").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    of = lambda kind, v: F.sum(F.when(F.col("kind") == kind, v).otherwise(0.0))
    # A row for the sums of each node, and one for each node above it.
    sums = each.groupBy("node", F.when(F.col("kind") == ABOVE, F.col("value")).alias("above")).agg(
        of(LOOK, F.col("n")).alias("pages"), of(LOOK, n_log_n).alias("looks"), of(FEATURE, F.col("n")).alias("total"), of(FEATURE, n_log_n - F.col("s")).alias("spread"), of(ABOVE, F.col("s")).alias("top")
    )
    sums = written(sums, "nodes")
    log_m, many = F.log("pages"), F.col("pages") > 1.5
    own = sums.where("above IS NULL").select("node", F.round("pages").cast("long").alias("pages"), F.when(many, 1 - F.col("looks") / F.col("pages") / log_m).otherwise(1.0).alias("presentation"), "total", (F.col("total") - F.when(many, F.col("spread") / log_m).otherwise(0.0)).alias("says"))
    above = sums.where("above IS NOT NULL").select("node", "above", "top")
    branch = above.join(own.select("node", "total", "says"), "node").groupBy(F.col("above").alias("node")).agg(F.sum("total").alias("total"), F.sum("says").alias("says"))
    out = own.select("node", "pages", "presentation").join(branch, "node").join(above.where("top > 0").select("node", F.col("above").alias("site")), "node")
    whole = branch.select(F.col("node").alias("site"), F.col("says").alias("all_says"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    out = out.join(whole, "site").select("node", "site", "pages", "presentation", ratio("says", "total").alias("content"), ratio("says", "all_says").alias("share"))
    return out.withColumn("importance", 1 - (1 - F.col("presentation")) * (1 - F.col("share")))


def judge(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(site, node, says) of the nodes that MIN_PAGES pages have; a site's row for the whole page marks it as one with statistics."""
    known = nodes.where(F.col("pages") >= MIN_PAGES)
    bit = lambda test, value: F.when(test, F.lit(value)).otherwise(0)
    low = F.col("importance") < threshold
    says = bit(F.col("content") < STALE, IS_STALE) + bit(low, IS_LOW) + bit(~low & (F.col("presentation") >= VARIED), IS_VARIED) + bit(F.col("content") >= OWN, IS_OWN) + bit(F.col("share") >= HEAVY, IS_HEAVY)
    # A branch without any feature says nothing, and there is nothing to remove of it.
    return known.select("site", "node", F.when(F.col("node") == F.col("site"), F.lit(0)).otherwise(says).alias("says"))


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds text: the main text of each page's whole html, blocks joined by two line ends."""
    if "text" in {c.lower() for c in pages.columns}:
        raise ValueError("the input has a column 'text' already")
    spark = pages.sparkSession
    rules = written(judge(tree(pages), threshold), "style")
    few = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    names, spare = pages.columns, "__host"
    while spare in names:
        spare += "_"
    out = T.StructType([*pages.schema.fields, T.StructField("text", T.StringType())])

    def texts(b, sites, judged_of):
        for k in range(0, b.num_rows, 256):
            s, got = b.slice(k, 256), []
            for i, h in enumerate(s.column("html").to_pylist(), k):
                known = judged_of(i)
                got.append(Page(h).text((lambda chain, at=sites[i], known=known: known.get(_key(at, chain), 0)) if _key(sites[i], WHOLE) in known else None) if h else "")
            yield pa.RecordBatch.from_arrays([*(s.column(i) for i in range(len(names))), pa.array(got, pa.string())], [*names, "text"])

    if few:
        shared = spark.sparkContext.broadcast({r.node: r.says for r in rules.toLocalIterator()})

        def run(batches):
            for b in batches:
                yield from texts(b, b.column(len(names)).to_pylist(), lambda i: shared.value)

        return pages.select("*", host(F.col("url")).alias(spare)).mapInArrow(run, out)
    # A host's rules are as many as its templates have nodes; AQE splits a large host's pages.
    lists = rules.groupBy(F.col("site").alias(f"{spare}_site")).agg(F.map_from_entries(F.collect_list(F.struct("node", "says"))).alias(f"{spare}_rules"))
    of = pages.select("*", host(F.col("url")).alias(spare))
    joined = of.join(lists, F.xxhash64(of[spare]) == lists[f"{spare}_site"], "left").select(*names, spare, f"{spare}_rules")

    def run_joined(batches):
        for b in batches:
            found = [dict(r or ()) for r in b.column(len(names) + 1).to_pylist()]
            yield from texts(b, b.column(len(names)).to_pylist(), lambda i, found=found: found[i])

    return joined.mapInArrow(run_joined, out)
