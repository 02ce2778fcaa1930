"""Main text of web pages by wrapper induction.

For each host a few distinct pages propose anchor trees, one for each layout.
Every page of the host is aligned with its best anchor by simple tree matching
over all its block elements; an aligned element takes the anchor's slot, and
every element has the slot of its own path. The lines of text in each slot are counted
over all distinct pages of the host: a line that nearly all pages with the slot
share is template, inside an article as well, and is left out where it stands
in that slot. Only pages with enough text that no other page has bear witness
to that: versions of one text share theirs. A constant heading stays if it heads
text that stays. The wrapper also says which article or main element holds the
most varying text. Menus, adverts, forms and the like are left out by name,
role and class besides.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import stored
from barloom.llm.url_filter import host_of

#: Distinct pages of a host that may propose its anchor trees, at most; what is template is counted over all pages.
SAMPLE_PAGES = 6
#: Share of a slot's pages that must have the same line there for it to be template.
CONSTANT_SHARE = 0.9
#: Pages that must witness it: those with this share of their text at least that is on no other page of the host.
WITNESSES, OWN_SHARE = 3, 0.3
#: An anchor that agrees with an earlier one in this share of the score is of the same layout.
SAME_LAYOUT = 0.8
#: Pairs of siblings that one alignment compares, and its levels; elements beyond keep the slots of their own paths.
MOST_PAIRS, MOST_LEVELS = 40_000, 300
#: Characters of anchors and templates that are broadcast; more than that meets the pages in a shuffle join.
BROADCAST_CHARS = 16_000_000

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("aside button dialog footer form head iframe input label menu nav noscript object script select style svg template textarea title canvas audio video".split())
MAIN = ("article", "main")
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo comment comments commentlist reply replies respond disqus sidebar menu nav navigation navbar breadcrumb breadcrumbs cookie cookies consent notice notices gdpr popup modal overlay subscribe newsletter signup share sharing social related recommended footer".split()
)
#: Those of them that name readers' comments.
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A token with one of these words tells how a page looks.
STATE_WORDS = frozenset("has no not without with free hide hidden enabled disabled".split())
#: Elements whose content is never a page's main text.
NEVER_MAIN = RAW | frozenset("head select object svg button canvas audio video".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
P_CLOSERS = BLOCK - {"body", "html", "option", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: An open element of the key ends where one of its values starts.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}

_TAG = re.compile(r"<(?:!--(?P<c>.*?)(?:-->|\Z)|(?P<d>[!?][^>]*)>|(?P<e>/?)(?P<n>[a-zA-Z][^\s/>]*)(?P<a>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"[0-9]+")


class Node:
    __slots__ = ("name", "mark", "role", "children")

    def __init__(self, name: str, mark: str = "", role: str = ""):
        self.name, self.mark, self.role, self.children = name, mark, role, []


def parse(page: str) -> Node:
    """A tolerant tree of ``page``: children are nodes and strings (character references decoded)."""
    root = Node("#root")
    stack, at = [root], 0
    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            stack[-1].children.append(html.unescape(text))
        if not m:
            return root
        at = m.end()
        if not m["n"]:
            continue
        name = m["n"].lower()
        if m["e"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
            continue
        attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(m["a"])} if m["a"] else {}
        node = Node(name, f"{attributes.get('class', '')} {attributes.get('id', '')}".strip().lower(), attributes.get("role", "").lower())
        for i in range(len(stack) - 1, 0, -1):
            open_ = stack[i].name
            if (open_ == "p" and name in P_CLOSERS) or name in ENDS.get(open_, ()):
                del stack[i:]
                break
            if open_ in BLOCK and open_ not in ENDS:
                break
        stack[-1].children.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif name not in VOID and not m["a"].endswith("/"):
            stack.append(node)


def _marked(mark: str) -> bool:
    """Whether a class or id token names a part of a page to leave out; ``no-sidebar`` or ``ad-free`` say what a page is like."""
    return any(not DROPPED_WORDS.isdisjoint(words) and STATE_WORDS.isdisjoint(words) for words in map(_WORDS.findall, mark.split()))


def dropped(node: Node, inside_main: bool, kept: frozenset[int] = frozenset()) -> bool:
    """Whether an element is a menu, footer, advert, form or the like by its name, role or class; those in ``kept`` never are."""
    if id(node) in kept:
        return False
    if node.name in DROPPED or node.role in DROPPED_ROLES:
        return True
    if node.name == "header":
        return not inside_main
    if node.name in MAIN:  # an article in an article may be a reader's comment
        return inside_main and any(not COMMENT_WORDS.isdisjoint(_WORDS.findall(token)) for token in node.mark.split())
    return bool(node.mark) and _marked(node.mark)


def kept_anyway(root: Node) -> frozenset[int]:
    """Elements that are no boilerplate whatever they are called: html, body, and what holds every article and main of the page.

    On a page without article and main: what holds more than half of its text
    outside links, if only its role, its class or being a form speak against it.
    """
    order, todo = [], [(root, None, False)]
    chars: dict[int, int] = {}
    mains: dict[int, int] = {}
    suspect = False
    while todo:
        node, above, link = todo.pop()
        order.append((node, above))
        link = link or node.name == "a"
        mains[id(node)] = int(node.name in MAIN)
        chars[id(node)] = 0 if link else sum(len(c.strip()) for c in node.children if isinstance(c, str))
        suspect = suspect or dropped(node, False)
        todo.extend((c, node, link) for c in node.children if not isinstance(c, str) and c.name not in NEVER_MAIN)
    if not suspect:
        return frozenset()
    for node, above in reversed(order):
        if above is not None:
            chars[id(above)] += chars[id(node)]
            mains[id(above)] += mains[id(node)]
    all_mains, half = mains[id(root)], chars[id(root)] / 2
    found = set()
    for node, _ in order:
        at = id(node)
        if node.name in ("html", "body") or (all_mains and mains[at] == all_mains and node.name not in MAIN):
            found.add(at)
        elif not all_mains and chars[at] > half and (node.name == "form" or node.name not in DROPPED | {"header"}):
            found.add(at)
    return frozenset(found)


def signature(node: Node) -> str:
    """Name and mark; numbers in a mark (``post-17``) are all the same."""
    return f"{node.name}.{_DIGITS.sub('0', node.mark)}" if node.mark else node.name


@lru_cache(1 << 16)
def _hash(above: int, what: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{above} {what}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


#: Slots of text outside every block element.
NOWHERE = (0,)


class Outline:
    """A block element of a tree: its signature and the block elements below it, inline elements left out."""

    __slots__ = ("sign", "children", "node", "key", "weight", "slot", "own")

    def __init__(self, sign: str, children: list, node: Node | None = None):
        self.sign, self.children, self.node = sign, children, node
        self.key = hash((sign, *(c.key for c in children)))
        self.weight = 3 + sum(c.weight for c in children)
        self.slot = self.own = 0


def outline(root: Node) -> Outline:
    order, todo = [], [(root, None)]
    while todo:
        node, above = todo.pop()
        if node is root or node.name in BLOCK:
            order.append((node, above))
            above = node
        todo.extend((c, above) for c in reversed(node.children) if not isinstance(c, str) and c.name not in RAW)
    below: dict[int, list[Outline]] = {}
    for node, above in reversed(order):
        made = Outline(signature(node), below.pop(id(node), [])[::-1], node)
        below.setdefault(id(above), []).append(made)
    return made


def _plain(tree: Outline) -> list:
    """Nested lists of signatures, to a depth that JSON can nest."""
    return _cut(tree, MOST_LEVELS)


def _cut(tree: Outline, levels: int) -> list:
    return [tree.sign, [_cut(c, levels - 1) for c in tree.children] if levels else []]


def _anchor(plain: list, above: int = 0) -> Outline:
    tree = Outline(plain[0], [_anchor(c) for c in plain[1]])
    if not above:
        _name_slots(tree, {})
    return tree


def _name_slots(tree: Outline, aligned: dict[int, int]) -> None:
    """Give every element its slot: of the anchor's element it is aligned with, else below its parent's by its own signature."""
    todo = [(tree, 0, 0)]
    while todo:
        x, above, own = todo.pop()
        x.own = _hash(own, x.sign)
        x.slot = aligned.get(id(x)) or _hash(above, x.sign)
        todo.extend((c, x.slot, x.own) for c in x.children)


def _same_name(a: Outline, b: Outline) -> bool:
    return a.sign == b.sign or a.sign.split(".", 1)[0] == b.sign.split(".", 1)[0]


def match(a: Outline, b: Outline, levels: int = MOST_LEVELS) -> tuple[int, list[tuple[Outline, Outline]]]:
    """Simple tree matching: the score of the best order-keeping alignment, and its pairs.

    Elements of one name may be aligned (2), better with the same mark (3). Equal
    subtrees at either end of the siblings belong together in a best alignment.
    """
    if a.key == b.key:
        pairs, todo = [], [(a, b)]
        while todo:
            x, y = todo.pop()
            pairs.append((x, y))
            todo.extend(zip(x.children, y.children))
        return a.weight, pairs
    if not _same_name(a, b):
        return 0, []
    total, pairs = 3 if a.sign == b.sign else 2, [(a, b)]
    xs, ys = (a.children, b.children) if levels else ([], [])
    lo, hi = 0, 0
    while lo < min(len(xs), len(ys)) and xs[lo].key == ys[lo].key:
        lo += 1
    while hi < min(len(xs), len(ys)) - lo and xs[-1 - hi].key == ys[-1 - hi].key:
        hi += 1
    for x, y in [*zip(xs[:lo], ys[:lo]), *(zip(xs[-hi:], ys[-hi:]) if hi else ())]:
        got = match(x, y)
        total += got[0]
        pairs += got[1]
    xs, ys = xs[lo : len(xs) - hi], ys[lo : len(ys) - hi]
    if not xs or not ys or len(xs) * len(ys) > MOST_PAIRS:
        return total, pairs
    score = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    kept: dict[tuple[int, int], tuple[int, list]] = {}
    for i, x in enumerate(xs, 1):
        for j, y in enumerate(ys, 1):
            got = kept[i, j] = match(x, y, levels - 1)
            score[i][j] = max(score[i - 1][j], score[i][j - 1], score[i - 1][j - 1] + got[0])
    i, j = len(xs), len(ys)
    while i and j:
        if kept[i, j][0] and score[i][j] == score[i - 1][j - 1] + kept[i, j][0]:
            pairs += kept[i, j][1]
            i, j = i - 1, j - 1
        elif score[i][j] == score[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return total + score[-1][-1], pairs


def propose(pages: list[str]) -> list:
    """Anchor trees of distinct pages of one host, one for each layout."""
    found: list[tuple[Outline, list]] = []
    for page in pages:
        tree = outline(parse(page))
        if all(match(tree, other)[0] < SAME_LAYOUT * min(tree.weight, other.weight) for other, _ in found):
            found.append((tree, _plain(tree)))
    return [plain for _, plain in found]


def _slots(root: Node, anchors: list[Outline]) -> dict[int, tuple[int, ...]]:
    """The slots of each block element of a page, by the node's id: that of its own path, and the anchor's (kept apart, as other layouts may be aligned with it too)."""
    tree = outline(root)
    best, pairs = 0, []
    for anchor in anchors:
        got = match(tree, anchor)
        if got[0] > best:
            best, pairs = got
    _name_slots(tree, {id(x): y.slot for x, y in pairs})
    found, todo = {}, [tree]
    while todo:
        x = todo.pop()
        found[id(x.node)] = (x.own, _hash(x.slot, "#aligned")) if pairs else (x.own,)
        todo.extend(x.children)
    return found


def _regions(root: Node, wanted: int | None, slots: dict[int, tuple[int, ...]], kept: frozenset[int]) -> list[Node]:
    """The outermost elements that hold the main text: those in the wrapper's slot, else any article or main element."""
    named, on_path, todo = [], [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        hit = node.name in MAIN
        if hit and not inside:
            named.append(node)
            if wanted in slots.get(id(node), NOWHERE):
                on_path.append(node)
        todo.extend((c, inside or hit) for c in reversed(node.children) if not isinstance(c, str) and not dropped(c, inside or hit, kept))
    return on_path or named


def _lines(regions: list[Node], slots: dict[int, tuple[int, ...]], inside_main: bool, kept: frozenset[int]) -> list[tuple[tuple[int, ...], str, bool]]:
    """The lines of text of ``regions``, each with the slots of the block element it stands in and whether that is a heading."""
    lines: list[tuple[tuple[int, ...], str, bool]] = []
    held: list[str] = []

    def end_line(slot: tuple[int, ...], heading: bool = False):
        line = " ".join("".join(held).split())
        held.clear()
        if line:
            lines.append((slot, line, heading))

    for region in regions:
        slot = slots.get(id(region), NOWHERE)
        todo: list = [(region, slot, inside_main)]
        while todo:
            item, above, inside = todo.pop()
            if item is None:
                end_line(above, inside)
            elif isinstance(item, str):
                held.append(item)
            elif item.name == "br":
                held.append(" ")
            elif item is region or not dropped(item, inside, kept):
                own = above
                if item.name in BLOCK:
                    end_line(above)
                    own = slots.get(id(item), above)
                    todo.append((None, own, item.name in HEADINGS))
                todo.extend((c, own, inside or item.name in MAIN) for c in reversed(item.children))
        end_line(slot)
    return lines


def _main_slot(slot: int) -> int:
    return _hash(slot, "#main")


def observe(page: str | None, anchors: list[Outline]) -> list[tuple[int, int, int]]:
    """What a page tells of its host's wrapper: ``(slot, entry, chars)``.

    Entry 0 says that the page has the slot, any other that a line (or, with no
    characters, the whole text of an article or main element) stands there; 1
    counts the characters of such an element.
    """
    if not page:
        return []
    root = parse(page)
    slots, kept = _slots(root, anchors), kept_anyway(root)
    regions = _regions(root, None, slots, kept)
    found: set[tuple[int, int, int]] = set()
    chars: Counter = Counter()
    for region in regions or [root]:
        lines = _lines([region], slots, bool(regions), kept)
        for both, line, _ in lines:
            for slot in both:
                found |= {(slot, 0, 0), (slot, _hash(slot, line), len(line))}
        whole = "\n".join(line for _, line, _ in lines)
        for slot in slots.get(id(region), NOWHERE) if regions else ():
            at = _main_slot(slot)
            chars[slot] += len(whole)
            found |= {(at, 0, 0), (at, _hash(at, whole), 0)}
    return [*found, *((slot, 1, n) for slot, n in chars.items())]


def is_constant(n, pages) -> bool:
    """Whether ``n`` of the ``pages`` that have a slot may make its line template (numbers or columns)."""
    return (n >= WITNESSES) & (n >= CONSTANT_SHARE * pages)


def induce(pages: list[str]) -> dict:
    """The wrapper of distinct pages of one host, as ``extract_main_text`` finds it: ``{"anchors", "template", "mains"}``."""
    pages = sorted(set(pages))
    plain = propose(pages[:SAMPLE_PAGES])
    anchors = [_anchor(a) for a in plain]
    n: Counter = Counter()
    mains: Counter = Counter()
    seen = [observe(page, anchors) for page in pages]
    for told in seen:
        for slot, entry, chars in told:
            if entry == 1:
                mains[slot] += chars
            else:
                n[slot, entry] += 1
    constant = {(slot, entry) for (slot, entry), k in n.items() if entry and is_constant(k, n[slot, 0])}
    witnesses: Counter = Counter()
    for told in seen:
        lines = [(slot, entry, chars) for slot, entry, chars in told if entry not in (0, 1)]
        own = sum(chars for slot, entry, chars in lines if n[slot, entry] == 1)
        if own > 0 and own >= OWN_SHARE * sum(chars for _, _, chars in lines):
            witnesses.update((slot, entry) for slot, entry, chars in lines if chars and (slot, entry) in constant)
    template, constant = sorted({entry for (_, entry), k in witnesses.items() if k >= WITNESSES}), {slot for slot, _ in constant}
    return {"anchors": plain, "template": template, "mains": [[k, v] for k, v in sorted(mains.items()) if _main_slot(k) not in constant]}


class Wrapper:
    """A host's wrapper, ready for its pages."""

    def __init__(self, found: dict | None = None):
        found = found or {}
        self.anchors = [_anchor(a) for a in found.get("anchors", ())]
        self.template = frozenset(found.get("template", ()))
        self.main = max(found.get("mains") or (), key=lambda m: (m[1], m[0]), default=(None, 0))[0]


def extract(page: str | None, wrapper: dict | Wrapper | None = None) -> str:
    """The main text of ``page``, its blocks joined by line feeds."""
    if not page:
        return ""
    w = wrapper if isinstance(wrapper, Wrapper) else Wrapper(wrapper)
    root = parse(page)
    kept = kept_anyway(root)
    regions = _regions(root, None, {}, kept)
    slots = _slots(root, w.anchors) if w.template or len(regions) > 1 else {}
    if len(regions) > 1:
        regions = _regions(root, w.main, slots, kept)
    lines = _lines(regions or [root], slots, bool(regions), kept)
    left: list[str] = []
    after = False  # whether the line after stays, from the last line on
    for both, line, heading in reversed(lines):
        template = bool(w.template) and any(_hash(slot, line) in w.template for slot in both)
        after = not template or (heading and after)
        if after:
            left.append(line)
    return "\n".join(reversed(left))


def _small(df: DataFrame, chars) -> DataFrame:
    """``df``, marked for a broadcast if it has no more than BROADCAST_CHARS."""
    return F.broadcast(df) if (df.agg(F.sum(chars)).first()[0] or 0) <= BROADCAST_CHARS else df


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """Add ``text string, n_chars long`` to every row of ``pages``.

    Whole pages are read; null and empty pages have an empty text. Pages
    without a host are read without a wrapper. ``sample_pages`` distinct pages
    of a host, those whose text hashes lowest, propose its anchor trees; its
    lines are counted over all its distinct pages, with partial sums. Repeated
    rows get equal results, columns named ``text`` or ``n_chars`` are replaced,
    all others stay; an empty table gives an empty result.

    The anchors and the wrappers (a short row for each host) meet the pages in
    a broadcast join when they are small, else in an equi-join on the host,
    whose hot hosts the adaptive skew join splits.
    """
    left = pages.drop("text", "n_chars", "__host", "__wrapper").withColumn("__host", F.nullif(host_of(F.col(url_col)), F.lit("")))
    read = left.where(F.col("__host").isNotNull() & (F.length(html_col) > 0)).select("__host", F.col(html_col).alias("__html"), F.xxhash64(html_col).alias("__id"))
    # ids of distinct pages are ranked, so copies take one place; copies of a chosen page meet in partial aggregates
    chosen = read.select("__host", "__id").distinct().withColumn("__rn", F.row_number().over(W.partitionBy("__host").orderBy("__id"))).where(F.col("__rn") <= sample_pages).drop("__rn")
    chosen = stored(chosen, "chosen")
    sample = read.join(_small(chosen, F.length("__host") + 8), ["__host", "__id"]).groupBy("__host", "__id").agg(F.min("__html").alias("__html"))

    def propose_host(pdf):
        import pandas as pd

        return pd.DataFrame({"__host": [pdf["__host"].iloc[0]], "__anchors": [json.dumps(propose(list(pdf.sort_values("__id")["__html"])), separators=(",", ":"))]})

    anchors = stored(sample.groupBy("__host").applyInPandas(propose_host, "__host string, __anchors string"), "anchors")

    def tell(batches):
        import pyarrow as pa

        known: dict[str, list[Outline]] = {}
        of = pa.list_(pa.struct([("slot", pa.int64()), ("entry", pa.int64()), ("chars", pa.int64())]))
        for b in batches:
            out, done = [], set()
            for host, page_id, page, plain in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist()):
                if plain not in known:
                    if len(known) > 1_000:
                        known = {}
                    known[plain] = [_anchor(a) for a in json.loads(plain)]
                # a copy in the same batch would say the same
                out.append([] if (host, page_id) in done else [dict(zip(("slot", "entry", "chars"), x)) for x in observe(page.as_py(), known[plain])])
                done.add((host, page_id))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, of)], names=["__host", "__id", "__seen"])

    told = read.join(_small(anchors, F.length("__host") + F.length("__anchors")), "__host").select("__host", "__id", "__html", "__anchors")
    told = told.mapInArrow(tell, "__host string, __id long, __seen array<struct<slot:long,entry:long,chars:long>>").where(F.size("__seen") > 0).dropDuplicates(["__host", "__id"])
    told = stored(told, "told")
    seen = told.select("__host", F.inline("__seen")).groupBy("__host", "slot", "entry").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")).where("n >= 2 or entry in (0, 1)")
    seen = stored(seen, "seen")
    total = seen.where("entry = 0").select("__host", "slot", F.col("n").alias("pages"))
    shared = seen.where("entry not in (0, 1)").join(total, ["__host", "slot"]).select("__host", "slot", "entry", "chars", is_constant(F.col("n"), F.col("pages")).alias("constant"))
    # only hosts with constant lines are looked at again; lines that no other page has are not in the table
    again = told.join(shared.where("constant").select("__host").distinct(), "__host", "left_semi").select("__host", "__id", F.inline("__seen")).where("entry not in (0, 1)")
    again = again.join(shared.drop("chars"), ["__host", "slot", "entry"], "left")
    own = F.sum(F.when(F.col("constant").isNull(), F.col("chars")).otherwise(0))
    lines = F.collect_set(F.when(F.col("constant") & (F.col("chars") > 0), F.struct("slot", "entry")))  # a page's own: bounded by the page
    witness = again.groupBy("__host", "__id").agg(F.sum("chars").alias("chars"), own.alias("own"), lines.alias("lines")).where(f"own > 0 and own >= {OWN_SHARE} * chars")
    constant = witness.select("__host", F.inline("lines")).groupBy("__host", "slot", "entry").agg(F.count(F.lit(1)).alias("witnesses")).where(f"witnesses >= {WITNESSES}")
    constant = stored(constant, "constant")
    # whole articles have no characters of their own here
    fixed = shared.where("constant and chars = 0").groupBy("__host").agg(F.collect_set("slot").alias("__fixed"))
    by_host = constant.groupBy("__host").agg(F.to_json(F.sort_array(F.collect_set("entry"))).alias("__template")).join(fixed, "__host", "full")
    main_slot = F.udf(lambda slot: _main_slot(slot), "long")
    mains = seen.where("entry = 1").groupBy("__host").agg(F.collect_list(F.struct("slot", main_slot("slot").alias("at"), "chars")).alias("__mains"))
    free = F.filter("__mains", lambda m: ~F.coalesce(F.array_contains("__fixed", m["at"]), F.lit(False)))
    wrappers = anchors.join(by_host, "__host", "left").join(mains, "__host", "left").select(
        F.col("__host").alias("__host2"),
        F.concat(
            F.lit('{"anchors":'), "__anchors", F.lit(',"template":'), F.coalesce("__template", F.lit("[]")),
            F.lit(',"mains":'), F.coalesce(F.to_json(F.transform(free, lambda m: F.array(m["slot"], m["chars"]))), F.lit("[]")), F.lit("}"),
        ).alias("__wrapper"),
    )
    wrappers = stored(wrappers, "wrappers")
    joined = left.join(_small(wrappers, F.length("__host2") + F.length("__wrapper")), F.col("__host") == F.col("__host2"), "left").drop("__host", "__host2")
    at, wrapper_at = joined.columns.index(html_col), joined.columns.index("__wrapper")
    keep = [i for i, c in enumerate(joined.columns) if c != "__wrapper"]
    schema = T.StructType([*(joined.schema.fields[i] for i in keep), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        import pyarrow as pa

        known: dict[str | None, Wrapper] = {}
        for b in batches:
            out = []
            for page, wrapper in zip(b.column(at), b.column(wrapper_at).to_pylist()):
                if wrapper not in known:
                    if len(known) > 1_000:
                        known = {}
                    known[wrapper] = Wrapper(json.loads(wrapper) if wrapper else None)
                out.append(extract(page.as_py(), known[wrapper]))
            columns = [*(b.column(i) for i in keep), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(b.schema.names[i] for i in keep), "text", "n_chars"])

    return joined.mapInArrow(run, schema)


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars")
