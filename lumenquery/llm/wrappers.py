"""Main text of web pages by wrappers inferred for each host.

A page is a stream of tags and texts, nested by its tags. Adjacent like elements fold into repeated
groups. The folded streams of a host are aligned one after the other, level by level: equal tags
match and are aligned inside, differing texts become slots, and what only one side has becomes
optional. The result is a union-free regular expression with, for every slot, how much text it held
and whether that text ever varied. Alignment can be done in any grouping, so every task aligns the
pages that it reads and the tasks' wrappers are aligned in a tree: all pages of a host take part.
The wrapper then tells, once for the host, which of its parts hold the article: the region of the
variable text, without parts that name themselves as menus, adverts, forms, comments and the like,
and without parts at the region's edges whose text never varies. Every page is read by matching it
against the wrapper and emitting the slots of those parts.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lumenquery.llm.frames import map_batches, texts
from lumenquery.session import Scratch

TEMPLATE_PAGES = 5  # different pages that must agree on a text before it counts as template
BROADCAST_BYTES = 32_000_000  # wrappers up to this size travel to every task, more are joined
HELD_BYTES = 64_000_000  # wrappers that a task holds while it aligns; beyond, it hands them on and starts anew
GROUPS = 64  # groups in which the tasks' wrappers of a host are aligned before the last alignment
PERIOD = 8  # elements of a group that is found to repeat at most
DEEPEST = 200  # levels of nesting that stay apart; what lies deeper is read as part of its ancestor there
TABLE = 1 << 18  # cells up to which children are aligned by the full table, beyond by their longest common runs

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+)>|/?[a-zA-Z!?][^>]*>)""", re.DOTALL)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
# elements by their meaning in the HTML standard (fixed values)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe object svg math textarea select title head".split())
ASIDE = frozenset("nav aside footer form button header menu dialog fieldset".split())
INLINE = frozenset("a abbr b bdi bdo br cite code data dfn em font i ins del kbd label mark q s samp small span strong sub sup time tt u var wbr img".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_ASIDE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsored|sponsor|promo|banner|cookies?|consent|gdpr|notices?|newsletter|subscribe|signup|login|"
    r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|header|masthead|topbar|toolbar|pagination|pager|comments?|commentlist|disqus|replies|respond)(?:$|[\s_-])",
    re.IGNORECASE,
)
# what an opening tag ends (HTML standard, fixed values)
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table select".split())


def _names(attrs: str) -> str:
    """class, id, role and itemprop of a tag, space-separated."""
    if "=" not in attrs:
        return ""
    return " ".join(a or b or c for _, a, b, c in _ATTR.findall(attrs)).strip()


def stream(page: str):
    """(kind, name, value) tokens: ("o", tag, names), ("c", tag, ""), ("t", "", text).

    Comments, declarations and the content of raw elements are left out; text is not yet decoded.
    """
    at = 0
    find = _TAG.search
    while True:
        m = find(page, at)
        if m is None:
            if at < len(page):
                yield "t", "", page[at:]
            return
        if m.start() > at:
            yield "t", "", page[at : m.start()]
        at = m.end()
        name = m.group("name")
        if name is None:
            continue
        name = name.lower()
        if m.group("close"):
            yield "c", name, ""
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.IGNORECASE).search(page, at) if name != "head" else re.compile(r"</head\s*>|(?=<body[\s>])", re.IGNORECASE).search(page, at)
            if end is None and name == "head":
                continue
            at = end.end() if end else len(page)
        else:
            yield "o", name, _names(m.group("attrs"))


def is_aside(name: str, names: str) -> bool:
    """Whether an element says that it is no part of an article."""
    return name in ASIDE or bool(names and _ASIDE_NAME.search(names))


def tree(page: str) -> list:
    """The page's root [key, children]: keys are "tag names", children texts (str) or elements; inline tags leave their text.

    Open paragraphs, items and cells end where the HTML standard ends them; a closing tag without an
    open element is left out.
    """
    root: list = ["", []]
    stack = [root]
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            stack[-1][1].append(text)

    for kind, name, value in stream(page):
        if kind == "t":
            run.append(html.unescape(value))
            continue
        if name in INLINE:
            if name == "br":
                run.append(" ")
            continue
        flush()
        if kind == "o":
            if name in _ENDS_P and stack[-1][0].split(" ")[0] == "p":
                stack.pop()
            for back in range(len(stack) - 1, 0, -1):
                tag = stack[back][0].split(" ")[0]
                if tag in _ENDS.get(name, ()):
                    del stack[back:]
                elif tag in _SCOPE:
                    break
            element = [f"{name} {value}".rstrip(), []]
            if len(stack) > DEEPEST:
                element[1] = stack[-1][1]  # its texts are its ancestor's
            else:
                stack[-1][1].append(element)
            if name not in VOID:
                stack.append(element)
        else:
            for back in range(len(stack) - 1, 0, -1):
                if stack[back][0].split(" ")[0] == name:
                    del stack[back:]
                    break
    flush()
    return root


# ---- inference: a wrapper item is [key, kids, many, optional, chars, text]; the key of texts is "#",
# of repeated groups of several elements "(", joined keys. text is a slot's only text, None once it varied.


def _item(key: str, kids: list, chars: int = 0, text: str | None = None) -> list:
    return [key, kids, False, False, chars, text]


def _merge(a: list, b: list) -> list:
    """Two items of one key as one."""
    return [a[0], _aligned(a[1], b[1]), a[2] or b[2], a[3] or b[3], a[4] + b[4], a[5] if a[5] == b[5] else None]


def _optional(item: list) -> list:
    return [*item[:3], True, *item[4:]]


def _pairs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of keys; of very long ones by their longest common runs."""
    if len(a) * len(b) > TABLE:
        return [(m.a + i, m.b + i) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() for i in range(m.size)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _aligned(a: list[list], b: list[list]) -> list[list]:
    """Two sequences of items as one: matches are merged, the rest becomes optional; repeats fold again."""
    left, right = [x[0] for x in a], [x[0] for x in b]
    if left == right:
        return [_merge(x, y) for x, y in zip(a, b, strict=True)]
    out: list[list] = []
    i = j = 0
    for x, y in [*_pairs(left, right), (len(a), len(b))]:
        out += [_optional(item) for item in a[i:x]]
        out += [_optional(item) for item in b[j:y]]
        if x < len(a):
            out.append(_merge(a[x], b[y]))
        i, j = x + 1, y + 1
    return _folded(out)


def _folded(items: list[list]) -> list[list]:
    """Runs of one key, and adjacent repeats of a few keys, as repeated items."""
    out: list[list] = []
    for item in items:
        if out and out[-1][0] == item[0] != "#":
            out[-1] = [*_merge(out[-1], item)[:2], True, out[-1][3] and item[3], out[-1][4] + item[4], None]
        else:
            out.append(item)
    for width in range(2, min(PERIOD, len(out) // 2) + 1):
        keys, at = [x[0] for x in out], 0
        while at + 2 * width <= len(out):
            square = keys[at : at + width]
            runs = 1
            while keys[at + runs * width : at + (runs + 1) * width] == square:
                runs += 1
            if runs > 1 and "#" not in square:
                kids = out[at : at + width]
                for r in range(1, runs):
                    kids = [_merge(x, y) for x, y in zip(kids, out[at + r * width : at + (r + 1) * width], strict=True)]
                out[at : at + runs * width] = [["( " + " ".join(square), kids, True, False, 0, None]]
                keys = [x[0] for x in out]
            at += 1
    return out


def _pattern(element: list) -> list:
    """A page's element as a wrapper item."""
    kids = [_item("#", [], len(k), k) if isinstance(k, str) else _pattern(k) for k in element[1]]
    return _item(element[0], _folded(kids))


def wrapper_of_page(page: str) -> dict:
    """The wrapper of a host with one page, and a mark of that page."""
    return {"root": _pattern(tree(page)), "marks": [zlib.crc32(page.encode("utf-8", "replace"))]}


def aligned(a: dict, b: dict) -> dict:
    """Two wrappers as one; marks are the least TEMPLATE_PAGES of the different pages."""
    return {"root": _merge(a["root"], b["root"]), "marks": sorted({*a["marks"], *b["marks"]})[:TEMPLATE_PAGES]}


def infer(pages: list[str]) -> dict:
    """The wrapper of pages, shorter ones first."""
    found: dict = {"root": _item("", []), "marks": []}
    for n, page in enumerate(sorted(set(pages), key=lambda p: (len(p), p))):
        one = wrapper_of_page(page)
        found = aligned(found, one) if n else one
    return found


def expression(item: list) -> str:
    """A wrapper as text: (...)+ repeated, (...)? optional, #PCDATA slots."""
    key, kids, many, optional, _, text = item
    inner = " ".join(expression(k) for k in kids)
    if key == "#":
        body = "#PCDATA" if text is None else text
    elif not key or key[0] == "(":
        body = inner
    else:
        body = " ".join(x for x in (f"<{key}>", inner, "" if key.split(" ")[0] in VOID else f"</{key.split(' ')[0]}>") if x)
    return f"({body})+" if many else f"({body})?" if optional else body


# ---- what a wrapper says about a host


def _aside(item: list) -> bool:
    name, _, names = item[0].partition(" ")
    return is_aside(name, names)


def _weight(item: list) -> int:
    """Characters of the texts that vary."""
    if item[0] == "#":
        return item[4] if item[5] is None else 0
    return 0 if _aside(item) else sum(_weight(k) for k in item[1])


def _chars(item: list) -> int:
    return item[4] if item[0] == "#" else 0 if _aside(item) else sum(_chars(k) for k in item[1])


def _every(item: list):
    yield item
    for k in item[1]:
        if not _aside(k):
            yield from _every(k)


def region_of(wrapper: dict) -> list | None:
    """The wrapper's item that holds the variable text.

    An article or main element that has any; else, from the root down, the child with most of the
    variable text while that is over 70 % of its parent's. Of a single page all text counts.
    """
    weight = _weight if _weight(wrapper["root"]) else _chars
    for tag in ("article", "main"):
        found = [x for x in _every(wrapper["root"]) if x[0].split(" ")[0] == tag and weight(x)]
        if found:
            return max(found, key=weight)
    at = wrapper["root"]
    while any(k[0] != "#" for k in at[1]):
        top = max(at[1], key=weight)
        if top[0] == "#" or weight(top) <= 0.7 * weight(at) or top[0].split(" ")[0] in ("p", *HEADINGS, "ul", "ol", "table"):
            break
        at = top
    return at if at[0].split(" ")[0] not in ("", "html", "body") else None


def _fixed(item: list) -> bool:
    """Whether an item has text and all of it is the same on every page that has it."""
    if item[0] == "#":
        return item[5] is not None
    return bool(item[1]) and not item[2] and all(_fixed(k) for k in item[1])


def template_of(region: list | None, marks: list[int]) -> list[list]:
    """Elements at the region's start and end whose text never varied, on enough different pages.

    Headings and loose texts stay; a region without variable text has no template.
    """
    if region is None or len(marks) < TEMPLATE_PAGES or not _weight(region):
        return []
    found: list[list] = []
    for kids in (region[1], region[1][::-1]):
        for k in kids:
            if not _fixed(k) or k[3] or k[0] == "#" or k[0].split(" ")[0] in HEADINGS:
                break
            found.append(k)
    return found


def reading(wrapper: dict) -> list:
    """What reading needs of a wrapper: [key, in, kids], parts that are all in or all out without kids.

    in is 1 for parts that hold the article and 0 for others. Without a region everything but asides
    is in.
    """
    region = region_of(wrapper)
    out = {id(x) for x in template_of(region, wrapper["marks"])}

    def go(item: list, inside: int) -> list:
        if item is region:
            inside = 1
        if inside and (id(item) in out or (item is not region and _aside(item))):
            return [item[0], 0, []]
        kids = []
        for k in item[1]:
            if k[0] == "#":
                continue
            if k[0][:1] == "(":  # a group's elements are matched like their neighbours
                kids += [go(x, inside) for x in k[1] if x[0] != "#"]
            else:
                kids.append(go(k, inside))
        if all(k[1] == inside and not k[2] for k in kids):
            kids = []
        return [item[0], inside, kids]

    return go(wrapper["root"], 0 if region is not None else 1)


def wrapper_of(pages: list[str]) -> dict:
    """A host's region (tag, names), template texts, expression, and what reading needs."""
    found = infer(pages)
    region = region_of(found)
    name, _, names = region[0].partition(" ") if region else ("", "", "")
    return {"region": (name, names) if region else None, "template": [expression(k) for k in template_of(region, found["marks"])], "expression": expression(found["root"]), "reading": reading(found)}


# ---- reading


def _emit(element: list, pattern: list | None, inside: int, out: list[str]) -> bool:
    """Add the texts of an element's parts that are in; whether any part that is in was met."""
    met = bool(inside)
    kids = pattern[2] if pattern else []
    at = 0
    for child in element[1]:
        if isinstance(child, str):
            if inside:
                out.append(child)
            continue
        # the next item of that key, or the first; an element that the wrapper lacks goes by its own tag
        place = next((i for i in range(at, len(kids)) if kids[i][0] == child[0]), None)
        if place is None:
            place = next((i for i in range(min(at, len(kids))) if kids[i][0] == child[0]), None)
        if place is None:
            name, _, names = child[0].partition(" ")
            met |= _emit(child, None, 0 if is_aside(name, names) else inside, out)
        else:
            at = place
            met |= _emit(child, kids[place], kids[place][1], out)
    return met


def main_text(page: str, read: list | None) -> str:
    """The texts of the wrapper's parts that hold the article, joined by line ends.

    A page on which none of these parts is found, or without a wrapper, gives its article, main or
    body element without asides.
    """
    root = tree(page)
    out: list[str] = []
    if read is not None and _emit(root, read, read[1], out):
        return "\n".join(out)
    return "\n".join(_plain(root))


def _plain(root: list) -> list[str]:
    """The texts of the article elements, else of main elements, else of the page, without asides."""

    def go(element: list, inside: bool, tag: str, out: list[str]) -> list[str]:
        for child in element[1]:
            if isinstance(child, str):
                if inside:
                    out.append(child)
            else:
                name, _, names = child[0].partition(" ")
                if not is_aside(name, names):
                    go(child, inside or name == tag, tag, out)
        return out

    def has(element: list, tag: str) -> bool:
        return any(not isinstance(c, str) and not is_aside(*c[0].partition(" ")[::2]) and (c[0].split(" ")[0] == tag or has(c, tag)) for c in element[1])

    tag = next((t for t in ("article", "main") if has(root, t)), "")
    return go(root, not tag, tag, [])


def host(url):
    """The host of a URL, lower-case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _partial(batches):
    """Wrappers of the pages that a task reads, one a host unless they get large; part tells tasks apart."""
    held: dict[str, dict] = {}
    size = 0

    def handed():
        rows = sorted(held.items())
        return pa.record_batch([pa.array([h for h, _ in rows], pa.string()), pa.array([json.dumps(w) for _, w in rows], pa.string())], names=["host", "wrapper"])

    for b in batches:
        for name, page in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
            one = wrapper_of_page(page)
            if name in held:
                held[name] = aligned(held[name], one)
            else:
                held[name] = one
                size += 2 * len(page)
        if size > HELD_BYTES:
            yield handed()
            held, size = {}, 0
    if held:
        yield handed()


def _align(table: pa.Table) -> pa.Table:
    found: dict | None = None
    for w in sorted(table["wrapper"].to_pylist(), key=lambda x: (len(x), x)):
        one = json.loads(w)
        found = one if found is None else aligned(found, one)
    return pa.table([table["host"][:1].combine_chunks().cast(pa.string()), pa.array([json.dumps(found)], pa.string())], names=["host", "wrapper"])


def _told(batches):
    for b in batches:
        found = [json.loads(w) for w in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array([json.dumps(reading(w)) for w in found], pa.string()), pa.array([expression(w["root"]) for w in found], pa.string())], names=["host", "reading", "expression"])


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, reading, expression) of every host, from all of its pages.

    Null html is an empty page, a null url belongs to the host without a name; repeated pages count
    as one for what is template; an empty table gives no rows.
    """
    slim = pages.select(host(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    parts = map_batches(slim, _partial, "host string, wrapper string")
    dealt = parts.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(GROUPS)))
    near = dealt.groupBy("host", "part").applyInArrow(lambda key, t: _align(t), "host string, wrapper string")
    whole = near.groupBy("host").applyInArrow(_align, "host string, wrapper string")
    return map_batches(whole, _told, "host string, reading string, expression string")


def _read(at: int, look):
    def run(batches):
        kept: dict[str, list | None] = {}
        for b in batches:
            out = []
            for page, w in zip(texts(b.column(at)), look(b), strict=True):
                if w not in kept:
                    if len(kept) > 10_000:
                        kept = {}
                    kept[w] = json.loads(w) if w else None
                out.append(main_text(page, kept[w]))
            yield pa.record_batch([*[b.column(i) for i in range(at)], pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=[*b.schema.names[:at], "text", "n_chars"])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text (its main text, empty if none), n_chars.

    Null html has no text; a null url belongs to the host without a name; repeated rows stay; an
    empty table gives no rows; other columns are ignored. Of equally heavy regions the first is
    taken. Wrappers are sent to every task if they are small together, otherwise they are joined by
    host.
    """
    short = Scratch(pages.sparkSession).store(wrappers(pages, url_col, html_col).select("host", "reading"))
    slim = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias(url_col), host(F.col(url_col)).alias("__host"), F.coalesce(F.col(html_col), F.lit("")).alias("__html"))
    kinds = f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, `{url_col}` string, text string, n_chars long"
    size = short.agg(F.coalesce(F.sum(F.length("host") + F.length("reading")), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        shared = pages.sparkSession.sparkContext.broadcast({r.host: r.reading for r in short.collect()})
        plan = slim.select(id_col, url_col, "__html", "__host")
        return map_batches(plan, _read(2, lambda b: [shared.value.get(h) for h in b.column(3).to_pylist()]), kinds)
    plan = slim.join(short.withColumnRenamed("host", "__host"), "__host", "left").select(id_col, url_col, "__html", "reading")
    return map_batches(plan, _read(2, lambda b: b.column(3).to_pylist()), kinds)
