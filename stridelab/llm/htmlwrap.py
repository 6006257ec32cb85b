"""Main text of web pages by wrappers inferred per host.

A wrapper is a union-free regular expression over a page's tags and texts. It
is inferred from all pages of a host: repeated runs of a page are folded into
groups, pages of one structure are joined text by text, structures are aligned
one after another, and what does not align becomes an optional group, repeated
runs of different lengths one repeated group, and texts that differ a text
slot; texts that never differ are template. The main region is where the slots are: from the root, the element
with most of the slots' text is entered for as long as there is one. Each text
of the wrapper is marked as main text or not, and pages are read along their
host's wrapper; where a page leaves it, by the wrapper's main region. Names of
tags and classes weigh in where regions are compared, and tell what is set
apart inside the main region.
"""

from __future__ import annotations

import html as entities
import json
import pickle
import re
from bisect import bisect_left
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, free_name
from .urlfilter import host_of

#: Structures of a host that are aligned in one task; those of hosts with more go through several rounds.
FAN = 32
#: Texts that a task holds for pages' structures before it hands them on.
HELD_TEXTS = 1 << 19
#: Levels of groups in a wrapper, beyond which optional groups stand beside each other.
DEEP = 32
#: Nodes from which pages are aligned by their rarer tags first.
MANY_NODES = 2_000
#: What a region's text counts for if its elements are by name boilerplate or main, and the share of it that leads into an element.
BOILER_WEIGHT, MAIN_WEIGHT, MOST = 0.25, 4.0, 0.6
#: Pages that occur more than once (a host name and a number each) up to which all tasks are told of them.
BROADCAST_MARKS = 500_000
#: Characters of all wrappers together up to which they are sent to every task.
BROADCAST_CHARS = 16_000_000

# HTML element classes.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_RAW = frozenset("script style".split())
_BOILER_TAGS = frozenset("head title nav header footer aside form button select option textarea noscript template iframe object svg menu dialog script style".split())
_MAIN_TAGS = frozenset("article main".split())
_BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side menu nav navbar navigation breadcrumb breadcrumbs header masthead footer foot comment comments reply replies respond disqus cookie cookies consent gdpr notice notices alert popup modal overlay share sharing social related recommended widget newsletter subscribe subscription signup login search pagination pager toolbar copyright legal".split()
)
#: Of an article's own classes only these tell that it is none; and none of an element's that says what it has or lacks.
_NO_ARTICLE = frozenset("ad ads advert advertisement comment comments reply replies response promo sponsored related recommended".split())
_QUALIFIERS = frozenset("has with without no".split())
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCKS_CLOSE_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+")


# --- tokens -----------------------------------------------------------------------------


def tokens(page: str) -> list[tuple]:
    """("o", tag, attributes), ("c", tag) and ("t", text), in one pass over the page."""
    out: list[tuple] = []
    at, n = 0, len(page)
    while at < n:
        mark = page.find("<", at)
        if mark < 0:
            out.append(("t", page[at:]))
            break
        if mark > at:
            out.append(("t", page[at:mark]))
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 4)
            at = n if end < 0 else end + 3
            continue
        m = _TAG.match(page, mark)
        if not m:
            following = page[mark + 1 : mark + 2]
            if following in ("!", "?", "/") or following.isalpha():
                end = page.find(">", mark)
                at = n if end < 0 else end + 1
            else:  # a mark that opens no tag is text
                out.append(("t", "<"))
                at = mark + 1
            continue
        tag = m[2].lower()
        at = m.end()
        if m[1]:
            out.append(("c", tag))
            continue
        out.append(("o", tag, _attributes(m[3])))
        if tag in _RAW and not m[3].endswith("/"):
            end = re.compile(f"</{tag}", re.I).search(page, at)
            at = end.start() if end else n
    return out


def _attributes(text: str) -> str:
    """Class, id and role as they tell templates apart, without digits."""
    if "=" not in text:
        return ""
    found = []
    for m in _ATTRIBUTE.finditer(text):
        value = " ".join(_WORDS.findall((m[2] or m[3] or m[4] or "").lower()))
        if value:
            found.append(f"{m[1].lower()}={value}")
    return ";".join(sorted(found))


def _signature(token: tuple) -> str:
    if token[0] == "t":
        return "#"
    return f"</{token[1]}>" if token[0] == "c" else f"<{token[1]}>{token[2]}"


def _significant(token: tuple) -> bool:
    return token[0] != "t" or not token[1].isspace()


# --- where a text stands -------------------------------------------------------------------


def _boiler(tag: str, attributes: str) -> bool:
    if tag in _BOILER_TAGS:
        return True
    for part in attributes.split(";") if attributes else ():
        key, _, value = part.partition("=")
        words = set(value.split())
        telling = _BOILER_ROLES if key == "role" else _NO_ARTICLE if tag in _MAIN_TAGS else _BOILER_WORDS
        if words & telling and not words & _QUALIFIERS:
            return True
    return False


def _is_main(tag: str, attributes: str) -> bool:
    return tag in _MAIN_TAGS or "role=main" in attributes


_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol blockquote pre td tr tbody table".split()) | _INLINE
_HEADINGS = frozenset("h1 h2 h3".split())


class _Place:
    """The open elements along a token stream."""

    def __init__(self):
        #: (tag, label, whether a main element is open, depth of the innermost boilerplate element)
        self.stack: list[tuple[str, str, bool, int]] = []

    def open(self, tag: str, attributes: str) -> None:
        close = _CLOSES.get(tag)
        if close:
            for k in range(len(self.stack) - 1, max(-1, len(self.stack) - 8), -1):
                if self.stack[k][0] in close:
                    del self.stack[k:]
                    break
                if self.stack[k][0] not in _INLINE:
                    break
        elif tag in _BLOCKS_CLOSE_P:
            for k in range(len(self.stack) - 1, max(-1, len(self.stack) - 8), -1):
                if self.stack[k][0] == "p":
                    del self.stack[k:]
                    break
                if self.stack[k][0] not in _INLINE:
                    break
        if tag not in _VOID:
            above = self.stack[-1] if self.stack else ("", "", False, 0)
            boiler = _boiler(tag, attributes) and tag not in ("html", "body")
            self.stack.append((tag, f"{tag}.{attributes}" if attributes else tag, above[2] or _is_main(tag, attributes), len(self.stack) + 1 if boiler else above[3]))

    def close(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return

    def step(self, token: tuple) -> None:
        if token[0] == "o":
            self.open(token[1], token[2])
        elif token[0] == "c":
            self.close(token[1])

    @property
    def main(self) -> bool:
        return bool(self.stack) and self.stack[-1][2]

    @property
    def boiler(self) -> int:
        return self.stack[-1][3] if self.stack else 0

    def container(self) -> str:
        """The enclosing elements, from the outermost to the innermost that is no paragraph or inline."""
        n = len(self.stack)
        while n and self.stack[n - 1][0] in _LEAVES:
            n -= 1
        return "/".join(label for _, label, _, _ in self.stack[:n])

    def heading(self) -> bool:
        n = len(self.stack)
        while n and self.stack[n - 1][0] in _INLINE:
            n -= 1
        return n > 0 and self.stack[n - 1][0] in _HEADINGS


# --- inference ---------------------------------------------------------------------------------
# A wrapper is a list of nodes: [signature] for a tag, ["#", constant or None, places, pages] for a
# text, ["+", nodes] for a repeated group and ["?", nodes] for an optional one. The places of a text
# are (container, depth of the innermost boilerplate element, in main, in a heading, inline) on the
# pages it was seen on, with its characters there.


def _key(node: list) -> str:
    if node[0] in "+?":
        return node[0] + _key(node[1][0])
    return node[0]


def _fold(nodes: list[list]) -> list[list]:
    """Fold neighbouring equal runs into repeated groups, short runs first, until none is left."""
    changed = True
    while changed:
        changed = False
        keys = [_deep_key(x) for x in nodes]
        size = 0
        while (size := _next_repeat(keys, size)) is not None:
            out, out_keys, i = [], [], 0
            while i < len(nodes):
                run = keys[i : i + size]
                times = 1
                if len(run) == size and keys[i + size : i + 2 * size] == run and not (size == 1 and run[0][0] in "+#"):
                    while keys[i + times * size : i + (times + 1) * size] == run:
                        times += 1
                if times > 1:
                    group = nodes[i : i + size]
                    for t in range(1, times):
                        group = [_joined(a, b) for a, b in zip(group, nodes[i + t * size : i + (t + 1) * size], strict=True)]
                    node = group[0] if size == 1 and group[0][0] == "+" else ["+", group]
                    out.append(node)
                    out_keys.append(_deep_key(node))
                    i += times * size
                    changed = True
                else:
                    out.append(nodes[i])
                    out_keys.append(keys[i])
                    i += 1
            nodes, keys = out, out_keys
    return nodes


def _next_repeat(keys: list[str], after: int) -> int | None:
    """The next larger size at which a run is followed by itself."""
    numbers: dict[str, int] = {}
    ids = np.array([numbers.setdefault(k, len(numbers)) for k in keys], dtype=np.int64)
    for size in range(after + 1, len(ids) // 2 + 1):
        same = np.flatnonzero(np.r_[True, ids[size:] != ids[:-size], True])
        if (np.diff(same) > size).any():
            return size
    return None


def _deep_key(node: list) -> str:
    if node[0] in "+?":
        return f"({''.join(map(_deep_key, node[1]))}){node[0]}"
    return node[0]


def _joined(a: list, b: list, pages: bool = False) -> list:
    """Two nodes with equal keys as one: of two pages (texts that differ become a slot), or of one (texts in a row)."""
    if a[0] == "#":
        if pages:
            text = a[1] if a[1] == b[1] else None
        else:
            text = None if a[1] is None or b[1] is None else f"{a[1]}\0{b[1]}"
            if text and len(text) > 100:
                text = xxhash.xxh3_128_hexdigest(text.encode("utf-8", "replace"))
        places = dict(a[2])
        for place, chars in b[2].items():
            places[place] = places.get(place, 0) + chars
        return ["#", text, places, a[3] + b[3] if pages else max(a[3], b[3])]
    if a[0] in "+?":
        return [a[0], align(a[1], b[1])]
    return a


def _repeat_singles(nodes: list[list], groups: list[list]) -> list[list]:
    """Single runs that look like another page's repeated group, as groups of one."""
    for group in groups:
        want = [_deep_key(x) for x in group]
        size, out, i = len(want), [], 0
        while i < len(nodes):
            if nodes[i][0] not in "+?" and [_deep_key(x) for x in nodes[i : i + size]] == want:
                out.append(["+", nodes[i : i + size]])
                i += size
            else:
                out.append(nodes[i])
                i += 1
        nodes = out
    return nodes


def align(a: list[list], b: list[list]) -> list[list]:
    """One wrapper for both: what aligns is joined, the rest becomes optional groups."""
    repeated = lambda nodes: [x[1] for x in nodes if x[0] == "+"]
    a, b = _repeat_singles(a, repeated(b)), _repeat_singles(b, repeated(a))
    out: list[list] = []
    plain = lambda x: _key(x).lstrip("?") if x[0] == "?" else _key(x)
    for kind, a0, a1, b0, b1 in SequenceMatcher(None, [plain(x) for x in a], [plain(x) for x in b], autojunk=min(len(a), len(b)) > MANY_NODES).get_opcodes():
        if kind == "equal":
            for x, y in zip(a[a0:a1], b[b0:b1], strict=True):
                if x[0] == "?" or y[0] == "?":
                    inner_x, inner_y = _bare(x), _bare(y)
                    if _levels([*inner_x, *inner_y]) < DEEP:
                        out.append(["?", align(inner_x, inner_y)])
                    else:
                        out += [["?", inner_x], ["?", inner_y]]
                else:
                    out.append(_joined(x, y, True))
        else:
            for part in (a[a0:a1], b[b0:b1]):
                if part:
                    out.append(part[0] if len(part) == 1 and part[0][0] == "?" else ["?", part])
    return out


def _bare(node: list) -> list[list]:
    """What an optional group holds, or the node itself."""
    nodes = [node]
    while len(nodes) == 1 and nodes[0][0] == "?":
        nodes = nodes[0][1]
    return nodes


def _levels(nodes: list[list]) -> int:
    return max((1 + _levels(x[1]) for x in nodes if x[0] in "+?"), default=0)


def _held_text(text: str) -> str:
    """A text as it is compared with others: itself if it is short, else a digest."""
    return text if len(text) <= 32 else xxhash.xxh3_128_hexdigest(text.encode("utf-8", "replace"))


def _nodes(stream: list[tuple]) -> list[list]:
    """The nodes of a page's significant tokens."""
    place, out, known = _Place(), [], {}
    for token in stream:
        if token[0] == "t":
            text, container = token[1].strip(), place.container()
            inline = bool(place.stack) and place.stack[-1][0] in _INLINE
            out.append(["#", _held_text(text), {(known.setdefault(container, container), place.boiler, place.main, place.heading(), inline): len(text)}, 1])
        else:
            out.append([_signature(token)])
            place.step(token)
    return out


class Structures:
    """Pages of a host in as few node lists as they have structures.

    Pages with the same tags are joined text by text as they come, so only one
    of them is folded; those that fold alike are joined in turn. Neither
    depends on the pages' order.
    """

    def __init__(self):
        self.held: dict[tuple[str, str], tuple[list[list], list[list]]] = {}
        self.texts = 0

    def add(self, host: str, page: str) -> None:
        stream = [t for t in tokens(page) if _significant(t)]
        key = host, xxhash.xxh3_128_hexdigest("\n".join(map(_signature, stream)).encode("utf-8", "replace"))
        if key not in self.held:
            nodes = _nodes(stream)
            self.held[key] = nodes, [x for x in nodes if x[0] == "#"]
            self.texts += len(self.held[key][1]) + 1
            return
        for node, token in zip(self.held[key][1], (t for t in stream if t[0] == "t"), strict=True):
            text = token[1].strip()
            if node[1] is not None and node[1] != _held_text(text):
                node[1] = None
            (place,) = node[2]
            node[2][place] += len(text)
            node[3] += 1

    def folded(self) -> Iterator[tuple[str, str, list[list]]]:
        """(host, key of the structure, nodes), and forget them."""
        found: dict[tuple[str, str], list[list]] = {}
        for (host, _), (nodes, _) in self.held.items():
            nodes = _fold(nodes)
            key = host, xxhash.xxh3_128_hexdigest("".join(map(_deep_key, nodes)).encode("utf-8", "replace"))
            found[key] = _alike(found[key], nodes) if key in found else nodes
        self.held, self.texts = {}, 0
        for (host, key), nodes in found.items():
            yield host, key, nodes


def _alike(a: list[list], b: list[list]) -> list[list]:
    """Nodes of one structure as one, text by text."""
    return [[x[0], _alike(x[1], y[1])] if x[0] in "+?" else _joined(x, y, True) for x, y in zip(a, b, strict=True)]


def _pages(nodes: list[list]) -> int:
    return max((x[3] for x in _texts(nodes)), default=0)


def aligned(structures: list[tuple[str, list[list]]]) -> list[list]:
    """One wrapper for the structures (key, nodes): first those of most pages."""
    wrapper: list[list] | None = None
    for _, nodes in sorted(structures, key=lambda s: (-_pages(s[1]), s[0])):
        wrapper = nodes if wrapper is None else _fold(align(wrapper, nodes))
    return wrapper or []


def infer(pages: list[str], boiler_weight: float = BOILER_WEIGHT) -> str:
    """The wrapper of pages, with a mark for each text and its main region, as JSON."""
    found = Structures()
    for page in pages:
        found.add("", page)
    return marked_wrapper(aligned([(key, nodes) for _, key, nodes in found.folded()]), boiler_weight)


def marked_wrapper(wrapper: list[list], boiler_weight: float = BOILER_WEIGHT) -> str:
    """A wrapper with a mark for each text and its main region, as JSON."""
    chosen = _main_region(list(_texts(wrapper)), boiler_weight)
    places: dict[tuple[str, int], int] = {}

    def marked(nodes: list[list]) -> list:
        out: list = []
        for node in nodes:
            if node[0] == "#":
                # What is the same on three pages or more is template, unless the pages call it main or it is part of a line.
                # Where pages have a text in different places, each page's own place tells.
                container, boiler, main, _, inline = next(iter(node[2]))
                if chosen is None or len(node[2]) > 1:
                    out.append(["#", None])
                else:
                    place = places.setdefault((container, boiler), len(places))
                    out.append(["#", int(_inside(container, boiler, chosen) and (main or inline or not _template(node))), place])
            elif node[0] in "+?":
                out.append([node[0], marked(node[1])])
            else:
                out.append(node[0])
        return out

    return json.dumps({"nodes": marked(wrapper), "places": list(places), "region": chosen}, ensure_ascii=False, separators=(",", ":"))


def _main_region(texts: list[list], boiler_weight: float) -> str | None:
    """The container of the slots: from the root, each time into the element with most of their text.

    The way ends where text is spread over several elements, or beside a
    heading that changes from page to page.
    """
    mass: dict[str, float] = {}
    headed: set[str] = set()
    for (container, boiler, main, heading, _), chars in (place for text in texts if not _template(text) for place in text[2].items()):
        weight = chars * (boiler_weight if boiler else MAIN_WEIGHT if main else 1.0)
        if heading and not boiler:
            headed.add(container)
        parts = container.split("/") if container else []
        for k in range(len(parts) + 1):
            path = "/".join(parts[:k])
            mass[path] = mass.get(path, 0.0) + weight
    if not mass.get(""):
        return None
    below: dict[str, list[str]] = {}
    for path in mass:
        if path:
            below.setdefault(path.rpartition("/")[0], []).append(path)
    here = ""
    while here in below and here not in headed:
        most = max(sorted(below[here]), key=lambda p: mass[p])
        if mass[most] < MOST * mass[here]:
            break
        here = most
    return here


def _inside(container: str, boiler: int, region: str) -> bool:
    """Whether a text is in the region, and in no boilerplate element inside of it."""
    return (not region or container == region or container.startswith(region + "/")) and boiler <= (region.count("/") + 1 if region else 0)


def _template(text: list) -> bool:
    return text[1] is not None and text[3] > 2


def _texts(nodes: list[list]) -> Iterator[list]:
    for node in nodes:
        if node[0] == "#":
            yield node
        elif node[0] in "+?":
            yield from _texts(node[1])


# --- extraction ------------------------------------------------------------------------------------


def _first(node) -> str:
    while not isinstance(node, str):
        if node[0] == "#":
            return "#"
        node = node[1][0]
    return node


def _follow(nodes: list, signs: list[str], at: int, marks: dict[int, list]) -> int | None:
    """Read signs along nodes from ``at``; the position behind, or None where they part."""
    for node in nodes:
        if isinstance(node, str):
            if at >= len(signs) or signs[at] != node:
                return None
            at += 1
        elif node[0] == "#":
            if at >= len(signs) or signs[at] != "#":
                return None
            marks[at] = node
            at += 1
        else:
            first, times = _first(node), 0
            while at < len(signs) and signs[at] == first:
                trial: dict[int, list] = {}
                end = _follow(node[1], signs, at, trial)
                if end is None or end == at:
                    break
                marks.update(trial)
                at, times = end, times + 1
                if node[0] == "?":
                    break
            if node[0] == "+" and not times:
                return None
    return at


def _along(wrapper: dict, signs: list[str]) -> dict[int, list]:
    """The wrapper's texts for a page's, where the page follows its wrapper, node by node."""
    marks: dict[int, list] = {}
    places: dict[str, list[int]] = {}
    for i, sign in enumerate(signs):
        places.setdefault(sign, []).append(i)
    at = 0
    for node in wrapper["nodes"]:
        trial: dict[int, list] = {}
        end = _follow([node], signs, at, trial)
        if end is None and isinstance(node, str):  # go on where the page has this tag next, if anywhere
            ahead = places.get(node, [])
            k = bisect_left(ahead, at)
            end = ahead[k] + 1 if k < len(ahead) else None
        if end is not None:
            marks.update(trial)
            at = end
    return marks


def main_text(page: str | None, wrapper: dict | None) -> str:
    """The page's main text: blocks with single spaces inside, joined by one space.

    Without a wrapper, the page's own main elements tell, or everything that
    is no boilerplate by name. A page whose main elements have nothing in its
    wrapper's main region is read so, too; one without main elements that has
    nothing there is read by a wrapper of its own. Nor is a page left empty
    that has text by its own names.
    """
    if not page:
        return ""
    stream = tokens(page)
    kept = [i for i, t in enumerate(stream) if _significant(t)]
    along = _along(wrapper, [_signature(stream[i]) for i in kept]) if wrapper else {}
    marks = {kept[i]: m for i, m in along.items()}
    region = wrapper["region"] if wrapper else None
    has_main = any(t[0] == "o" and _is_main(t[1], t[2]) for t in stream)
    place, blocks, block = _Place(), [], []
    met = main_met = False
    for i, token in enumerate(stream):
        if token[0] == "t":
            node = marks.get(i)
            container = place.container() if region is not None else ""
            if region is not None and not token[1].isspace() and _inside(container, 0, region):
                met, main_met = True, main_met or place.main
            # A wrapper's text tells only of texts that stand where it does.
            if node is not None and node[1] is not None and wrapper["places"][node[2]] == [container, place.boiler]:
                inside = bool(node[1])
            elif region is not None:
                inside = _inside(container, place.boiler, region)
            else:
                inside = not place.boiler and (place.main or not has_main)
            if inside:
                block.append(entities.unescape(token[1]))
            continue
        place.step(token)
        if token[1] not in _INLINE:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    text = " ".join(" ".join(b.split()) for b in blocks if b and not b.isspace())
    if region is not None and has_main and not main_met:
        return main_text(page, None)
    if region is not None and not met:
        own = json.loads(infer([page], 0.0))
        return main_text(page, own if own["region"] != region else None)
    return text if text or wrapper is None else main_text(page, None)


# --- on Spark ------------------------------------------------------------------------------------------


def _distinct_pages(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, html) of every page with a text, copies within a host once; only pages that have copies are moved."""
    keyed = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).filter(F.length("html") > 0).withColumn("mark", F.xxhash64("html"))
    copied = checkpointed(keyed.groupBy("host", "mark").count().filter("count > 1").select("host", "mark"))
    few = F.broadcast(copied) if copied.count() <= BROADCAST_MARKS else copied
    once = keyed.join(few, ["host", "mark"], "left_anti")
    return once.unionByName(keyed.join(few, ["host", "mark"], "left_semi").dropDuplicates(["host", "mark"])).select("host", "html")


def _structures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, key, nodes) of the structures of a task's pages."""
    found = Structures()

    def rows() -> pd.DataFrame:
        return pd.DataFrame([(host, key, pickle.dumps(nodes)) for host, key, nodes in found.folded()], columns=["host", "key", "nodes"])

    for batch in batches:
        for host, page in zip(batch["host"], batch["html"], strict=True):
            found.add(host, page)
            if found.texts > HELD_TEXTS:
                yield rows()
    yield rows()


def _joined_structures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one (host, key), which follow each other, as one."""
    rows = (row for batch in batches for row in batch[["host", "key", "nodes"]].itertuples(index=False, name=None))
    for (host, key), same in groupby(rows, key=lambda r: r[:2]):
        joined = pickle.loads(next(same)[2])
        for row in same:
            joined = _alike(joined, pickle.loads(row[2]))
        yield pd.DataFrame({"host": [host], "key": [key], "nodes": [pickle.dumps(joined)]})


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper) of every host, from all of its distinct pages.

    Each task joins its pages of one structure, a shuffle those of all tasks;
    so what is left of a host are its structures, however many pages it has.
    They are aligned ``FAN`` or so at a time, then what comes of it in turn,
    until a host has one wrapper. Which meet is told by hashes of the
    structures, so that it does not depend on how the pages are stored.
    """
    schema = "host string, key string, nodes binary"
    partial = _distinct_pages(pages, url_col, html_col).mapInPandas(_structures, schema)
    parts = checkpointed(partial.repartition("host", "key").sortWithinPartitions("host", "key").mapInPandas(_joined_structures, schema))

    def met(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = aligned([(key, pickle.loads(x)) for key, x in zip(rows["key"], rows["nodes"], strict=True)])
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "key": [min(rows["key"])], "nodes": [pickle.dumps(nodes)]})

    while (parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        sizes = parts.groupBy("host").agg(F.ceil(F.count("*") / FAN).alias("places"))
        placed = parts.join(sizes, "host").withColumn("place", F.pmod(F.xxhash64("key"), F.col("places")))
        parts = checkpointed(placed.groupBy("host", "place").applyInPandas(met, schema))

    @F.pandas_udf(T.StringType())
    def marked(nodes: pd.Series) -> pd.Series:
        return pd.Series([marked_wrapper(pickle.loads(x)) for x in nodes], dtype=object)

    return parts.select("host", marked("nodes").alias("wrapper"))


def _text_column(html, wrapper):
    known: dict[str, dict] = {}

    @F.pandas_udf(T.StringType())
    def texts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pages, given in batches:
            out = []
            for page, w in zip(pages, given, strict=True):
                if w is not None and w not in known:
                    if len(known) > 500:
                        known.clear()
                    known[w] = json.loads(w)
                out.append(main_text(page, known[w] if w is not None else None))
            yield pd.Series(out, dtype=object)

    return texts.asNondeterministic()(html, wrapper)


def extract(pages: DataFrame, out: str = "text", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with the main text of each in column ``out`` (empty if there is none).

    Null or empty html gives an empty text; pages without a host share one
    wrapper; a host of one page has that page's own; other columns pass.
    """
    learned = checkpointed(wrappers(pages, url_col, html_col))
    size = learned.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    host, key, wrapper = (free_name(pages, n) for n in ("__host", "__key", "__wrapper"))
    learned = learned.select(F.col("host").alias(key), F.col("wrapper").alias(wrapper))
    placed = pages.withColumn(host, host_of(F.col(url_col)))
    joined = placed.join(F.broadcast(learned) if size <= BROADCAST_CHARS else learned, F.col(host) == F.col(key), "left")
    return joined.withColumn(out, _text_column(F.col(html_col), F.col(wrapper))).drop(host, key, wrapper)
