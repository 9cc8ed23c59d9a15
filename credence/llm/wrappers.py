"""HTML extraction: union-free regular expressions inferred per host, with text slots, optional and repeated groups.

A wrapper is a tree of groups.  A group has a label (tag and class), a least and a most number of times it
repeats among its neighbours, its inner groups in order, and a text slot that is one string or any string.
Two token streams of a host are aligned level by level: equal labels meet in order, runs of one label fold into a
repeated group, labels without a partner become optional.  Merging wrappers the same way lets every task
infer one per host from its own pages and needs only those small trees to come together.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm.common import written

#: Bytes of wrappers that are sent to every task; more are joined by host instead.
BROADCAST_BYTES = 32 << 20
#: Wrappers of a host that one task merges at a time.
FAN_IN = 64
#: Pages that must say the same in a group before it counts as template.
TEMPLATE_PAGES = 2

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|</?[a-zA-Z][^\s/>]*(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_CLASS = re.compile(r"\s(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template xmp iframe".split())
#: Tags inside a block of text; all others end the block before and after them.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: A tag that closes an open one of the same list entry.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Groups that are never main text by tag; by a whole word of class, id or role only as the tie-break among free text.
_OUT_TAGS = frozenset("head nav footer aside form script style noscript template textarea button select iframe object svg canvas dialog title menu".split())
_OUT_WORDS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header menu modal nav navbar navigation newsletter notice notices popup promo promoted related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget alert contentinfo complementary search".split())
_MAIN_WORDS = frozenset("article main post entry story".split())
_NEVER_OUT = frozenset("html body article main".split())


class Node:
    """An element: its label, and inner nodes and strings in order."""

    __slots__ = ("label", "inner")

    def __init__(self, label: str) -> None:
        self.label, self.inner = label, []


def parse(page: str) -> Node:
    """The tree of a page. Lenient: stray end tags are dropped, open elements end with the page or where their kind does."""
    root = Node("")
    stack, at, size = [root], 0, len(page)
    tokens = _TOKEN.finditer(page)
    for token in tokens:
        if token.start() < at:
            continue
        if token.start() > at:
            stack[-1].inner.append(page[at : token.start()])
        at = token.end()
        text = token[0]
        if text[1] in "!?":
            continue
        name = _NAME.match(text)[1].lower()
        if text[1] == "/":
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].label.split(".", 1)[0] == name:
                    del stack[depth:]
                    break
            continue
        closes = _CLOSES.get(name, ())
        top = stack[-1].label.split(".", 1)[0]
        if top in closes or (top == "p" and name in _ENDS_P):
            stack.pop()
        elif name in _ENDS_P:  # a paragraph left open under inline tags ends with them
            for depth in range(len(stack) - 1, 0, -1):
                tag = stack[depth].label.split(".", 1)[0]
                if tag == "p":
                    del stack[depth:]
                    break
                if tag not in _INLINE:
                    break
        words = sorted({w for m in _CLASS.finditer(text) for w in (m[1] or m[2] or m[3] or "").lower().split()})
        node = Node(".".join([name, *words]))
        stack[-1].inner.append(node)
        if name in _RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            node.inner.append(page[at : end.start() if end else size])
            at = end.end() if end else size
        elif name not in _VOID and not text.endswith("/>"):
            stack.append(node)
    if at < size:
        rest = page[at:]
        cut = rest.rfind("<")  # a tag that the page breaks off in
        stack[-1].inner.append(rest[:cut] if cut >= 0 and re.match(r"</?[a-zA-Z!?]|<$|</$", rest[cut:]) else rest)
    return root


# A group is [label, least, most, slot, groups, pages]: slot None without text, the text that all pages with the group have
# there (that of repeats in one page is joined), or True for any text; pages is how many streams have the group.


def _run(job):
    """The value of a generator that yields the generators whose values it needs; trees of any depth need no deep call stack."""
    stack, value = [job], None
    while stack:
        try:
            job = stack[-1].send(value)
        except StopIteration as end:
            stack.pop()
            value = end.value
        else:
            stack.append(job)
            value = None
    return value


def _short(text: str) -> str:
    """A text as it is held in a slot: a long one by its beginning and a hash."""
    return text if len(text) <= 80 else f"{text[:40]}#{hashlib.blake2b(text.encode('utf-8', 'surrogatepass'), digest_size=12).hexdigest()}"


def infer(node: Node) -> list:
    """The wrapper of one page."""
    stack = [([node.label, 1, 1, None, [], 1], iter(node.inner), [])]
    while True:
        group, parts, texts = stack[-1]
        for part in parts:
            if not isinstance(part, str):
                stack.append(([part.label, 1, 1, None, [], 1], iter(part.inner), []))
                break
            texts += part.split()
        else:
            stack.pop()
            if texts:
                group[3] = _short(" ".join(texts))
            if not stack:
                return group
            groups = stack[-1][0][4]
            if groups and groups[-1][0] == group[0]:
                groups[-1] = _fold(groups[-1], group, True)
            else:
                groups.append(group)


def _fold(a: list, b: list, beside: bool) -> list:
    """One group for two of the same label: beside each other they repeat, from two streams they are alternatives of one place."""
    return _run(_folding(a, b, beside, beside))


def _folding(a: list, b: list, beside: bool, joined: bool):
    """``joined``: both are of one stream, so their texts follow each other; else a slot stays a text only if both streams have it."""
    if a[3] is None or b[3] is None:
        slot = a[3] if b[3] is None else b[3]
    elif a[3] is True or b[3] is True:
        slot = True
    else:
        slot = _short(f"{a[3]} {b[3]}") if joined else a[3] if a[3] == b[3] else True
    least, most = (a[1] + b[1], a[2] + b[2]) if beside else (min(a[1], b[1]), max(a[2], b[2]))
    groups = (yield _aligning(a[4], b[4], joined)) if a[4] and b[4] else [_optional(g) for g in a[4] or b[4]]
    return [a[0], min(least, 2), min(most, 2), slot, groups, max(a[5], b[5]) if joined else a[5] + b[5]]


def align(a: list, b: list) -> list:
    """Two sequences of groups as one: a longest common subsequence of labels meets, the rest is optional; equal neighbours fold."""
    return _run(_aligning(a, b, False))


def _aligning(a: list, b: list, joined: bool):
    if not a or not b:
        merged = [_optional(g) for g in a or b]
    else:
        n, m = len(a), len(b)
        if [g[0] for g in a] == [g[0] for g in b]:
            merged = []
            for x, y in zip(a, b):
                merged.append((yield _folding(x, y, False, joined)))
            return merged
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
        merged, i, j = [], 0, 0
        while i < n or j < m:
            if i < n and j < m and a[i][0] == b[j][0]:
                merged.append((yield _folding(a[i], b[j], False, joined)))
                i, j = i + 1, j + 1
            elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
                merged.append(_optional(a[i]))
                i += 1
            else:
                merged.append(_optional(b[j]))
                j += 1
    out: list = []
    for group in merged:
        if out and out[-1][0] == group[0]:
            out[-1] = yield _folding(out[-1], group, True, True)
        else:
            out.append(group)
    return (yield _rolling(out))


def _optional(group: list) -> list:
    return [group[0], 0, *group[2:]]


def _rolling(groups: list, most: int = 64):
    """A long sequence in which labels keep recurring is one repeated bag: the later ones fold into the first of their label."""
    if len(groups) <= most:
        return groups
    place: dict[str, int] = {}
    out: list = []
    for group in groups:
        if group[0] in place:
            out[place[group[0]]] = yield _folding(out[place[group[0]]], group, True, True)
        else:
            place[group[0]] = len(out)
            out.append(group)
    return out


def dumps(wrapper: list) -> str:
    """A wrapper as flat JSON, each group before its inner groups with their number last."""
    flat, stack = [], [wrapper]
    while stack:
        group = stack.pop()
        flat.append([*group[:4], group[5], len(group[4])])
        stack += reversed(group[4])
    return json.dumps(flat)


def loads(text: str) -> list:
    top: list = []
    stack = [(top, 1)]
    for *head, pages, n in json.loads(text):
        groups, left = stack.pop()
        groups.append([*head, [], pages])
        if left > 1:
            stack.append((groups, left - 1))
        if n:
            stack.append((groups[-1][4], n))
    return top[0]


def expression(group: list) -> str:
    """The wrapper as a regular expression over tags, #TEXT for a free slot."""
    return _run(_expressing(group))


def _expressing(group: list):
    inner = "#TEXT" if group[3] is True else re.escape(group[3]) if group[3] else ""
    for g in group[4]:
        inner += yield _expressing(g)
    mark = "" if group[1] and group[2] == 1 else "+" if group[1] else "?" if group[2] == 1 else "*"
    return f"(<{group[0]}>{inner}</>){mark}" if group[0] else inner


def _out(label: str) -> bool:
    tag, *words = label.split(".")
    return tag in _OUT_TAGS or tag == "header" or (tag not in _NEVER_OUT and not _OUT_WORDS.isdisjoint(words))


def _main(label: str) -> bool:
    tag, *words = label.split(".")
    return tag in ("article", "main") or (tag not in ("html", "body") and not _MAIN_WORDS.isdisjoint(words))


class Places:
    """What a wrapper says of the paths of labels in a page, each path a number; 0 is the page."""

    def __init__(self) -> None:
        self.ids: dict[tuple[int, str], int] = {}
        self.main: set[int] = set()
        self.template: set[int] = set()
        self.mute: set[int] = set()


def content(wrapper: list) -> Places:
    """Paths of article-like groups, and those of the template: what the pages of a host that have a group all say alike.

    A group is template if no text in it is free, and neither is seen in fewer than TEMPLATE_PAGES pages, which
    shows nothing.  A block's own text is mute on the same terms, unless inline groups in it are free.  A wrapper
    without any free slot (one page, or copies of it) has no template.  Tags that never hold main text, and as
    the tie-break among what is free words of the class, count besides.
    """
    places = Places()
    groups, parents, paths = [wrapper], [-1], [0]
    for at, group in enumerate(groups):  # grows while it is read
        for inner in group[4]:
            if not _out(inner[0]) or inner[0].split(".", 1)[0] == "header":
                groups.append(inner)
                parents.append(at)
                paths.append(places.ids.setdefault((paths[at], inner[0]), len(places.ids) + 1))
    free, open_, inline_open = ([False] * len(groups) for _ in range(3))
    varied: set[int] = set()
    loud: set[int] = set()
    for at in range(len(groups) - 1, -1, -1):
        label, _, _, slot, _, pages = groups[at]
        inline = label.split(".", 1)[0] in _INLINE
        own = slot is True or (slot is not None and pages < TEMPLATE_PAGES)
        free[at] |= slot is True
        open_[at] |= own
        if own or inline_open[at]:
            loud.add(paths[at])
        if open_[at]:
            varied.add(paths[at])
        if _main(label):
            places.main.add(paths[at])
        if at:
            up = parents[at]
            free[up] |= free[at]
            open_[up] |= open_[at]
            inline_open[up] |= inline and (own or inline_open[at])
    if free[0]:
        for at, group in enumerate(groups):
            if group[0] and group[0].split(".", 1)[0] not in _INLINE:
                if paths[at] not in varied:
                    places.template.add(paths[at])
                if paths[at] not in loud:
                    places.mute.add(paths[at])
    return places


def blocks(root: Node, places: Places) -> list[str]:
    """Blocks of main text in page order: of the page's own article-like groups, else, where they have none, of its whole body.

    Inside an article nothing is template: headings, table heads and sentences that the pages of a host share are its text.  The
    body is taken without the template, and with it only if the page has nothing else.
    """
    tries = [(True, False), (False, True), (False, False)] if places.template or places.mute else [(True, False), (False, False)]
    for main, template in tries:
        found = _blocks(root, places, main, template)
        if found:
            return found
    return []


def _blocks(root: Node, places: Places, main: bool, template: bool) -> list[str]:
    held: list[str] = []
    out: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append(text)

    # what is open: parts left, path, inside main text, own text taken, whether its end ends a block
    stack = [(iter(root.inner), 0, not main, True, False)]
    while stack:
        parts, path, inside, said, ends = stack[-1]
        for part in parts:
            if isinstance(part, str):
                if inside and said:
                    held.append(part)
                continue
            tag = part.label.split(".", 1)[0]
            here = places.ids.get((path, part.label), -1)
            inline = tag in _INLINE
            if (_out(part.label) and not (inside and tag == "header")) or (template and here in places.template):
                if not inline:
                    flush()
                continue
            if not inline:
                flush()
            if tag in ("br", "wbr"):
                held.append("\n" if tag == "br" and inside else "")
            speaks = said if inline else not (template and here in places.mute)
            stack.append((iter(part.inner), here, inside or (main and here in places.main), speaks, not inline))
            break
        else:
            stack.pop()
            if ends:
                flush()
    flush()
    return out


def main_text(page: str, wrapper: list | None = None) -> str:
    root = parse(page)
    return "\n\n".join(blocks(root, content(wrapper if wrapper is not None else infer(root))))


def _host() -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON, n_pages): tasks infer a wrapper per host of their pages, those of a host merge in rounds of FAN_IN."""

    def local(batches):
        held: dict[str, list] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                wrapper = infer(parse(page.as_py() or ""))
                held[host] = [_fold(held[host][0], wrapper, False), held[host][1] + 1] if host in held else [wrapper, 1]
        yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([dumps(w) for w, _ in held.values()], pa.string()), pa.array([n for _, n in held.values()], pa.int64())], names=["host", "wrapper", "n_pages"])

    def merge(table: pa.Table) -> pa.Table:
        by: dict[str, list] = defaultdict(list)
        for host, wrapper, n in zip(*(table[c].to_pylist() for c in ("host", "wrapper", "n_pages"))):
            by[host].append((wrapper, n))
        rows = []
        for host, parts in by.items():
            merged, total = None, 0
            for wrapper, n in sorted(parts):
                merged = loads(wrapper) if merged is None else _fold(merged, loads(wrapper), False)
                total += n
            rows.append((host, dumps(merged), total))
        hosts, wrappers, totals = zip(*rows)
        return pa.table({"host": pa.array(hosts), "wrapper": pa.array(wrappers), "n_pages": pa.array(totals, pa.int64())})

    schema = "host string, wrapper string, n_pages long"
    parts = written(pages.select(_host().alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).mapInArrow(local, schema), "wrappers")
    most = parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    while most > FAN_IN:
        salt = F.pmod(F.xxhash64("wrapper", "n_pages"), F.lit(-(-most // FAN_IN)))
        parts = written(parts.withColumn("salt", salt).groupBy("host", "salt").applyInArrow(merge, schema), "wrappers")
        now = parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if now >= most:
            break
        most = now
    return written(parts.groupBy("host").applyInArrow(merge, schema), "wrappers")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page: the main text by the wrapper of its host.

    Null and empty html, and pages without main text, give the empty text; pages without a host share one
    wrapper, and a page in which it finds no article-like group gives its whole body; repeated rows and null ids are kept; other columns are not read.  Wrappers are sent to the tasks where
    they measure at most BROADCAST_BYTES, else pages join them by host, whose skew adaptive execution splits.
    """
    found = infer_wrappers(pages)
    size = found.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    kept = found.select("host", "wrapper")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), _host().alias("host"))
    joined = rows.join(F.broadcast(kept) if size <= BROADCAST_BYTES else kept, "host", "left").select("page_id", "url", "html", "wrapper")

    def read(batches):
        chosen: dict[str, Places] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column(2), batch.column(3).to_pylist()):
                root = parse(page.as_py())
                if wrapper is None:
                    paths = content(infer(root))
                else:
                    if wrapper not in chosen:
                        if len(chosen) >= 1000:
                            chosen.clear()
                        chosen[wrapper] = content(loads(wrapper))
                    paths = chosen[wrapper]
                texts.append("\n\n".join(blocks(root, paths)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(read, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")
