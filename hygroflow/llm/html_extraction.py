"""Main text of pages by wrapper induction.

Pages meet same-host pages in groups of about ``GROUP`` (a hot host is salted
into many groups).  Each page becomes a DOM tree whose equal neighbouring
children form runs; simple tree matching aligns it with the group's reference
tree, where runs weigh what matches below them, however many there are.
Aligned nodes share a slot.  A slot whose text is the same on nearly all
pages of the group is template; slots full of links are navigation; what varies
is content.  Near copies, pages that share most of their free text, count as one
page, so what only they have in common stays.  Names and roles of elements (menus, adverts, comments, ...) settle
what alignment cannot see, and a page whose host has no other page is read by
these names alone.

Blocks are the texts between block-level tags; character references are decoded,
white space becomes one space, and blocks are joined by an empty line.

Defined cases: null html is empty; a page without content has an empty text;
unclosed and stray tags are closed or ignored; null urls share the host ``''``;
repeated rows are pages of their own; an empty table gives no rows.
"""

from __future__ import annotations

import html as references
import re
from bisect import bisect_left
from collections import Counter
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hygroflow.llm.tables import read, stored
from hygroflow.llm.url_filters import host

#: Pages that are aligned with each other, about.
GROUP = 64
#: A text is template from so many pages and such a share of its group on.
LEAST_PAGES, SHARE = 5, 0.8
#: Share of linked characters from which a slot is navigation.
LINKED = 0.6
#: Lists of children with more pairs than this are aligned along their diagonal, as far from it as the best alignment can
#: go, beginning with so much less than the lighter list weighs; these bound neither lists nor results.
LARGE, SLACK = 200 * 200, 256
#: Sizes of matches, rows of lists and shapes that are remembered, about; forgotten ones are found again.
REMEMBERED, ROWS, SHAPES = 1 << 20, 16, 1 << 16

#: HTML elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea noscript iframe svg object select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike"
    " strong sub sup time tt u var ruby rt rp".split()
)
CLOSES = {
    "li": ("li", ("ul", "ol")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}
PARAGRAPH_ENDS = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main"
    " menu nav ol p pre section table ul".split()
)
#: Elements and names that are never the article.
APART = frozenset("head nav header footer aside form button menu dialog".split())
NAMES = frozenset(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu"
    " breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent notice notices alert popup modal"
    " overlay newsletter subscribe signup social share sharing related recommended widget comment comments"
    " commentlist disqus respond pagination pager toolbar skip login".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>", re.DOTALL
)
_NAME = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "key", "apart", "children", "runs", "shape")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children = tag, []
        self.key, self.apart = tag, tag in APART
        if attributes:
            found = {m[0].lower(): (m[1] or m[2] or m[3]).lower() for m in _NAME.findall(attributes)}
            if found:
                names = f"{found.get('class', '')} {found.get('id', '')}"
                self.key = f"{tag}.{' '.join(_WORD.findall(names))}"
                self.apart |= not NAMES.isdisjoint(_WORD.findall(names)) or found.get("role") in ROLES


def parsed(text: str) -> Node:
    """DOM tree; text nodes are strings."""
    root = Node("#root")
    stack, at = [root], 0
    for tag in _TAG.finditer(text):
        if tag.start() < at:
            continue
        if tag.start() > at:
            stack[-1].children.append(text[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == name:
                    del stack[depth:]
                    break
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(text, at)
            at = end.end() if end else len(text)
            continue
        ends, scope = ("p", ()) if name in PARAGRAPH_ENDS else CLOSES.get(name, ("", ()))
        if ends:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in scope:
                    break
                if stack[depth].tag in ends.split():
                    del stack[depth:]
                    break
                if name in PARAGRAPH_ENDS and stack[depth].tag not in INLINE:
                    break
        node = Node(name, tag[3])
        stack[-1].children.append(node)
        if name not in VOID and not tag[3].endswith("/"):
            stack.append(node)
    if at < len(text):
        stack[-1].children.append(text[at:])
    return root


def runs(node: Node) -> list[tuple[str, list[Node]]]:
    """Element children, equal neighbours together."""
    out: list[tuple[str, list[Node]]] = []
    for child in node.children:
        if isinstance(child, Node) and child.tag not in INLINE and child.tag not in VOID:
            if out and out[-1][0] == child.key:
                out[-1][1].append(child)
            else:
                out.append((child.key, [child]))
    return out


class _Alignment:
    """Heaviest common subsequence of two lists of (key, value): rows of best weights of their beginnings.

    ``at`` has the places in ``b`` of each key; ``weights`` has, for items of ``a``,
    the first of these places that counts and the weights from there on.
    ``heavy`` is the most that the items of each list can weigh.  Only the band
    around the diagonal that a best alignment can touch is computed: where the
    rest of either list is too light to reach ``least``, none passes.  Values
    outside the band, and values inside it that no best
    alignment passes, may be too low.
    """

    def __init__(self, a: list, b: list, heavy: tuple[list[int], list[int]]):
        self.a, self.b, self.weights = a, b, {}
        at: dict = {}
        for j, (key, _) in enumerate(b):
            at.setdefault(key, []).append(j)
        self.at = {key: np.array(places) for key, places in at.items()}
        self.heavy = [np.cumsum([0, *h], dtype=np.int64) for h in heavy]
        self.step = isqrt(len(a)) + 1

    def bands(self):
        """Sets a band and yields, so that ``weights`` can be filled, until the best weight lies within."""
        all_a, all_b = (int(h[-1]) for h in self.heavy)
        most, slack = min(all_a, all_b), SLACK
        least = 0 if len(self.a) * len(self.b) <= LARGE else most - slack
        while True:
            self.low = np.searchsorted(self.heavy[1], self.heavy[0] + (least - all_a)).tolist()
            self.high = (np.searchsorted(self.heavy[1], self.heavy[0] + (all_b - least), "right") - 1).tolist()
            yield
            self.best = self._forward()
            if self.best >= least:
                return
            # what was reached bounds the best from below
            slack *= 8
            least = max(self.best, most - slack)

    def _next(self, row: np.ndarray, i: int) -> None:
        """The row of the first ``i`` items of ``a`` from the one before, in place."""
        x = self.a[i - 1]
        low, high = max(self.low[i], 1), self.high[i]
        if x in self.weights and low <= high:
            (first, weights), at = self.weights[x], self.at[x[0]]
            start, end = at.searchsorted((low - 1, high)).tolist()
            at = at[start:end]
            here = row[at] + weights[start - first : end - first]
            at = at + 1
            row[at] = np.maximum(here, row[at])
            row[low : high + 1] = np.maximum.accumulate(row[low : high + 1])

    def _weight(self, i: int, j: int) -> int:
        x, y = self.a[i - 1], self.b[j - 1]
        if x[0] != y[0] or x not in self.weights:
            return 0
        first, weights = self.weights[x]
        return int(weights[self.at[x[0]].searchsorted(j - 1) - first])

    def _kept(self, row: np.ndarray, i: int) -> tuple[int, np.ndarray]:
        return self.low[i], row[self.low[i] : self.high[i] + 1].copy()

    def _forward(self) -> int:
        row = np.zeros(len(self.b) + 1, np.int32)
        self.marks = []
        for i in range(len(self.a) + 1):
            if i:
                self._next(row, i)
            if i % self.step == 0:
                self.marks.append(self._kept(row, i))
        return int(row[-1])

    def pairs(self) -> list[tuple[int, int]]:
        """Places of the best alignment that pairs late items first, last first."""
        out, i, j = [], len(self.a), len(self.b)
        while i and j:
            # rows between two marks are made again
            start = (i - 1) // self.step * self.step
            low, values = self.marks[start // self.step]
            row = np.zeros(len(self.b) + 1, np.int32)
            row[low : low + len(values)] = values
            rows = [(low, values)]
            for k in range(start + 1, i + 1):
                self._next(row, k)
                rows.append(self._kept(row, k))

            def at(i: int, j: int) -> int:
                low, values = rows[i - start]
                return int(values[j - low]) if 0 <= j - low < len(values) else -1

            while i > start and j:
                weight, here, before = self._weight(i, j), at(i, j), at(i - 1, j - 1)
                if weight and before >= 0 and here == before + weight:
                    i, j = i - 1, j - 1
                    out.append((i, j))
                elif here == at(i - 1, j):
                    i -= 1
                else:
                    j -= 1
        return out


def in_order(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence."""
    alignment = _Alignment([(x, 0) for x in a], [(y, 0) for y in b], ([1] * len(a), [1] * len(b)))
    alignment.weights = {(x, 0): (0, np.ones(len(at), np.int32)) for x, at in alignment.at.items()}
    for _ in alignment.bands():
        pass
    return alignment.pairs()[::-1]


class Shapes:
    """Numbers for what matching sees of a tree: the keys of its runs, and of the first element of each run the same.

    Matches of equal shapes are equal, so each pair of shapes is matched once.
    Generators stand for recursion, as unclosed tags nest deeply: they yield a
    shape with others and get the sizes of its matches with them.
    """

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.lists: list[tuple] = []
        self.sizes: list[int] = []  # runs at any depth
        self.found: dict[int, dict[int, int]] = {}
        self.n_found = 0
        self.rows: dict[tuple, tuple] = {}

    def of(self, page: Node) -> int:
        """Number of a tree; it is noted, as the runs are, at each element that can be matched."""
        todo, nodes = [page], []
        while todo:
            node = todo.pop()
            node.runs = runs(node)
            nodes.append(node)
            todo += [same[0] for _, same in node.runs]
        for node in reversed(nodes):
            shape = tuple((key, same[0].shape) for key, same in node.runs)
            node.shape = self.numbers.setdefault(shape, len(self.lists))
            if node.shape == len(self.lists):
                self.lists.append(shape)
                self.sizes.append(sum(self.sizes[below] + 1 for _, below in shape))
        return page.shape

    def _weigh(self, a: int, others: list[int]):
        """Weights of a run of one shape with runs of others of its key."""
        if not self.sizes[a]:
            return [1] * len(others)
        known = self.found.get(a, {})
        unknown = [b for b in others if self.sizes[b] and a != b and b not in known]
        new = (yield a, unknown) if unknown else {}
        sizes = {b: known[b] if b in known else new[b] for b in others if self.sizes[b] and a != b}
        sizes[a] = self.sizes[a]
        return [1 + sizes.get(b, 0) for b in others]

    def _aligned(self, left: tuple, right: tuple):
        """Alignment of two lists of runs."""
        alignment = _Alignment(left, right, tuple([self.sizes[s] + 1 for _, s in x] for x in (left, right)))
        numbers = {key: {} for key in alignment.at}
        for key, shape in right:
            numbers[key].setdefault(shape, len(numbers[key]))
        values = {key: np.array([numbers[key][right[j][1]] for j in at]) for key, at in alignment.at.items()}
        different = {key: list(found) for key, found in numbers.items()}
        for _ in alignment.bands():
            reach: dict[tuple, tuple[int, int]] = {}
            for i, x in enumerate(left, 1):
                if x[0] in numbers:
                    low, high = reach.get(x, (len(right), 0))
                    reach[x] = min(low, alignment.low[i]), max(high, alignment.high[i])
            for (key, shape), (low, high) in reach.items():
                first, end = alignment.at[key].searchsorted((low - 1, high)).tolist()
                met, place = different[key], values[key][first:end]
                if len(place) < len(met):
                    some, place = np.unique(place, return_inverse=True)
                    met = [met[k] for k in some.tolist()]
                weights = yield from self._weigh(shape, met)
                alignment.weights[key, shape] = first, np.array(weights, np.int32)[place]
        return alignment

    def _long(self, a: int, b: int):
        """Size of the match of two long lists."""
        left, right = self.lists[a], self.lists[b]
        # equal runs at either end weigh most with each other
        first, last = 0, min(len(left), len(right))
        while first < last and left[first] == right[first]:
            first += 1
        ends = 0
        while ends < last - first and left[-1 - ends] == right[-1 - ends]:
            ends += 1
        size = sum(self.sizes[s] + 1 for _, s in left[:first] + left[len(left) - ends :])
        left, right = left[first : len(left) - ends], right[first : len(right) - ends]
        if left and right:
            size += (yield from self._aligned(left, right)).best
        return size

    def _row_of(self, others: list[int]) -> tuple[dict, dict, np.ndarray, np.ndarray]:
        """Lists one after the other: numbers of their runs, runs by key, numbers by place, first places and the end."""
        if tuple(others) not in self.rows:
            number, places, starts, met = {}, [], [], {}
            for b in others:
                starts.append(len(places))
                # the place before the first run has no weight
                places.append(0)
                places += [number.setdefault(y, len(number) + 1) for y in self.lists[b]]
            for y in number:
                met.setdefault(y[0], []).append(y)
            if len(self.rows) >= ROWS:
                self.rows.clear()
            self.rows[tuple(others)] = number, met, np.array(places), np.array([*starts, len(places)])
        return self.rows[tuple(others)]

    def _short(self, a: int, others: list[int]):
        """Sizes of the matches of a list with others, which lie one after the other in one row."""
        number, met, places, starts = self._row_of(others)
        # each list begins beyond what the one before can reach
        beyond = np.arange(len(others)) * (self.sizes[a] + 1)
        row = np.repeat(beyond, np.diff(starts))
        often, weights = Counter(self.lists[a]), {}
        for x in self.lists[a]:
            same = met.get(x[0])
            if not same:
                continue
            weight = weights.get(x)
            if weight is None:
                weight = np.zeros(len(number) + 1, np.int32)
                weight[[number[y] for y in same]] = yield from self._weigh(x[1], [s for _, s in same])
                if often[x] > 1:
                    weights[x] = weight
            here = row[:-1] + weight[places[1:]]
            np.maximum(here, row[1:], out=here)
            np.maximum.accumulate(here, out=row[1:])
        return (row[starts[1:] - 1] - beyond).tolist()

    def _matches(self, a: int, others: list[int]):
        """Sizes of the matches of one shape with others."""
        n, found = len(self.lists[a]), {}
        short = [b for b in others if n * len(self.lists[b]) <= LARGE]
        if short:
            found.update(zip(short, (yield from self._short(a, short)), strict=True))
        for b in others:
            if b not in found:
                found[b] = yield from self._long(a, b)
        self.n_found += len(found)
        if self.n_found > REMEMBERED:
            self.found.clear()
            self.n_found = len(found)
        self.found.setdefault(a, {}).update(found)
        return found

    def _solved(self, asking):
        """Result of a generator that asks for sizes."""
        todo, result = [asking], None
        while todo:
            try:
                asked = todo[-1].send(result)
            except StopIteration as done:
                todo.pop()
                result = done.value
            else:
                todo.append(self._matches(*asked))
                result = None
        return result

    def pairs(self, a: int, b: int) -> list[tuple[int, int]]:
        """Places of the runs of two shapes that are matched."""
        left, right = self.lists[a], self.lists[b]
        n, m, out = len(left), len(right), []
        # equal runs at the end weigh most with each other
        while n and m and left[n - 1] == right[m - 1]:
            n, m = n - 1, m - 1
            out.append((n, m))
        if not n or not m:
            return out
        left, right = left[:n], right[:m]
        keys = {key for key, _ in left} & {key for key, _ in right}
        ours, theirs = ([i for i, (key, _) in enumerate(x) if key in keys] for x in (left, right))
        if len(ours) == len(theirs) == len(keys) and all(left[i][0] == right[j][0] for i, j in zip(ours, theirs)):
            # one partner each, in the same order: all are matched, whatever they weigh
            return out + list(zip(ours, theirs))
        return out + self._solved(self._aligned(left, right)).pairs()


def matched(a: Node, b: Node, shapes: Shapes | None = None) -> tuple[int, list]:
    """Simple tree matching of two trees: its size, and the pairs of runs with what lies below them.

    Trees have their numbers already where ``shapes`` are given.
    """
    if shapes is None:
        shapes = Shapes()
        shapes.of(a), shapes.of(b)
    size, top = 0, []
    todo = [(a, b, top)]
    while todo:
        ours, theirs, pairs = todo.pop()
        for i, j in shapes.pairs(ours.shape, theirs.shape):
            left, right, below = ours.runs[i][1], theirs.runs[j][1], []
            pairs.append((left, right, below))
            size += 1
            if left[0].runs and right[0].runs:
                todo.append((left[0], right[0], below))
    return size, top


def slots(reference: Node, page: Node, shapes: Shapes | None = None) -> dict[int, int]:
    """Slot of each aligned element of a page (by object identity): the reference's run."""
    found: dict[int, int] = {}
    todo = [matched(reference, page, shapes)[1]]
    while todo:
        for ours, theirs, below in todo.pop():
            for node in theirs:
                found[id(node)] = id(ours[0])
            todo.append(below)
    return found


class Block:
    __slots__ = ("text", "linked", "slot", "apart", "article")

    def __init__(self, slot, apart: bool, article: bool):
        self.text, self.linked, self.slot, self.apart, self.article = "", 0, slot, apart, article


def blocks(page: Node, slot_of: dict[int, int]) -> list[Block]:
    """Texts between block-level tags, in page order."""
    out: list[Block] = []
    parts: list[str] = []
    linked = 0

    def close(slot, apart, article) -> None:
        nonlocal linked
        text = " ".join(references.unescape("".join(parts)).split())
        if text:
            block = Block(slot, apart, article)
            block.text, block.linked = text, linked
            out.append(block)
        parts.clear()
        linked = 0

    # a stack instead of recursion, as unclosed tags nest deeply
    todo: list = [(page, "", False, False, False, iter(page.children))]
    while todo:
        node, slot, apart, article, link, rest = todo[-1]
        child = next(rest, None)
        if child is None:
            todo.pop()
            if node.tag not in INLINE:
                close(slot, apart, article)
            continue
        if isinstance(child, str):
            parts.append(child)
            linked += len(child) if link else 0
        elif child.tag == "br":
            parts.append(" ")
        elif child.tag == "hr":
            close(slot, apart, article)
        elif child.tag not in VOID:
            inline = child.tag in INLINE
            if not inline:
                close(slot, apart, article)
            below = slot if inline else slot_of.get(id(child), f"{slot}/{child.key}")
            inside = article or child.tag in ("article", "main")
            todo.append((child, below, apart or child.apart, inside, link or child.tag == "a", iter(child.children)))
    return out


def copies(pages: list[list[Block]]) -> list[int]:
    """A number per page; near copies, which share most of their text with the first page of a number, have it in common."""
    holders: dict[str, list[int]] = {}
    sizes: list[int] = []
    out = []
    for page in pages:
        texts = {b.text for b in page}
        size, common = sum(map(len, texts)), Counter()
        for text in texts:
            for first in holders.get(text, ()):
                common[first] += len(text)
        near = [first for first in common if 2 * common[first] > max(size, sizes[first])]
        if near:
            out.append(min(near))
            continue
        out.append(len(sizes))
        for text in texts:
            holders.setdefault(text, []).append(len(sizes))
        sizes.append(size)
    return out


def extracted(pages: list[str]) -> list[str]:
    """Main texts of same-host pages."""
    reference = parsed(pages[0])
    shapes, found = None, []
    for n, text in enumerate(pages):
        if shapes is None or len(shapes.lists) > SHAPES:
            shapes = Shapes()
            shapes.of(reference)
        # one tree besides the reference at a time
        page = parsed(text) if n else reference
        shapes.of(page)
        found.append(blocks(page, slots(reference, page, shapes)))
    size, linked = Counter(), Counter()
    for page in found:
        for b in page:
            size[b.slot] += len(b.text)
            linked[b.slot] += b.linked
    free = []
    for page in found:
        named = [b for b in page if not b.apart]
        named = [b for b in named if b.article] or named
        free.append([b for b in named if b.article or linked[b.slot] < LINKED * size[b.slot]])
    # near copies support a template once: they share one page's weight
    groups = copies(free)
    members = Counter(groups)
    seen: Counter = Counter()
    for page, group in zip(found, groups, strict=True):
        for key in {(b.slot, b.text) for b in page}:
            seen[key] += 1 / members[group]
    least = max(LEAST_PAGES, SHARE * len(members)) - 1e-6
    texts = []
    for page in free:
        varying = [b for b in page if seen[b.slot, b.text] < least]
        texts.append("\n\n".join(b.text for b in varying or page))
    return texts


def _per_group(batches):
    key, held = None, []

    def done():
        texts = extracted([h or "" for _, _, h in held])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _, _ in held], pa.int64()),
                pa.array([u for _, u, _ in held], pa.string()),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ],
            ["page_id", "url", "text", "n_chars"],
        )

    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("host", "salt", "page_id", "url", "html")]
        for site, salt, page, url, text in zip(*columns, strict=True):
            # a group is closed at twice its usual size, which also bounds a badly dealt one
            if held and ((site, salt) != key or len(held) >= 2 * GROUP):
                yield done()
                held = []
            key = site, salt
            held.append((page, url, text))
    if held:
        yield done()


def main_texts(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html): page_id, url, text, n_chars."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html", F.coalesce(host(F.col("url")), F.lit("")).alias("host")
    )
    # only hosts of more than GROUP pages are salted; stored, so that Spark knows the size of this table before it plans the join
    hosts = rows.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"))
    large = stored(hosts.where("groups > 1"), "large-hosts")
    salted = rows.join(large, "host", "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.col("groups")))
    dealt = salted.select("host", "salt", "page_id", "url", "html").repartition("host", "salt")
    dealt = dealt.sortWithinPartitions("host", "salt", "page_id")
    return dealt.mapInArrow(_per_group, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return main_texts(read(spark, folder, "pages", "page_id", "url", "html"))
