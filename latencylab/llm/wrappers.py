"""Main text of web pages by wrapper induction.

Every page of a host is aligned with the host's reference page (the longest one not above the median length) by
simple tree matching of their DOM trees.  Over all pages of the host each reference node collects how often it
was matched, how often with equal text, and how much varying text it received; page nodes without a partner give
theirs to the nearest matched ancestor.  Nodes with equal text are the template.  The content slot is found from
the body downwards, always into the child that holds most of the varying text.

A page's text is that of the blocks in its content slot, without constant nodes and without elements that by tag
or name are menus, headers, footers, sidebars, notices, adverts, forms or comments.  Where there is nothing to
compare (a host's only page, a page of another layout) the slot is its article or main element, else its body.

Statistics are sums, combined in the task and before the shuffle; pages join their host's wrapper (reference page
and slots), which is broadcast if all wrappers together are small, and otherwise shuffled, where adaptive
execution splits a hot host.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from latencylab.llm.shared import SLICE_ROWS, arrow_schema, map_arrow, only, stored

CONSTANT = 0.9  # share of matched pages with equal text that makes a node template
FEWEST_PAGES = 10  # other pages a node must be matched in before it can be template
SLOT_SHARE = 0.6  # share of the varying text that draws the slot into a child
SHORT = 24  # siblings up to which a row is worked out one by one
WHOLE_TABLE = 4_000_000  # cells of a matching table that is kept; larger ones are halved and worked out again
BROADCAST_BYTES = 8 << 20

# HTML element names by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math select option button".split())
REMOVED = RAW | set("head nav footer aside form fieldset dialog menu label input object canvas audio video".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = set("html body div main section article center table tbody tr td".split())
# Elements that a start tag closes, up to the element that stops the search.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
# Words of class, id and role names that mark what is not the article.
BOILERPLATE_NAMES = set(
    "ad ads advert advertisement advertising sponsor sponsored promo banner menu menubar nav navbar navigation breadcrumb "
    "breadcrumbs header masthead footer colophon sidebar aside widget related recommended share sharing social cookie "
    "cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login search form "
    "comment comments respond reply replies disqus pagination pager toolbar complementary contentinfo".split()
)
# Those that are never around the article itself.
BESIDE_ARTICLE = set("comment comments respond reply replies disqus related recommended".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*'|["'])*)>?""", re.S,
)
NAME = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[A-Za-z]+")


class Node:
    __slots__ = ("tag", "label", "names", "kids", "number")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.kids, self.number = tag, [], -1
        found = ""
        if "=" in attributes:
            found = " ".join(sorted((m[2] or m[3] or m[4] or "") for m in NAME.finditer(attributes)))
        self.names = found
        self.label = f"{tag} {found}" if found else tag

    def elements(self) -> list[Node]:
        return [k for k in self.kids if type(k) is Node]

    def own_text(self) -> str:
        return " ".join(" ".join(k for k in self.kids if type(k) is str).split())

    def is_boilerplate(self, in_article: bool) -> bool:
        """True for what is not the article by tag or name; a named element around an article is spared."""
        if self.tag in REMOVED or (self.tag == "header" and not in_article):
            return True
        if not self.names or self.tag in ("html", "body", "main") or (self.tag == "article" and not in_article):
            return False
        said = BOILERPLATE_NAMES.intersection(w.lower() for w in WORDS.findall(self.names))
        if in_article:
            said -= {"header", "masthead"}
        return bool(said) and (not said.isdisjoint(BESIDE_ARTICLE) or not self.holds_article())

    def holds_article(self) -> bool:
        stack = self.elements()
        while stack:
            node = stack.pop()
            if node.tag in ("article", "main"):
                return True
            stack.extend(node.elements())
        return False


def dom(page: str) -> Node:
    """A lenient DOM tree; texts are kept with their character references."""
    root = Node("#root")
    stack, at, size = [root], 0, len(page)
    opened: dict[str, int] = {}  # elements on the stack by tag

    def close(k: int):
        for node in stack[k:]:
            opened[node.tag] -= 1
        del stack[k:]

    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at:m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            if m[0].startswith("<![CDATA["):
                stack[-1].kids.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            if opened.get(tag):
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        ends, stops = IMPLIED_END.get(tag, (None, None))
        if tag in BLOCKS and tag not in ("html", "body"):
            ends, stops = (ends or set()) | {"p"}, stops or CONTAINERS | {"ul", "ol", "blockquote"}
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    close(k)
                    break
                if stack[k].tag in stops:
                    break
        node = Node(tag, m[3])
        stack[-1].kids.append(node)
        if tag in VOID or m[0].endswith("/>") and tag not in BLOCKS:
            continue
        if tag in RAW and tag not in ("svg", "math", "select", "button", "option", "template", "noscript"):
            end = re.compile(f"</{tag}", re.I).search(page, at)
            node.kids.append(page[at:end.start() if end else size])
            at = end.start() if end else size
        stack.append(node)
        opened[tag] = opened.get(tag, 0) + 1
    return root


def numbered(root: Node) -> list[Node]:
    """The elements of a tree in document order; each gets its place as number."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        node.number = len(out)
        out.append(node)
        stack.extend(reversed(node.elements()))
    return out


class Matching:
    """Simple tree matching: the largest order-preserving match of two trees whose matched nodes' parents match.

    Subtrees of equal shape (labels and order) get one number, so a size is worked out once for two shapes, and
    equal shapes match node by node.  Children of equal shape at either end of two lists always belong to a largest
    match; only what is between them needs a table, a row at a time; its halves are found again if it is large.
    """

    def __init__(self):
        self.shapes: dict[tuple, int] = {}
        self.nodes: list[int] = []  # nodes of a shape
        self.labels: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.sizes: dict[tuple[int, int], int] = {}
        self.of: dict[int, int] = {}

    def shape(self, root: Node) -> int:
        """Number of the tree's shape; those of all its nodes are kept."""
        order, stack = [], [root]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(node.elements())
        for node in reversed(order):
            kids = tuple([self.of[id(k)] for k in node.elements()])
            key = node.label, kids
            number = self.shapes.get(key)
            if number is None:
                number = self.shapes[key] = len(self.nodes)
                self.nodes.append(1 + sum(self.nodes[k] for k in kids))
                self.labels.append(node.label)
                self.kids.append(kids)
            self.of[id(node)] = number
        return self.of[id(root)]

    @staticmethod
    def ends(left, right) -> tuple[int, int]:
        """How many entries two lists have in common at their start, and then at their end."""
        most = min(len(left), len(right))
        head = next((i for i in range(most) if left[i] != right[i]), most)
        tail = next((i for i in range(most - head) if left[-1 - i] != right[-1 - i]), most - head)
        return head, tail

    def size(self, a: int, b: int) -> int:
        """Matched nodes of two shapes; inner pairs are worked out first, without recursion."""
        todo = [(a, b)]
        while todo:
            a, b = pair = todo[-1]
            if pair in self.sizes:
                todo.pop()
            elif a == b or self.labels[a] != self.labels[b] or not self.kids[a] or not self.kids[b]:
                self.sizes[pair] = self.nodes[a] if a == b else int(self.labels[a] == self.labels[b])
                todo.pop()
            else:
                left, right, head, tail = self._between(a, b)
                first, second = set(left), set(right)
                missing = [(x, y) for x in first for y in second if (x, y) not in self.sizes]
                if missing:
                    todo.extend(missing)
                    continue
                ends = [*self.kids[a][:head], *self.kids[a][len(self.kids[a]) - tail:]]
                middle = int(self._row(left, right)[-1]) if left and right else 0
                self.sizes[pair] = 1 + sum(self.nodes[k] for k in ends) + middle
                todo.pop()
        return self.sizes[a, b]

    def _between(self, a: int, b: int):
        left, right = self.kids[a], self.kids[b]
        head, tail = self.ends(left, right)
        return left[head:len(left) - tail], right[head:len(right) - tail], head, tail

    def _weights(self, left, right) -> dict[int, np.ndarray]:
        """Sizes of each different shape on the left against the list on the right."""
        return {x: np.array([self.sizes[x, y] for y in right], np.int64) for x in set(left)}

    def _row(self, left, right) -> np.ndarray:
        """Largest sums of matches of the whole left list with each start of the right one."""
        if len(right) < SHORT:
            sizes, plain = self.sizes, [0] * (len(right) + 1)
            for x in left:
                corner = 0
                for j, y in enumerate(right, 1):
                    corner, plain[j] = plain[j], max(plain[j], plain[j - 1], corner + sizes[x, y])
            return np.array(plain)
        weights, row = self._weights(left, right), np.zeros(len(right) + 1, np.int64)
        for x in left:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights[x]))
        return row

    def _matched(self, left, right) -> list[tuple[int, int]]:
        """Places of a largest sum of matches between two lists."""
        found, todo = [], [(0, len(left), 0, len(right))]
        while todo:
            i0, i1, j0, j1 = todo.pop()
            if i0 == i1 or j0 == j1:
                continue
            a, b = left[i0:i1], right[j0:j1]
            if len(a) > 1 and len(a) * len(b) > WHOLE_TABLE:
                half = len(a) // 2
                cut = int(np.argmax(self._row(a[:half], b) + self._row(a[half:][::-1], b[::-1])[::-1]))
                todo += [(i0, i0 + half, j0, j0 + cut), (i0 + half, i1, j0 + cut, j1)]
                continue
            weights, rows = self._weights(a, b), np.zeros((len(a) + 1, len(b) + 1), np.int64)
            for i, x in enumerate(a):
                rows[i + 1, 1:] = np.maximum.accumulate(np.maximum(rows[i, 1:], rows[i, :-1] + weights[x]))
            i, j = len(a), len(b)
            while i and j:
                w = weights[a[i - 1]][j - 1]
                if w and rows[i, j] == rows[i - 1, j - 1] + w:
                    i, j = i - 1, j - 1
                    found.append((i0 + i, j0 + j))
                elif rows[i, j] == rows[i - 1, j]:
                    i -= 1
                else:
                    j -= 1
        return found

    def pairs(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """Matched nodes of two trees with equal root labels."""
        self.size(self.shape(a), self.shape(b))
        found, todo = [], [(a, b)]
        while todo:
            a, b = todo.pop()
            found.append((a, b))
            x, y = self.of[id(a)], self.of[id(b)]
            left, right = a.elements(), b.elements()
            if x == y:
                todo.extend(zip(left, right))
                continue
            if not left or not right:
                continue
            self.size(x, y)
            inner, outer, head, tail = self._between(x, y)
            todo.extend(zip(left[:head], right[:head]))
            todo.extend(zip(left[len(left) - tail:], right[len(right) - tail:]))
            todo.extend((left[head + i], right[head + j]) for i, j in self._matched(inner, outer))
        return found


def aligned(reference: Node, page: Node) -> dict[int, int]:
    """Number of the reference node for each matched node of a page, by the page node's number."""
    return {b.number: a.number for a, b in Matching().pairs(reference, page)}


def observe(reference: Node, nodes_of_reference: list[Node], texts: list[str], page: str) -> list[tuple[int, int, int]]:
    """Per matched reference node: its number, 1 if the own text is equal, and characters of varying text."""
    root = dom(page)
    nodes = numbered(root)
    partner = aligned(reference, root)
    equal, mass = dict.fromkeys(partner.values(), 0), dict.fromkeys(partner.values(), 0)
    stack = [(root, 0)]
    while stack:
        node, owner = stack.pop()
        if node.tag in REMOVED:
            owner_of = partner.get(node.number)
            if owner_of is not None:
                equal[owner_of] = 1
            continue
        match = partner.get(node.number)
        text = node.own_text()
        if match is not None:
            owner = match
            if text == texts[match]:
                equal[match] = 1
                text = ""
        mass[owner] += len(text)
        stack.extend((k, owner) for k in node.elements())
    return [(n, equal[n], mass[n]) for n in equal]


def induce(reference: Node, stats: list[tuple[int, int, int, int]]) -> tuple[list[int], int]:
    """Template nodes and content slot (-1 without variation) from ``number, matched, equal, mass`` of a host."""
    nodes = numbered(reference)
    mass = [0] * len(nodes)
    constant = []
    for number, matched, equal, varying in stats:
        mass[number] = varying
        # the reference agrees with itself, which says nothing
        if matched - 1 >= FEWEST_PAGES and equal - 1 >= CONSTANT * (matched - 1) and nodes[number].own_text():
            constant.append(number)
    under = mass[:]
    order = {id(n): n.number for n in nodes}
    for node in reversed(nodes):
        under[node.number] += sum(under[order[id(k)]] for k in node.elements())
    if not under[0]:
        return sorted(constant), -1
    at = reference
    while True:
        best = max((k for k in at.elements() if k.tag in CONTAINERS), key=lambda k: under[k.number], default=None)
        if best is None or under[best.number] < SLOT_SHARE * under[0]:
            return sorted(constant), at.number
        at = best


def _only_article(root: Node) -> Node | None:
    """The single article (or main) element below a node, if there is just one outermost one."""
    for tag in ("article", "main"):
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.tag == tag:
                found.append(node)
            elif node is root or not node.is_boilerplate(False):
                stack.extend(node.elements())
        if len(found) == 1:
            return found[0]
    return None


def blocks(root: Node, template: set[int]) -> list[str]:
    """Texts of the blocks below a node, in order."""
    out, words = [], []

    def flush():
        text = " ".join(html.unescape("".join(words)).split())
        if text:
            out.append(text)
        words.clear()

    stack: list = [(root, root.tag == "article")]
    while stack:
        item, inside = stack.pop()
        if type(item) is str:
            words.append(item)
        elif item is None:
            flush()
        elif item.tag == "br":
            words.append(" ")
        elif item.is_boilerplate(inside) and item is not root:
            flush() if item.tag in BLOCKS else words.append(" ")
        else:
            inside = inside or item.tag == "article"
            block = item.tag in BLOCKS
            if block:
                flush()
                stack.append((None, inside))
            hidden = item.number in template
            stack.extend((k, inside) for k in reversed(item.kids) if not (hidden and type(k) is str))
    flush()
    return out


def main_text(page: str | None, reference: Node | None, template: list[int], slot: int) -> str:
    """Blocks of the content slot, joined by empty lines."""
    if not page:
        return ""
    root = dom(page)
    nodes = numbered(root)
    content, constant = None, set()
    if reference is not None and slot >= 0:
        partner = aligned(reference, root)
        content = next((n for n in nodes if partner.get(n.number) == slot), None)
        fixed = set(template)
        constant = {n for n, m in partner.items() if m in fixed}
    if content is None or content.tag != "article":
        content = _only_article(content or root) or content or root
    return "\n\n".join(blocks(content, constant))


class _References:
    """Parsed reference pages of the hosts a task has met, a bounded number at a time."""

    def __init__(self, most: int = 256):
        self.most, self.held = most, {}

    def __call__(self, host: str, page: str):
        if host not in self.held:
            if len(self.held) >= self.most:
                self.held.pop(next(iter(self.held)))
            tree = dom(page)
            nodes = numbered(tree)
            self.held[host] = tree, nodes, [n.own_text() for n in nodes]
        return self.held[host]


HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, reference, template, slot`` for each host of ``id, host, html``, learnt from all its pages."""
    sized = pages.select("id", "host", F.length("html").alias("size")).where("size > 0")
    counted = sized.groupBy("host", "size").agg(F.count("*").alias("n"))
    median = stored(counted.groupBy("host").agg(F.expr("percentile(size, 0.5, n) as median")), "median-sizes")  # exact
    # maxima of salted parts first, so that the join of a hot host may be split
    near = sized.join(median, "host").where("size <= median").groupBy("host", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt"))
    near = near.agg(F.max(F.struct("size", (-F.col("id")).alias("back"))).alias("best")).groupBy("host").agg(F.max("best").alias("best"))
    chosen = stored(near.select("host", F.col("best.size").alias("size"), (-F.col("best.back")).alias("id")), "reference-ids")
    references = pages.join(chosen.withColumnsRenamed({"host": "r_host", "size": "r_size", "id": "r_id"}),
                            (F.col("host") == F.col("r_host")) & F.col("id").eqNullSafe(F.col("r_id")) & (F.length("html") == F.col("r_size")))
    references = stored(references.groupBy("host").agg(F.min("html").alias("reference")), "references")
    schema = "host string, number int, matched bigint, equal bigint, mass bigint"
    out = arrow_schema(schema)

    def run(batches):
        parsed = _References()
        for batch in batches:
            sums: dict[tuple[str, int], list[int]] = {}
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for row in batch.slice(at, SLICE_ROWS).to_pylist():
                    if not row["html"]:
                        continue
                    tree, nodes, texts = parsed(row["host"], row["reference"])
                    for number, equal, mass in observe(tree, nodes, texts, row["html"]):
                        entry = sums.setdefault((row["host"], number), [0, 0, 0])
                        entry[0] += 1
                        entry[1] += equal
                        entry[2] += mass
            if sums:
                made = [(*k, *v) for k, v in sums.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)

    seen = map_arrow(pages.select("host", "html").join(_small(references), "host"), run, schema)
    summed = seen.groupBy("host", "number").agg(*[F.sum(c).alias(c) for c in ("matched", "equal", "mass")])
    # one row for each element of a host's reference page
    stats = summed.groupBy("host").agg(F.collect_list(F.struct("number", "matched", "equal", "mass")).alias("stats"))
    joined = references.join(stats, "host", "left")
    made_schema = "host string, reference string, template array<int>, slot int"
    made_out = arrow_schema(made_schema)

    def learn(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                stats = [(s["number"], s["matched"], s["equal"], s["mass"]) for s in row["stats"] or []]
                rows.append((row["host"], row["reference"], *induce(dom(row["reference"]), stats)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), made_out)], schema=made_out)

    return stored(map_arrow(joined, learn, made_schema), "wrappers")


def _small(table: DataFrame) -> DataFrame:
    """Hint a broadcast if the stored reference pages are small together."""
    size = table.agg(F.sum(F.octet_length("reference")).alias("n")).first()["n"] or 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def extract(pages: DataFrame, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """``id, url, text, n_chars`` of every page.

    Null and empty pages have an empty text.  Pages without a host (null or odd url) share one wrapper.  Repeated
    rows come out alike, ids may be null, extra columns are ignored, an empty table gives no rows.
    """
    rows = only(pages, id=id_col, url=url_col, html=html_col)
    rows = rows.withColumn("host", F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit(""))))
    found = _small(wrappers(rows.withColumn("id", F.col("id").cast("bigint"))))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"id {kinds['id']}, url string, text string"
    out = arrow_schema(schema)

    def run(batches):
        parsed = _References()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                piece, texts = batch.slice(at, SLICE_ROWS), []
                for row in piece.select(["host", "html", "reference", "template", "slot"]).to_pylist():
                    reference = parsed(row["host"], row["reference"])[0] if row["reference"] else None
                    texts.append(main_text(row["html"], reference, row["template"] or [], -1 if row["slot"] is None else row["slot"]))
                columns = [piece.column("id"), piece.column("url"), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

    made = map_arrow(rows.join(found, "host", "left"), run, schema)
    return made.withColumn("n_chars", F.length("text").cast("bigint"))
