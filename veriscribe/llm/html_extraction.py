"""Main text of web pages by wrapper induction.

Pages become trees of block elements (inline markup only adds to its block's text), in which neighbours of one
shape are one repeated node. A few pages with different texts, of each host and layout, are aligned one after
another by simple tree matching, the dynamic programme over children of equally labelled nodes, and merged into a
wrapper: each of its nodes knows in how many pages it is, which texts it has in how many of them, and how much of
its text is links. A text that most pages have at one node is template. What varies, outside of links, is a node's
mass, and the slot of the article is found by going down from the root as long as one container holds most of it and no
heading that varies would stay outside. Inside the slot, nodes made of links, and texts that all pages share,
are template too. A page is then aligned with its wrapper, once, and its text is what lies in that slot.

Tags, roles and words of class and id are parts of the labels that are aligned. By themselves they decide nothing: no
article mark confines content. What names itself a menu, notice, advert, comment or the like counts a quarter in
the search for the slot, and is left out of it if its mass is small. Elements that never hold article text (code, forms,
the invisible) are no nodes.

A page uses the wrapper of its host and layout if that is made of ENOUGH pages, else the one of its host, else the one of its
layout at all hosts, whichever has enough first, or the most pages. So a page that nothing is like has a wrapper made of itself.

Pages for the wrappers are chosen by least hashes of their texts, so copies count once: a task keeps PEERS
for each group, and minima with partial sums do the rest; no host's pages are gathered. All wrappers
together are broadcast if they are under a size that is checked, else pages and wrappers meet in a salted join.
A block with more than WIDE repeated nodes has its blocks of one label together, which bounds the tables of matching.

A null html is an empty page with the empty text; a null url has the empty host. Long pages are read whole. Repeated rows and ids stay, each
with its own text; ties between hashes go by the tree. An empty table gives no rows. Only page_id, url and html are read,
so other columns may have any names.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscribe.llm.common import materialise, table

#: Pages that a wrapper is made of, at most; how many are enough.
PEERS, ENOUGH = 8, 3
#: Blocks inside one another that are told apart.
DEEPEST = 120
#: Characters of all wrappers together up to which they are broadcast, salts of the join beyond, and trees that a task keeps at once.
BROADCAST, SALTS, KEPT = 16_000_000, 16, 2_000
#: The share of a page's text that a copy of it has.
COPY = 0.75
#: The share of mass that the slot must have; of links that makes a menu; what a named node counts; of the slot's mass that a named node in it has at most.
MOST, LINKS, NAMED, SMALL = 0.5, 0.6, 0.25, 0.25
#: Repeated nodes of a block beyond which all its blocks of one label are one.
WIDE = 64
#: Fixed values of HTML: elements without content, with raw text, of block kind; and what each new element closes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td template tfoot th thead tr ul noscript button".split()
)
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: Elements that a search for something to close does not leave.
SCOPE = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "optgroup": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
#: Elements that may be an article's slot, and headings.
CONTAINERS = set("# html body div main article section center td table tbody tr form".split())
HEADING = re.compile(r"h[1-6]$")
#: Elements that are no text, and names of what is no article (fixed values): elements, roles, and words of class and id.
NO_TEXT = set("form script style noscript template iframe svg math object canvas button select dialog head title textarea noembed noframes xmp plaintext audio video".split())
NO_TAG = set("nav header footer aside menu search".split())
NO_ROLE = set("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
NO_WORD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|alert|popup|modal|overlay|newsletter|subscri\w+|signup|login|sidebar|side-bar|rail|widgets?|related"
    r"|recommend\w*|share|sharing|social|comments?|commentlist|respond|repl(?:y|ies)|disqus|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|topbar|toolbar|pagination|pager|skip|copyright)(?:$|[\s_-])"
)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|([^\s"'>/=]+)""")
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")


class Node:
    """A block element; items are its texts and children, in page order; links the characters of its texts that are links."""

    __slots__ = ("label", "items", "named", "links", "depth", "shape")

    def __init__(self, label: str, named: bool, depth: int):
        self.label, self.items, self.named, self.links, self.depth, self.shape = label, [], named, 0, depth, 0


def parse(page: str | None) -> Node:
    """The tree of a page's blocks. A text item is the decoded text of one run of inline content."""
    page = page or ""
    root = Node("#", False, 0)
    stack: list[tuple[str, Node | None]] = [("#", root)]  # open elements with the block that each adds to; none in what is no text
    run: list[str] = []
    at = linked = 0  # characters of the run inside links

    def close_run() -> None:
        nonlocal linked
        if run:
            text = SPACE.sub(" ", entities.unescape("".join(run))).strip()
            run.clear()
            if text:
                stack[-1][1].items.append(text)
                stack[-1][1].links += min(linked, len(text))
        linked = 0

    def pop_to(i: int) -> None:
        if any(tag in BLOCK or node is None for tag, node in stack[i:]):
            close_run()
        del stack[i:]

    def add(text: str) -> None:
        nonlocal linked
        if stack[-1][1] is not None:
            run.append(text)
            if any(tag == "a" for tag, _ in stack):
                linked += len(text.strip())

    while True:
        found = TAG.search(page, at)
        if found is None:
            add(page[at:])
            break
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
                if stack[i][0] in ("article", "main", "body", "table") and tag not in BLOCK:
                    break
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                close_run()
            continue
        attributes = {(a or e).lower(): entities.unescape(b or c or d or "") for a, b, c, d, e in ATTRIBUTE.findall(found[3])} if found[3].strip(" /") else {}
        if tag in BLOCK:
            # a block ends an open paragraph, and what its own kind ends
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][0] in BLOCK:
                    break
            ends, scope = CLOSES.get(tag, ()), SCOPE.get(tag, ())
            for i in range(len(stack) - 1, 0, -1) if ends else ():
                if stack[i][0] in scope:
                    break
                if stack[i][0] in ends:
                    pop_to(i)
            close_run()
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        words = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip().lower()
        role = attributes.get("role", "").lower()
        above = stack[-1][1]
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(HIDDEN.search(attributes.get("style", "")))
        if above is None or tag in NO_TEXT or (hidden and tag not in ("html", "body")):
            close_run()
            stack.append((tag, None))
            continue
        named = (tag in NO_TAG or role in NO_ROLE or bool(words and NO_WORD.search(words))) and tag not in ("html", "body")
        if tag in BLOCK or named:
            close_run()
            if above.depth >= DEEPEST:  # its blocks are then the outer element's
                stack.append((tag, above))
                continue
            node = Node(f"{tag}.{DIGITS.sub('0', words)}" if words else tag, named, above.depth + 1)
            above.items.append(node)
            stack.append((tag, node))
        else:
            stack.append((tag, above))
    close_run()
    return root


def code(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) >> 12


class Part:
    """A node of a tree that is aligned: blocks of a page, or of many.

    pages: how many have it; texts: in how many each text's hash is, and its length; chars, links: of all texts in all pages.
    """

    __slots__ = ("label", "named", "pages", "texts", "chars", "links", "children", "members", "kind")

    def __init__(self, label: str, named: bool):
        self.label, self.named, self.pages, self.texts, self.chars, self.links = label, named, 1, {}, 0, 0
        self.children: list[Part] = []
        self.members: list[Node] = []
        self.kind = OUTSIDE

    def written(self) -> list:
        return [self.label, int(self.named), self.pages, [[h, *x] for h, x in self.texts.items()], self.chars, self.links, self.kind, [c.written() for c in self.children]]

    @classmethod
    def read(cls, x: list) -> "Part":
        out = cls(x[0], bool(x[1]))
        out.pages, out.texts, out.chars, out.links, out.kind = x[2], {h: (n, size) for h, n, size in x[3]}, x[4], x[5], x[6]
        out.children = [cls.read(c) for c in x[7]]
        return out


#: What the wrapper says of a node: not in the article's slot, the slot itself or in it, or in it and left out.
OUTSIDE, SLOT, INSIDE, LEFT_OUT = range(4)


def groups(members: list[Node]) -> list[list[Node]]:
    """The children of blocks: those of one shape beside one another together; if these differ or are over WIDE, all of one label."""
    runs = [runs_of(node) for node in members]
    if all(len(own) == len(runs[0]) <= WIDE for own in runs):
        return [[node for own in runs for node in own[k]] for k in range(len(runs[0]))]
    named: dict[str, list[Node]] = {}
    for node in members:
        for x in node.items:
            if isinstance(x, Node):
                named.setdefault(x.label, []).append(x)
    return [own for _, own in sorted(named.items())]


def runs_of(node: Node) -> list[list[Node]]:
    out: list[list[Node]] = []
    for x in node.items:
        if isinstance(x, Node):
            if out and out[-1][0].shape == x.shape:
                out[-1].append(x)
            else:
                out.append([x])
    return out


def shape(node: Node) -> int:
    for x in node.items:
        if isinstance(x, Node):
            shape(x)
    node.shape = hash((node.label, *[run[0].shape for run in runs_of(node)]))
    return node.shape


def part_of(members: list[Node]) -> Part:
    """Blocks of one shape, or of one label, as one part, children likewise."""
    out = Part(members[0].label, members[0].named)
    out.members = members
    for node in members:
        out.links += node.links
        for x in node.items:
            if isinstance(x, str):
                out.texts[code(x)] = (1, len(x))
                out.chars += len(x)
    out.children = [part_of(own) for own in groups(members)]
    return out


def tree_of(page: str | None) -> Part:
    root = parse(page)
    shape(root)
    return part_of([root])


def score(a: Part, b: Part) -> int:
    """Simple tree matching: the greatest number of nodes matched, order and parents kept."""
    if a.label != b.label:
        return 0
    return 1 + (last_row(a.children, b.children)[-1] if a.children and b.children else 0)


def last_row(x: list[Part], y: list[Part]) -> list[int]:
    """Of x matched with each beginning of y."""
    above = [0] * (len(y) + 1)
    for p in x:
        row = [0]
        for j, q in enumerate(y):
            best = max(above[j + 1], row[j])
            if p.label == q.label:
                best = max(best, above[j] + score(p, q))
            row.append(best)
        above = row
    return above


def best_pairs(x: list[Part], y: list[Part]) -> list[tuple[Part, Part]]:
    """The pairs of children that a best matching of two lists has."""
    if not x or not y:
        return []
    rows, taken = [0] * (len(y) + 1), []
    for p in x:
        row, steps = [0], bytearray(len(y) + 1)
        for j, q in enumerate(y):
            best, step = (rows[j + 1], 0) if rows[j + 1] >= row[j] else (row[j], 1)
            if p.label == q.label and rows[j] + (n := score(p, q)) > best:
                best, step = rows[j] + n, 2
            row.append(best)
            steps[j + 1] = step
        rows = row
        taken.append(steps)
    out, i, j = [], len(x), len(y)
    while i and j:
        step = taken[i - 1][j]
        if step == 2:
            out.append((x[i - 1], y[j - 1]))
        i, j = i - (step != 1), j - (step != 0)
    return out[::-1]


def aligned(a: Part, b: Part) -> Iterator[tuple[Part, Part]]:
    """The pairs of nodes in a best simple tree matching."""
    if a.label == b.label:
        yield a, b
        for p, q in best_pairs(a.children, b.children):
            yield from aligned(p, q)


def merge(wrapper: Part, page: Part) -> None:
    """Add a page's tree to a wrapper; nodes that it lacks go after the last one that matches."""
    wrapper.pages += page.pages
    wrapper.chars += page.chars
    wrapper.links += page.links
    for h, (n, size) in page.texts.items():
        wrapper.texts[h] = (wrapper.texts.get(h, (0, 0))[0] + n, size)
    partner = {id(q): p for p, q in best_pairs(wrapper.children, page.children)}
    children, at = list(wrapper.children), 0
    for q in page.children:
        if id(q) in partner:
            merge(partner[id(q)], q)
            at = next(k for k, c in enumerate(children) if c is partner[id(q)]) + 1
        else:
            children.insert(at, q)
            at += 1
    wrapper.children = children


def all_texts(part: Part, out: dict[int, int]) -> dict[int, int]:
    out.update((h, size) for h, (_, size) in part.texts.items())
    for c in part.children:
        all_texts(c, out)
    return out


def mass(part: Part) -> float:
    """Characters of a node and below that vary and are no links; of what names itself no article, a part."""
    constant = sum(n * size for n, size in part.texts.values() if n >= 2 and 2 * n > part.pages)
    own = max(0, part.chars - part.links - constant)
    return (own + sum(mass(c) for c in part.children)) * (NAMED if part.named else 1)


def sums(part: Part) -> tuple[int, int]:
    below = [sums(c) for c in part.children]
    return part.chars + sum(c for c, _ in below), part.links + sum(n for _, n in below)


def menu(part: Part) -> bool:
    chars, links = sums(part)
    return links > LINKS * chars


def headed(part: Part) -> bool:
    """Whether a heading that varies is in it, outside of menus and what names itself no article."""
    if part.named or menu(part):
        return False
    return bool(HEADING.match(part.label.partition(".")[0]) and mass(part)) or any(headed(c) for c in part.children)


def decided(wrapper: Part) -> Part:
    """Mark the slot of the article and what in it is left out."""
    at = wrapper
    while at.children:
        best = max(at.children, key=mass)
        if best.label.partition(".")[0] not in CONTAINERS or not mass(best) or mass(best) < MOST * mass(at):
            break
        if any(headed(c) for c in at.children if c is not best):
            break
        at = best
    whole = mass(at)

    def mark(part: Part) -> None:
        for c in part.children:
            c.kind = LEFT_OUT if menu(c) or (c.named and mass(c) < SMALL * whole) else INSIDE
            if c.kind == INSIDE:
                mark(c)

    at.kind = SLOT
    mark(at)
    return wrapper


def induced(trees: list[Part]) -> Part:
    """The wrapper of pages' trees; copies of one that is in it, by most of their text, are passed over."""
    wrapper, known = None, []
    for tree in trees:
        texts = all_texts(tree, {})
        size = sum(texts.values())
        if any(sum(n for h, n in texts.items() if h in old) >= COPY * size for old in known if size):
            continue
        known.append(texts)
        if wrapper is None:
            wrapper = tree
        else:
            merge(wrapper, tree)
    return decided(wrapper) if wrapper is not None else decided(Part("#", False))


def blocks(tree: Part, wrapper: Part) -> list[str] | None:
    """The texts of a page that are in its wrapper's slot; none if the page has no such slot."""
    said = {id(p): w for p, w in aligned(tree, wrapper)}
    kinds: dict[int, tuple[int, Part | None]] = {}  # of the page's blocks
    found, room = False, 0

    def tell(part: Part, above: int) -> None:
        nonlocal found, room
        w = said.get(id(part))
        if above in (SLOT, INSIDE):
            kind = w.kind if w is not None and w.kind in (INSIDE, LEFT_OUT) else INSIDE if w is None else above
            if w is None and (menu(part) or (part.named and mass(part) < SMALL * room)):
                kind = LEFT_OUT
        else:
            kind = OUTSIDE if above == LEFT_OUT or w is None else w.kind
        if kind == SLOT:
            found, room = True, mass(part)
        for node in part.members:
            kinds[id(node)] = kind, w
        for c in part.children:
            tell(c, kind)

    tell(tree, OUTSIDE)
    if not found:
        return None
    out: list[str] = []

    def write(node: Node) -> None:
        kind, w = kinds[id(node)]
        for x in node.items:
            if isinstance(x, Node):
                write(x)
            elif kind in (SLOT, INSIDE):
                n = w.texts.get(code(x), (0, 0))[0] if w is not None and w.pages >= ENOUGH else 0
                if not n or n < w.pages:
                    out.append(x)

    for node in tree.members:
        write(node)
    return out


def main_text(tree: Part, wrapper: Part | None) -> str:
    found = blocks(tree, wrapper) if wrapper is not None else None
    if found is None:  # nothing is like this page, so it is its own wrapper
        found = blocks(tree, decided(Part.read(tree.written())))
    return "\n".join(found or ())


def layout(tree: Part) -> str:
    """The labels of the outermost blocks of which there are several."""
    while len(tree.children) == 1 and tree.children[0].children:
        tree = tree.children[0]
    return "|".join(sorted({c.label for c in tree.children}))


HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"


def chosen(pages: DataFrame, peers: int) -> DataFrame:
    """(host, layout, h0, t0, h1, t1, ...): trees of every group with the least hashes of their texts, under as many seeds as there are peers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        best: dict[tuple, tuple[int, str]] = {}

        def out() -> pa.RecordBatch:
            columns = [*zip(*[(*key, *value) for key, value in best.items()])] or [[]] * 5
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string()))], ["host", "layout", "seed", "h", "tree"])

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tree = tree_of(page)
                key = repr(sorted(all_texts(tree, {}))).encode()
                group, text = (host, layout(tree)), None
                for j in range(peers):
                    h = xxhash.xxh64_intdigest(key, j) >> 1
                    old = best.get((*group, j))
                    if old is None or h <= old[0]:
                        text = text or json.dumps(tree.written(), separators=(",", ":"))
                        if old is None or (h, text) < old:
                            best[*group, j] = h, text
                if len(best) >= KEPT:
                    yield out()
        yield out()

    found = pages.mapInArrow(run, "host string, layout string, seed int, h long, tree string")
    return found.groupBy("host", "layout", "seed").agg(F.min(F.struct("h", "tree")).alias("p"))


def wrappers(pages: DataFrame, peers: int) -> DataFrame:
    """(host, layout, wrapper) of every host and layout; pages has host and html."""
    picks = materialise(chosen(pages, peers))

    def induce(keys: list[str], least: DataFrame) -> DataFrame:
        """The wrapper of each group, and of how many pages it is."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [induced([Part.read(json.loads(t)) for t in trees]) for trees in batch.column(batch.num_columns - 1).to_pylist()]
                columns = [pa.array([x.pages for x in made], pa.int32()), pa.array([json.dumps(x.written(), separators=(",", ":")) for x in made], pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*keys, "pages", "wrapper"])

        trees = least.groupBy(*keys).agg(F.sort_array(F.collect_set("p.tree")).alias("trees"))  # one for each seed, at most
        return trees.mapInArrow(run, "".join(f"{k} string, " for k in keys) + "pages int, wrapper string")

    again = lambda *keys: picks.groupBy(*keys, "seed").agg(F.min("p").alias("p"))
    both = induce(["host", "layout"], picks)
    host = induce(["host"], again("host")).select("host", F.col("pages").alias("host_pages"), F.col("wrapper").alias("host_wrapper"))
    same = induce(["layout"], again("layout")).select("layout", F.col("pages").alias("layout_pages"), F.col("wrapper").alias("layout_wrapper"))
    offer = lambda rank, n, w: F.struct(F.least(F.col(n), F.lit(ENOUGH)).alias("n"), F.lit(-rank).alias("rank"), F.col(w).alias("wrapper"))
    best = F.greatest(offer(0, "pages", "wrapper"), offer(1, "host_pages", "host_wrapper"), offer(2, "layout_pages", "layout_wrapper"))
    return both.join(host, "host").join(same, "layout").select("host", "layout", best["wrapper"].alias("wrapper"))


def extract(pages: DataFrame, peers: int = PEERS, broadcast: int = BROADCAST) -> DataFrame:
    """(page_id, url, text) of every page."""
    host = F.coalesce(F.regexp_extract(F.lower("url"), HOST, 1), F.lit(""))
    own = pages.select("page_id", "url", "html", host.alias("host"))
    schema = pages.select("page_id", "url").schema.add("text", "string")
    if not peers:
        known = None
    else:
        known = materialise(wrappers(own.select("host", "html"), peers))
        size = known.agg(F.sum(F.length("wrapper") + F.length("host") + F.length("layout"))).first()[0] or 0
    if known is None or size <= broadcast:
        table_ = {(r["host"], r["layout"]): r["wrapper"] for r in known.toLocalIterator()} if known is not None else {}
        sent = pages.sparkSession.sparkContext.broadcast(table_)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of (page_id, url, html, host), by the broadcast wrappers, or of (page_id, url, html, wrapper)."""
        read: dict[str, Part] = {}
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch, out = whole.slice(i, 1000), []
                for page, key in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    tree = tree_of(page)
                    text = sent.value.get((key, layout(tree))) if batch.schema.names[3] == "host" else key
                    if text is not None and text not in read:
                        if len(read) >= 256:
                            read.clear()
                        read[text] = Part.read(json.loads(text))
                    out.append(main_text(tree, read[text] if text is not None else None))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.string())], ["page_id", "url", "text"])

    if known is None or size <= broadcast:
        return own.mapInArrow(texts, schema)
    sent = None

    def layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([layout(tree_of(x)) for x in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "layout"])

    laid = own.mapInArrow(layouts, type(schema)([*own.schema.fields]).add("layout", "string"))
    salted = laid.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)))
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).hint("merge")
    return salted.join(spread, ["host", "layout", "salt"], "left").select("page_id", "url", "html", "wrapper").mapInArrow(texts, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
