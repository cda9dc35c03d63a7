"""Main text of web pages by wrapper induction.

Pages of a host share a template. The whole tree of each, menus and adverts included, is aligned with that of the host's
first page by simple tree matching: two nodes with one label match with the best order-keeping match of their children.
Runs of siblings with one label are one node, so that a list or a text of many paragraphs is one place of the template;
but boxes without a name are each a place.
All pages of a host vote on each node: is its text the same as in the first page, and how much text is it? Nodes with
constant text become template. Varying nodes are slots, told apart by what they hold:

- content is where the text is: from the root down, the container that has most of the varying text outside links, as
  long as it also has the heading that varies;
- a slot in it that holds links rather than text is a list of links, not content;
- names and tags (nav, footer, `class="ad"`) only weigh: a slot that is named as an aside counts for a tenth of its text
  in the search for the content, `article` and `main` for ten times theirs; an aside is left out of the content unless it
  holds a third of it.

So pages whose names mean nothing are read as well, and a sole page is read by the same rule, without votes of others. A
page's main text is what it has at the place of the content, less template and the slots that were told apart. A page that
has nothing there is read by its tags.

Votes are sums by host and node, added up in tasks before they are shuffled, so a host with a third of all pages is
no more work for one task than another. Null html is an empty page; null urls are one host. Copies of the first page
don't vote. Repeated rows get equal results. A page is read whole. Empty tables give no rows. Other columns pass through the operator.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import Scratch, query, rows_of, table
from millrace.llm.dom import MAIN_TAGS, Element, flowing, parse, pieces

#: Elements that may be the place of a host's content; others are parts of a text.
CONTAINERS = frozenset({"", "html", "body", "main", "article", "section", "div", "td", "center", "table", "tbody", "tr"})
#: Labels of boxes without a name: side by side they are places of their own, not a list.
BARE = frozenset({"div", "section", "article"})
HEADINGS = frozenset({"h1", "h2"})
#: Share of the text that the content's container must have of what is around it.
DOMINANT = 0.6
#: What a name as an aside leaves of a slot's weight, what `article` and `main` make of it, and the share of the content at
#: which a slot's text outweighs its name.
NAMED_WEIGHT, MAIN_WEIGHT, NAMED_SHARE = 0.1, 10.0, 1 / 3
#: Share of a slot's text in links from which it is a list of links.
LINKS = 0.5


class Node:
    """Elements of one label that stand side by side, as one place of the template."""

    __slots__ = ("label", "tag", "members", "kids", "number", "linked", "aside")

    def __init__(self, members: list[Element], linked: bool = False):
        self.label, self.tag, self.members = members[0].label, members[0].tag, members
        self.linked, self.aside = linked or self.tag == "a", members[0].aside
        runs: list[list[Element]] = []
        for member in members:
            for kid in member.kids:
                if not isinstance(kid, str) and not kid.silent:
                    if runs and runs[-1][0].label == kid.label and kid.label not in BARE:
                        runs[-1].append(kid)
                    else:
                        runs.append([kid])
        self.kids = [Node(run, self.linked) for run in runs]

    def text(self) -> str:
        """Texts that stand in the node itself."""
        return flowing([x for m in self.members for x in (*(k for k in m.kids if isinstance(k, str)), " ")])


def tree(page: str) -> Node:
    return Node([parse(page)])


def numbered(root: Node) -> list[Node]:
    """All nodes in page order, each with its place in that list."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        node.number = len(out)
        out.append(node)
        todo.extend(reversed(node.kids))
    return out


def matched(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: size and pairs of the largest match that keeps order and ancestry."""
    if a.label != b.label:
        return 0, []
    m, n = len(a.kids), len(b.kids)
    labels = [k.label for k in a.kids]
    if m == n and labels == [k.label for k in b.kids] and len(set(labels)) == m:
        found = [matched(x, y) for x, y in zip(a.kids, b.kids, strict=True)]
        return 1 + sum(s for s, _ in found), [(a, b), *(p for _, pairs in found for p in pairs)]
    part = [[matched(x, y) if x.label == y.label else (0, []) for y in b.kids] for x in a.kids]
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        above, row, own = best[i - 1], best[i], part[i - 1]
        for j in range(1, n + 1):
            row[j] = max(row[j - 1], above[j], above[j - 1] + own[j - 1][0])
    pairs, i, j = [], m, n
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs.append(part[i - 1][j - 1][1])
            i, j = i - 1, j - 1
    return 1 + best[m][n], [(a, b), *(p for found in reversed(pairs) for p in found)]


_VOTES = pa.schema([("host", pa.string()), ("node", pa.int32()), ("seen", pa.int64()), ("same", pa.int64()), ("chars", pa.int64())])


class _Recent(OrderedDict):
    """What was made of the last keys; pages of a host come together or are few hosts."""

    def __init__(self, make, most: int = 256):
        self.make, self.most = make, most

    def of(self, key, *given):
        if key not in self:
            self[key] = self.make(*given)
            if len(self) > self.most:
                self.popitem(last=False)  # the one that was not asked for the longest
        self.move_to_end(key)
        return self[key]


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each host and node of its first page: pages that have it, with the same text, and their characters."""

    def first(page: str):
        nodes = numbered(tree(page))
        return nodes, [n.text() for n in nodes]

    hosts: _Recent = _Recent(first)
    sums: dict[tuple[str, int], list[int]] = {}

    def told() -> pa.RecordBatch:
        rows = [(h, k, *v) for (h, k), v in sums.items()]
        sums.clear()
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _VOTES, strict=True)], schema=_VOTES)

    for batch in rows_of(batches):
        for host, page, pivot in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if page == pivot:
                continue
            nodes, texts = hosts.of((host, pivot), pivot)
            for a, b in matched(nodes[0], tree(page))[1]:
                text = b.text()
                sum_ = sums.setdefault((host, a.number), [0, 0, 0])
                sum_[0] += 1
                sum_[1] += text == texts[a.number]
                sum_[2] += len(text)
        if len(sums) > 50_000:
            yield told()
    yield told()


class Wrapper:
    """A host's template, ready to read pages."""

    def __init__(self, page: str, votes: list[dict], share: float):
        self.nodes = numbered(tree(page))
        told = {v["node"]: v for v in votes}
        texts = [n.text() for n in self.nodes]
        # the first page has its own text, of course: others must have it, too
        self.template = {k for k, v in told.items() if texts[k] and v["same"] and v["same"] >= share * v["seen"]}
        chars = [len(texts[k]) + (told[k]["chars"] if k in told else 0) for k in range(len(self.nodes))]
        own = [0 if k in self.template else c for k, c in enumerate(chars)]
        self.parent = {kid.number: n.number for n in self.nodes for kid in n.kids}
        self.text = [0 if n.linked else own[n.number] for n in self.nodes]
        self.links = [own[n.number] if n.linked else 0 for n in self.nodes]
        self.weight = [float(x) for x in self.text]
        self.heads = [int(n.tag in HEADINGS and not n.linked and own[n.number] > 0) for n in self.nodes]
        for k in range(len(self.nodes) - 1, -1, -1):
            if self.nodes[k].aside:
                self.weight[k] *= NAMED_WEIGHT
                self.heads[k] = 0
            elif self.nodes[k].tag in MAIN_TAGS:
                self.weight[k] *= MAIN_WEIGHT
            if k:
                for of in (self.text, self.links, self.weight, self.heads):
                    of[self.parent[k]] += of[k]
        self.place = self._content()
        self.left = self._left_out()

    def _content(self) -> int:
        at = 0
        while True:
            inner = max((kid.number for kid in self.nodes[at].kids if kid.tag in CONTAINERS), key=lambda k: self.weight[k], default=None)
            if inner is None or self.weight[inner] < DOMINANT * self.weight[at] or not self.weight[inner] or self.heads[inner] < min(self.heads[at], 1):
                return at
            at = inner

    def _left_out(self) -> dict[int, bool]:
        """The slots within the content, and whether they are left out."""
        out, todo = {}, [kid.number for kid in self.nodes[self.place].kids]
        while todo:
            k = todo.pop()
            text, links = self.text[k], self.links[k]
            listed = links > LINKS * (text + links) and self.nodes[k].tag not in ("a", "p")
            small = text < NAMED_SHARE * self.text[self.place]
            out[k] = small and (listed or self.nodes[k].aside)
            if not out[k]:
                todo += [kid.number for kid in self.nodes[k].kids]
        return out

    def read(self, page: str) -> str:
        root = tree(page)
        at = {a.number: b for a, b in matched(self.nodes[0], root)[1]}
        if self.place in at:
            skip = {id(m) for k in self.template if k in at for m in at[k].members}
            left = {id(m): gone for k, gone in self.left.items() if k in at for m in at[k].members}
            parts: list[str] = []
            for member in at[self.place].members:
                pieces(member, skip, parts, left)
                parts.append(" ")
            if text := flowing(parts):
                return text
        return by_tags(root.members[0])


def by_tags(root: Element) -> str:
    """Main text of a page by itself: of its articles, else its main, else all that is no aside."""
    for tag in ("article", "main", ""):
        found, todo = [], [root]
        while todo:
            e = todo.pop()
            if e.tag == tag:
                found.append(e)
            else:
                todo.extend(k for k in reversed(e.kids) if not isinstance(k, str) and not k.aside)
        parts: list[str] = []
        for e in found:
            pieces(e, frozenset(), parts)
            parts.append(" ")
        if text := flowing(parts):
            return text
    return ""


def _read(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: _Recent = _Recent(lambda page, votes: Wrapper(page, votes, share))
        for batch in rows_of(batches):
            host, page, pivot, votes = (batch.column(k) for k in range(1, 5))
            texts = []
            for k in range(batch.num_rows):
                name, html = host[k].as_py(), page[k].as_py()
                key = (name, hash(pivot[k].as_py()))
                wrapper = hosts[key] if key in hosts else hosts.of(key, pivot[k].as_py() or "", votes[k].as_py() or [])
                texts.append(wrapper.read(html) if html else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    return run


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = 0.9) -> DataFrame:
    """(row, text): each row as a struct, and its page's main text. A node is template if at least `share` of the other
    pages of the host that have it have it with the same text."""
    scratch = Scratch(pages.sparkSession, "wrapper")
    html = pages[f"`{html_col}`"].cast("string")
    df = pages.select(F.struct(*[pages[f"`{c}`"] for c in pages.columns]).alias("row"), host_of(pages[f"`{url_col}`"]).alias("host"), html.alias("page"), pages[f"`{id_col}`"].alias("id"))
    first = df.filter("page <> ''").groupBy("host").agg(F.min(F.struct("id", "page"))["page"].alias("pivot"))
    first = scratch.write(first, "first")
    votes = df.select("host", "page").filter("page <> ''").join(first, "host").mapInArrow(_votes, "host string, node int, seen long, same long, chars long")
    votes = votes.groupBy("host", "node").agg(F.sum("seen").alias("seen"), F.sum("same").alias("same"), F.sum("chars").alias("chars"))
    # as many votes a host as its first page has nodes
    votes = votes.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("node", "seen", "same", "chars"))).alias("votes"))
    wrappers = scratch.write(first.join(votes, "host", "left"), "wrappers")
    told = df.select("row", "host", "page").join(wrappers, "host", "left").select("row", "host", "page", "pivot", "votes")
    return told.mapInArrow(_read(share), T.StructType([told.schema["row"], T.StructField("text", T.StringType())]))


@query("op10_html_extraction")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(table(spark, sf_dir, "pages"))
    return out.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
