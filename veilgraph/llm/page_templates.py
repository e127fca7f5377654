"""Main text of pages by equivalence-class template deduction.

The tokens of a page are its tags, told apart by their place in the page (the path of their containers, those of one
label numbered), and its text nodes. Tokens of one host that occur equally often on each of its pages share an occurrence
vector; it is summed as one hash a token, so vectors need no page to meet another in a task. Tokens of equal vectors on
at least SUPPORT of the host's pages make an equivalence class; it is valid if its members' mean places are in order, and
classes must nest: one that crosses a larger one is dropped. The containers of the valid classes are the template, what
they hold directly or in containers beside the template are slots. Text nodes on SUPPORT of a host's page contents are
text of the template, others are data; contents count once however many copies they have, and pages whose three longest
text nodes agree are copies. The slot with most data is the host's main slot; it grows to the containers around it that
add more data than text of the template. Names of elements and classes have no part in that.

A page's text is what stands in its host's main slot, without the containers that by element, role or name are menus,
headers, footers, sidebars, notices, adverts, forms or comments. Nothing else is left out of the slot, except where it
is the body itself: there text of the template ends a slot like its tags do. A page of a host of fewer than
LEAST_PAGES contents, or without the main slot, has no template: its article or main element counts, or else its own
container with most text.

Defined results: null and empty pages give an empty text. A null or odd URL counts as host "". Repeated rows are
treated one by one. Columns other than id, url and html are not read. Tags that never end are text of no page; reading a
page takes time in proportion to its length, whatever it holds.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_shuffles, remove, shared_dir, stored

SUPPORT, LEAST_PAGES, BROADCAST_HOSTS = 0.5, 4, 20_000
#: Containers that lie deeper count as part of the container at this depth.
MOST_DEPTH = 64
TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)")
REST_OF_TAG = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Elements whose content is no text, containers, other elements that end a block, and void elements.
RAW = {"script", "style", "template", "iframe", "head", "select", "textarea", "button"}
CONTAINERS = set("html body div section article main nav header footer aside form ul ol dl table figure fieldset details dialog menu".split())
BLOCKS = CONTAINERS | set("p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody caption blockquote pre address hr figcaption summary legend title option".split())
DROPPED = {"nav", "footer", "aside", "form", "menu", "dialog"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "alert", "dialog"}
NAMES = set(
    "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs masthead header footer sidebar side widget widgets related recommended recommendations "
    "share sharing social cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search form comment comments reply replies respond responses discussion disqus toolbar pagination pager skip".split()
)
CONTENT = {"article", "post", "entry", "story", "content", "main"}


def host_of(url: str | None) -> str:
    _, mark, rest = (url or "").partition("://")
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower() if mark else ""


class Node:
    """An open container."""

    __slots__ = ("name", "path", "dropped", "article", "main", "inside")

    def __init__(self, name: str, attributes: str, parent: Node | None):
        found = {k.lower(): (v or "").strip("\"'").lower() for k, v in ATTRIBUTE.findall(attributes)} if attributes else {}
        words = set(re.split(r"[^a-z]+", f"{found.get('class', '')} {found.get('id', '')}"))
        label = name + ("".join("." + w for w in sorted(found.get("class", "").split())) + ("#" + re.sub(r"\d+", "0", found["id"]) if found.get("id") else "")).replace("/", "|")
        label = label if len(label) <= 80 else f"{name}.{xxhash.xxh64_hexdigest(label.encode('utf-8', 'surrogatepass'))}"
        self.inside: Counter = Counter()
        if parent:  # containers of one label in one container are told apart by their number
            parent.inside[label] += 1
            label += f"[{parent.inside[label]}]" if parent.inside[label] > 1 else ""
        self.name, self.path = name, (parent.path + "/" if parent else "") + label
        role, within = found.get("role", ""), bool(parent and parent.article)
        named = bool(words & NAMES) and not (words & CONTENT and not words & {"comment", "comments", "related", "sidebar", "ad", "ads", "share", "social"})
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        self.dropped = bool(parent and parent.dropped) or hidden or name != "body" and (name in DROPPED or name == "header" and not within or role in ROLES or (named and name not in ("html", "article", "main") or bool(words & {"comment", "comments", "reply", "ad", "ads", "related"})))
        self.article = within or (name == "article" and not self.dropped)
        self.main = bool(parent and parent.main) or name == "main" or role == "main"


def markup(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether it closes, name, attributes) of each tag; comments and declarations have no name, elements of
    RAW come as one piece. Each character is read a bounded number of times: a quote that is never closed ends quoting for
    the rest of the page, and what is known not to come again is not sought again."""
    last, at, quoting, unclosed = page.rfind(">"), 0, True, set()
    while 0 <= (i := page.find("<", at)):
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = len(page) if end < 0 else end + 3
            yield i, at, False, "", ""
            continue
        if i > last:
            return
        m = TAG.match(page, i)
        if not m:
            if page[i + 1 : i + 2] in ("!", "?"):
                at = page.find(">", i) + 1
                yield i, at, False, "", ""
            else:
                at = i + 1
            continue
        rest = REST_OF_TAG.match(page, m.end()) if quoting else None
        if not rest:
            quoting = False
        at = rest.end() if rest else page.find(">", m.end()) + 1
        if not at:
            return
        close, name, attributes = m[1] == "/", m[2].lower(), page[m.end() : at - 1]
        if name in RAW and not close and not attributes.rstrip().endswith("/"):
            over = None if name in unclosed else re.compile(rf"</{name}\s*+>", re.I).search(page, at)
            if over:
                at = over.end()
            elif name in ("script", "style"):
                at = len(page)
            else:
                unclosed.add(name)
        yield i, at, close, name, attributes


def parse(page: str) -> tuple[list[tuple[str, Node | None, int]], list[tuple[str, int]]]:
    """Text nodes (text, container, number of the block) and tag tokens (token, place), in page order."""
    texts: list[tuple[str, Node | None, int]] = []
    tags: list[tuple[str, int]] = []
    stack: list[Node] = []
    at = block = place = deeper = 0
    for start, end, close, name, attributes in markup(page):
        if start > at:
            texts.append((page[at:start], stack[-1] if stack else None, block))
        at = end
        if name in BLOCKS or name == "head":
            block += 1
        elif name == "br":
            texts.append((" ", stack[-1] if stack else None, block))
        if name not in CONTAINERS:
            continue
        if not close and len(stack) >= MOST_DEPTH:
            deeper += 1
        elif not close:
            stack.append(Node(name, attributes, stack[-1] if stack else None))
            tags.append((stack[-1].path, place))
        elif deeper:
            deeper -= 1
        else:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    tags.append(("/" + stack[i].path, place))
                    del stack[i:]
                    break
        place += 1
    if at < len(page):
        texts.append((page[at:], stack[-1] if stack else None, block))
    return texts, tags


def clean(text: str) -> str:
    return " ".join(entities.unescape(text).split())


def joined(nodes: list[tuple[str, int]]) -> str:
    """Blocks of (text, block number) in order, white space as one space, joined by line ends."""
    blocks: dict[int, list[str]] = {}
    for text, block in nodes:
        blocks.setdefault(block, []).append(text)
    return "\n".join(x for parts in blocks.values() if (x := clean("".join(parts))))


def token_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by host and token over a task's pages: pages, vector hash, places, characters. Kind 0: the host itself, 1: tag,
    2: text node in the container path. Kinds 0 and 2 also by the page's content."""
    task, number = TaskContext.get().partitionId(), 0
    sums: dict[tuple, list] = {}

    def add(key: tuple, page: int, times: int, place: float, chars: int) -> None:
        own = sums.setdefault(key, [0, 0, 0.0, 0])
        own[0] += 1
        own[1] = (own[1] + xxhash.xxh64_intdigest(b"%d %d" % (page, times))) & ((1 << 62) - 1)
        own[2] += place
        own[3] += chars

    def rows() -> pa.RecordBatch:
        columns = list(zip(*((*k, *v) for k, v in sums.items()), strict=True))
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["host", "kind", "token", "path", "content", "pages", "vector", "place", "chars"])

    for b in batches:
        for url, page in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            host, number = host_of(url), number + 1
            page_key = task << 40 | number
            texts, tags = parse(page or "")
            count, first, seen = Counter(t for t, _ in tags), {}, Counter()
            for t, place in tags:
                first.setdefault(t, place / max(1, len(tags)))
            for t, times in count.items():
                add((host, 1, token_hash(t), t, 0), page_key, times, first[t], 0)
            for text, node, _ in texts:
                if (x := clean(text)) and not (node and node.dropped):
                    seen[x, node.path if node else ""] += 1
            content = token_hash("\n".join(sorted({x for x, _ in seen}, key=lambda x: (-len(x), x))[:3]))
            add((host, 0, 0, "", content), page_key, 1, 0, 0)
            for (x, path), times in seen.items():
                add((host, 2, token_hash(x), path, content), page_key, times, 0, times * len(x))
            if len(sums) > 100_000:
                yield rows()
                sums.clear()
    if sums:
        yield rows()


def page_level(path: str) -> bool:
    """Whether the path is of a whole page."""
    return re.split(r"[.#\[]", path.rpartition("/")[2], maxsplit=1)[0] in ("", "html", "body")


def main_slot(tags: list[str], slots: list[tuple[str, int, int]]) -> str | None:
    """Path of the main slot. tags: containers of the template; slots: (path, characters of data, of text of the template)."""
    best, data, _ = max(slots, key=lambda s: (s[1], s[0]), default=("", 0, 0))
    if not data:
        return None
    parts = best.split("/")
    ups = ["/".join(parts[:i]) for i in range(len(parts), 0, -1)]
    held = set(tags)

    def within(p: str) -> tuple[int, int]:
        inside = [s for s in slots if s[0] == p or s[0].startswith(p + "/")]
        return sum(s[1] for s in inside), sum(s[2] for s in inside)

    for p in ups[1:]:
        if p in held and not page_level(p) and not page_level(best):
            (more, fixed), (own, own_fixed) = within(p), within(best)
            if more - own > fixed - own_fixed:
                best = p
    return best


def _main(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [main_slot(tags or [], [(s["path"], s["data"], s["fixed"]) for s in slots or []]) for tags, slots in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string()), b.column(3)], ["host", "main", "boilerplate"])


def templates(pages: DataFrame, folder: str) -> DataFrame:
    """host, main (path of the main slot), boilerplate (hashes of text nodes of the template)."""
    summed = pages.mapInArrow(_tokens, "host string, kind int, token long, path string, content long, pages long, vector long, place double, chars long")
    summed = summed.groupBy("host", "kind", "token", "path", "content").agg(F.sum("pages").alias("pages"), (F.sum(F.col("vector").cast("decimal(30,0)")) % (1 << 62)).cast("long").alias("vector"), (F.sum("place") / F.sum("pages")).alias("place"), F.sum("chars").alias("chars"))
    summed = stored(summed, f"{folder}/tokens")
    hosts = summed.where("kind = 0").groupBy("host").agg(F.sum("pages").alias("total"), F.count("*").alias("contents")).where(F.col("contents") >= LEAST_PAGES)
    hosts = stored(hosts, f"{folder}/hosts")
    # beside every row of its host only where it is small; else Spark splits hosts with many rows
    of_host = F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts
    # equivalence classes of tags: equal vectors; order within a class by mean place, nesting by the spans
    tags = summed.where("kind = 1").join(of_host, "host").where(F.col("pages") >= SUPPORT * F.col("total"))
    tags = tags.groupBy("host", "vector", "pages").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("size"), F.array_sort(F.collect_list(F.struct("place", "path"))).alias("members"))
    larger = Window.partitionBy("host").orderBy(F.desc("size"), "first", "vector").rowsBetween(Window.unboundedPreceding, -1)
    spans = F.collect_list(F.struct("first", "last")).over(larger)
    crosses = F.exists(spans, lambda s: ((s["first"] < F.col("first")) & (F.col("first") < s["last"]) & (s["last"] < F.col("last"))) | ((F.col("first") < s["first"]) & (s["first"] < F.col("last")) & (F.col("last") < s["last"])))
    valid = tags.withColumn("crosses", crosses).where("NOT crosses").select("host", F.explode(F.transform("members", lambda m: m["path"])).alias("up")).where("up NOT LIKE '/%'")
    # written, so that the join below deals its rows by host and container, not by host alone
    valid = stored(valid, f"{folder}/valid")
    # text nodes of the template, by the contents that hold them
    texts = summed.where("kind = 2").join(of_host, "host")
    fixed = texts.groupBy("host", "token", "content", "contents").agg(F.lit(1).alias("one")).groupBy("host", "token", "contents").agg(F.count("*").alias("held")).where(F.col("held") >= SUPPORT * F.col("contents")).select("host", "token", F.lit(True).alias("fixed"))
    # each container's text counts for the slot of its nearest container of the template
    paths = texts.join(fixed, ["host", "token"], "left").groupBy("host", "path").agg(F.sum(F.when(F.col("fixed").isNull(), F.col("chars")).otherwise(0)).alias("data"), F.sum(F.when(F.col("fixed"), F.col("chars")).otherwise(0)).alias("fixed"))
    parts = F.split("path", "/")
    ups = paths.withColumn("up", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))).join(valid, ["host", "up"])
    slots = ups.groupBy("host", "path", "data", "fixed").agg(F.max_by("up", F.length("up")).alias("slot")).groupBy("host", "slot").agg(F.sum("data").alias("data"), F.sum("fixed").alias("fixed"))
    slots = slots.groupBy("host").agg(F.collect_list(F.struct(F.col("slot").alias("path"), "data", "fixed")).alias("slots"))
    found = hosts.select("host").join(valid.groupBy("host").agg(F.collect_list("up").alias("tags")), "host", "left").join(slots, "host", "left")
    found = found.join(fixed.groupBy("host").agg(F.collect_list("token").alias("boilerplate")), "host", "left").select("host", "tags", "slots", "boilerplate")
    return found.mapInArrow(_main, "host string, main string, boilerplate array<long>")


def main_text(page: str, main: str | None, boilerplate: frozenset) -> str:
    texts, _ = parse(page)
    kept = [(t, n, b) for t, n, b in texts if not (n and n.dropped)]
    data = [(t, n, b) for t, n, b in kept if not boilerplate or token_hash(clean(t)) not in boilerplate]
    if main:
        inside = [(t, b) for t, n, b in (data if page_level(main) else kept) if n and (n.path == main or n.path.startswith(main + "/"))]
        if any(t.strip() for t, _ in inside):
            return joined(inside)
    for within in ("article", "main"):  # no template for this page
        inside = [(t, b) for t, n, b in kept if n and getattr(n, within)]
        if any(t.strip() for t, _ in inside):
            return joined(inside)
    size: Counter = Counter()
    for t, n, _ in data if any(t.strip() for t, _, _ in data) else kept:
        size[n.path if n else ""] += len(t.strip())
    best = max(size, key=lambda p: (size[p], p), default="")
    return joined([(t, b) for t, n, b in kept if (n.path if n else "") == best or (n and best and n.path.startswith(best + "/"))])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "pages")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    host = F.when(F.instr("url", "://") > 0, F.lower(F.regexp_extract("url", r"://([^/?#]*)", 1))).otherwise("")
    found = stored(templates(rows, folder), f"{folder}/templates")
    few = found.count() <= BROADCAST_HOSTS
    found = found.select(F.col("host"), "main", "boilerplate")
    with_host = rows.withColumn("host", F.coalesce(host, F.lit("")))
    with_host = with_host.join(F.broadcast(found) if few else found, "host", "left").select("id", "url", "html", "main", "boilerplate")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page, main, words in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                out.append(main_text(page, main, frozenset(words or ())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["id", "url", "text", "n_chars"])

    out = stored(with_host.mapInArrow(run, "id long, url string, text string, n_chars long"), f"{folder}/out")
    remove(spark, *(f"{folder}/{x}" for x in ("tokens", "hosts", "valid", "templates")))
    free_shuffles(spark)
    return out
