"""Main text of pages by structure and nearest-URL differencing.

A page is read as blocks of text. Elements that are never article text
(navigation, headers, footers, asides, forms, scripts, adverts, notices,
comments, by tag, role or class) are dropped while reading.

The template is what a page shares with its neighbour: every page is paired
with the page of the same host whose path sorts next to its own and has the
longer common prefix, their block sequences are aligned by longest common
subsequence, and what is left unshared is the page's own text. A page equal to
its neighbour, block for block, has no template (a copy is none).

* A page that marks no article (article, main, role=main) is its own text.
* On a page that marks both, the own text tells which mark is the article's:
  ``article`` if half of the marked own text stands there, else ``main``.
* Inside the mark, a box (div, section, list, table) of which every block is
  shared is template and deleted, unless such boxes hold most of the marked
  text. Paragraphs that are not boxed off stay: two articles of a host may
  carry the same one, and differencing would delete it from both.

Neighbours are found in cells of the sorted addresses; cells have stored
bounds and know the last address before and the first after them, so a host
of any size is split and no pair is lost at an edge.

Nulls: null html is empty, a null url belongs to a host of its own and has no
neighbour. Repeated rows are extracted each. Empty tables give no rows.
"""

from __future__ import annotations

import bisect
import html as entities
import re
from collections.abc import Collection

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presence.llm.textkit import column, hash_filter, in_filter, lists, slices, stored

CELL_ROWS = 2_000
MOST_CELLS = 1_024

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
DROP = frozenset("nav header footer aside form button select dialog menu object audio video canvas".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
DROP_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr
    notice notices notification popup modal overlay sidebar side menu nav navbar navigation breadcrumb breadcrumbs pagination pager
    footer header masthead topbar toolbar comment comments commentlist respond disqus reply replies share sharing social related
    recommended newsletter subscribe subscription signup login widget skip hidden""".split()
)
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q rp rt ruby s samp small
    span strike strong sub sup time tt u var wbr""".split()
)

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_PARTS = re.compile(r"[\s_-]+")
HOST = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)")
BOXES = frozenset("address center details div dl figure ol section table ul".split())


def _dropped(name: str, attributes: str) -> bool:
    if name in DROP:
        return True
    for key, a, b, c in ATTRIBUTE.findall(attributes) if attributes else ():
        value = (a or b or c).lower()
        if key.lower() == "role":
            if value.strip() in DROP_ROLES:
                return True
        elif not DROP_NAMES.isdisjoint(NAME_PARTS.split(value)):
            return True
    return False


def read_blocks(page: str) -> tuple[list[str], list[int], list[tuple[int, int]]]:
    """Texts of the blocks that are not dropped, in page order; whether each
    stands in an article (2), else main (1) element; and the boxes inside
    those, as the places of their first block and after their last."""
    out: list[str] = []
    where: list[int] = []
    buffer: list[str] = []
    boxes: list[tuple[int, int]] = []
    stack: list[tuple[str, int, int]] = []  # name; 0 plain, 1 dropped, 2 main, 3 article; a box's first block, else -1
    dropped = main = article = at = 0

    def text(piece: str) -> None:
        if piece and not dropped:
            buffer.append(entities.unescape(piece) if "&" in piece else piece)

    def flush() -> None:
        joined = " ".join("".join(buffer).split())
        buffer.clear()
        if joined:
            out.append(joined)
            where.append(2 if article else 1 if main else 0)

    def close(index: int) -> None:
        nonlocal dropped, main, article
        for _, kind, begin in stack[index:]:
            if 0 <= begin < len(out):
                boxes.append((begin, len(out)))
            dropped -= kind == 1
            main -= kind == 2
            article -= kind == 3
        del stack[index:]

    search = TAG.search
    while match := search(page, at):
        text(page[at : match.start()])
        at = match.end()
        name = match[2]
        if not name:
            continue
        name = name.lower()
        if name not in INLINE:
            if name == "br":
                text(" ")
            else:
                flush()
        if match[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        if name in VOID or match[3].endswith("/") and name not in RAW:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "body":
            kind = 0
        elif _dropped(name, match[3]):
            kind = 1
        elif name == "article":
            kind = 3
        elif name == "main" or "role" in match[3] and re.search(r"\brole\s*=\s*[\"']?main\b", match[3], re.I):
            kind = 2
        else:
            kind = 0
        boxed = name in BOXES and not kind and not dropped and (main or article)
        stack.append((name, kind, len(out) if boxed else -1))
        dropped += kind == 1
        main += kind == 2
        article += kind == 3
    rest = page[at:]
    cut = re.search(r"<[a-zA-Z/!][^<>]*\Z", rest)  # a page cut off inside a tag
    text(rest[: cut.start()] if cut else rest)
    flush()
    close(0)
    return out, where, boxes


def blocks(page: str) -> tuple[list[str], list[bool]]:
    """The blocks, and whether each stands inside an article (else main)
    element, as far as the page alone can tell."""
    out, where, _ = read_blocks(page)
    level = max(where, default=0)
    return out, [level > 0 and w == level for w in where]


def common(a: list, b: list) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``."""
    places: dict[object, list[int]] = {}
    for j, line in enumerate(b):
        places.setdefault(line, []).append(j)
    ends: list[int] = []
    links: list[tuple[int, object]] = []
    for i, line in enumerate(a):
        for j in reversed(places.get(line, ())):
            k = bisect.bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    out: set[int] = set()
    link = links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def shared_places(own: list, near: list | None) -> list[int]:
    """Places of the blocks that are template, by the neighbour's blocks."""
    return [] if near is None or own == near else sorted(common(own, near))


def own_text(page: str, shared: Collection[int] = ()) -> str:
    """The page's main text, given the places of its shared blocks."""
    lines, where, boxes = read_blocks(page)
    shared = set(shared)
    if not any(where):
        return " ".join(line for i, line in enumerate(lines) if i not in shared)

    def size(places) -> int:
        return sum(len(lines[i]) for i in places)

    marked = [i for i, w in enumerate(where) if w]
    judged = [i for i in marked if i not in shared] or marked
    if 2 * size(i for i in judged if where[i] == 2) >= size(judged):
        marked = [i for i in marked if where[i] == 2]
    template = {i for a, b in boxes if shared.issuperset(range(a, b)) for i in range(a, b)}.intersection(marked)
    if 2 * size(template) > size(marked):
        template = set()
    return " ".join(lines[i] for i in marked if i not in template)


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")
    ).withColumn("uid", F.xxhash64("page_id", "url", "html"))


def _outlines(pages: DataFrame) -> DataFrame:
    """Per page: uid, host, path and a hash of each block."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = column(batch, "html")
            for a, b in slices(col):
                part = batch.slice(a, b - a)
                rows = [[xxhash.xxh64_intdigest(line) for line in read_blocks(p)[0]] for p in col.slice(a, b - a).to_pylist()]
                urls = part.column(part.schema.get_field_index("url")).to_pylist()
                found = [HOST.match(u or "") for u in urls]
                values = np.array([x for row in rows for x in row], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(part.schema.get_field_index("uid")),
                        pa.array([m[1].lower() if m else None for m in found], pa.string()),
                        pa.array([m[2] if m else None for m in found], pa.string()),
                        lists(values, np.array([len(row) for row in rows], np.int64)),
                    ],
                    names=["uid", "host", "path", "outline"],
                )

    return _pages(pages).select("uid", "url", "html").mapInArrow(run, "uid long, host string, path string, outline array<long>")


def neighbours(addresses: DataFrame) -> DataFrame:
    """(uid, near): for each address (uid, host, path) the one of the same
    host next to it in path order with the longer common prefix, the earlier
    at a tie. Equal rows count once."""
    keyed = (
        addresses.filter("host is not null")
        .groupBy("uid")
        .agg(F.first("host").alias("host"), F.first("path").alias("path"))
        .withColumn("key", F.concat_ws("\x01", "host", "path", F.format_string("%020d", "uid")))
    )
    keyed = stored(keyed, "addresses")
    n = keyed.count()
    cells = min(MOST_CELLS, max(1, n // CELL_ROWS))
    # Bounds of the cells: the keys with the smallest hashes, 16 a cell. They
    # only decide where to split; every address is in a cell.
    drawn = keyed.select("key", F.xxhash64(F.lit(3), "key").alias("x")).orderBy("x", "key").limit(16 * cells).collect()
    bounds = sorted(r["key"] for r in drawn)[8::16][1:]

    def cell(batches):
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index("key")).to_pylist()
            yield batch.append_column("cell", pa.array([bisect.bisect_right(bounds, k) for k in keys], pa.int32()))

    celled = keyed.mapInArrow(cell, "uid long, host string, path string, key string, cell int")
    ends = celled.groupBy("cell").agg(
        F.min(F.struct("key", "host", "path", "uid")).alias("lo"), F.max(F.struct("key", "host", "path", "uid")).alias("hi")
    )  # at most MOST_CELLS rows
    over = Window.orderBy("cell")
    edges = ends.select("cell", F.lag("hi").over(over).alias("before"), F.lead("lo").over(over).alias("after"))
    own = F.struct("key", "host", "path", "uid")
    inside = Window.partitionBy("cell").orderBy("key")
    both = celled.join(edges, "cell").select(
        "uid", "host", "path",
        F.coalesce(F.lag(own).over(inside), "before").alias("p"), F.coalesce(F.lead(own).over(inside), "after").alias("q"),
    )
    prefix = lambda x: F.when(
        F.col(f"{x}.host") == F.col("host"),
        F.expr(f"size(filter(sequence(1, greatest(1, least(length(path), length({x}.path)))), i -> substring(path, 1, i) = substring({x}.path, 1, i)))"),
    )
    near = both.withColumn("np", prefix("p")).withColumn("nq", prefix("q"))
    return near.select(
        "uid",
        F.when(F.coalesce("np", F.lit(-1)) >= F.coalesce("nq", F.lit(-1)), F.when(F.col("np").isNotNull(), F.col("p.uid")))
        .otherwise(F.col("q.uid"))
        .alias("near"),
    )


def templates(pages: DataFrame) -> DataFrame:
    """(uid, shared): the places of the blocks that a page shares with its
    neighbour, of every page that shares any."""
    outlines = stored(_outlines(pages), "outlines")
    pairs = neighbours(outlines.select("uid", "host", "path")).filter("near is not null")
    each = outlines.select("uid", "outline").dropDuplicates(["uid"])
    other = each.select(F.col("uid").alias("near"), F.col("outline").alias("other"))
    sides = pairs.join(other, "near").select("uid", "other").join(each, "uid").select("uid", "outline", "other")

    def align(batches):
        for batch in batches:
            own, near = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            places = [shared_places(a, b) for a, b in zip(own, near, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.list_(pa.int32()))], names=["uid", "shared"])

    return sides.mapInArrow(align, "uid long, shared array<int>").filter("size(shared) > 0")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    shared = stored(templates(pages), "templates")
    held = pages.sparkSession.sparkContext.broadcast(hash_filter(shared.select(F.xxhash64(F.lit(1), "uid").alias("h"))))

    def texts(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col, places = column(batch, "html"), batch.schema.get_field_index("shared")
            for a, b in slices(col):
                part = batch.slice(a, b - a)
                shared_ = [()] * (b - a) if places < 0 else part.column(places).to_pylist()
                out = [own_text(p, s or ()) for p, s in zip(col.slice(a, b - a).to_pylist(), shared_, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    def known(batches, sharing: bool):
        """Pages that may share a block, or the others; only those meet the
        templates, so no other page is shuffled."""
        for batch in batches:
            h = batch.column(batch.schema.get_field_index("h")).to_numpy(zero_copy_only=False).view(np.uint64)
            part = batch.drop_columns(["h"]).filter(pa.array(in_filter(h, held.value) == sharing))
            if part.num_rows:
                yield part

    rows = _pages(pages).withColumn("h", F.xxhash64(F.lit(1), "uid"))
    text = "page_id long, url string, text string"
    alone = rows.drop("uid").mapInArrow(lambda batches: texts(known(batches, False)), text)
    some = rows.mapInArrow(lambda batches: known(batches, True), "page_id long, url string, html string, uid long")
    some = some.join(shared, "uid", "left").select("page_id", "url", "html", "shared").mapInArrow(texts, text)
    found = alone.unionByName(some)
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
