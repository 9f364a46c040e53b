"""Main text of pages by differencing each page with its nearest neighbours in url order.

A page is cut into lines at block tags. Within a host, pages stand in order of path, then id; a page is paired with the one
before and the one after it, the lines of the pair are aligned by longest common subsequence, and shared lines are deleted, inside
``article`` and ``main`` too. What differencing cannot tell is settled by markup: a marked text of which ``COPY`` or more is shared is a
copy and stays whole; lines in marked menus, headers, footers, sidebars, notices, adverts, forms and comments go though no
neighbour has them; and where a page marks its article, unmarked lines outside go too, unless the page has no ``main`` and they are longer
than its longest ``article``: then its articles are teasers, and all unshared lines stay.

Words of class, id and role mark an element as not the article, but such a wrapper may hold it: ``main`` below a wrapper counts as anywhere, an
``article`` below it when it is longer than any marked text outside wrappers (else than the unmarked lines, which stay then too), and an
``article`` or ``main`` is never dropped by its own words, but for those that name a reader comment or a list of them: such elements go
whole, however long. A page that is wrappers throughout keeps its unshared lines.

Pages are dealt out by slices of the (host, path, id) order, each of about ``SLICE_PAGES`` pages whatever the size of a host; the
first and last page of a slice are also sent to the neighbouring slice, so every page meets its true neighbours. Slice
borders come from the urls alone. The page text is shuffled once.

Defined results: null or empty html gives an empty text; a null url, or one without ``://``, belongs to the empty host; a page equal to
its neighbour line by line tells nothing, so its lines are not deleted for that; a host with one page is settled by markup alone; repeated
rows stand side by side and each is returned; markup that never ends reaches to the end of the page; an empty
table gives no rows; only id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .urls import host_path

SLICE_PAGES = 2_000
# Cells of the alignment held at once; larger pairs are halved first.
ALIGN_CELLS = 1 << 28

# Share of the characters of a marked text that makes it a copy, as near copies are told elsewhere.
COPY = 0.75

# Outermost ``article`` elements outside ``main`` have the zones from CARD on, each its own among its neighbours.
CARD, KEEP, OPEN, DROP = 3, 2, 1, 0
# Below wrappers that their words mark, and ``article`` elements there, numbered downwards from HELD.
WRAP, HELD = -1, -2
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<!--|<[!?][^>]*>?""")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.IGNORECASE) for t in ("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "select", "object")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split())
OPTIONAL_END = frozenset("p li dt dd td th tr thead tbody tfoot option".split())
DROPPED = frozenset("nav aside footer form head menu dialog button fieldset".split())
KEPT = frozenset(("article", "main"))
# Words of class, id and role that mark what is not the article.
DROPPED_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies footer
    gdpr masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related respond share sharing sidebar signup social
    sponsor sponsored subscribe toolbar widget widgets complementary contentinfo search""".split())
KEPT_WORDS = frozenset(("articlebody",))
# Names of class and id that hold reader comments and nothing else, whatever their element (``comments-open`` says something of a page).
COMMENTS = re.compile(r"(?:user|reader|post)?-?comments?(?:-?(?:list|area|section|thread|body|content|text|item|wrap|wrapper|container|[0-9]+))?|respond|repl(?:y|ies)(?:-?list)?|disqus[a-z_-]*", re.IGNORECASE)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def zone_of(tag: str, attributes: str, inside: int) -> int:
    """The zone of an element that stands in the zone ``inside``."""
    if inside == DROP or tag in DROPPED or tag == "header" and inside in (OPEN, WRAP):
        return DROP
    if attributes and "=" in attributes or "hidden" in attributes:
        named = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
        words = {w.lower() for k in ("class", "id", "role") for w in WORD.findall(named.get(k, ""))}
        if tag not in ("html", "body") and re.search(r"(?:^|\s)hidden(?=[\s/=]|$)", attributes):
            return DROP
        if tag not in ("html", "body", "main") and any(COMMENTS.fullmatch(name) for k in ("class", "id") for name in named.get(k, "").split()):
            return DROP
        role = named.get("role", "").lower()
        if named.get("itemprop", "").lower() in KEPT_WORDS:
            return KEEP
        tag = role if role in KEPT and tag != "main" else tag
        if words & DROPPED_WORDS and tag not in ("html", "body", *KEPT):
            return WRAP
    return KEEP if tag == "main" else {OPEN: CARD, WRAP: HELD}.get(inside, inside) if tag == "article" else inside


def lines_of(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of each non-empty line, in page order."""
    page = page or ""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements and the zone outside each
    opened: dict[str, int] = {}
    zone, at, end, cards = OPEN, 0, len(page), 0

    def flush() -> None:
        if text:
            line = " ".join("".join(text).split())
            if line:
                out.append((zone, line))
            text.clear()

    def say(piece: str) -> None:
        if piece:
            text.append(entities.unescape(piece) if "&" in piece else piece)

    def close(name: str) -> int:
        inside = zone
        while stack:
            top, inside = stack.pop()
            opened[top] -= 1
            if top == name:
                break
        return inside

    while at < end:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            shut = page.find("-->", at)
            at = end if shut < 0 else shut + 3
            continue
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if name in BLOCK:
            flush()
        if m[1] or m[4]:
            if opened.get(name):
                inside = close(name)
                if inside != zone:
                    flush()
                zone = inside
            continue
        if name in RAW:
            shut = RAW[name].search(page, at)
            at = end if shut is None else shut.end()
            continue
        attributes = m[3] or m[6] or ""
        if name in VOID or attributes.endswith("/"):
            continue
        if name == "body" and opened.get("head"):
            zone = close("head")
        if name in OPTIONAL_END and stack and stack[-1][0] == name:
            zone = close(name)
        new = zone_of(name, attributes, zone)
        if new == CARD and zone == OPEN:
            new, cards = CARD + cards, cards + 1
        elif new == HELD and zone == WRAP:
            new, cards = HELD - cards, cards + 1
        if name in OPTIONAL_END and new == zone:
            continue
        if new != zone:
            flush()
        stack.append((name, zone))
        opened[name] = opened.get(name, 0) + 1
        zone = new
    flush()
    return out


def _rows(a: list[int], b: list[int]) -> list[int]:
    """Per item of ``a``, a number whose zero bits count the longest common subsequence with each prefix of ``b``."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows


def _align(a: list[int], b: list[int], at: int, bt: int, pairs: list[tuple[int, int]]) -> None:
    while a and b and a[0] == b[0]:
        pairs.append((at, bt))
        a, b, at, bt = a[1:], b[1:], at + 1, bt + 1
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
        pairs.append((at + len(a), bt + len(b)))
    common = set(a) & set(b)
    if not common:
        return
    if len(a) * len(b) > ALIGN_CELLS and len(a) > 1:
        half = len(a) // 2
        head, tail = _rows(a[:half], b)[-1], _rows(a[half:][::-1], b[::-1])[-1]
        left = [0]
        for j in range(len(b)):
            left.append(left[-1] + (head >> j & 1 ^ 1))
        right = [0]
        for j in range(len(b)):
            right.append(right[-1] + (tail >> j & 1 ^ 1))
        cut = max(range(len(b) + 1), key=lambda j: left[j] + right[len(b) - j])
        _align(a[:half], b[:cut], at, bt, pairs)
        _align(a[half:], b[cut:], at + half, bt + cut, pairs)
        return
    rows = [(1 << len(b)) - 1, *_rows(a, b)]
    i, j = len(a), len(b)
    while i and j:
        if rows[i] >> (j - 1) & 1:  # the subsequence does not grow at j
            j -= 1
        elif not rows[i - 1] >> (j - 1) & 1 and (rows[i - 1] & ((1 << j) - 1)).bit_count() == (rows[i] & ((1 << j) - 1)).bit_count():
            i -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((at + i, bt + j))


def common_lines(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence of two lists of lines."""
    ids: dict[str, int] = {}
    pairs: list[tuple[int, int]] = []
    _align([ids.setdefault(x, len(ids)) for x in a], [ids.setdefault(x, len(ids)) for x in b], 0, 0, pairs)
    return sorted(pairs)


def main_text(zones: list[int], lines: list[str], shared: set[int]) -> str:
    """The lines that stay: marked article, unless it is only teasers or shared in part, else unmarked lines that no neighbour shares."""
    size: dict[int, int] = {}
    own: dict[int, int] = {}  # characters that no neighbour shares
    for i, (z, x) in enumerate(zip(zones, lines)):
        size[z] = size.get(z, 0) + len(x)
        own[z] = own.get(z, 0) + (0 if i in shared else len(x))
    rest = own.get(OPEN, 0)
    plain = {z for z in size if z >= KEEP}
    held = {z for z in size if z <= HELD}
    longest = max((size[z] for z in plain), default=rest)
    marked = plain | held if max((size[z] for z in held), default=0) > longest else plain
    if not marked and OPEN not in size:
        marked = {WRAP} & set(size)
    teasers = KEEP not in marked and rest > max((size[z] for z in marked), default=0)
    copy = not teasers and WRAP not in marked and sum(own[z] for z in marked) <= (1 - COPY) * sum(size[z] for z in marked)
    loose = teasers or not plain  # unmarked lines count
    return " ".join(x for i, (z, x) in enumerate(zip(zones, lines)) if z in marked and copy or i not in shared and (z in marked or z == OPEN and loose))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, set[int]]]:
    """Sorted rows with the lines that each shares with the row before or after it on its host."""
    before, shared = None, set()
    for batch in batches:
        for row in batch.to_pylist():
            now: set[int] = set()
            if before is not None:
                if before["slice"] == row["slice"] and before["host"] == row["host"] and before["lines"] != row["lines"]:
                    for i, j in common_lines(before["lines"], row["lines"]):
                        shared.add(i)
                        now.add(j)
                yield before, shared
            before, shared = row, now
    if before is not None:
        yield before, shared


def _order(host: str, path: str, page) -> tuple:
    return host, path, page is not None, page if page is not None else 0


def slices(keys: DataFrame) -> list[tuple[tuple, tuple]]:
    """First and last (host, path, id) of consecutive ranges of about ``SLICE_PAGES`` rows; one small row per range."""
    n = max(1, -(-keys.count() // SLICE_PAGES))
    ranged = keys.repartitionByRange(n, "host", "path", "id").groupBy(F.spark_partition_id().alias("p"))
    key = F.struct("host", "path", "id")
    found = ranged.agg(F.min(key).alias("first"), F.max(key).alias("last")).collect()
    return sorted((_order(*r["first"]), _order(*r["last"])) for r in found)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url and ``text``, the main text of the page."""
    host, path = host_path(F.col(f"`{url_col}`"))
    source = pages.select(host.alias("host"), path.alias("path"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    borders = slices(source.select("host", "path", "id"))
    shared = pages.sparkSession.sparkContext.broadcast(borders)
    kinds = {f.name: f for f in source.schema.fields}
    cut = T.StructType([T.StructField("slice", T.IntegerType()), T.StructField("own", T.BooleanType()), *[kinds[c] for c in ("host", "path", "id", "url")],
                        T.StructField("sum", T.LongType()), T.StructField("zones", T.ArrayType(T.IntegerType())), T.StructField("lines", T.ArrayType(T.StringType()))])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = shared.value
        firsts = [a for a, _ in ranges]
        for batch in batches:
            for k in range(0, len(batch), 500):
                part = batch.slice(k, 500)
                rows, which, mine = [], [], []
                for i, (h, p, page, page_html) in enumerate(zip(*[part.column(c).to_pylist() for c in ("host", "path", "id", "html")])):
                    found = lines_of(page_html)
                    lines = [x for _, x in found]
                    rows.append(([z for z, _ in found], lines, zlib.crc32("\n".join(lines).encode("utf-8", "surrogatepass"))))
                    key = _order(h, p, page)
                    s = max(0, bisect_right(firsts, key) - 1)
                    which.append((i, s))
                    mine.append(True)
                    for t, edge in ((s - 1, ranges[s][0]), (s + 1, ranges[s][1])):
                        if key == edge and 0 <= t < len(ranges):
                            which.append((i, t))
                            mine.append(False)
                take = pa.array([i for i, _ in which], pa.int32())
                columns = [part.column(c).take(take) for c in ("host", "path", "id", "url")]
                yield pa.RecordBatch.from_arrays([
                    pa.array([s for _, s in which], pa.int32()), pa.array(mine, pa.bool_()), *columns, pa.array([rows[i][2] for i, _ in which], pa.int64()),
                    pa.array([rows[i][0] for i, _ in which], pa.list_(pa.int32())), pa.array([rows[i][1] for i, _ in which], pa.list_(pa.string()))], names=cut.names)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []

        def give() -> pa.RecordBatch:
            rows = list(zip(*done)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(rows[0], id_type), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())], names=[id_col, url_col, "text"])

        size = 0
        for row, common in _neighbours(batches):
            if row["own"]:
                done.append((row["id"], row["url"], main_text(row["zones"], row["lines"], common)))
                size += len(done[-1][2])
                if size > 8_000_000:
                    yield give()
                    done.clear()
                    size = 0
        yield give()

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kinds["id"].dataType)
    rows = source.mapInArrow(parse, cut).repartition("slice").sortWithinPartitions("slice", "host", "path", "id", "sum", "url")
    out = T.StructType([T.StructField(id_col, kinds["id"].dataType), T.StructField(url_col, kinds["url"].dataType), T.StructField("text", T.StringType())])
    return rows.mapInArrow(decide, out)
