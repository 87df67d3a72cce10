"""Main text of web pages by nearest-URL page differencing.

Pages of a host are ordered by URL path and each is paired with its nearest neighbour of other content.
The text lines of the two are aligned by a longest common subsequence, and lines that they share are the
site's, not the page's: they are deleted. Lines inside an article element stay, since two articles may well
have a line in common, but for lines wholly of inline elements with a class of chrome; those inside menus, adverts and other chrome always go.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carbonproof.llm.common import materialise

# Elements by what they mean for the text.
RAW = ("script", "style", "template", "textarea", "title")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
INLINE = (
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    "math", "mfrac", "mi", "mn", "mo", "mrow", "ms", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtext", "semantics",
)
CHROME = (
    "nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "head", "noscript", "svg", "iframe", "object", "canvas", "select", "annotation",
)
#: What a list of choices may hold; any other element ends it.
CHOICES = ("option", "optgroup", "hr")
MAIN = ("article", "main")
# Words in a class, id or role that mark chrome.
CHROME_WORDS = (
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent",
    "contentinfo", "cookie", "cookies", "disqus", "footer", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo",
    "promoted", "related", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|[^<]+|<",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
_WORDS = frozenset(CHROME_WORDS)
#: Roles of a line: inside an article, inside chrome, neither, or wholly of inline elements that only a word of their class calls chrome.
ARTICLE, IN_CHROME, OPEN, WEAK = "a", "c", "o", "w"
#: Share of the lines of two pages from which they count as the same.
NEARLY = 0.9


def _named_chrome(tag: str, attributes: str) -> bool:
    """Whether a word of the class, id or role says chrome."""
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    names = " ".join("".join(m) for m in _NAMED.findall(attributes)).lower()
    return not _WORDS.isdisjoint(re.split(r"[^a-z]+", names))


class _Lines:
    """Text blocks of a page while its tags are read."""

    def __init__(self) -> None:
        self.out: list[tuple[str, str]] = []
        self.role, self.weak = OPEN, False
        self.stack: list[tuple[str, str, bool]] = []
        self.open: Counter[str] = Counter()
        self.buffer: list[str] = []
        self.certain = False

    def text(self, text: str) -> None:
        self.buffer.append(text)
        self.certain |= not self.weak and not text.isspace()

    def flush(self) -> None:
        text = _SPACE.sub(" ", html.unescape("".join(self.buffer))).strip()
        if text:
            self.out.append((text, self.role if self.certain or self.role == IN_CHROME else WEAK))
        self.buffer.clear()
        self.certain = False

    def begin(self, tag: str, attributes: str) -> None:
        if self.stack and self.stack[-1][0] == "select" and tag not in CHOICES and tag not in INLINE:
            self.end("select")
        inner, weak = self.role, self.weak
        if self.role != IN_CHROME:
            named = _named_chrome(tag, attributes)
            if tag in CHROME or (named and tag not in INLINE) or (tag == "header" and self.role == OPEN):
                inner = IN_CHROME
            elif tag in MAIN or "role=main" in attributes.replace('"', "").replace("'", "").lower():
                inner = ARTICLE
            weak |= named
        if inner != self.role:
            self.flush()
        if tag not in ("p", "li", "td", "tr", "dt", "dd", "option") or inner != self.role:
            self.stack.append((tag, self.role, self.weak))
            self.open[tag] += 1
        self.role, self.weak = inner, weak

    def end(self, tag: str) -> None:
        """Close the innermost open element of this name, and what is open in it; an end tag of none is passed over."""
        while self.open[tag]:
            name, role, weak = self.stack.pop()
            self.open[name] -= 1
            if role != self.role:
                self.flush()
            self.role, self.weak = role, weak
            if name == tag:
                break


def page_lines(page: str | None) -> list[tuple[str, str]]:
    """Text blocks of a page in order, each with its role; white space is one space and trimmed."""
    lines = _Lines()
    for m in _TOKEN.finditer(page or ""):
        tag = m[3]
        if tag is None:
            if not m[1] and (not m[0].startswith("<") or m[0] == "<"):
                lines.text(m[0])
            continue
        tag = tag.lower()
        if tag not in INLINE:
            lines.flush()
        if tag in VOID or m[4].endswith("/"):
            continue
        if m[2]:
            lines.end(tag)
        else:
            lines.begin(tag, m[4])
    lines.flush()
    return lines.out


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``, bit-parallel by rows of ``a``.

    Only every so many rows are kept, and those between are made again on the way back, so that a pair of
    pages of n lines each takes about n times the root of n bits.
    """
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full, step = (1 << len(b)) - 1, max(1, math.isqrt(len(a)))

    def rows(first: int, row: int, stop: int) -> Iterator[int]:
        """Rows after ``first`` to ``stop``; a set bit j means: the subsequence grows at b[j]."""
        for x in a[first:stop]:
            grown = row | where.get(x, 0)
            row = grown & (grown ^ (grown - (row << 1 | 1))) & full
            yield row

    kept, row = [0], 0
    for i, row in enumerate(rows(0, 0, len(a)), 1):
        if i % step == 0:
            kept.append(row)
    out, end = [], len(b)
    for k in range(len(kept) - 1, -1, -1):
        first, stop = k * step, min(len(a), (k + 1) * step)
        part = [kept[k], *rows(first, kept[k], stop)]
        for i in range(stop, first, -1):
            mask = (1 << end) - 1
            now, before = part[i - first] & mask, part[i - 1 - first] & mask
            if now.bit_count() > before.bit_count():
                out.append(i - 1)
                end = now.bit_length() - 1
    return out[::-1]


def _parsed(pages: DataFrame) -> DataFrame:
    """``page_key, url, lines, roles, hashes`` of every page, of its lines outside of chrome."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[x for x in page_lines(p.as_py()) if x[1] != IN_CHROME] for p in batch.column(2)]
            lines = [[t for t, _ in p] for p in found]
            hashes = [[xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in p] for p in lines]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(lines, pa.list_(pa.string())), pa.array(["".join(r for _, r in p) for p in found], pa.string()),
                    pa.array(hashes, pa.list_(pa.int64())),
                ],
                ["page_key", "url", "lines", "roles", "hashes"],
            )

    return pages.mapInArrow(run, "page_key bigint, url string, lines array<string>, roles string, hashes array<bigint>")


def nearly_same(a: list[int], b: list[int]) -> bool:
    """Whether all or nearly all lines of two pages are the same."""
    return sum((Counter(a) & Counter(b)).values()) >= NEARLY * max(len(a), len(b))


def _in_runs(ordered: DataFrame) -> DataFrame:
    """Sorted pages ``(page_key, host, path, hashes)`` with ``run``, one number for neighbours of nearly the same lines.

    A partition numbers its own runs; how partitions join is settled from the lines of their first and
    last pages, two rows of each partition.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_key", "host", "path", "local", "edge"]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        last, local = None, 0
        for batch in batches:
            rows = []
            for key, host, path, hashes in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if last is not None:
                    rows.append((*last[:4], last[4] if last[5] else None))
                    local += not (last[1] == host and nearly_same(last[4], hashes))
                last = (key, host, path, local, hashes, last is None)
            yield packed(rows)
        if last is not None:
            yield packed([last[:5]])

    local = ordered.mapInArrow(number, "page_key bigint, host string, path string, local bigint, edge array<bigint>")
    local = materialise(local.withColumn("at", F.monotonically_increasing_id()), "page-order")
    edges = sorted(local.where("edge is not null").select("at", "host", "local", "edge").collect())
    offsets, following, last = {}, 0, None
    for e in edges:
        if e["at"] >> 33 not in offsets:
            joined = last is not None and last["host"] == e["host"] and nearly_same(last["edge"], e["edge"])
            offsets[e["at"] >> 33] = following - joined
        following, last = offsets[e["at"] >> 33] + e["local"] + 1, e
    table = ordered.sparkSession.createDataFrame(list(offsets.items()), "part bigint, offset bigint")
    numbered = local.withColumn("part", F.shiftright("at", 33)).join(F.broadcast(table), "part")
    return numbered.select("page_key", "host", "path", "at", (F.col("local") + F.col("offset")).alias("run"))


def nearest_pages(pages: DataFrame) -> DataFrame:
    """``page_key, mate`` of pages ``(page_key, url, hashes)``: the neighbour of other content in path order.

    Neighbours on a host whose lines are nearly all the same (print addresses, mirrors, http and https)
    form a run; a page's mate is the end of the run before or the start of the run after, on its host,
    whichever shares more of the path. Pages are ordered by a range partitioning, so a large host is
    dealt over many tasks; runs then meet by an equi-join on their number. Without other content on the
    host there is no mate. Ties go to the page before.
    """
    place = F.regexp_replace(F.coalesce("url", F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*:", "")
    host = F.lower(F.regexp_extract(place, "^//([^/?#]*)", 1))
    path = F.regexp_extract(place, "^(?://[^/?#]*)?([^?#]*)", 1)
    parts = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sites = pages.select("page_key", host.alias("host"), path.alias("path"), "hashes")
    ordered = sites.repartitionByRange(parts, "host", "path", "page_key").sortWithinPartitions("host", "path", "page_key")
    ranked = _in_runs(ordered)
    page = F.struct("page_key", "host", "path")
    ends = ranked.groupBy("run").agg(F.min_by(page, "at").alias("first"), F.max_by(page, "at").alias("last"))

    def side(end: str, shift: int, name: str) -> DataFrame:
        return ends.select((F.col("run") + shift).alias("run"), F.col(end).alias(name))

    def shared(other: str) -> Column:
        n = F.least(F.length("path"), F.length(f"{other}.path"))
        same = F.aggregate(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0),
            lambda k, i: F.when((k == i - 1) & (i <= n) & (F.substring("path", i, F.lit(1)) == F.substring(F.col(f"{other}.path"), i, F.lit(1))), i).otherwise(k),
        )
        return F.when(F.col(f"{other}.host") == F.col("host"), same).otherwise(-1)

    both = ranked.join(side("last", 1, "prior"), "run", "left").join(side("first", -1, "next"), "run", "left")
    both = both.withColumn("p", F.coalesce(shared("prior"), F.lit(-1))).withColumn("n", F.coalesce(shared("next"), F.lit(-1)))
    mate = F.when(F.greatest("p", "n") < 0, F.lit(None)).when(F.col("p") >= F.col("n"), F.col("prior.page_key")).otherwise(F.col("next.page_key"))
    return both.select("page_key", mate.alias("mate"))


def _differenced(rows: DataFrame) -> DataFrame:
    """Text of each page from its lines, roles and hashes and its mate's hashes."""

    def text(lines: list[str], roles: str, mine: list[int], other: list[int] | None) -> str:
        shared = set(common_lines(mine, other)) if other and roles.strip(ARTICLE) else set()
        return "\n".join(x for k, (x, role) in enumerate(zip(lines, roles, strict=True)) if role == ARTICLE or k not in shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(2, 6)]
            out = [text(*row) for row in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_key", "url", "text"])

    columns = ["page_key", "url", "lines", "roles", "hashes", "mate_hashes"]
    return rows.select(*columns).mapInArrow(run, "page_key bigint, url string, text string")


def extract_text(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Main text of every whole page: ``(id_col, url, text, n_chars)``.

    Blocks outside of chrome, joined by \\n, less those outside of an article that the page shares with its
    nearest neighbour of other content. Null html counts as empty and has the
    empty text; a null URL belongs to the host without a name; repeated rows give a row each; of rows
    that repeat an id with other contents the first by order serves as the neighbour's mate; an empty
    table gives an empty table; other columns are ignored.
    """
    source = pages.select(F.col(id_col).cast("bigint").alias("page_key"), "url", "html")
    parsed = _parsed(source)  # twice, which costs less disk than to keep all lines
    hashed = materialise(parsed.where("page_key is not null").select("page_key", "url", "hashes"), "page-hashes")
    known = materialise(hashed.groupBy("page_key").agg(F.min("url").alias("url"), F.min("hashes").alias("hashes")), "page-hashes")
    mates = nearest_pages(known).where("mate is not null")
    wanted = mates.join(known.select(F.col("page_key").alias("mate"), F.col("hashes").alias("mate_hashes")), "mate")
    rows = parsed.join(wanted.select(F.col("page_key").alias("k"), "mate_hashes"), F.col("page_key") == F.col("k"), "left")
    out = _differenced(rows)
    return out.select(F.col("page_key").alias(id_col), "url", "text", F.length("text").cast("bigint").alias("n_chars"))
