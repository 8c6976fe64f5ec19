"""Main text of web pages by consensus of their hosts.

Every page scores its containers by the text of their blocks and casts votes for the generalised tag-class paths of the good ones;
Spark sums the votes by host and path, and the winning path of a host is extracted from all of its pages again. A page that doesn't
have its host's path, or has another container of over FOREIGN times the text, follows its own best container.

Votes are summed before they leave a task and combine on the way, so a host of a third of all pages is a few numbers; the pages
themselves are read twice and not shuffled while the winners (a row per host) are under Spark's broadcast threshold, and joined
by host beyond it, where AQE splits a large host.

Defined results: null or empty html gives an empty text; a null url belongs to the host ''; rows are not told apart by page_id, so
repeated rows give repeated results; an empty table gives an empty result; other columns are not read. Unclosed and stray tags are
repaired as browsers do in outline; a deep nesting costs no more than its length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

# Elements of HTML by their part in a page, and words, and beginnings of words, that name such parts in classes, ids and roles.
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
CONTAINERS = ("html", "body", "main", "article", "section", "div", "td", "center", "fieldset", "details")
LEAVES = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "li", "dt", "dd", "th", "caption", "figcaption", "summary", "address")
OTHER_BLOCKS = ("ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "tr", "figure", "hr", "br", "header", "footer", "nav", "aside", "form", "hgroup", "option", "menu", "dialog", "search")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
DROPPED = ("head", "nav", "footer", "aside", "form", "menu", "dialog", "search", "template", "svg", "canvas", "object", "video", "audio", "select", "button", "datalist", *RAW)
ROLES = ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar")
WORDS = (
    "ad", "ads", "adv", "adsense", "promo", "promotion",
    "nav", "navbar", "navigation", "menu", "menubar", "pagination", "pager", "topbar", "masthead",
    "widget", "widgets", "consent", "gdpr", "notice", "notices", "notification", "alert",
    "popup", "modal", "overlay", "subscribe", "subscription", "signup", "login", "form", "search", "searchbox",
    "share", "sharing", "social",
)
READERS = ("disqus", "reply", "replies", "respond", "responses", "discussion")
BEGINNINGS = ("advert", "banner", "breadcrumb", "cookie", "footer", "newsletter", "sidebar", "sponsor")
READERS_BEGINNING = ("comment",)
FOREIGN = 4
"""How many times the text of its host's container another container needs for a page to leave its host's path."""
NEAR = 2
"""Containers of at least 1/NEAR of the best score of their page get votes."""
SHOWN = 8
"""Steps of a path that are shown; its identity is a hash of all steps."""

NAMED, ELEMENT = 1, 2
"""Flags of parts that don't belong to an article: by a name, which may also stand on a wrapper of the article, or for sure."""

_TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|(\Z)))|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[!?][^>]*+>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>)", re.S)
#: The same without quotes, for what follows a tag whose quotes never close: so no quote is searched for twice.
_PLAIN = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|(\Z)))|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|[!?][^>]*+>)", re.S)
_CUT = re.compile(r"<[a-zA-Z/!?].*", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_SPLIT = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"\d+")
_HOST = r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
_BLOCKS = frozenset((*CONTAINERS, *LEAVES, *OTHER_BLOCKS))
_CONTAINERS, _LEAVES, _VOID, _DROPPED, _WORDS, _ROLES, _READERS = map(frozenset, (CONTAINERS, LEAVES, VOID, DROPPED, WORDS, ROLES, READERS))
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])|\Z", re.I) for t in RAW}
#: A start tag closes open elements of the first kind, unless one of the second kind was opened after them.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tbody": (("thead", "tbody", "tfoot", "tr"), ("table",)), "tfoot": (("thead", "tbody", "tfoot", "tr"), ("table",)),
}


class Page:
    """A page as elements (tag, parent, first and last piece of text, key of the path) and pieces of text in page order; no recursion.

    Places of pieces tell what an element holds: the pieces from start to end.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.start, self.end, self.key, self.label, self.flag = ["#"], [-1], [0], [0], [0], [""], [0]
        self.text: list[str] = []
        self.at: list[int] = []
        self._read(source)
        self._drop()

    def _open(self, tag: str, attributes: str) -> int:
        label, flag = tag, ELEMENT * (tag in _DROPPED)
        if attributes and "=" in attributes and tag not in ("html", "body"):
            names = {n.lower(): a or b or c for n, a, b, c in reversed(_NAMES.findall(attributes))}
            words = {w for n in ("class", "id") if n in names for w in _SPLIT.split(_CAMEL.sub("-", names[n]).lower())}
            if not words.isdisjoint(_READERS) or any(w.startswith(READERS_BEGINNING) for w in words):
                flag = ELEMENT
            elif not flag:
                named = not words.isdisjoint(_WORDS) or any(w.startswith(BEGINNINGS) for w in words) or names.get("role", "").strip().lower() in _ROLES
                flag = NAMED * (named or "header" in words and self._is_page_header())
            if tag == "header" and self._is_page_header():
                flag = ELEMENT
            if "class" in names:
                label = tag + "".join(f".{_DIGITS.sub('#', c)}" for c in sorted(set(names["class"].lower().split())))
        elif tag == "header":
            flag = ELEMENT * self._is_page_header()
        up = self.stack[-1]
        self.tag.append(tag)
        self.parent.append(up)
        self.start.append(len(self.text))
        self.end.append(-1)
        self.key.append(xxhash.xxh64_intdigest(label, self.key[up] & 0xFFFFFFFF) >> 1 if tag in _CONTAINERS else self.key[up])
        self.label.append(label)
        self.flag.append(flag)
        return len(self.tag) - 1

    def _is_page_header(self) -> bool:
        return not (self.open["article"] or self.open["main"])

    def _close(self, to: int) -> None:
        """Elements of the stack from place `to` on are closed."""
        for i in self.stack[to:]:
            self.end[i] = len(self.text)
            self.open[self.tag[i]] -= 1
        del self.stack[to:]

    def _close_last(self, tags, stop=()) -> None:
        """Closes the last open element of these tags, if no element of `stop` was opened after it."""
        k = len(self.stack) - 1
        while k > 0:
            t = self.tag[self.stack[k]]
            if t in tags:
                return self._close(k)
            if t in stop:
                return None
            k -= 1

    def _add(self, text: str) -> None:
        if text:
            self.text.append(html.unescape(text) if "&" in text else text)
            self.at.append(self.stack[-1])

    def _break(self) -> None:
        if self.text and self.text[-1] != " ":
            self.text.append(" ")
            self.at.append(self.stack[-1])

    def _read(self, source: str) -> None:
        self.stack, self.open = [0], Counter()
        place, last, find = 0, source.rfind(">") + 1, _TAG.search
        while True:
            m = find(source, place, last)
            if not m:
                self._add(_CUT.sub("", source[place:]))  # a tag or comment that never ends
                break
            self._add(source[place : m.start()])
            place = m.end()
            slash, tag, attributes = m[2], m[3], m[4]
            if find == _TAG.search and m[6]:
                slash, tag, attributes, find = m[5], m[6], m[7], _PLAIN.search
            if not tag:
                if m[1] is not None:
                    break
                continue
            tag = tag.lower()
            if tag in _BLOCKS:
                self._break()
            if slash:
                if self.open[tag]:
                    self._close_last((tag,))
                continue
            if tag in _VOID:
                continue
            if self.open["head"] and (tag == "body" or tag in _BLOCKS):
                self._close_last(("head",))
            if tag in ("html", "body") and self.open[tag]:
                continue
            if self.open["p"] and tag in _BLOCKS:
                self._close_last(("p",), _CONTAINERS)
            if tag in _CLOSES and any(self.open[t] for t in _CLOSES[tag][0]):
                self._close_last(*_CLOSES[tag])
            i = self._open(tag, attributes)
            if attributes.endswith("/") and tag not in _BLOCKS and tag not in RAW:
                self.end[i] = len(self.text)
                continue
            self.stack.append(i)
            self.open[tag] += 1
            if tag in _RAW_END:
                place = _RAW_END[tag].search(source, place).start()
        self._close(0)

    def _drop(self) -> None:
        """`kept` tells of each piece whether it counts. A part flagged by a name stays where it holds an article, or half of the paragraphs of a page without an article element."""
        n = len(self.tag)
        holds, chars = [False] * n, [0] * n
        for i in range(n - 1, 0, -1):
            holds[i] |= self.tag[i] in ("article", "main") and not self.flag[i]
            holds[self.parent[i]] |= holds[i]
        for text, i in zip(self.text, self.at):
            if self.tag[i] in ("p", "b", "i", "em", "strong", "span"):
                chars[i] += len(text)
        for i in range(n - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
        self.kept, until = bytearray(b"\1" * len(self.text)), -1
        self.dropped = [False] * n
        for i in range(1, n):
            up = self.dropped[self.parent[i]]
            stays = self.flag[i] == NAMED and (holds[i] or not holds[0] and 2 * chars[i] > chars[0] and self.tag[i] in _CONTAINERS)
            self.dropped[i] = up or self.flag[i] > 0 and not stays
            if self.dropped[i] and not up and self.end[i] > until:
                self.kept[self.start[i] : self.end[i]] = b"\0" * (self.end[i] - self.start[i])
                until = self.end[i]

    def scores(self) -> dict[int, int]:
        """Characters of text blocks outside links, by container: twice for the block's own container, once for the next one."""
        n = len(self.tag)
        link, leaf, box = [False] * n, [-1] * n, [0] * n
        for i in range(1, n):
            up, tag = self.parent[i], self.tag[i]
            link[i] = link[up] or tag == "a"
            box[i] = i if tag in _CONTAINERS else box[up]
            leaf[i] = i if tag in _LEAVES else -1 if tag in _CONTAINERS else leaf[up]
        self.box, self.leaf, out = box, leaf, Counter()
        for text, i, kept in zip(self.text, self.at, self.kept):
            if kept and not link[i] and (k := len(text.strip())):
                b = box[i]
                out[b] += 2 * k
                if b:
                    out[box[self.parent[b]]] += k
        return out

    def best(self, scores: dict[int, int]) -> int:
        """The container of most text, lifted to its article or main element, or while its parent adds headings only."""
        if not scores:
            return 0
        b = min(scores, key=lambda i: (-scores[i], i))
        up, lifted = b, -1
        while up > 0:
            if self.tag[up] in ("article", "main"):
                lifted = up
                if self.tag[up] == "article":
                    break
            up = self.parent[up]
        if lifted >= 0:
            return lifted
        while (up := self.box[self.parent[b]] if b else 0) and self.tag[up] not in ("body", "html"):
            more = [k for k in (*range(self.start[up], self.start[b]), *range(self.end[b], self.end[up])) if self.kept[k] and self.text[k].strip()]
            if not more or any(self.leaf[self.at[k]] < 0 or self.tag[self.leaf[self.at[k]]] not in HEADINGS for k in more):
                break
            b = up
        return b

    def path(self, i: int) -> str:
        steps = []
        while i > 0 and len(steps) <= SHOWN:
            if self.tag[i] in _CONTAINERS:
                steps.append(self.label[i])
            i = self.parent[i]
        return "/".join((["..."] if len(steps) > SHOWN else []) + steps[:SHOWN][::-1])

    def votes(self) -> list[tuple[int, str, int]]:
        """(key, path, weight) of containers of at least 1/NEAR of the best score: thousandths of it, and 1000 more for the chosen one."""
        s = self.scores()
        if not s:
            return []
        b, most, out = self.best(s), max(s.values()), Counter()
        path = {}
        for i, x in s.items():
            if NEAR * x >= most or i == b:
                out[self.key[i]] += 1000 * x // most + 1000 * (i == b)
                path.setdefault(self.key[i], i)
        if b not in s:
            out[self.key[b]] += 2000
            path.setdefault(self.key[b], b)
        return [(k, self.path(path[k]), w) for k, w in out.items()]

    def extract(self, key: int | None) -> tuple[str, str]:
        """(text, path) of all elements of the host's path, or of the page's own best container."""
        s = self.scores()
        own = self.best(s)
        found = [i for i in range(1, len(self.tag)) if self.key[i] == key and self.tag[i] in _CONTAINERS and not self.dropped[i]] if key is not None else []
        size = lambda i: sum(len(self.text[k]) for k in range(self.start[i], self.end[i]) if self.kept[k])
        if not found or sum(map(size, found)) * FOREIGN < size(own):
            found = [own]
        pieces = "".join(self.text[k] if self.kept[k] else " " for i in found for k in range(self.start[i], self.end[i]))
        return " ".join(pieces.split()), self.path(found[0])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[str, int], list] = {}
    for batch in batches:
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            for key, path, weight in Page(source or "").votes():
                x = sums.setdefault((host, key), [path, 0])
                x[1] += weight
        if len(sums) > 100_000:
            yield _sums(sums)
            sums = {}
    yield _sums(sums)


def _sums(sums: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([h for h, _ in sums], pa.string()), pa.array([k for _, k in sums], pa.int64()), pa.array([p for p, _ in sums.values()], pa.string()), pa.array([w for _, w in sums.values()], pa.int64())],
        names=["host", "key", "path", "weight"],
    )


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [Page(source or "").extract(key) for source, key in zip(batch.column("html").to_pylist(), batch.column("key").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array([t for t, _ in found], pa.string()), pa.array([p for _, p in found], pa.string())], names=["page_id", "url", "text", "path"]
        )


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), _HOST, 1))
    return pages.select("page_id", "url", host.alias("host"), F.col("html").cast("string").alias("html"))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, key, path, weight, paths) of each host that has any text: its path of most votes, of equals the smallest key; paths counts those that got votes."""
    votes = with_host(pages).select("host", "html").mapInArrow(_vote, "host string, key long, path string, weight long")
    sums = votes.groupBy("host", "key").agg(F.min("path").alias("path"), F.sum("weight").alias("weight"))
    best = F.max_by(F.struct("key", "path", "weight"), F.struct("weight", -F.col("key")))
    return sums.groupBy("host").agg(best.alias("b"), F.count(F.lit(1)).alias("paths")).select("host", "b.*", "paths")


def extract_main(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, path) of every row of pages (page_id, url, html). The winners are a written table, so Spark knows their size when it chooses the join."""
    winners = written(host_paths(pages).select("host", "key"), "host-paths")
    rows = with_host(pages).join(winners, "host", "left").select("page_id", "url", "html", "key")
    kinds = dict(pages.dtypes)
    return rows.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, path string")


def op11_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = extract_main(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return t.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "path")
