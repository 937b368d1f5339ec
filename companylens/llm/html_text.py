"""Main text of web pages by equivalence classes of template tokens.

Pages of one host come out of a few templates. A token is an element with its path, or the
text of a block with its path; its occurrence vector says how often it stands on each page of
the host. Tokens of the template share their vectors, so tokens with equal vectors form
equivalence classes. A vector is as long as the host has pages, but for classes it is enough
to know which vectors are equal: each token carries sums over pages of its count times a
random number of the page. These are partial sums, so a host with most of the pages is in no
task's way.

Templates are deduced for all pages of a host and for each of its frames, which are the pages
with the same named elements near the root, so that several page types have one each.

Classes that occur on most pages are nested by their paths: a class is valid if its elements'
parents are in valid classes. Valid classes with one occurrence a page frame the template;
the others repeat inside its slots. The content is in the slot with the element ``article`` or
``main`` if the template has one, else in the deepest element that holds most of the text that
differs between pages. What remains after constant texts, and after elements that are known
to be no content (navigation, forms, adverts, comments and so on), is the main text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from companylens.operators.distributed import fits_broadcast, materialize

# A token is part of the template if it is on so much of the host's pages.
FRAME_SHARE = 0.8
# Constant texts are only looked for on hosts with so many pages.
MIN_PAGES = 5

# Pages with the same named and sectioning elements down to this depth share a frame.
FRAME_DEPTH = 4

# Elements by what they mean for text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set(
    "script style noscript template head title iframe object svg math canvas audio video map "
    "select option optgroup textarea button datalist".split()
)
BLOCKS = set(
    "html body address article aside blockquote caption dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section "
    "summary table tbody td tfoot th thead tr ul center".split()
)
NO_CONTENT = set("nav footer aside form menu dialog search fieldset".split())
CONTENT = {"article", "main"}
# Words in class, id and role that mark what is no content.
NO_CONTENT_WORDS = set(
    "nav navbar navigation menu masthead header footer sidebar aside widget cookie cookies consent gdpr notice "
    "notification alert banner popup modal overlay ad ads adv advert adverts advertisement promo promotion "
    "sponsor sponsored comment comments respond reply disqus share sharing social breadcrumb breadcrumbs "
    "pagination pager related recommended newsletter subscribe subscription signup login search searchbox "
    "form complementary contentinfo dialog skip toolbar".split()
)
# Of these, an element with the page's only article in it is no content all the same.
READER_WORDS = set("comment comments respond reply disqus ad ads adv advert adverts advertisement".split())
# First words of names that say what an element has or lacks, and last words
# that say what kind of page or layout it is.
_HAS = set("has have no not with without hide hides hidden show shows is".split())
_KIND = set("page layout less free open closed enabled disabled fixed".split())
SECTIONS = set("nav header footer main article section aside div form".split())
# Start tags that close an open element of these.
_CLOSES = {
    "p": {"p"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
}
_NO_P = BLOCKS - {"html", "body", "p"}
_LIMITS = {"li": {"ul", "ol", "menu"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}}
_WORD = re.compile(r"[a-z0-9]+")


@lru_cache(maxsize=100_000)
def _hash(value: str) -> int:
    return int.from_bytes(blake2b(value.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _named(label: str) -> bool:
    """A name marks no content, unless it only says what its element has or lacks."""
    for name in label.split():
        words = _WORD.findall(name)
        if words and words[0] not in _HAS and words[-1] not in _KIND and set(words) & NO_CONTENT_WORDS:
            return True
    return False


class _Element:
    __slots__ = ("tag", "parent", "at", "path", "depth", "label", "named", "off", "rescued", "silent", "inside")

    def __init__(self, tag: str, attributes, parent: _Element | None, at: int):
        marks = {k: (v or "") for k, v in attributes if k in ("class", "id", "role", "hidden", "aria-hidden")}
        self.label = " ".join(marks.get(k, "") for k in ("class", "id", "role")).lower()
        self.tag, self.parent, self.at = tag, parent, at
        # Names of html and body often name the single page.
        shown = "" if tag in ("html", "body") else re.sub("[0-9]+", "#", self.label).strip()
        self.path = _hash(f"{parent.path if parent else 0}/{tag}.{shown}")
        self.depth = parent.depth + 1 if parent else 1
        role_main = "main" in marks.get("role", "").lower().split()
        self.inside = bool(parent and parent.inside) or tag in CONTENT or role_main
        self.named = tag not in {"html", "body"} | CONTENT and _named(self.label)
        # A header inside the article belongs to it.
        page_header = tag == "header" and not (parent and parent.inside)
        hidden = "hidden" in marks or marks.get("aria-hidden") == "true"
        self.off = tag in NO_CONTENT or page_header or hidden
        self.rescued = False
        self.silent = bool(parent and parent.silent) or tag in SILENT


@dataclass
class Page:
    """Elements and blocks of a page as flat lists, in page order; an element's parent comes before it."""

    paths: list[int]
    parents: list[int]  # -1: none
    depths: list[int]
    flags: list[int]  # SKIP, INSIDE and CONTENT
    at: list[int]  # element of each block, -1: none
    texts: list[str]
    keys: list[int]  # hash of each block's path and text
    frame: int  # hash of the named and sectioning elements near the root


class PageReader(HTMLParser):
    """Collects blocks as (innermost open element, text), and every element, in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[_Element] = []
        self.elements: list[_Element] = []
        self.blocks: list[tuple[_Element | None, str]] = []
        self.text: list[str] = []

    def _break(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.blocks.append((self.stack[-1] if self.stack else None, text))
            self.text = []

    def handle_starttag(self, tag, attrs) -> None:
        if tag in VOID:
            if tag == "hr":
                self._break()
            elif tag == "br":
                self.text.append(" ")
            return
        if tag not in BLOCKS and tag not in SILENT:
            self._mark_inline(tag, attrs)
            return
        if tag in BLOCKS:
            self._break()
            closes = _CLOSES.get(tag, set()) | ({"p"} if tag in _NO_P else set())
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i].tag in closes:
                    del self.stack[i:]
                    break
                if self.stack[i].tag in BLOCKS and self.stack[i].tag in _LIMITS.get(tag, set()):
                    break
                if self.stack[i].tag in BLOCKS - {"p"} and tag not in _CLOSES:
                    break
        self._open(tag, attrs)

    def _open(self, tag, attrs) -> None:
        element = _Element(tag, attrs, self.stack[-1] if self.stack else None, len(self.elements))
        self.stack.append(element)
        self.elements.append(element)

    def _mark_inline(self, tag, attrs) -> None:
        """Inline elements only matter if they are named as no content."""
        label = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower()
        if label and _named(label):
            self._break()
            self._open(tag, attrs)

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag) -> None:
        if tag in VOID:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                self._break()
                del self.stack[i:]
                return
            if self.stack[i].tag in ("article", "main", "body", "table") and tag not in BLOCKS:
                return
        if tag in BLOCKS:
            self._break()

    def handle_data(self, data) -> None:
        if not (self.stack and self.stack[-1].silent):
            self.text.append(data)

    def finish(self) -> Page:
        self.close()
        self._break()
        contents = [e for e in self.elements if e.tag in CONTENT]
        articles = sum(e.tag == "article" for e in contents)
        for content in contents:
            # A name further out does not drop the page's main, or its only article.
            outer = content.parent if content.tag == "main" or articles == 1 else None
            while outer and not outer.rescued:
                outer.rescued = not set(_WORD.findall(outer.label)) & READER_WORDS
                outer = outer.parent
        flags: list[int] = []
        for e in self.elements:
            skip = e.off or e.named and not e.rescued or bool(e.parent and flags[e.parent.at] & SKIP)
            flags.append(SKIP * skip + INSIDE * e.inside + CONTENT_ELEMENT * (e.tag in CONTENT))
        frame = {e.path for e in self.elements if e.depth <= FRAME_DEPTH and (e.label or e.tag in SECTIONS)}
        return Page(
            [e.path for e in self.elements],
            [e.parent.at if e.parent else -1 for e in self.elements],
            [e.depth for e in self.elements],
            flags,
            [e.at if e else -1 for e, _ in self.blocks],
            [text for _, text in self.blocks],
            [_hash(f"{e.path if e else 0}\n{text}") for e, text in self.blocks],
            _hash(" ".join(map(str, sorted(frame)))),
        )


def read_page(html: str | None) -> Page:
    reader = PageReader()
    try:
        reader.feed(html or "")
    except (AssertionError, ValueError):
        # The parser gives up on some broken declarations; what came before stays.
        pass
    return reader.finish()


ELEMENT, TEXT, PAGE = 0, 1, 2
SKIP, INSIDE, CONTENT_ELEMENT = 1, 2, 4

_PAGES = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("frame", pa.int64()), ("seed", pa.int64())]
    + [(name, pa.list_(pa.int64())) for name in ("paths", "parents", "depths", "flags", "at", "keys", "sizes")]
    + [("texts", pa.list_(pa.string()))]
)
PAGE_SCHEMA = (
    "page_id long, url string, host string, frame long, seed long, paths array<long>, parents array<long>, "
    "depths array<long>, flags array<long>, at array<long>, keys array<long>, sizes array<long>, texts array<string>"
)
_TOKENS = pa.schema(
    [("host", pa.string()), ("frame", pa.int64()), ("token", pa.int64()), ("kind", pa.int32()), ("parent", pa.int64()),
     ("times", pa.int64()), ("chars", pa.int64()), ("content", pa.bool_()), ("depth", pa.int32()),
     ("x", pa.int64()), ("y", pa.int64())]
)
TOKEN_SCHEMA = (
    "host string, frame long, token long, kind int, parent long, times long, chars long, content boolean, depth int, "
    "x long, y long"
)


def parsed_pages(pages: DataFrame) -> DataFrame:
    """PAGE_SCHEMA of pages with page_id, url, html and host: each is parsed once."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                rows = []
                for page_id, url, html, host in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "host")), strict=True):
                    page = read_page(html)
                    # The page's random number follows from what it is, not from where it is stored.
                    seed = _hash(f"{url}\n{len(html or '')}\n{(html or '')[-200:]}")
                    rows.append(
                        (page_id, url, host, page.frame, seed, page.paths, page.parents, page.depths, page.flags,
                         page.at, page.keys, [len(t) for t in page.texts], page.texts)
                    )
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, _PAGES, strict=True)], schema=_PAGES
                )

    return pages.select("page_id", "url", "html", "host").mapInArrow(parse, PAGE_SCHEMA)


def _page_tokens(paths, parents, depths, flags, at, keys, sizes) -> list[tuple]:
    """(token, kind, parent, times, chars, content, depth) of a page; chars leave out what is skipped."""
    held = [0] * len(paths)
    texts: dict[int, list] = {}
    for element, key, size in zip(at, keys, sizes, strict=True):
        shown = element < 0 or not flags[element] & SKIP
        if shown and element >= 0:
            held[element] += size
        path = paths[element] if element >= 0 else 0
        row = texts.setdefault(key, [key, TEXT, path, 0, 0, False, depths[element] + 1 if element >= 0 else 1])
        row[3] += 1
        row[4] += size * shown
    for i in range(len(paths) - 1, -1, -1):
        if parents[i] >= 0:
            held[parents[i]] += held[i]
    found: dict[int, list] = {}
    for i, path in enumerate(paths):
        parent = paths[parents[i]] if parents[i] >= 0 else 0
        row = found.setdefault(path, [path, ELEMENT, parent, 0, 0, bool(flags[i] & CONTENT_ELEMENT), depths[i]])
        row[3] += 1
        row[4] += held[i]
    return [tuple(r) for r in (*found.values(), *texts.values())]


def deduce_template(tokens: list[dict], pages: int) -> tuple[int | None, bool, list[int]]:
    """Content element, whether it is an article or main, and constant texts of a host.

    ``tokens`` has token, kind, parent, pages, times, chars, content, depth, x and y of the
    tokens on many of the host's pages.
    """
    classes: dict[tuple, list[dict]] = defaultdict(list)
    for token in tokens:
        if token["pages"] >= FRAME_SHARE * pages:
            classes[token["kind"] == TEXT, token["pages"], token["times"], token["x"], token["y"]].append(token)
    # Nesting: from the root on, an element is valid if its parent's class is.
    valid: set[int] = {0}
    members = sorted(
        (t for (is_text, *_), group in classes.items() if not is_text for t in group),
        key=lambda t: t["depth"],
    )
    frame = []
    for token in members:
        if token["parent"] in valid or token["depth"] == 1:
            valid.add(token["token"])
            if token["times"] == token["pages"]:
                frame.append(token)
    named = [t for t in members if t["content"] and t["token"] in valid]
    constant = [
        t["token"]
        for (is_text, *_), group in classes.items()
        if is_text and pages >= MIN_PAGES
        for t in group
        if t["parent"] in valid
    ]
    most = max((t["chars"] for t in members), default=0)
    if sum(t["chars"] for group in classes.values() for t in group if t["kind"] == TEXT) >= most:
        # Nothing differs: the pages are copies of each other, which says nothing about their template.
        constant = []
    if named:
        best = max(named, key=lambda t: (t["chars"], -t["depth"], t["token"]))
        return best["token"], True, constant
    if not frame:
        return None, False, constant
    most = max(t["chars"] for t in frame)
    holding = [t for t in frame if t["chars"] >= 0.8 * most]
    best = max(holding, key=lambda t: (t["depth"], t["chars"], t["token"]))
    return best["token"], False, constant


def chosen_blocks(
    paths, parents, flags, at, keys, sizes, content: int | None, named: bool, constant: frozenset[int]
) -> list[int]:
    """Blocks of the content element that are left, in page order.

    A page without the host's content element falls back on its own article or main, then
    on its whole body. Constant texts of the host go, also inside an article or main; but if
    they are most of an article, its pages are near copies and not a template, and all stay.
    """
    within_content: list[bool] = []
    for path, parent in zip(paths, parents, strict=True):
        within_content.append(content is not None and (path == content or parent >= 0 and within_content[parent]))
    allowed = [i for i, e in enumerate(at) if e < 0 or not flags[e] & SKIP]
    within = [i for i in allowed if at[i] >= 0 and within_content[at[i]]]
    if not within or not named:
        own = [i for i in allowed if at[i] >= 0 and flags[at[i]] & INSIDE]
        if own:
            within, named = own, True
    chosen = within or allowed
    differs = [i for i in chosen if keys[i] not in constant]
    if named and 2 * sum(sizes[i] for i in differs) < sum(sizes[i] for i in chosen):
        return chosen
    return differs


def main_text(page: Page, content: int | None, named: bool, constant: frozenset[int]) -> str:
    """The page's chosen blocks, joined."""
    sizes = [len(t) for t in page.texts]
    chosen = chosen_blocks(page.paths, page.parents, page.flags, page.at, page.keys, sizes, content, named, constant)
    return "\n\n".join(page.texts[i] for i in chosen)


def host_templates(parsed: DataFrame) -> DataFrame:
    """(host, frame, content, named, constant): each host's template, and one for each frame.

    A frame is a group of a host's pages with the same named elements near the root. The row
    with a null frame is about all pages of the host. Frames with fewer than MIN_PAGES pages
    have no row.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = ("paths", "parents", "depths", "flags", "at", "keys", "sizes")
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                out: list[tuple] = []
                columns = [part.column(c).to_pylist() for c in ("host", "frame", "seed", *lists)]
                for host, frame, seed, *page in zip(*columns, strict=True):
                    x, y = seed & 0x7FFFFFFF, (seed >> 31) & 0x7FFFFFFF
                    out.append((host, frame, 0, PAGE, 0, 1, 0, False, 0, 0, 0))
                    for token, kind, parent, n, chars, content, depth in _page_tokens(*page):
                        out.append((host, frame, token, kind, parent, n, chars, content, depth, x * n, y * n))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, _TOKENS, strict=True)], schema=_TOKENS
                )

    def counted(rows: DataFrame, keys: list[str], pages) -> DataFrame:
        total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
        return rows.groupBy(*keys, "token", "kind", "parent").agg(
            pages.alias("pages"),
            F.sum("times").alias("times"),
            F.sum("chars").alias("chars"),
            F.max("content").alias("content"),
            F.max("depth").alias("depth"),
            total("x"),
            total("y"),
        )

    of_frames = materialize(
        counted(parsed.drop("page_id", "url", "texts").mapInArrow(tokens, TOKEN_SCHEMA), ["host", "frame"], F.count("*")),
        "page-tokens",
    )
    # Stored, as it is read twice.
    of_hosts = materialize(counted(of_frames, ["host"], F.sum("pages")), "host-tokens")

    def often(table: DataFrame, keys: list[str], least: int) -> DataFrame:
        sizes = table.where(f"kind = {PAGE} and pages >= {least}").select(*keys, F.col("pages").alias("n"))
        # A row for each group; broadcast if they are few, so that the tokens stay where they are.
        sizes = F.broadcast(sizes) if fits_broadcast(sizes) else sizes
        wanted = (F.col("pages") >= FRAME_SHARE * F.col("n")) & ((F.col("kind") == ELEMENT) | (F.col("n") >= MIN_PAGES))
        return table.where(f"kind <> {PAGE}").join(sizes, keys).where(wanted)

    whole = often(of_hosts, ["host"], 1).withColumn("frame", F.lit(None).cast("long"))
    rows = often(of_frames, ["host", "frame"], MIN_PAGES).unionByName(whole)
    rows = rows.withColumn("x", F.col("x").cast("string")).withColumn("y", F.col("y").cast("string"))

    def deduce(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        content, named, constant = deduce_template(rows, rows[0]["n"])
        return pa.table(
            {
                "host": pa.array([rows[0]["host"]], pa.string()),
                "frame": pa.array([rows[0]["frame"]], pa.int64()),
                "content": pa.array([content], pa.int64()),
                "named": pa.array([named], pa.bool_()),
                "constant": pa.array([constant], pa.list_(pa.int64())),
            }
        )

    # A group's tokens here are at most those of a page and a quarter.
    return rows.groupBy("host", "frame").applyInArrow(
        deduce, "host string, frame long, content long, named boolean, constant array<long>"
    )


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``.

    A page takes its content element from the template of its frame, else of its host; constant
    texts of both go. A null or empty page has an empty text. Pages without an url form a host
    of their own. Repeated rows stay; other columns are ignored; an empty table gives an empty
    result.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    pages = pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string"),
        F.col("html").cast("string"),
        host.alias("host"),
    )
    parsed = materialize(parsed_pages(pages), "parsed-pages", compression="zstd")
    templates = materialize(host_templates(parsed), "templates")
    lists = ("paths", "parents", "flags", "at", "keys", "sizes", "texts")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                columns = (part.column(c).to_pylist() for c in (*lists, "content", "named", "constant"))
                texts = []
                for *page, shown, content, named, constant in zip(*columns, strict=True):
                    chosen = chosen_blocks(*page, content, bool(named), frozenset(constant or ()))
                    texts.append("\n\n".join(shown[i] for i in chosen))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("page_id"),
                        part.column("url"),
                        pa.array(texts, pa.string()),
                        pa.array(np.fromiter(map(len, texts), np.int64, len(texts))),
                    ],
                    ["page_id", "url", "text", "n_chars"],
                )

    framed = templates.where("frame is not null").select(
        "host", "frame", F.col("content").alias("own"), F.col("named").alias("own_named"), F.col("constant").alias("more")
    )
    joined = (
        parsed.join(templates.where("frame is null").drop("frame"), "host", "left")
        .join(framed, ["host", "frame"], "left")
        .select(
            "page_id",
            "url",
            *lists,
            F.coalesce("own", "content").alias("content"),
            F.when(F.col("own").isNotNull(), F.col("own_named")).otherwise(F.col("named")).alias("named"),
            F.concat(*[F.coalesce(c, F.array().cast("array<long>")) for c in ("constant", "more")]).alias("constant"),
        )
    )
    return joined.mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def op3_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
