"""Main text of web pages by template deduction from equivalence classes.

A page becomes a sequence of tokens: block tags with the path of their containers, and text nodes with theirs. The occurrence vector of
a token says how often each distinct page of a host holds it; copies of a page count once. Tokens with one vector form an equivalence class. Vectors are compared by the number of
pages and the sum of a hash of (page, count), which tasks add up for their own pages before anything is shuffled, so no host is ever
gathered in one place. A class is frequent if (nearly) all pages of a host hold it and large if it has several tokens. Classes
that occur once a page are the outline; the others are nested into the outline's gaps by their mean position. A page that keeps the
outline's order is read with the template: blocks made of its text tokens are fixed labels and go, and the remaining slots are
extracted. A slot that lies in menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments,
by the elements around it, is not main text. Where slots lie in an ``article`` or ``main`` element, only those are taken.

Names of classes, ids and roles are weaker than elements. They never take ``html``, ``body``, ``main`` or an outermost ``article``. A whole name
takes any other container. A part of a name (``related`` of ``related-work``) is a hint: it takes its container only if the page has main text without it.

Labels go only where the template leaves variable slots on most distinct pages of the host; within articles these slots must hold at least
as much text as the labels, so what near copies of one article share stays.

Hosts with fewer than ``MIN_PAGES`` distinct pages have no template; there the elements alone decide. Character references are decoded, white
space inside a block becomes one space, blocks are joined by one line end. Defined results: null or empty html gives an empty text; a null
or odd url is a host of its own kind; unclosed elements end with their container; repeated rows give a row each and change no other; an empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrid.llm.textkit import byte_strings, free_name, mix, stored

MIN_PAGES = 8
FREQUENT = 0.95
LARGE = 2
TAG, ASIDE = -1, -2

#: Elements and names of classes, ids and roles that hold no main text.
CHROME_TAGS = frozenset("head nav footer aside form script style noscript template iframe object svg canvas button select textarea dialog menu".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination footer masthead comment comments disqus reply replies respond social share sharing "
    "related widget toolbar contentinfo complementary search login signup".split()
)
#: Names that mean page furniture only outside an article.
HEADER_WORDS = frozenset(["header", "topbar"])
#: Elements that no name takes; an article within another can be a comment.
FRAME = frozenset(["html", "body", "main", "article"])
#: How surely a text is furniture.
NO, HINTED, SURE = range(3)
RAW = frozenset(["script", "style", "textarea", "title", "template", "noscript", "iframe"])
CONTAINERS = frozenset("html head body nav header footer aside form main article section div ul ol dl table tbody thead tfoot tr blockquote figure dialog menu fieldset details".split()) | CHROME_TAGS
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre br hr figcaption caption address summary legend option".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+")


def events(page: str) -> Iterator[tuple[str, str, str, int, bool]]:
    """(kind, path, text, how surely in furniture, in an article) of each block tag ("tag") and text node ("text"), in page order."""
    stack: list[tuple[str, str, int, bool]] = []  # name, path, furniture, article
    at = 0
    end = len(page)
    while at < end:
        path, furniture, article = stack[-1][1:] if stack else ("", NO, False)
        match = MARKUP.search(page, at)
        if (text := page[at : match.start() if match else end]) and not text.isspace():
            yield "text", path, text, furniture, article
        if match is None:
            return
        at = match.end()
        closing, name, attributes = match.groups()
        if name is None:
            continue
        name = name.lower()
        if name in RAW and not closing:  # its content is not markup
            close = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else end
            continue
        if name not in BLOCKS:
            continue
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                path = stack[depth][1]
                del stack[depth:]
            yield "tag", f"{path}</{name}", "", furniture, article
            continue
        own = f"{path}>{name}"
        if name in CONTAINERS:
            named = " ".join("".join(m) for m in NAMES.findall(attributes)).lower()
            furniture = max(furniture, _furniture(name, named, article))
            article = article or name in ("article", "main") or "main" in named.split() and name in ("div", "section") and not furniture
            own = f"{own}.{named}" if named else own
            if not attributes.rstrip().endswith("/"):
                stack.append((name, own, furniture, article))
        yield "tag", own, "", furniture, article


def _furniture(name: str, named: str, article: bool) -> int:
    words = CHROME_WORDS if article else CHROME_WORDS | HEADER_WORDS
    if name in CHROME_TAGS or (name == "header" and not article):
        return SURE
    if name in FRAME and not (name == "article" and article):
        return NO
    if not words.isdisjoint(named.split()):
        return SURE
    return NO if words.isdisjoint(WORDS.findall(named)) else HINTED


def weakest(found: list[tuple[str, str, str, int, bool]]) -> int:
    """What still counts as main text: hinted furniture too where a page has nothing else."""
    return NO if any(kind == "text" and furniture == NO for kind, _, _, furniture, _ in found) else HINTED


def token(kind: str, path: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}\0{path}\0{' '.join(text.split())}".encode())


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").strip().lower()).split("/")[0].split("?")[0].split("#")[0]


def _distinct(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, digest, article, tokens, sizes) of the distinct html of each host. Tasks drop their own copies before the shuffle, and those of others after it.

    ``sizes`` has the length of each token that is main text by its elements, ``TAG`` for block tags and ``ASIDE`` for other text.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, bytes]] = set()
        for batch in batches:
            rows = []
            for url, page in zip(batch.column(0).to_pylist(), byte_strings(batch.column(1))):
                key = host_of(url), hashlib.blake2b(page, digest_size=16).digest()
                if key not in seen:
                    seen.add(key)
                    found = list(events(page.decode()))
                    only_article, kept = has_article(found), weakest(found)
                    sizes = [TAG if kind == "tag" else len(" ".join(text.split())) if furniture <= kept and (article or not only_article) else ASIDE for kind, _, text, furniture, article in found]
                    rows.append((*key, only_article, np.array([token(*e[:3]) for e in found], np.uint64).tobytes(), np.array(sizes, np.int32).tobytes()))
            columns = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, bytes]] = set()
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            new = [key not in seen and not seen.add(key) for key in keys]
            yield batch.filter(pa.array(new, pa.bool_()))

    kinds = {"host": pa.string(), "digest": pa.binary(), "article": pa.bool_(), "tokens": pa.binary(), "sizes": pa.binary()}
    schema = "host string, digest binary, article boolean, tokens binary, sizes binary"
    return pages.select(url_col, html_col).mapInArrow(own, schema).repartition("host", "digest").mapInArrow(first, schema)


def _vectors(distinct: DataFrame) -> DataFrame:
    """(host, token, pages, vector, place): parts of each token's occurrence vector, added up within a task. Token 0 counts pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, tokens, counts, ids, places = [], [], [], [], []
            for host, digest, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = np.frombuffer(blob, np.uint64).tolist()
                number = int.from_bytes(digest[:8], "little")
                first = {t: i for i, t in reversed(list(enumerate(found)))}
                own = Counter(found)
                hosts.extend([host] * (len(own) + 1))
                tokens.extend([0, *own])
                counts.extend([1, *own.values()])
                ids.extend([number] * (len(own) + 1))
                places.extend([0.0, *(first[t] / len(found) for t in own)])
            part = np.array(counts, np.uint64) + np.array(ids, np.uint64)
            rows = pa.table({
                "host": hosts, "token": pa.array(np.array(tokens, np.uint64).view(np.int64)), "once": pa.array(np.array(counts) == 1).cast(pa.int64()),
                "vector": pa.array((mix(part) >> np.uint64(32)).astype(np.int64)), "place": pa.array(places, pa.float64()),
            })
            summed = rows.group_by(["host", "token"]).aggregate([("vector", "count"), ("once", "sum"), ("vector", "sum"), ("place", "sum")])
            summed = summed.select(["host", "token", "vector_count", "once_sum", "vector_sum", "place_sum"]).rename_columns(["host", "token", "pages", "once", "vector", "place"])
            yield from summed.to_batches()

    return distinct.select("host", "digest", "tokens").mapInArrow(run, "host string, token long, pages long, once long, vector long, place double")


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, frequent: float = FREQUENT) -> DataFrame:
    """(host, outline, nested, article_labels, other_labels): tokens of the frequent, large classes; the outline in page order, the others with the
    gap they lie in; whether labels are dropped from the main text of pages with an article, and of pages without one."""
    distinct = stored(_distinct(pages, url_col, html_col), "distinct-pages")
    parts = _vectors(distinct)
    vector = F.sum(F.col("vector").cast("decimal(38,0)"))
    tokens = parts.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum("once").alias("once"), vector.alias("vector"), F.sum("place").alias("place"))
    tokens = stored(tokens.where(f"pages >= {min_pages}"), "occurrences")
    total = tokens.where("token = 0").select(F.col("host").alias("of"), F.col("pages").alias("total"))
    known = tokens.where("token <> 0").join(total, F.col("host") == F.col("of")).where(F.col("pages") >= frequent * F.col("total"))
    classes = known.groupBy("host", "pages", "vector").agg(
        F.count(F.lit(1)).alias("size"), F.min(F.col("once") == F.col("pages")).alias("once"), F.collect_list(F.struct((F.col("place") / F.col("pages")).alias("place"), "token")).alias("tokens")
    )
    members = classes.where(f"size >= {LARGE}").select("host", "once", F.explode("tokens").alias("t"))
    ordered = members.groupBy("host").agg(
        F.array_sort(F.collect_list(F.when(F.col("once"), F.col("t")))).alias("outline"), F.array_sort(F.collect_list(F.when(~F.col("once"), F.col("t")))).alias("nested")
    )
    found = stored(ordered.select("host", F.col("outline.token").alias("outline"), F.col("nested.token").alias("nested")), "outlines")
    return found.join(_slots(distinct, found), "host", "left")


def _slots(distinct: DataFrame, found: DataFrame) -> DataFrame:
    """(host, article_labels, other_labels): whether most distinct pages that keep to the template have variable slots in their main text.

    Outside articles a slot is enough. In articles the slots must hold at least as much text as the labels, or else what the pages share is the article.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, article, tokens, sizes, outline, nested in zip(*(batch.column(i).to_pylist() for i in range(6))):
                found = np.frombuffer(tokens, np.uint64).tolist()
                if labels := _labels(found, outline, nested):
                    total, size, fixed = [0, 0], 0, True
                    for t, n in [*zip(found, np.frombuffer(sizes, np.int32).tolist()), (0, TAG)]:
                        if n == TAG:
                            total[fixed] += size
                            size, fixed = 0, True
                        elif n != ASIDE:
                            size += n
                            fixed = fixed and t in labels
                    if any(total):
                        rows.append((host, article, total[0] >= total[1] if article else total[0] > 0))
            hosts, articles, slots = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(articles, pa.bool_()), pa.array(slots, pa.bool_())], ["host", "article", "slots"])

    joined = distinct.join(found, "host").select("host", "article", "tokens", "sizes", "outline", "nested")
    most = [F.coalesce(F.avg(F.when(F.col("article") == a, F.col("slots").cast("int"))) > 0.5, F.lit(False)).alias(name) for a, name in ((True, "article_labels"), (False, "other_labels"))]
    return joined.mapInArrow(run, "host string, article boolean, slots boolean").groupBy("host").agg(*most)


def _labels(tokens: list[int], outline: list[int] | None, nested: list[int] | None) -> frozenset[int]:
    """The template's tokens, or none if the page does not keep to it."""
    if not outline:
        return frozenset()
    rank = {t & 0xFFFFFFFFFFFFFFFF: i for i, t in enumerate(outline)}
    met = [rank[t] for t in tokens if t in rank]
    if all(a < b for a, b in zip(met, met[1:])):  # valid here: the outline's tokens come in its order
        return frozenset([*rank, *(t & 0xFFFFFFFFFFFFFFFF for t in nested or ())])
    return frozenset()


def has_article(found: list[tuple[str, str, str, int, bool]]) -> bool:
    kept = weakest(found)
    return any(kind == "text" and article and furniture <= kept for kind, _, _, furniture, article in found)


def main_text(page: str, outline: list[int] | None, nested: list[int] | None, article_labels: bool = True, other_labels: bool = True) -> str:
    """The blocks of main text of a page, with the template of its host if the page keeps to it."""
    found = list(events(page))
    only_article, kept = has_article(found), weakest(found)
    labels: frozenset[int] = frozenset()
    if outline and (article_labels if only_article else other_labels):
        labels = _labels([token(*e[:3]) for e in found], outline, nested)
    blocks, open_, fixed = [], [], True
    for kind, path, text, furniture, article in [*found, ("tag", "", "", NO, False)]:
        if kind == "tag":
            if not fixed:  # a block of labels only belongs to the template
                blocks.append("".join(open_))
            open_, fixed = [], True
        elif furniture <= kept and (article or not only_article):
            open_.append(text)
            fixed = fixed and bool(labels) and token(kind, path, text) in labels
    cleaned = (" ".join(html.unescape(b).split()) for b in blocks if b)
    return "\n".join(b for b in cleaned if b)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, main text, and its number of code points."""
    found = stored(templates(pages, url_col, html_col), "templates")
    of = free_name(pages, "template_host")
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    address = F.lower(F.trim(F.coalesce("url", F.lit(""))))
    host = F.regexp_extract(F.regexp_replace(address, r"^[a-z][a-z0-9+.-]*://", ""), r"^[^/?#]*", 0)
    joined = own.join(found.withColumnRenamed("host", of), host == F.col(of), "left").select("id", "url", "html", "outline", "nested", "article_labels", "other_labels")
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page or "", *rest) for page, *rest in zip(*(batch.column(i).to_pylist() for i in range(2, 7)))]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [id_col, url_col, "text", "n_chars"])

    return joined.mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
