"""Main text of web pages by a site style tree.

The pages of a host are merged: nodes with the same path of tags and classes
are one node of the host's tree.  For every node two entropies are taken over
the host's distinct pages, with the number of pages as the base of the
logarithm.  Presentation: the entropy of the node's child sequences; a node
that always looks alike scores 0, one whose layout varies scores up to 1.
Content: one minus the mean entropy of the text blocks below the node; a text
on one page has entropy 0, a text on all pages 1.  A node's importance is the
weighted sum, and branches under the threshold are removed from each page of
the host that has them.

Elements say themselves what they are, too.  Tags that hold no content (nav,
footer, ...) are removed on every page.  A class or id that tells of no content
(ad, menu, cookie) lowers a node's importance, and removes it on its own unless
it holds the page's main article, or, where the name only mentions such a thing
(related-story-body), most of the page's text.  All nodes enter the tree,
whatever their names.  An <article>, failing that <main>, is the part that is
read.  Text blocks inside it are never removed one by one, only containers are.

Pages count once if the blocks that make up nine tenths of their text are the
same, so copies don't turn their own article into boilerplate, nor does a long
text that pages share hide how they differ.  Two pages are heard, but must be
clearer than many: the threshold is lower by a share of one in their number.

Nulls: a null page has an empty text; a null or hostless url belongs to the
host ''.  Repeated rows give equal texts.  Empty table: no rows.  Unclosed,
crossed and cut-off markup is read as far as it goes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesdeck.llm.common import read, save_shared

#: Weight of presentation in a node's importance, least importance of content
#: and the pages from which a host's statistics are heard.
PRESENTATION = 0.1
THRESHOLD = 0.35
LEAST_PAGES = 2
#: What a name that tells of no content adds to the threshold.
NAMED = 0.3
#: Share of a page's text whose blocks sign it.
SIGNED = 0.9
SALTS = 32
#: Up to so many pages with noise, the noise goes to the pages and not the
#: pages' text through a shuffle.
FEW_PAGES = 50_000

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt "
                   "ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption".split())
#: Content is skipped up to the closing tag.
RAW = frozenset("script style title textarea noscript template iframe svg math object noembed noframes xmp select".split())
NO_CONTENT = frozenset("nav footer aside button dialog menu head datalist audio video canvas".split())
#: May hold a whole page, and are then no matter.
FORMS = frozenset("form fieldset".split())
#: Closed by an opening tag of the second kind.
CLOSES = {"p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
                         "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()),
          "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
          "tr": frozenset({"tr", "tbody", "tfoot"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"})}
NAMED_NO_CONTENT = frozenset(
    "nav navbar navigation menu menubar footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor "
    "sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup "
    "comment comments respond reply replies disqus share sharing social related recommended breadcrumb breadcrumbs "
    "pagination pager widget toolbar login search copyright legal skip hidden".split())
#: Never removed for what other pages look like.
KEPT = frozenset(("html", "body", "article", "main"))
#: Only outside the main part, where a heading may call itself a header.
NAMED_HEADER = frozenset("header masthead banner topbar".split())
#: A name that begins so speaks of a part, not of the element.
MODIFIERS = frozenset("has with without no not is show hide".split())
NO_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PART = re.compile(r"[a-z]+")
#: Numbers in a class or id that count pages or posts, not kinds of elements.
DIGITS = re.compile(r"\d{3,}")


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)} if text else {}


#: How far an element tells that it is no content: not; its name mentions it;
#: its name says so; its tag or an attribute does.
SILENT, MENTIONED, SAID, SURE = range(4)


def told_by(names: list[str], words: frozenset[str]) -> int:
    """What class names and ids tell, of which the last part says what the element is."""
    most = SILENT
    for name in names:
        parts = PART.findall(name)
        if not words.isdisjoint(parts):
            most = max(most, SAID if parts[-1] in words and parts[0] not in MODIFIERS else MENTIONED)
    return most


def key_of(*parts) -> int:
    import xxhash
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts)).encode()) - (1 << 63)


class Page:
    """Blocks of text with the containers around them.

    ``nodes``: (key, parent, tag, told): ``told`` is how far the element tells
    that it is no content.  ``children``: labels below each node.  ``blocks``:
    (node, text).  ``gone``: whether what it tells removes a node."""

    def __init__(self, source: str | None):
        self.nodes = [(0, -1, "", SILENT)]
        self.children: list[list[str]] = [[]]
        self.blocks: list[tuple[int, str]] = []
        self._read(source or "")
        self.gone = self._judged()

    def _read(self, source: str) -> None:
        stack, text, at = [0], [], 0

        def flush() -> None:
            if text:
                words = html.unescape("".join(text)).split()
                if words:
                    self.blocks.append((stack[-1], " ".join(words)))
                text.clear()

        while True:
            m = MARKUP.search(source, at)
            if not m:
                break
            if m.start() > at:
                text.append(source[at:m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag, closing, rest = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
            if tag == "br":
                text.append(" ")
            elif tag in INLINE:
                continue
            elif closing:
                for depth in range(len(stack) - 1, 0, -1):
                    if self.nodes[stack[depth]][2] == tag:
                        flush()
                        del stack[depth:]
                        break
                else:
                    flush()
            elif tag in RAW:
                if not rest.endswith("/"):
                    end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, at)
                    at = end.end() if end else len(source)
                if tag not in ("svg", "math", "select"):
                    flush()
            else:
                flush()
                while len(stack) > 1 and tag in CLOSES.get(self.nodes[stack[-1]][2], ()):
                    stack.pop()
                if tag in VOID:
                    continue
                if rest.endswith("/") and tag not in TEXT_BLOCKS and tag != "div":
                    rest = rest[:-1]
                self._open(tag, rest, stack)
        if at < len(source):
            cut = source.find("<", at)  # a tag that the end cuts off
            tail = source[at:] if cut < 0 or not re.match(r"</?[a-zA-Z!]", source[cut:]) else source[at:cut]
            text.append(tail)
        flush()

    def _open(self, tag: str, rest: str, stack: list[int]) -> None:
        found = attributes(rest)
        names = DIGITS.sub("0", f"{found.get('class', '')} #{found['id']}" if "id" in found else found.get("class", "")).lower()
        label = f"{tag}.{' '.join(names.split())}" if names.strip() else tag
        parent = stack[-1]
        self.children[parent].append(label)
        named = [x for x in names.replace("#", "").split() if x]
        told = told_by(named, NAMED_NO_CONTENT)
        if tag in NO_CONTENT or found.get("role", "").lower() in NO_CONTENT_ROLES or "hidden" in found \
                or found.get("aria-hidden", "").lower() == "true" or "display:none" in re.sub(r"\s", "", found.get("style", "")).lower():
            told = SURE
        elif tag in FORMS:
            told = max(told, SAID)
        if not any(self.nodes[i][2] in ("article", "main") for i in stack):
            told = SURE if tag == "header" else max(told, told_by(named, NAMED_HEADER))
        if tag in ("html", "body"):
            told = SILENT
        self.nodes.append((key_of(self.nodes[parent][0], label), parent, tag, told))
        self.children.append([])
        stack.append(len(self.nodes) - 1)

    def chain(self, node: int) -> list[int]:
        out = []
        while node > 0:
            out.append(node)
            node = self.nodes[node][1]
        return out

    def _judged(self) -> list[bool]:
        size = [0] * len(self.nodes)  # code points below, but for what surely is no content
        for node, text in self.blocks:
            size[node] += len(text)
        hidden = [False]
        for _, parent, _, told in self.nodes[1:]:
            hidden.append(hidden[parent] or told == SURE)
        for i in range(len(self.nodes) - 1, 0, -1):
            if self.nodes[i][3] != SURE:
                size[self.nodes[i][1]] += size[i]
        held: set[int] = set()
        for kind in ("article", "main"):
            found = [i for i, n in enumerate(self.nodes) if n[2] == kind and not hidden[i]]
            if found:
                held = set(self.chain(max(found, key=lambda i: size[i])))
                break
        return [told == SURE or (told == SAID and i not in held)
                or (told == MENTIONED and i not in held and 2 * size[i] <= size[0])
                for i, (_, _, _, told) in enumerate(self.nodes)]

    def kept_blocks(self, noise: frozenset[int] = frozenset()) -> list[str]:
        """The blocks of the main part that no container removed for its name or as noise holds."""
        bad: list[bool] = [False]
        part: list[str] = [""]
        for (key, parent, tag, _), gone in zip(self.nodes[1:], self.gone[1:], strict=True):
            bad.append(bad[parent] or gone or (key in noise and tag not in KEPT))
            inside = part[parent]
            part.append("article" if tag == "article" or inside == "article" else "main" if tag == "main" or inside else "")
        for want in ("article", "main"):
            kept = [t for node, t in self.blocks if not bad[node] and (part[node] == want or (want == "main" and part[node]))]
            if kept:
                return kept
        return [t for node, t in self.blocks if not bad[node]]

    def main_text(self, noise: frozenset[int] = frozenset()) -> str:
        return "\n".join(self.kept_blocks(noise))

    def features(self) -> Iterator[tuple[int, int, int, bool, bool]]:
        """(node, kind, feature, named, gone): the child sequence of a container
        (kind 0) and the text blocks below it (kind 1); nodes of one path are
        merged.  What can't be removed has no features.  ``named``: the node or
        one around it tells of no content; ``gone``: that alone removes it."""
        counted, named, gone = [False], [False], [False]
        for i, (_, parent, tag, told) in enumerate(self.nodes[1:], 1):
            named.append(named[parent] or told > SILENT)
            gone.append(gone[parent] or self.gone[i])
            counted.append(tag not in TEXT_BLOCKS and tag not in KEPT)
        made: set[tuple[int, int, int, bool, bool]] = set()
        for i, below in enumerate(self.children):
            if counted[i]:
                made.add((self.nodes[i][0], 0, key_of(*[c for j, c in enumerate(below) if not j or below[j - 1] != c]), named[i], gone[i]))
        for node, text in self.blocks:
            chain = [i for i in self.chain(node) if counted[i]]
            if chain:
                feature = key_of(text)
                made.update((self.nodes[i][0], 1, feature, named[i], gone[i]) for i in chain)
        return iter(made)

    def signature(self) -> int:
        """The hash of the longest blocks of the main part, as many as make up ``SIGNED`` of it."""
        blocks = sorted(self.kept_blocks(), key=lambda t: (-len(t), t))
        left, signed = SIGNED * sum(map(len, blocks)), []
        for text in blocks:
            if left <= 0:
                break
            signed.append(text)
            left -= len(text)
        return key_of(*signed)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def page_features(pages: DataFrame) -> DataFrame:
    """(``content``, ``host``, ``signature``, ``node``, ``kind``, ``feature``, ``named``, ``gone``)."""
    long = T.LongType()
    schema = T.StructType([T.StructField("content", long), T.StructField("host", T.StringType())]
                          + [T.StructField(n, long) for n in ("signature", "node", "kind", "feature")]
                          + [T.StructField(n, T.BooleanType()) for n in ("named", "gone")])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for content, host, source in zip(*[c.to_pylist() if i < 2 else c for i, c in enumerate(batch.columns)], strict=True):
                page = Page(source.as_py())
                signature = page.signature()
                rows += [(content, host, signature, *f) for f in page.features()]
                if len(rows) > 50_000:
                    yield made(rows)
                    rows = []
            if rows:
                yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        content, host, *rest, named, gone = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(content, pa.int64()), pa.array(host, pa.string()),
                                           *[pa.array(c, pa.int64()) for c in rest], pa.array(named, pa.bool_()), pa.array(gone, pa.bool_())],
                                          names=schema.names)

    return pages.select("content", "host", "html").mapInArrow(features, schema)


def node_importance(features: DataFrame, presentation: float) -> DataFrame:
    """(``host``, ``node``, ``pages``, ``named``, ``importance``) of every node of the hosts' trees."""
    distinct = features.select("host", "signature", "node", "kind", "feature", "named").distinct()
    counts = distinct.groupBy("host", "node", "kind", "feature").agg(F.count("*").alias("k"), F.max("named").alias("named"))
    # pages that hold the node: each shows one child sequence, or the first of several
    pages = distinct.filter("kind = 0").select("host", "node", "signature").distinct() \
        .groupBy("host", "node").agg(F.count("*").alias("m"))

    # the entropies over k of m pages need only the sums of k and of k log k
    def of_kind(kind: int, value: Column) -> Column:
        return F.sum(F.when(F.col("kind") == kind, value))

    k, m = F.col("k"), F.col("m")
    sums = counts.groupBy("host", "node").agg(
        F.max("named").alias("named"), of_kind(0, k).alias("k0"), of_kind(0, k * F.log(k)).alias("l0"),
        of_kind(1, k).alias("k1"), of_kind(1, k * F.log(k)).alias("l1"))
    weighed = sums.join(pages, ["host", "node"]).filter(m > 1) \
        .withColumn("layout", (F.col("k0") * F.log(m) - F.col("l0")) / (m * F.log(m))) \
        .withColumn("repeated", F.col("l1") / (F.col("k1") * F.log(m)))
    importance = presentation * F.least(F.lit(1.0), F.coalesce("layout", F.lit(0.0))) \
        + (1 - presentation) * (1 - F.coalesce("repeated", F.lit(1.0)))
    return weighed.select("host", "node", m.alias("pages"), "named", importance.alias("importance"))


def noise_nodes(features: DataFrame, presentation: float, threshold: float, least_pages: int, named: float = NAMED) -> DataFrame:
    """(``host``, ``node``) of the branches whose importance is below the
    threshold: less for few pages, more for nodes whose names tell of no content."""
    bar = threshold * (1 - 1 / F.col("pages")) + F.when(F.col("named"), named).otherwise(0.0)
    return node_importance(features, presentation).filter((F.col("pages") >= least_pages) & (F.col("importance") < bar)).select("host", "node")


def _main_texts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for sources, noises in batches:
        yield pd.Series([Page(s).main_text(frozenset(() if n is None else map(int, n)))
                         for s, n in zip(sources, noises, strict=True)], dtype=object)


def extract(pages: DataFrame, carry: list[str], url: str = "url", source: str = "html",
            presentation: float = PRESENTATION, threshold: float = THRESHOLD,
            least_pages: int = LEAST_PAGES) -> DataFrame:
    """``doc`` (the carried columns) and ``text`` of every row of ``pages``."""
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), host_of(F.col(url)).alias("host"),
                        F.coalesce(F.col(source), F.lit("")).alias("html")) \
        .withColumn("content", F.xxhash64("html", "host"))
    features = save_shared(page_features(rows), "page-features")
    noise = noise_nodes(features, presentation, threshold, least_pages) \
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # what a page removes by itself need not be looked up
    found = save_shared(
        features.filter("kind = 0 AND NOT gone").select("content", "host", "node").distinct()
        .withColumn("salt", F.pmod("content", F.lit(SALTS)).cast("int"))
        .join(noise, ["host", "node", "salt"])
        .groupBy("content").agg(F.collect_set("node").alias("noise")), "page-noise")  # a page's own nodes
    if found.count() <= FEW_PAGES:  # else both sides are shuffled
        found = F.broadcast(found)
    main_text = F.pandas_udf(_main_texts, "string")
    return rows.join(found, "content", "left").select("doc", main_text("html", "noise").alias("text"))


def op3_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html")
    return extract(pages, ["page_id", "url"]).select("doc.*", "text", F.length("text").cast("long").alias("n_chars"))
