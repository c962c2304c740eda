"""Main text of pages by template deduction from equivalence classes.

Pages are tokens: tags, and the text between them as a whole, each in its role, which is the path of the
containers around it.  Tokens of a host that occur equally often on every page share an occurrence vector.
Pages of a host with the same body, which are copies of one text, count once.  The vectors are compared by
sums of hashes over pages, so they are built by partial aggregation, however many pages a host has.  Tokens
with the same vector form an equivalence class.  A class is valid if it is frequent and its tokens keep one
order; valid classes are nested by the spans of their tokens into the host's template.  What lies between
template tokens are slots; the main slot is the lowest container around all that varies, or around what varies
in article containers where the host has them.  Extraction takes a page's main slot without text of the template
and without the slots that serve navigation, adverts, notices, forms or readers' comments.  Pages most of whose
text is in the template are near copies of each other, and keep it.

Defined results: null and empty html give an empty text; a page whose host is unknown shares a host with
all such pages; a host with few different pages has no frequent class, so only the containers decide; equal pages
are extracted alike, one row each; an empty table gives no rows; other columns pass through, whatever their names, but one
called text, in any letter case, gives way to the result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspan.llm.common import own_columns, place, positional, stored

MIN_PAGES = 4
MIN_SHARE = 0.5
MIN_TOKENS = 3
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<",
    re.DOTALL | re.IGNORECASE)
_MARKS = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.IGNORECASE)
# The roles of elements in HTML.
CONTAINERS = set("body main article section div nav header footer aside form ul ol dl table blockquote figure details "
                 "dialog fieldset head title select button menu".split())
BLOCKS = CONTAINERS | set("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption pre hr figcaption address html summary option".split())
LEFT_OUT = set("head title nav header footer aside form select button menu dialog fieldset".split())
MAIN = set("article main".split())
# Words in class, id and role that name what is not the article.
LEFT_OUT_MARKS = set("ad ads advert adverts advertisement banner sponsor sponsored promo cookie cookies consent notice notices sidebar "
                     "menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments disqus reply replies "
                     "share sharing related newsletter subscribe popup modal widget pagination pager login signup search".split())
MAIN_MARKS = {"articlebody", "main"}
UNMARKED = MAIN | {"body"}  # whatever their marks say, they hold the article too


def host_of(url: Column) -> Column:
    """Host part of a URL; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


class Token:
    """A tag or a whole text in its role; ``text`` is decoded, with white space turned into single spaces."""

    __slots__ = ("path", "key", "text", "left_out", "main", "opens_block")

    def __init__(self, path: str, key: str, text: str, left_out: bool, main: bool, opens_block: bool):
        self.path, self.key, self.text, self.left_out, self.main, self.opens_block = path, key, text, left_out, main, opens_block

    @property
    def number(self) -> int:
        return xxhash.xxh3_64_intdigest(f"{self.path}\0{self.key}") - (1 << 63)


def _marks(attributes: str) -> tuple[str, set[str]]:
    values = [m[2].strip("\"'").lower() for m in _MARKS.finditer(attributes)]
    return ".".join(values), {w for v in values for w in re.split(r"[^a-z]+", v)}


def tokens_of(source: str | None) -> Iterator[Token]:
    """The tokens of a page in order.  Containers that are never closed end where an enclosing one does."""
    stack: list[tuple[str, str, bool, bool]] = []  # tag, label, left out, main
    for m in _TOKEN.finditer(source or ""):
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            whole = m[0]
            text = " ".join(html.unescape(whole).split()) if not whole.startswith("<") or whole == "<" else ""
            if whole.startswith("<") and whole != "<":
                continue
            yield Token(_path(stack), f"#{text}", html.unescape(whole), _out(stack), _main(stack), False)
            continue
        closing, attributes = bool(m[2] or m[5]), m[4] or m[7] or ""
        label, words = _marks(attributes) if attributes and not closing else ("", set())
        if tag in CONTAINERS:
            if closing:
                at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
                if at is not None:
                    del stack[at:]
            elif not attributes.rstrip().endswith("/"):
                out = tag in LEFT_OUT or (tag not in UNMARKED and bool(words & LEFT_OUT_MARKS))
                main = (tag in MAIN or (tag != "body" and bool(words & MAIN_MARKS))) and not out
                if main and not any(s[3] for s in stack):
                    # The article begins even if something before it was never closed.
                    while stack and stack[-1][2] and stack[-1][0] not in ("div", "section"):
                        stack.pop()
                stack.append((tag, f"{tag}.{label}" if label else tag, out, main))
        yield Token(_path(stack), f"<{'/' if closing else ''}{tag}>", "", _out(stack), _main(stack), tag in BLOCKS)


def _path(stack: list) -> str:
    return "/".join(s[1] for s in stack)


def _out(stack: list) -> bool:
    return any(s[2] for s in stack)


def _main(stack: list) -> bool:
    return any(s[3] for s in stack)


def occurrences(pages: DataFrame, page_col: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """Rows (host, body, page, tokens), one per page.

    ``body`` is a 64-bit hash of the texts that are not left out, and ``tokens`` has (token, path, is_text, left_out,
    main, times, place, chars) of each distinct token.
    """
    rows = pages.select(host_of(F.col(url)).alias("host"), F.xxhash64(F.col(page_col).cast("string"), F.col(url)).alias("page"),
                        F.col(source).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _NAMES]
            ends, bodies = [0], []
            for text in batch.column(2).to_pylist():
                times: Counter = Counter()
                first: dict[int, tuple] = {}
                body = xxhash.xxh3_64()
                for place, t in enumerate(tokens_of(text)):
                    if t.key != "#":
                        number = t.number
                        times[number] += 1
                        first.setdefault(number, (t, place))
                        if t.key[0] == "#" and not t.left_out:
                            body.update(f"{t.key}\0")
                for number, n in times.items():
                    t, place = first[number]
                    for column, value in zip(out, (number, t.path, t.key[0] == "#", t.left_out, t.main, n, place,
                                                   n * (len(t.key) - 1) if t.key[0] == "#" else 0)):
                        column.append(value)
                ends.append(len(out[0]))
                bodies.append(body.intdigest() - (1 << 63))
            kinds = [pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.int64()]
            tokens = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=_NAMES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(bodies, pa.int64()), batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens)],
                names=["host", "body", "page", "tokens"])

    return rows.mapInArrow(run, "host string, body long, page long, tokens array<struct<token: long, path: string, is_text: boolean, "
                                "left_out: boolean, main: boolean, times: int, place: int, chars: long>>")


_NAMES = ["token", "path", "is_text", "left_out", "main", "times", "place", "chars"]


def distinct_bodies(found: DataFrame) -> DataFrame:
    """Rows (host, page, and the fields of a token): the tokens of one page of each body of a host."""
    # Copies fall together before the shuffle, so a large group of them is no large task.
    one = found.groupBy("host", "body").agg(F.min(F.struct("page", "tokens")).alias("one"))
    return one.select("host", "one.page", F.explode("one.tokens").alias("t")).select("host", "page", "t.*")


def vectors(found: DataFrame) -> DataFrame:
    """Per host and token, its occurrence vector: the number of pages and a sum of hashes of (page, times)."""
    mark = F.xxhash64("page", "times").cast("decimal(20,0)")
    return found.groupBy("host", "token").agg(
        F.first("path").alias("path"), F.first("is_text").alias("is_text"), F.first("left_out").alias("left_out"),
        F.first("main").alias("main"), F.count("*").alias("n_pages"), F.sum(mark).alias("vector"),
        F.max("times").alias("most"), F.sum("place").alias("places"), F.sum("chars").alias("chars"))


def frequent_classes(found: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
                     min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Tokens of the frequent equivalence classes: at most about the tokens of a page or two per host."""
    seen = vectors(found)
    # Every page has a token; the most frequent one says how many pages the host has.
    hosts = seen.groupBy("host").agg(F.max("n_pages").alias("host_pages"))
    often = seen.join(hosts, "host").where((F.col("n_pages") >= min_pages) & (F.col("n_pages") >= min_share * F.col("host_pages")))
    sizes = often.groupBy("host", "n_pages", "vector").agg(F.count("*").alias("n_tokens"))
    return often.join(sizes.where(F.col("n_tokens") >= min_tokens), ["host", "n_pages", "vector"]).withColumn(
        "place", F.col("places") / F.col("n_pages"))


_TEMPLATE = "host string, class_id int, parent int, n_pages long, tokens array<long>, texts array<long>"


def nested_templates(classes: DataFrame) -> DataFrame:
    """The valid classes of each host, nested: rows (host, class_id, parent, n_pages, tokens, texts)."""
    def nest(rows: pd.DataFrame) -> pd.DataFrame:
        spans = []
        for (_, vector), group in rows.groupby(["n_pages", "vector"], sort=False):
            group = group.sort_values(["place", "token"])
            if group["place"].is_unique:  # an order that all pages keep on average
                spans.append((group["place"].iloc[0], group["place"].iloc[-1], group))
        spans.sort(key=lambda s: (s[0], -s[1]))
        out = []
        for k, (low, high, group) in enumerate(spans):
            around = [j for j in range(k) if spans[j][0] <= low and high <= spans[j][1]]
            parent = min(around, key=lambda j: spans[j][1] - spans[j][0]) if around else None
            crosses = any(spans[j][0] < low < spans[j][1] < high for j in range(k))
            if not crosses:
                out.append((group["host"].iloc[0], k, parent, int(group["n_pages"].iloc[0]), group["token"].tolist(),
                            group["token"][group["is_text"]].tolist()))
        return pd.DataFrame(out, columns=["host", "class_id", "parent", "n_pages", "tokens", "texts"]).astype({"parent": "Int32"})

    return classes.select("host", "n_pages", F.col("vector").cast("string").alias("vector"), "token", "place", "is_text").groupBy(
        "host").applyInPandas(nest, _TEMPLATE)


def main_slots(found: DataFrame, template: DataFrame) -> DataFrame:
    """Rows (host, has_main, main_path): the lowest container of the slots that vary, of those in article containers if there are any.

    ``template`` has (host, path, main, chars) of the template's texts.
    """
    names = ["host", "path", "main"]
    text = found.where("is_text AND NOT left_out").groupBy(*names).agg(F.sum("chars").alias("chars"))
    fixed = template.groupBy(*names).agg(F.sum("chars").alias("fixed"))
    varies = text.join(fixed, names, "left").where("chars > coalesce(fixed, 0)")
    # The lowest container of all is what the first and the last path in order have in common.
    ends = varies.groupBy("host", "main").agg(F.min(F.concat("path", F.lit("/"))).alias("low"), F.max(F.concat("path", F.lit("/"))).alias("high"))
    best = ends.groupBy("host").agg(F.max(F.struct("main", "low", "high")).alias("best")).select(
        "host", F.col("best.main").alias("has_main"), F.split("best.low", "/").alias("low"), F.split("best.high", "/").alias("high"))
    best = best.withColumn("n", F.expr("array_position(transform(low, (x, k) -> coalesce(x = get(high, k), false) AND k < size(low) - 1), false)"))
    return best.select("host", "has_main", F.expr("array_join(slice(low, 1, cast(n - 1 AS int)), '/')").alias("main_path"))


def deduce(pages: DataFrame, page_col: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """Rows (host, has_main, main_path, template_texts): what extraction needs of each host's template."""
    found = stored(distinct_bodies(occurrences(pages, page_col, url, source)), "occurrences")  # read several times
    classes = stored(frequent_classes(found), "classes")
    texts = nested_templates(classes).select("host", F.explode("texts").alias("token")).distinct()
    texts = stored(classes.where("is_text AND NOT left_out").join(texts, ["host", "token"]), "template-texts")
    listed = texts.groupBy("host").agg(F.collect_set("token").alias("template_texts"))
    return main_slots(found, texts).join(listed, "host", "full").select("host", "has_main", "main_path", "template_texts")


def main_text(source: str | None, has_main: bool | None, main_path: str | None, template_texts: frozenset) -> str:
    """Blocks of the main slot, joined by empty lines."""
    tokens = list(tokens_of(source))
    said = [t for t in tokens if t.key[0] == "#" and t.key != "#" and not t.left_out]
    article = any(t.main for t in said)
    inside = main_path or ""
    below = lambda t: not inside or t.path == inside or t.path.startswith(f"{inside}/")
    within = not article and not has_main and any(below(t) for t in said)
    slot = [t for t in said if (t.main if article else not within or below(t))]
    own = sum(len(t.key) - 1 for t in slot if t.number not in template_texts)
    if 2 * own < sum(len(t.key) - 1 for t in slot):
        template_texts = frozenset()  # a near copy: most of the text is that of other pages
    wanted = {id(t) for t in slot if t.number not in template_texts}
    blocks, part = [], []
    for t in tokens:
        if t.opens_block:
            blocks.append("".join(part))
            part = []
        elif t.key == "<br>" or (t.key == "#" and not t.left_out):
            part.append(" ")
        elif id(t) in wanted:
            part.append(t.text)
    blocks.append("".join(part))
    cleaned = (" ".join(b.split()) for b in blocks)
    return "\n\n".join(b for b in cleaned if b)


def extract(pages: DataFrame, page_col: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """All columns of ``pages`` with ``text``, the main text of each page."""
    known = stored(deduce(pages, page_col, url, source), "templates")
    rows, body = positional(pages), place(pages, source)
    names = rows.columns
    # One small row per host; Spark broadcasts them while the table's measured size allows.
    rows = rows.withColumn("page_host", host_of(F.col(place(pages, url)))).join(known, F.col("page_host") == F.col("host"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in (body, "has_main", "main_path", "template_texts"))
            texts = [main_text(s, m, p, frozenset(t or ())) for s, m, p, t in zip(*columns)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, "text"])

    schema = T.StructType([*positional(pages).schema.fields, T.StructField("text", T.StringType())])
    found = rows.select(*names, "has_main", "main_path", "template_texts").mapInArrow(run, schema)
    return found.select(*own_columns(pages, ("text",)), "text")
