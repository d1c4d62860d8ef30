"""Conversion to structured text: HTML pages, extracted PDF text, block documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import clean_pdf_text, html_title, once, postprocess_lines, strip

#: Tags and classes without content, inline and block tags, and where a page's content is, best first.
SKIP_TAGS = {"script", "style", "noscript", "nav", "footer", "aside", "iframe", "object", "embed", "canvas", "svg"}
SKIP_CLASSES = {"has-results", "no-results", "search-results"}
INLINE = {"a", "strong", "b", "em", "i", "code", "span", "abbr", "sub", "sup", "small", "mark"}
BLOCK = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "form", "table", "tr", "ul", "ol", "dl", "blockquote", "figure", "figcaption", "details", "summary", "hr", "br"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HEADINGS = {f"h{n}": "#" * n + " " for n in range(1, 7)}
#: So many tokens of pages, or characters of texts, go back to Spark together.
TOKENS, CHARS = 8192, 1 << 20
DIV_CLASSES = ("body-inner", "page-inner", "theme-default-content")
ROLE = "main"
DIV_PARTS, DIV_NAMES = ("content", "post", "article"), ("content", "main", "article")
SECTION_PART, LAST_PARTS = "content", ("markdown", "document")


class Node:
    __slots__ = ("attrs", "kids", "tag", "up")

    def __init__(self, tag: str, attrs: dict | None = None, up: Node | None = None):
        self.tag, self.attrs, self.up, self.kids = tag, attrs or {}, up, []


class _Tree(HTMLParser):
    """A forgiving tree: a new paragraph or list item ends the open one, with the inline tags inside it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html")

    def _close(self, tags: set[str], stop: set[str]) -> None:
        n = self.at
        while n.up is not None and n.tag not in stop:
            if n.tag in tags:
                self.at = n.up
                return
            n = n.up

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK - {"br"} or tag in HEADINGS or tag in ("li", "pre"):
            self._close({"p"}, BLOCK - {"p", "br"} | {"li"})
        if tag == "li":
            self._close({"li"}, {"ul", "ol"})
        if tag in ("td", "th", "tr"):
            self._close({"td", "th"} if tag != "tr" else {"tr"}, {"table"})
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(n)
        if tag not in VOID:
            self.at = n

    def handle_endtag(self, tag):
        n = self.at
        while n.up is not None:
            if n.tag == tag:
                self.at = n.up
                return
            n = n.up

    def handle_data(self, data):
        if self.at.tag not in ("script", "style"):
            self.at.kids.append(data)


def _kind(n: Node) -> str:
    """What a node gives to the text: nothing with all below it (none), or with what is below it unless that is looked at (other)."""
    if n.tag in SKIP_TAGS or n.tag in INLINE or n.attrs.get("class", "").lower() in SKIP_CLASSES:
        return "none"
    return n.tag if n.tag in ("table", "pre", "li") else "head" if n.tag in HEADINGS else "block" if n.tag in BLOCK else "other"


def page_tokens(html: str | None) -> list[dict]:
    """A page's elements and text pieces in order, with unclosed tags repaired.

    Each is numbered and names its parent, the last token below it, the nearest ancestor that is no inline tag (owner),
    and the nearest token, itself or above, that hides it from a text in which it stands (cover).
    """
    tree = _Tree()
    tree.feed(re.sub(r"<!--.*?-->", "", html or "", flags=re.S))
    out: list[dict] = []
    todo: list[tuple] = [(tree.root, None, 0, -1)]
    while todo:
        n, up, owner, cover = todo.pop()
        if isinstance(n, int):  # the end of that token
            out[n]["last"] = len(out) - 1
            continue
        i, is_text = len(out), isinstance(n, str)
        row = dict.fromkeys(("tag", "kind", "cls", "name", "role", "alt", "text", "up_tag"))
        out.append(row | {"id": i, "up": -1 if up is None else up[0], "last": i, "owner": owner, "cover": cover})
        if is_text:
            out[i]["text"] = n
            continue
        kind = _kind(n)
        own = i if kind in ("none", "other") else cover
        out[i] |= {"tag": n.tag, "kind": kind, "cls": n.attrs.get("class", ""), "name": n.attrs.get("id"), "role": n.attrs.get("role"), "alt": n.attrs.get("alt"), "up_tag": up and up[1], "cover": own}
        todo.append((i, None, 0, 0))
        below = (i, n.tag), owner if n.tag in INLINE else i, i if kind in ("table", "pre") else own
        todo.extend((k, *below) for k in reversed(n.kids))
    return out


_TOKEN = "id int, up int, last int, owner int, cover int, tag string, kind string, cls string, name string, role string, alt string, text string, up_tag string"


def _tokens(pages: DataFrame) -> DataFrame:
    """(page, tokens) of pages (page, html): a page's tokens in a row, each at the place of its number."""

    fields = [c.split(" ") for c in _TOKEN.split(", ")]
    most = TOKENS
    kind = pa.list_(pa.struct([(n, pa.int32() if t == "int" else pa.string()) for n, t in fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, n = [], 0
            pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (b.schema.field("page").type, kind), strict=True)], names=["page", "tokens"])  # noqa: B023, E731
            for page, html in zip(b["page"], b["html"], strict=True):
                tokens = page_tokens(html.as_py())
                out.append((page.as_py(), tokens))
                n += len(tokens)
                if n >= most:
                    yield pack(out)
                    out, n = [], 0
            if out:
                yield pack(out)

    return pages.select("page", "html").mapInArrow(run, "page bigint, tokens array<struct<" + ",".join(f"`{n}`:{t}" for n, t in fields) + ">>")


def _of(x: F.Column) -> F.Column:
    """x and the tokens below it, each looked up by its number: slice would go through all of the page for each x."""
    return F.transform(F.sequence(x["id"], x["last"]), lambda i: F.get("tokens", i))


def _text_of(x: F.Column) -> F.Column:
    return strip(F.array_join(F.transform(_of(x), lambda y: y["text"]), ""))


def content_root() -> F.Column:
    """The first element of the best test that has one with more than 30 characters, else the body, else all."""
    has = lambda c, *parts: F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(c, p))
    tests = [
        lambda x: x["tag"] == "article", lambda x: x["tag"] == "main", *[lambda x, c=c: (x["tag"] == "div") & has(x["cls"], c) for c in DIV_CLASSES], lambda x: x["role"] == ROLE,
        lambda x: (x["tag"] == "div") & has(x["cls"], *DIV_PARTS), lambda x: (x["tag"] == "div") & x["name"].isin(*DIV_NAMES), lambda x: (x["tag"] == "section") & has(x["cls"], SECTION_PART), lambda x: (x["tag"] == "div") & has(x["cls"], *LAST_PARTS),
    ]
    first = lambda test: F.get(F.filter("tokens", lambda x: ~x["tag"].isin(*SKIP_TAGS) & test(x)), F.lit(0))
    fit = F.filter(F.array_compact(F.array(*[first(t) for t in tests])), lambda x: F.length(_text_of(x)) > 30)
    return F.coalesce(F.get(fit, F.lit(0)), first(lambda x: x["tag"] == "body"), F.get("tokens", F.lit(0)))


def _table_rows(x: F.Column) -> F.Column:
    """The rows of cells of a table in order, those without cells left out."""
    cells = lambda r: F.transform(F.filter(_of(r), lambda c: c["tag"].isin("th", "td")), _text_of)
    return F.filter(F.transform(F.filter(_of(x), lambda r: r["tag"] == "tr"), cells), lambda r: F.size(r) > 0)


def _content(tokens: DataFrame) -> DataFrame:
    """(page, x): a page's tokens from its root on that go to its text, in a row: elements, of which some are seen, and pieces of text."""

    def slim(x: F.Column, root: F.Column) -> F.Column:
        seen = (x["kind"] != "none") & ((x["id"] == root["id"]) | (x["cover"] <= root["id"]) & ~root["kind"].isin("none", "table", "pre"))
        up = F.get("tokens", x["up"])
        broken = (x["tag"] == "br") & (x["up"] >= root["id"]) & up["tag"].isin(*INLINE)  # may count or not, by what else that tag holds
        piece = F.when(x["tag"].isNull(), x["text"]).when((x["tag"] == "img") & (F.coalesce(x["alt"], F.lit("")) != ""), F.concat(F.lit("[图: "), x["alt"], F.lit("]"))).when(x["tag"] == "br", "\n")
        return F.struct(
            x["id"].alias("id"), x["up"].alias("up"), x["last"].alias("last"), x["owner"].alias("owner"), x["tag"].alias("tag"), x["kind"].alias("kind"), (x["up_tag"] == "ol").alias("in_ol"), F.coalesce(seen, F.lit(False)).alias("seen"), piece.alias("piece"),
            F.when(broken, x["up"]).alias("lo"), F.when(broken, up["last"]).alias("hi"), F.when(seen & (x["kind"] == "table"), _table_rows(x)).alias("rows"), F.when(seen & (x["kind"] == "pre"), _text_of(x)).alias("code"),
        )

    within = lambda root: F.transform(F.slice("tokens", root["id"] + 1, root["last"] - root["id"] + 1), lambda x: slim(x, root))
    return tokens.select("page", once(content_root(), within).alias("x"))


def page_lines(tokens: DataFrame) -> DataFrame:
    """(page, text) of tokens: the lines of what is shown below each page's root, in order.

    An element's own text is that of the pieces it owns; headings, list items, code and tables get their marks. What
    follows a line that isn't blank is set apart by one, unless it is the first below an element with text of its own.
    A page moves once, as a row with what its text needs; all that follows is grouped where the page is.
    """
    t = _content(tokens).repartition("page").select("page", F.inline("x"))
    t = t.withColumn("piece", F.when(F.col("tag").isNull(), strip(F.col("piece"))).otherwise(F.col("piece")))
    element, piece = F.when(F.col("tag").isNotNull(), F.col("id")), F.when(F.col("piece") != "", F.col("owner"))
    t = t.withColumn("of", F.explode(F.array_distinct(F.array_compact(F.array(element, piece)))))  # itself, the element that a piece belongs to
    itself = F.col("of") == F.col("id")
    g = t.groupBy("page", "of").agg(
        F.first(F.when(itself, F.struct("last", "up", "tag", "kind", "in_ol", "seen", "rows", "code")), ignorenulls=True).alias("e"),
        F.sort_array(F.collect_list(F.when(~itself, F.struct(F.col("id").alias("at"), "piece", "lo", "hi")))).alias("all"),
    )
    some = lambda ok: F.exists("all", lambda y: (y["piece"] != "\n") & ok(y["at"]))
    # a line break in an inline tag counts between what else that tag holds, not at its edge
    kept = F.filter("all", lambda x: x["lo"].isNull() | some(lambda at: (at > x["lo"]) & (at < x["at"])) & some(lambda at: (at > x["at"]) & (at <= x["hi"])))
    own = F.array_join(F.transform(kept, lambda x: x["piece"]), " ").alias("own")
    g = g.where("e is not null").select("page", F.col("of").alias("id"), "e.*", own)
    item = Window.partitionBy("page", "up").orderBy("id")
    g = g.withColumn("item", F.sum(F.when((F.col("tag") == "li") & F.col("in_ol"), 1)).over(item)).where("seen")
    g = g.withColumn("own", strip(F.replace("own", F.lit(" \n "), F.lit("\n"))))
    text, code = F.coalesce("own", F.lit("")), F.col("code")
    marks = F.concat(F.repeat(F.lit("#"), F.substring("tag", 2, 1).cast("int")), F.lit(" "), text)
    cells = lambda r, width: F.concat(F.lit("| "), F.array_join(F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width), " | "), F.lit(" |"))
    width = F.size(F.get("rows", F.lit(0)))
    table = F.concat(F.array(F.lit(""), cells(F.get("rows", F.lit(0)), width), cells(F.array_repeat(F.lit("---"), width), width)), F.transform(F.slice("rows", F.lit(2), F.size("rows")), lambda r: cells(r, width)), F.array(F.lit("")))
    number = F.when(F.col("in_ol"), F.concat(F.col("item").cast("string"), F.lit(". ")))
    lines = (
        F.when(F.col("kind") == "table", F.when(F.size("rows") > 1, table))
        .when(F.col("kind") == "pre", F.when(code != "", F.array(F.lit(""), F.lit("```"), code, F.lit("```"), F.lit(""))))
        .when(text == "", None).when(F.col("kind") == "head", F.array(F.lit(""), marks, F.lit("")))
        .when(F.col("kind") == "li", F.array(F.concat(F.coalesce(number, F.lit("- ")), text))).otherwise(F.array(text))
    )
    g = g.select("page", "id", "last", lines.alias("lines")).where("lines is not null")
    before = Window.partitionBy("page").orderBy("id")
    apart = (F.lag("last").over(before) < F.col("id")) & (F.lag(F.element_at("lines", -1)).over(before) != "")
    g = g.select("page", "id", F.when(F.coalesce(apart, F.lit(False)), F.concat(F.array(F.lit("")), "lines")).otherwise(F.col("lines")).alias("lines"))
    return g.groupBy("page").agg(F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("id", "lines"))), lambda x: x["lines"])), "\n").alias("text"))


def html_to_text(pages: DataFrame) -> DataFrame:
    """TX1: (page_id, url, title, text). Python repairs the tags of a page and numbers its tokens, nothing else.

    Which part is the content, tables, lists, code and lines are found by expressions over a page's tokens, grouping and
    windows. Rows are told apart by page_id and url; null html has an empty text.
    """
    page = F.xxhash64("page_id", "url", "html")
    tokens = _tokens(pages.select(page.alias("page"), "html").dropDuplicates(["page"]))
    own = pages.select(page.alias("page"), "page_id", "url", html_title(F.col("html"), F.col("url")).alias("title")).join(page_lines(tokens).hint("merge"), "page", "left")
    return own.select("page_id", "url", "title", postprocess_lines(F.coalesce("text", F.lit(""))).alias("text"))


def structure_pdf_lines(text: str | None) -> str | None:
    """TX5: line repair, numbered headings, digit runs and fences for the lines of extracted PDF text."""
    if text is None:
        return None
    glued: list[str] = []
    open_line = False  # may the last line still take a number?
    for line in text.split("\n"):
        if open_line and re.fullmatch(r"\d{1,4}", line.strip()):
            glued[-1] = glued[-1].rstrip() + line.strip()
            open_line = False
            continue
        glued.append(line)
        open_line = bool(line.strip())
    out = []
    for line in glued:
        s = line.strip()
        if re.fullmatch(r"\d{1,6}|[a-z]{10,}", s):
            continue
        m = re.match(r"(\d{1,2}(?:\.\d{1,2})+)(?:\s|(?=[一-鿿]))", s) or re.match(r"(\d{1,2})(?:\.(?=[\s一-鿿])|\s+(?=[一-鿿]))", s)
        out.append("#" * min(m[1].count(".") + 2, 4) + " " + s if m and len(s) > 5 else line)
    return "\n".join(_fence(_blank_digit_runs(out)))


def _blank_digit_runs(lines: list[str]) -> list[str]:
    out, run = list(lines), []
    for i, line in enumerate([*lines, "x"]):
        if line.strip().isdigit():
            run.append(i)
            continue
        if len(run) >= 3:
            for k in run:
                out[k] = ""
        run = []
    return out


def _fence(lines: list[str]) -> list[str]:
    out, inside = [], False
    for i, line in enumerate(lines):
        s = line.strip()
        if not inside and s.startswith(("{", '["')):
            ahead = 0
            for x in lines[i + 1 : i + 5]:
                if x.strip() and not x.strip().startswith(('"', ",", "}", "]")):
                    break
                ahead += 1
            if ahead >= 2:
                inside = True
                out.append("```")
        out.append(line)
        following = lines[i + 1].strip() if i + 1 < len(lines) else ""
        if inside and s.startswith(("}", "]")) and not following.startswith(('"', ",")):
            out.append("```")
            inside = False
    return out + ["```"] * inside


def structure_pdf_text(df: DataFrame) -> DataFrame:
    """TX4 and TX5: (doc_id, text)."""

    most = CHARS
    rows = df.select("doc_id", clean_pdf_text(F.col("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out, chars = 0, [], 0
            for i, text in enumerate(b["text"], 1):
                text = text.as_py()
                out.append(structure_pdf_lines(text))
                chars += len(text or "")
                if chars >= most or i == len(b):
                    yield pa.RecordBatch.from_arrays([b["doc_id"].slice(at, i - at), pa.array(out, pa.string())], names=["doc_id", "text"])
                    at, out, chars = i, [], 0

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")


def blocks_to_markdown(blocks: DataFrame) -> DataFrame:
    """TX6: (doc_token, title, text) from rows (doc_token, title, pos, block_type, elements)."""
    text = F.array_join(F.transform("elements", lambda e: F.coalesce(e["text_run"]["content"], F.lit(""))), "")
    kind = F.col("block_type")
    mark = F.when(kind.between(3, 11), F.concat(F.repeat(F.lit("#"), F.least(kind - 2, F.lit(9))), F.lit(" "), text)).when(kind == 12, F.concat(F.lit("- "), text)).when(kind == 13, F.concat(F.lit("1. "), text)).when(kind == 14, F.concat(F.lit("```\n"), text, F.lit("\n```"))).otherwise(text)
    lines = blocks.where("block_type <> 1").withColumn("line", F.when(F.trim(text) != "", mark)).where("line is not null")
    joined = lines.groupBy("doc_token").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n\n").alias("text"))
    return blocks.select("doc_token", "title").dropDuplicates(["doc_token"]).join(joined, "doc_token", "left").select("doc_token", "title", F.coalesce("text", F.lit("")).alias("text"))


def block_links(blocks: DataFrame) -> DataFrame:
    """(doc_token, child, pos): linked and mentioned documents of each document, by first mention, itself left out."""
    e = blocks.select("doc_token", "pos", F.posexplode("elements").alias("k", "e"))
    url = F.try_url_decode(F.col("e.text_run.text_element_style.link.url"))
    child = F.coalesce(F.nullif(F.regexp_extract(url, "/wiki/([^/?#]+)", 1), F.lit("")), F.nullif(F.col("e.mention_doc.token"), F.lit("")))
    c = e.select("doc_token", child.alias("child"), F.struct("pos", "k").alias("at")).where("child is not null and child <> doc_token")
    first = c.groupBy("doc_token", "child").agg(F.min("at").alias("at"))
    return first.select("doc_token", "child", (F.row_number().over(Window.partitionBy("doc_token").orderBy("at")) - 1).alias("pos"))


def merge_children(docs: DataFrame, links: DataFrame) -> DataFrame:
    """TX7: each document's text with those of its linked documents, one level deep; missing ones are skipped."""
    kids = links.join(docs.select(F.col("doc_token").alias("child"), F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.col("text")).alias("part"), "text").where("text <> ''").drop("text"), "child")
    added = kids.groupBy("doc_token").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "\n\n").alias("more"))
    return docs.join(added, "doc_token", "left").select("doc_token", "title", F.concat_ws("\n\n", "text", "more").alias("text"))
