"""Service graphs and link graphs: neighbours, chains, crawls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import extract_links, normalize_url
from ..sources.staging import stage_table

#: Endings of links that lead to no document.
SKIP_ENDINGS = [".pdf", ".zip", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".css", ".js", ".json", ".xml", ".mp4", ".mp3", ".woff", ".woff2", ".ttf"]


def neighbours(edges: DataFrame, node: str | int, direction: str = "down") -> DataFrame:
    """JN14: (node) one edge downstream or upstream; repeated edges stay."""
    a, b = ("src", "dst") if direction == "down" else ("dst", "src")
    return edges.where(F.col(a) == node).select(F.col(b).alias("node"))


def graph_nodes(services: DataFrame, edges: DataFrame) -> DataFrame:
    """ST4: (name, description): declared services, whose description wins, and nodes that only edges name."""
    ends = edges.select(F.col("src").alias("name")).unionByName(edges.select(F.col("dst").alias("name")))
    rows = services.select("name", "description", F.lit(0).alias("o")).unionByName(ends.select("name", F.lit("").alias("description"), F.lit(1).alias("o")))
    return rows.groupBy("name").agg(F.min_by("description", "o").alias("description"))


def graph_overview(services: DataFrame, edges: DataFrame) -> DataFrame:
    """AG14: (services, edges): how many of each, edge-only nodes included."""
    return graph_nodes(services, edges).agg(F.count(F.lit(1)).alias("services")).join(edges.agg(F.count(F.lit(1)).alias("edges")), F.lit(True), "left")


def trace(edges: DataFrame, starts: DataFrame, direction: str = "down", max_depth: int = 6, mark: str = "(环)", services: DataFrame | None = None) -> DataFrame:
    """GR1: (start, path, depth, is_cycle): all paths from each start to a leaf, to max_depth or to a repeated node.

    Repeated edges give repeated paths. A start without edges in that direction is a path of itself, of depth 0, if it is
    known: as another edge's end or, where given, among services (name); unknown ones give nothing. The frontier is
    joined with the edges on its last node, once for each level, and written once; finished paths leave it. Of the edges
    only those that begin where it has come to are joined, few where many paths meet. Edges are written first, unless
    they come from stage_table. The mark is appended to the repeated node's name.
    """
    a, b = ("src", "dst") if direction == "down" else ("dst", "src")
    edges = edges if hasattr(edges, "staged_at") else stage_table(edges.select("src", "dst"), "edges")
    e = edges.select(F.col(a).cast("string").alias("at"), F.col(b).cast("string").alias("to"))
    known = e.select("at").distinct().unionByName(e.select(F.col("to").alias("at")).distinct())
    known = known if services is None else known.unionByName(services.select(F.col("name").cast("string").alias("at")))
    front = starts.select(F.col("start").cast("string").alias("at")).distinct().join(known.distinct(), "at", "left_semi")
    front = front.select(F.col("at").alias("start"), F.array("at").alias("path"), "at")
    done = None
    for depth in range(max_depth + 1):
        near = e.join(front.select("at").distinct(), "at", "left_semi") if depth else e
        step = stage_table(front.join(near, "at", "left").select("start", "path", "to"), "step") if depth < max_depth else front.withColumn("to", F.lit(None).cast("string"))
        over = step.where("to is null").select("start", "path", F.lit(depth).alias("depth"), F.lit(False).alias("is_cycle"))
        loop = step.where(F.array_contains("path", F.col("to"))).select("start", F.concat("path", F.array(F.concat("to", F.lit(mark)))).alias("path"), F.lit(depth + 1).alias("depth"), F.lit(True).alias("is_cycle"))
        done = over.unionByName(loop) if done is None else done.unionByName(over).unionByName(loop)
        if depth == max_depth:
            break
        front = step.where(F.col("to").isNotNull() & ~F.array_contains("path", F.col("to"))).select("start", F.concat("path", F.array("to")).alias("path"), F.col("to").alias("at"))
    return done


def resolve_links(pages: DataFrame) -> DataFrame:
    """(url, pos, target): links of pages to other documents, absolute and normalised, in page order."""
    x = pages.select(normalize_url(F.col("url")).alias("url"), F.col("url").alias("base"), F.posexplode(extract_links(F.col("html"))).alias("pos", "href"))
    x = x.where(~F.col("href").rlike("(?i)^(?:mailto:|javascript:|tel:|#)"))
    site = F.regexp_extract("url", "^https?://[^/]*", 0)
    folder = F.regexp_replace(F.regexp_replace("base", r"[?#].*$", ""), "(?<=[^/:]/)[^/]*$", "")
    target = F.when(F.col("href").rlike("^https?://"), F.col("href")).when(F.startswith("href", F.lit("//")), F.concat(F.lit("https:"), "href")).when(F.startswith("href", F.lit("/")), F.concat(site, "href")).when(F.col("href").rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), None).otherwise(F.concat(F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/"))), "href"))
    x = x.select("url", "pos", normalize_url(target).alias("target")).where("target is not null")
    path = F.lower(F.regexp_replace("target", r"[?].*$", ""))
    return x.where(~F.exists(F.array(*[F.lit(s) for s in SKIP_ENDINGS]), lambda s: F.endswith(path, s)))


def crawl(pages: DataFrame, seeds: DataFrame, max_depth: int = 2, max_pages: int = 50, links: DataFrame | None = None) -> DataFrame:
    """GR2: (seed, url, depth, ordinal): pages that a breadth-first crawl of the table keeps.

    pages (url, html, text); seeds (seed); links (url, pos, target), if given, are followed beside those in the html.
    Links lead within the seed's host and the folder of its path. Pages are visited once, in the order of their first
    link; the cap counts pages with text. A level is one join. A page's place is the list of links that lead to it,
    which sorts like the visits, so nothing is numbered along the way.
    """
    p = pages.select(normalize_url(F.col("url")).alias("url"), "html", (F.coalesce("text", F.lit("")) != "").alias("has_text")).dropDuplicates(["url"])
    found = resolve_links(pages.select("url", "html")).select("url", F.col("pos").cast("long").alias("pos"), "target")
    if links is not None:
        found = found.unionByName(links.select(normalize_url(F.col("url")).alias("url"), F.col("pos").cast("long").alias("pos"), normalize_url(F.col("target")).alias("target")))
    found = stage_table(found, "links")
    have = stage_table(p.select("url", "has_text"), "pages")
    s = seeds.select("seed").distinct().withColumn("url", normalize_url(F.col("seed")))
    full = F.regexp_replace(F.when(F.col("seed").rlike("^https?://"), F.col("seed")).otherwise(F.concat(F.lit("https://"), "seed")), r"[?#].*$", "")
    prefix = F.when(full.rlike("^https?://[^/]+/"), F.regexp_replace(full, "[^/]*$", "")).otherwise(F.concat(full, F.lit("/")))
    place = lambda pos: F.array(F.struct(pos.alias("pos"), F.col("url").alias("url")))
    front = stage_table(s.withColumn("prefix", prefix).select("seed", "prefix", "url", F.lit(0).alias("depth"), place(F.lit(0).cast("long")).alias("at")), "front")
    seen = front
    for depth in range(1, max_depth + 1):
        # a page is reached in the order of its parent, then of the link in it
        step = front.join(found, "url").select("seed", "prefix", F.col("target").alias("url"), F.struct("at", "pos").alias("via"))
        step = step.where(F.startswith("url", F.col("prefix")) | (F.concat("url", F.lit("/")) == F.col("prefix"))).groupBy("seed", "prefix", "url").agg(F.min("via").alias("via"))
        step = step.join(have.select("url"), "url", "left_semi").join(seen.select("seed", "url"), ["seed", "url"], "left_anti")
        front = stage_table(step.select("seed", "prefix", "url", F.lit(depth).alias("depth"), F.concat("via.at", place(F.col("via.pos"))).alias("at")), "front")
        seen = seen.unionByName(front)
    # Spark cuts to max_pages before the shuffle as well
    kept = seen.join(have.where("has_text"), "url").select("seed", "url", "depth", F.row_number().over(Window.partitionBy("seed").orderBy("depth", "at")).alias("ordinal"))
    return kept.where(F.col("ordinal") <= max_pages)


def crawl_documents(pages: DataFrame, kept: DataFrame) -> DataFrame:
    """(seed, title, text, n_pages): the pages of each crawl as one document."""
    p = pages.select(normalize_url(F.col("url")).alias("url"), "title", "text").dropDuplicates(["url"])
    row = F.struct("ordinal", F.coalesce("title", F.lit("")).alias("title"), F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n"), "text").alias("part"))
    g = kept.join(p, "url").groupBy("seed").agg(F.array_sort(F.collect_list(row)).alias("r"))  # max_pages at most
    return g.select("seed", F.get("r", F.lit(0))["title"].alias("title"), F.array_join(F.transform("r", lambda x: x["part"]), "\n\n").alias("text"), F.size("r").alias("n_pages"))
