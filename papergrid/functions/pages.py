"""Rule-driven clean-up of saved pages, their figures' files, and the Markdown form of a page."""

from __future__ import annotations

import mimetypes
import re
from dataclasses import dataclass
from pathlib import PurePosixPath
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papergrid.functions import html as H
from papergrid.functions import text as T
from papergrid.functions.markdown import type_of
from papergrid.functions.udf import vectorised


@dataclass(frozen=True)
class PageRule:
    """How the pages of one publisher are read: tags and classes that go, where the abstract stands, headings that end or are passed over."""

    drop_tags: tuple[str, ...] = ("script", "style", "noscript", "nav", "header", "footer")
    drop_classes: tuple[str, ...] = ("cookie", "advertisement")
    abstract_class: str = "abstract"
    preferred_abstract: str = "author"
    refused_abstract: str = "author-highlights"
    stop: tuple[str, ...] = ("references", "bibliography", "transparency document", "acknowledgments", "acknowledgements", "supplementary material")
    skip: tuple[str, ...] = ("highlights", "keywords", "abstract")
    paragraph_tags: tuple[str, ...] = ("p", "li", "div")


def _classes(node: H.Node) -> list[str]:
    return node.attrs.get("class", "").split()


def _abstract(root: H.Node, rule: PageRule) -> str:
    boxes = [n for n in root.find("div") if rule.abstract_class in _classes(n)]
    chosen = [n for n in boxes if rule.preferred_abstract in _classes(n)] or [
        n for n in boxes if rule.refused_abstract not in _classes(n) and "reference-abstract" not in n.attrs.get("id", "")
    ]
    return re.sub(r"(?i)^Abstract\s*", "", chosen[0].plain()) if chosen else ""


def _own_paragraphs(section: H.Node, rule: PageRule) -> list[str]:
    """Texts whose closest section this is; boxes around other blocks don't count, a text stands once."""
    out: dict[str, None] = {}
    stack = list(reversed(section.children))
    while stack:
        node = stack.pop()
        if node.tag == "section":
            continue
        stack.extend(reversed(node.children))
        if node.tag in rule.paragraph_tags and not (node.tag == "div" and node.find("div", "p", "li")[1:]):
            text = node.plain()
            if text and not text.startswith("Download:"):
                out[text] = None
    return list(out)


def ruled_sections(page: str, rule: PageRule = PageRule()) -> list[dict]:
    """Abstract and headed sections of a page, each title once, up to the first heading that ends the article."""
    root = H.read(page)
    for node in root.walk():
        node.children = [c for c in node.children if c.tag not in rule.drop_tags and not set(_classes(c)) & set(rule.drop_classes)]
    article = (root.find("article") or root.find("body") or [root])[0]
    abstract, out, seen = _abstract(article, rule), [], set()
    if abstract:
        out.append(H._section("Abstract", "abstract", [abstract]))
    for section in article.find("section"):
        head = next((c.plain() for c in section.children if c.tag in ("h2", "h3", "h4")), None)
        if head is None:
            continue
        if head.lower() in rule.stop:
            break
        if head and head.lower() not in rule.skip and head not in seen:
            seen.add(head)
            out.append(H._section(head, type_of(head.lower(), "numbered"), _own_paragraphs(section, rule)))
    return out


def sections_by_rule(rules: dict[str, PageRule], default: PageRule = PageRule()):
    """Column function (html, publisher) -> sections, by the publisher's rule."""

    @vectorised(f"array<struct<title:string,type:string,content:string,paragraphs:array<string>,subsections:array<{H._SUB}>>>")
    def run(pages: pd.Series, publishers: pd.Series) -> pd.Series:
        return pd.Series([ruled_sections(p, rules.get(k, default)) if p else [] for p, k in zip(pages, publishers)], dtype=object)

    return run


def page_markdown(sections: Column) -> Column:
    """Sections of a page (of article_of) as Markdown: '## title', paragraphs, '### subsection'; skipped back matter left out."""
    kept = F.filter(sections, lambda s: ~F.lower(s["title"]).isin(*T.SKIPPED_TITLES["html"]))
    block = lambda mark, s: F.concat_ws("\n\n", F.concat(F.lit(mark), s["title"]), F.array_join(s["paragraphs"], "\n\n"))
    inner = lambda s: F.array_join(F.transform(s["subsections"], lambda u: block("### ", u)), "\n\n")
    return F.array_join(F.transform(kept, lambda s: F.concat_ws("\n\n", block("## ", s), F.nullif(inner(s), F.lit("")))), "\n\n")


def image_addresses(page: Column) -> Column:
    """Map from file name to the first address, of a page's figure images on the article service's content network."""
    urls = F.regexp_extract_all(page, F.lit(r"(https://cdn\.ncbi\.nlm\.nih\.gov/pmc/blobs/[^\s\"']+\.jpg)"), 1)
    names = F.transform(urls, lambda u: F.element_at(F.split(u, "/"), -1))
    pairs = F.transform(F.arrays_zip(names.alias("n"), urls.alias("u")), lambda p, i: F.struct(p["n"].alias("n"), p["u"].alias("u"), i.alias("i")))
    first = F.filter(pairs, lambda p: F.array_position(names, p["n"]) == p["i"] + 1)
    return F.map_from_entries(F.transform(first, lambda p: F.struct(p["n"].alias("key"), p["u"].alias("value"))))


@vectorised("array<struct<ordinal:int,title:string,legend:string,src:string>>")
def page_figures(pages: pd.Series) -> pd.Series:
    """Figures whose id begins with 'fig' and which have an image: label as title, caption without it as legend."""
    out = []
    for page in pages:
        rows = []
        for i, box in enumerate(H.read(page or "").find("figure"), 1):
            image = next((n.attrs["src"].strip() for n in box.find("img") if n.attrs.get("src")), "")
            if not image or not box.attrs.get("id", "").lower().startswith("fig"):
                continue
            caption = next((n for n in box.walk() if "captions" in _classes(n)), None) or next(iter(box.find("figcaption")), None)
            label = next((n.plain() for n in caption.walk() if "label" in _classes(n)), "") if caption else ""
            whole = caption.plain() if caption else ""
            title = re.sub(r"(?i)^fig\.?\s*", "Figure ", label).strip() or f"Figure {i}"
            legend = re.sub(rf"(?i)^{re.escape(label)}\s*\.?\s*", "", whole) if label else whole
            rows.append({"ordinal": i, "title": title, "legend": legend, "src": image})
        out.append(rows)
    return pd.Series(out, dtype=object)


@vectorised("string")
def figure_file(titles: pd.Series, sources: pd.Series, types: pd.Series) -> pd.Series:
    """'Figure_N' with the source's ending, else that of the media type."""
    names = []
    for title, source, kind in zip(titles, sources, types):
        number = re.search(r"\d+[A-Za-z]?", title or "")
        stem = f"Figure_{number[0]}" if number else re.sub(r"[^A-Za-z0-9]+", "_", title or "").strip("_")
        names.append(stem + (PurePosixPath(urlparse(source or "").path).suffix.lower() or mimetypes.guess_extension(kind or "") or ".bin"))
    return pd.Series(names, dtype=object)


def figure_parts(pages: DataFrame, parts: DataFrame) -> DataFrame:
    """(path, ordinal, title, legend, src, content_type, file): figures of saved pages with the stored part of their image; each title once."""
    figures = pages.select("path", F.explode(page_figures("text")).alias("f")).select("path", "f.*")
    first = figures.groupBy("path", "title").agg(F.min_by(F.struct("ordinal", "legend", "src"), "ordinal").alias("v")).select("path", "title", "v.*")
    images = parts.select("path", F.col("location").alias("src"), "content_type").where("content_type LIKE 'image/%'").dropDuplicates(["path", "src"])
    return first.join(images, ["path", "src"]).withColumn("file", figure_file("title", "src", "content_type"))


def figure_like(title: Column, kind: Column, content: Column) -> Column:
    """A figure by its type, its title or its content."""
    return F.coalesce((kind == "figure") | title.rlike(r"(?i)\Afigure\s+\d+") | content.rlike(r"(?i)\[Image URL:"), F.lit(False))


def collected_figures(articles: DataFrame, keep: str) -> DataFrame:
    """(keep, place, title, image_url, legend): figures among sections and subsections, each title, legend beginning and image once."""
    s = articles.select(keep, F.posexplode("sections").alias("sp", "s"))
    own = F.struct(F.lit(-1).alias("up"), F.col("s.title").alias("title"), F.col("s.type").alias("type"), F.col("s.content").alias("content"))
    subs = F.transform(F.coalesce("s.subsections", F.array()), lambda u, i: F.struct(i.alias("up"), u["title"].alias("title"), F.lit(None).cast("string").alias("type"), u["content"].alias("content")))
    items = s.select(keep, "sp", F.explode(F.concat(F.array(own), subs)).alias("x")).select(keep, F.struct("sp", "x.up").alias("at"), "x.title", "x.type", "x.content")
    figures = items.where(figure_like(F.col("title"), F.col("type"), F.col("content"))).withColumn("p", H.figure_parts(F.col("content")))
    key = F.concat_ws("|", "title", F.substring("p.legend", 1, 100), "p.image_url")
    first = figures.groupBy(keep, key.alias("_k")).agg(F.min_by(F.struct("at", "title", "p"), "at").alias("v"))
    from pyspark.sql import Window

    out = first.select(keep, "v.at", "v.title", "v.p.image_url", "v.p.legend")
    return out.withColumn("place", F.row_number().over(Window.partitionBy(keep).orderBy("at"))).drop("at")


def standard_article(sections: Column) -> Column:
    """Sections of older sets in today's form: titles filled in, types by number or name where unknown, paragraphs from the content."""
    kind = lambda s: F.when(F.coalesce(s["type"], F.lit("")) != "", s["type"]).otherwise(T.section_type(s["title"], "numbered"))
    named = lambda x: F.when(F.coalesce(x, F.lit("")) == "", "Untitled").otherwise(x)
    text = lambda x: T.strip(F.coalesce(x, F.lit("")))
    paras = lambda x: T.paragraphs(x, r"\n\s*\n")
    inner = lambda u: F.struct(named(u["title"]).alias("title"), text(u["content"]).alias("content"), paras(u["content"]).alias("paragraphs"))
    return F.transform(
        F.coalesce(sections, F.array()),
        lambda s: F.struct(named(s["title"]).alias("title"), kind(s).alias("type"), text(s["content"]).alias("content"), paras(s["content"]).alias("paragraphs"),
                           F.transform(F.coalesce(s["subsections"], F.array()), inner).alias("subsections")),
    )
