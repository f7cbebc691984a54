"""Service payloads and full texts in XML or JSON into structs and Markdown.

Flat fields use the engine's xpath and from_json; nested full texts are walked by the standard library's
parser, one batch of rows at a time. Unreadable payloads give null.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from papergrid.functions.udf import vectorised
from papergrid.functions.references import article_type, is_review_type
from papergrid.functions.text import SKIPPED_TITLES, either


def pubmed_record(xml: Column) -> Column:
    """STRUCT of a PubMed record: ids, title, abstract (parts joined by blank lines), authors 'Last Fore', journal, year, types, terms."""
    one = lambda path: F.coalesce(F.xpath_string(xml, F.lit(path)), F.lit(""))
    many = lambda path: F.xpath(xml, F.lit(path + "/text()"))
    last, fore = many("//AuthorList/Author/LastName"), many("//AuthorList/Author/ForeName")
    authors = F.transform(F.arrays_zip(last.alias("l"), fore.alias("f")), lambda a: F.trim(F.concat_ws(" ", a["l"], a["f"])))
    types = many("//PublicationType")
    return F.struct(
        one("//MedlineCitation/PMID").alias("pmid"), one("//ArticleId[@IdType='doi']").alias("doi"), one("//ArticleTitle").alias("title"),
        F.array_join(many("//AbstractText"), "\n\n").alias("abstract"), authors.alias("authors"), one("//Journal/Title").alias("journal"),
        either(one("//PubDate/Year"), F.regexp_extract(one("//PubDate/MedlineDate"), r"(\d{4})", 1), one("//ArticleDate/Year")).alias("year"),
        types.alias("publication_types"), many("//MeshHeading/DescriptorName").alias("mesh_terms"), many("//Keyword").alias("keywords"),
        is_review_type(types).alias("is_review"), article_type(types).alias("article_type"),
    )


def crossref_meta(body: Column) -> Column:
    """STRUCT of a Crossref answer, in the shape of a pubmed entry."""
    parsed = F.from_json(
        body, "message struct<DOI:string,title:array<string>,abstract:string,publisher:string,`container-title`:array<string>,"
        "author:array<struct<given:string,family:string>>,issued:struct<`date-parts`:array<array<int>>>>",
    )["message"]
    first = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(""))
    year = F.try_element_at(F.try_element_at(parsed["issued"]["date-parts"], F.lit(1)), F.lit(1)).cast("string")
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(parsed["abstract"], F.lit("")), r"<[^>]+>", " "), r"\s+", " "))
    names = F.transform(F.coalesce(parsed["author"], F.array()), lambda a: F.trim(F.concat_ws(" ", a["family"], a["given"])))
    return F.when(
        parsed.isNotNull(),
        F.struct(
            F.lit("").alias("pmid"), F.coalesce(parsed["DOI"], F.lit("")).alias("doi"), first(parsed["title"]).alias("title"), plain.alias("abstract"),
            names.alias("authors"), first(parsed["container-title"]).alias("journal"), F.coalesce(year, F.lit("")).alias("year"),
            F.coalesce(parsed["publisher"], F.lit("")).alias("publisher"), F.lit("crossref").alias("source"),
        ),
    )


def europepmc_meta(body: Column) -> Column:
    """STRUCT of the first EuropePMC result, in the shape of a pubmed entry."""
    result = F.try_element_at(
        F.from_json(body, "resultList struct<result:array<struct<pmid:string,doi:string,title:string,abstractText:string,authorString:string,journalTitle:string,pubYear:string>>>")["resultList"]["result"],
        F.lit(1),
    )
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.when(
        result.isNotNull(),
        F.struct(
            text(result["pmid"]).alias("pmid"), text(result["doi"]).alias("doi"), text(result["title"]).alias("title"), text(result["abstractText"]).alias("abstract"),
            F.filter(F.split(text(result["authorString"]), r",\s*"), lambda a: a != "").alias("authors"), text(result["journalTitle"]).alias("journal"),
            text(result["pubYear"]).alias("year"), F.lit("").alias("publisher"), F.lit("europepmc").alias("source"),
        ),
    )


def abstract_by_doi(crossref: Column, europepmc: Column) -> Column:
    """The first of the two entries that has an abstract, else null."""
    has = lambda c: F.coalesce(c["abstract"], F.lit("")) != ""
    return F.when(has(crossref), crossref).when(has(europepmc), europepmc)


def _local(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


_MARKS = {"italic": ("*", "*"), "bold": ("**", "**"), "sup": ("^", "^"), "sub": ("~", "~")}


def inline_markdown(node: ET.Element) -> str:
    """Text with emphasis, superscripts ^x^ and subscripts ~x~; line breaks inside parentheses become blanks."""
    parts = [node.text or ""]
    for child in node:
        a, b = _MARKS.get(_local(child), ("", ""))
        inner = inline_markdown(child)
        parts += [a + inner + b if inner.strip() else inner, child.tail or ""]
    text = "".join(parts)
    return re.sub(r"\([^()]*\)", lambda m: re.sub(r"\s*\n\s*", " ", m[0]), text).strip() if _local(node) not in _MARKS else text


def _figure(node: ET.Element) -> str:
    label = next((inline_markdown(n) for n in node.iter() if _local(n) == "label"), "")
    caption = next((n for n in node.iter() if _local(n) == "caption"), None)
    parts = [inline_markdown(n) for n in caption if _local(n) in ("title", "p")] if caption is not None else []
    return f"**{label}**\n\n" * bool(label) + " ".join(p for p in parts if p)


def _section(node: ET.Element, level: int, out: list[str]) -> None:
    for child in node:
        kind = _local(child)
        if kind == "title":
            out.append("#" * level + " " + inline_markdown(child))
        elif kind == "p":
            out.append(inline_markdown(child))
        elif kind == "list":
            out.append("\n".join("- " + " ".join(inline_markdown(p) for p in item if _local(p) == "p") for item in child if _local(item) == "list-item"))
        elif kind == "fig":
            out.append(_figure(child))
        elif kind == "sec":
            title = next((inline_markdown(n) for n in child if _local(n) == "title"), "")
            if title.lower().strip() not in SKIPPED_TITLES["xml"]:
                _section(child, level + 1, out)


def full_text_markdown(xml: str) -> str | None:
    """Body and reference list of a full text; text ahead of the first section stands under an Introduction."""
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return None
    out: list[str] = []
    body = next((n for n in root.iter() if _local(n) == "body"), None)
    if body is not None:
        lead = [inline_markdown(n) for n in body if _local(n) == "p"]
        if lead:
            out += ["## Introduction", *lead]
        _section(ET.Element("body"), 1, out)
        holder = ET.Element("body")
        holder.extend([n for n in body if _local(n) == "sec"])
        _section(holder, 1, out)
    refs = [n for n in root.iter() if _local(n) == "ref"]
    if refs:
        out.append("## References")
        for i, ref in enumerate(refs, 1):
            holder = next((n for n in ref if _local(n) in ("mixed-citation", "element-citation", "citation")), None)
            if holder is not None:
                out.append(f"{i}. " + " ".join(" ".join(holder.itertext()).split()))
    return "\n\n".join(x for x in out if x.strip())


@vectorised("string")
def full_text(xmls: pd.Series) -> pd.Series:
    """Markdown of each full text in XML."""
    return pd.Series([None if x is None else full_text_markdown(x) for x in xmls], dtype=object)
