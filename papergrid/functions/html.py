"""Saved pages into article and reference sets.

A page is read once into a light tree by the standard library's tolerant parser; extraction walks that
tree. Column forms work on Arrow batches of pages. Unclosed and stray tags, entities of all kinds and
pages without any of the looked-for parts give the best that is there, never an error; null gives null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from papergrid.functions.udf import vectorised
from papergrid.functions.markdown import type_of

#: Small forms of characters in formulas, and the entities that are decoded by name.
SUBSCRIPTS = str.maketrans("0123456789+-−=()", "₀₁₂₃₄₅₆₇₈₉₊₋₋₌₍₎")
SUPERSCRIPTS = str.maketrans("0123456789+-−=()ni", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁻⁼⁽⁾ⁿⁱ")
ENTITIES = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"'}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES_P = frozenset("p div section ul ol table figure h1 h2 h3 h4 h5 h6 article header footer nav aside blockquote pre".split())


def decode_entities(text: str) -> str:
    """Numbered entities and the six named ones; others stay."""

    def number(m: re.Match) -> str:
        code = m[1].lower()
        value = int(code[1:], 16) if code[0] == "x" else int(code)
        return chr(value) if value <= 0x10FFFF and not 0xD800 <= value < 0xE000 else m[0]

    text = re.sub(r"&#(x[0-9a-fA-F]+|\d+);", number, text)
    return re.sub(r"&([a-zA-Z]+);", lambda m: ENTITIES.get(m[1].lower(), m[0]), text)


def strip_tags(text: str, sup: str = "raise", drop: tuple[str, ...] = ("script", "style")) -> str:
    """Plain text of an HTML piece: entities first, formulas in small characters, tags to blanks. sup: 'raise' or 'drop' superscripts."""
    text = decode_entities(text)
    small = lambda m, to: re.sub(r"<[^>]+>", "", m[1]).translate(to)
    text = re.sub(r"(?is)<sub\b[^>]*>(.*?)</sub>", lambda m: small(m, SUBSCRIPTS), text)
    text = re.sub(r"(?is)<sup\b[^>]*>(.*?)</sup>", (lambda m: small(m, SUPERSCRIPTS)) if sup == "raise" else " ", text)
    for tag in drop:
        text = re.sub(rf"(?is)<{tag}\b.*?</{tag}>", " ", text)
    return " ".join(re.sub(r"<[^>]+>", " ", text).split())


def strip_tags_column(html: Column) -> Column:
    """strip_tags of pages without formulas and entities, by built-in functions."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", " "), r"(?U)\s+", " "))


#: Elements deeper than this stand beside each other, so that no page is too deep to be read; their texts stay.
DEPTH_MOST = 300


class Node:
    """An element, or a text if tag is empty."""

    __slots__ = ("tag", "attrs", "children", "text", "parent", "depth")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, text: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.children, self.text, self.parent = tag, attrs or {}, [], text, parent
        self.depth = parent.depth + 1 if parent else 0

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def plain(self, skip: tuple[str, ...] = ("script", "style"), sup: str = "raise") -> str:
        out: list[str] = []

        def put(node: Node, form: str) -> None:
            if not node.tag:
                out.append(node.text.translate(SUBSCRIPTS if form == "sub" else SUPERSCRIPTS) if form else node.text)
                return
            if node.tag in skip or (node.tag == "sup" and sup == "drop"):
                out.append(" ")
                return
            inline = node.tag in ("sub", "sup")
            if not inline:
                out.append(" ")
            for child in node.children:
                put(child, node.tag if inline else form)
            if not inline:
                out.append(" ")

        put(self, "")
        return " ".join("".join(out).split())

    def has(self, name: str, pattern: str) -> bool:
        return bool(re.search(pattern, self.attrs.get(name, ""), re.I))


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("root")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _CLOSES_P and self.at.tag == "p":
            self.at = self.at.parent
        if tag == self.at.tag and tag in ("li", "tr", "td", "th", "option"):
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, parent=self.at)
        self.at.children.append(node)
        if tag not in _VOID and node.depth < DEPTH_MOST:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, parent=self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent and node.tag != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(Node("", text=data, parent=self.at))


def read(html: str) -> Node:
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.root


# --- metadata ---------------------------------------------------------------------------------------------------------------------


def metas(root: Node, names: str) -> list[str]:
    """Contents of the meta tags whose name or property matches whole, in order."""
    wanted = re.compile(names, re.I)
    return [c for n in root.find("meta") if wanted.fullmatch(n.attrs.get("name") or n.attrs.get("property", "")) and (c := strip_tags(n.attrs.get("content", "")))]


def _first(items: list[str]) -> str:
    return items[0] if items else ""


def title_of(root: Node, kind: str = "article") -> str:
    own = metas(root, "citation_title") or ([] if kind == "article" else metas(root, r"dc\.title") or metas(root, "og:title"))
    head = [n.plain(sup="drop") for n in (root.find("h1") if kind == "article" else [])] or [n.plain() for n in root.find("title")]
    return re.sub(r"(?i)\s*-\s*ScienceDirect$", "", (_first(own) or _first(head))[: 260 if kind == "article" else 220]).strip()


def authors_of(root: Node, complete: bool = False) -> list[str]:
    """Authors by meta tags, by name parts, by marked spans. complete: Dublin Core creators and lone surnames, too."""
    if found := metas(root, "citation_author") or (complete and metas(root, r"dc\.creator")):
        return found
    spans = root.find("span")
    names = []
    for i, s in enumerate(spans[:-1]):
        if s.has("class", "given-name") and spans[i + 1].has("class", "surname"):
            names.append(f"{s.plain()} {spans[i + 1].plain()}".strip())
    if names:
        return names
    if complete:
        return [t for s in spans if s.has("class", "surname") and (t := s.plain())]
    return [t for s in spans if s.has("property", "^author$") and (t := re.sub(r"(?i),\s*(?:MSc|MD|PhD|FRCS|MBA)\b.*$", "", s.plain()))]


def meta_of(root: Node, url: str) -> dict[str, str]:
    in_url = re.search(r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+", url or "")
    doi = _first(metas(root, "citation_doi")) or _first(metas(root, r"dc\.identifier")) or (in_url[0] if in_url else "")
    year = re.search(r"\d{4}", _first(metas(root, "citation_publication_date")))
    return {"journal": _first(metas(root, "citation_journal_title")), "year": year[0] if year else "", "doi": doi.lower()}


# --- bodies -----------------------------------------------------------------------------------------------------------------------

#: A paragraph without content, ids of abstracts, headings that end the body.
_BOILERPLATE = re.compile(r"(?i)https?://(?:dx\.)?doi\.org/10\.\d{4,9}/\S+\s+Digital Object Identifier \(DOI\)")
_ABSTRACT_IDS = ("abstract", "abstracts", "structured-abstract", "editor-abstract", "abstract-content", "author-highlights")
_BODY_END = re.compile(
    r"(?i)(?:Acknowledg|Competing\s+Interests|Conflict\s+of\s+Interest|Funding|Author\s+Contributions|Data\s+Availability|ORCID|Footnote|References"
    r"|Supplementary\s+Material|Article Metrics|Recommended articles)"
)
_TEXT_SKIP = ("script", "style", "table", "figcaption")


def table_markdown(table: Node) -> str:
    """Rows as '| a | b |', a rule after the first one; rows without cells go."""
    lines = []
    for i, row in enumerate(table.find("tr")):
        cells = [c.plain(("script", "style", "figcaption"), sup="drop") for c in row.find("td", "th")]
        if cells:
            lines.append("| " + " | ".join(cells) + " |")
            if i == 0:
                lines.append("| " + " | ".join(["---"] * len(cells)) + " |")
    return "\n".join(lines)


def _is_table_figure(node: Node) -> bool:
    return node.tag == "figure" and (bool(node.find("table")) or any(re.search(r"(?i)\btable\b", v) for v in node.attrs.values()) or node.has("id", r"^T\d+"))


def _is_paragraph(node: Node) -> bool:
    return node.tag == "p" or (node.tag == "div" and (node.has("role", "^paragraph$") or node.has("class", "para")))


def paragraphs_of(nodes: list[Node]) -> list[str]:
    """Paragraphs and tables of a run of siblings, in document order; its whole text if there are none."""
    out: list[str] = []

    def visit(node: Node) -> None:
        if _is_table_figure(node):
            tables = node.find("table")
            caption = " ".join(c.plain(("script", "style"), sup="drop") for c in node.find("figcaption")[:1])
            text = table_markdown(tables[0]) if tables else ""
            if text:
                out.append(f"**{caption}**\n\n{text}" if caption else text)
        elif node.tag == "table":
            if text := table_markdown(node):
                out.append(text)
        elif _is_paragraph(node):
            text = node.plain(_TEXT_SKIP, sup="drop")
            if text and not _BOILERPLATE.fullmatch(text):
                out.append(text)
        else:
            for child in node.children:
                visit(child)

    for n in nodes:
        visit(n)
    if out:
        return out
    rest = " ".join(x for n in nodes if (x := n.plain(_TEXT_SKIP, sup="drop")))
    return [rest] if rest and not _BOILERPLATE.fullmatch(rest) else []


def abstract_of(root: Node) -> list[str]:
    """Abstract paragraphs: a marked container, else what follows an 'Abstract' heading, else a meta tag."""
    for name in _ABSTRACT_IDS:
        for tag in ("section", "div"):
            for box in root.find(tag):
                if box.attrs.get("id", "").lower() == name or name in box.attrs.get("class", "").lower():
                    if found := paragraphs_of([c for c in box.children if not re.fullmatch("h[1-6]", c.tag)]):
                        return found
    blocks = [n for n in root.find("h1", "h2", "h3", "h4", "p", "div") if n.tag != "div" or not n.find("p", "div", "h1", "h2", "h3", "h4")[1:]]
    texts = [(n.tag, n.plain(_TEXT_SKIP, sup="drop")) for n in blocks]
    for i, (_, text) in enumerate(texts):
        if re.fullmatch("(?i)abstract:?", text):
            out = []
            for tag, t in texts[i + 1 :]:
                if tag[0] == "h" and t or re.match(r"(?i)(?:keywords?|key words?|mini review|article type|introduction|background|references?)\b", t):
                    break
                if t:
                    out.append(t)
            if out:
                return out
    found = metas(root, r"citation_abstract|dc\.description|og:description|description")
    return found[:1]


def figures_of(root: Node) -> list[dict]:
    """Figure elements that aren't tables; without any, what follows a 'Figure legends' line."""
    boxes, out = root.find("figure"), []
    for box in boxes:
        captions, image = box.find("figcaption"), [n.attrs["src"] for n in box.find("img") if n.attrs.get("src")]
        marked = [n for c in captions[:1] for n in c.walk() if (n.tag == "span" and n.attrs.get("class") == "heading") or n.tag in ("strong", "b")]
        title = re.sub(r"[.\s]+$", "", marked[0].plain(sup="drop")) if marked else ""
        title = title or ("Figure " + box.attrs.get("id", "")).strip()
        if _is_table_figure(box) or re.match(r"(?i)table\b", title):
            continue
        legend = captions[0].plain(("script", "style", "table"), sup="drop") if captions else box.plain(_TEXT_SKIP, sup="drop")
        out.append((re.sub(r"(?i)^fig\b\.?", "Figure", title).strip(), [f"[Image URL: {image[0]}]\n\n{legend}" if image else legend]))
    if not boxes:
        blocks = [(n.tag, n.plain(_TEXT_SKIP, sup="drop")) for n in root.find("h1", "h2", "h3", "h4", "p")]
        start = next((i for i, (tag, t) in enumerate(blocks) if tag == "p" and re.fullmatch(r"(?i)Figure\s+legends?", t)), None)
        for tag, text in blocks[start + 1 :] if start is not None else ():
            if tag[0] == "h" or re.match(r"(?i)(?:References?|Acknowledg|Funding|Conflict)\b", text):
                break
            new = re.match(r"(?i)(Figure\s+\d+[A-Za-z]?)\.?\s*(.*)", text)
            if new:
                out.append((new[1], [new[2].strip()] if new[2].strip() else []))
            elif out and text:
                out[-1][1].append(text)
    return [_section(t, "figure", p) for t, p in out]


def _section(title: str, kind: str, paras: list[str], subs: list[dict] | None = None) -> dict:
    return {"title": title, "type": kind, "content": "\n\n".join(paras), "paragraphs": paras, "subsections": subs or []}


def _stream(node: Node) -> Iterator[Node]:
    """Headings, paragraphs and tables in document order."""
    if re.fullmatch("h[2-4]", node.tag) or node.tag in ("table", "figure") or _is_paragraph(node):
        yield node
    else:
        for child in node.children:
            yield from _stream(child)


def sections_of_page(root: Node) -> list[dict]:
    """Abstract, introduction, headed sections with their subsections, figures; 'Main Text' where nothing has a heading."""
    body = next(
        (n for n in root.find("section", "div") if n.has("id", "^(?:bodymatter|body)$") or n.has("class", "Body|article-body") or n.has("property", "^articleBody$")), root
    )
    items: list[Node] = []
    for n in _stream(body):
        if n.tag[0] == "h" and items and _BODY_END.match(n.plain(sup="drop")):
            break
        items.append(n)
    heads = [(i, int(n.tag[1]), n.plain(_TEXT_SKIP, sup="drop")) for i, n in enumerate(items) if re.fullmatch("h[2-4]", n.tag)]
    heads = [h for h in heads if h[2]]
    twos = [h for h in heads if h[1] == 2]
    top = [(h, kind) for h in twos if (kind := type_of(h[2].lower().removesuffix(":").strip(), "html")) not in ("references", "acknowledgements")]
    out = []
    abstract = abstract_of(root)
    if abstract and not any(k == "abstract" for _, k in top):
        out.append(_section("Abstract", "abstract", abstract))
    methods = next((h for h, k in top if k == "materials|methods"), None)
    if methods and methods[0] > 0 and not any(k == "intro" for _, k in top):
        if lead := paragraphs_of([n for n in items[: methods[0]] if n.tag[0] != "h"]):
            out.append(_section("Introduction", "intro", lead))
    for (at, _, title), kind in top:
        end = next((h[0] for h in twos if h[0] > at), len(items))
        inner = [h for h in heads if at < h[0] < end and h[1] > 2]
        subs, parent = [], ""
        for j, (place, level, name) in enumerate(inner):
            name = name.removesuffix(":")
            parent = name if level == 3 else parent
            paras = paragraphs_of(items[place + 1 : inner[j + 1][0] if j + 1 < len(inner) else end])
            if paras:
                subs.append({"title": f"{parent} > {name}" if level == 4 and parent else name, "content": "\n\n".join(paras), "paragraphs": paras})
        out.append(_section(title, kind, paragraphs_of(items[at + 1 : inner[0][0] if inner else end]), subs))
    if not out or (len(out) == 1 and out[0]["type"] == "abstract"):
        known = set(out[0]["paragraphs"]) if out else set()
        if rest := [p for p in paragraphs_of([body]) if p not in known]:
            out.append(_section("Main Text", "other", rest))
    out += figures_of(root)
    return [s for s in out if s["paragraphs"] or any(u["paragraphs"] for u in s["subsections"])]


# --- references -------------------------------------------------------------------------------------------------------------------

_DOI = re.compile(r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+")
#: Fixed values, in the order in which they are tried.
_PMIDS = tuple(re.compile(rf"(?i){p}") for p in (r"pubmed\.ncbi\.nlm\.nih\.gov/(\d+)", r"ncbi\.nlm\.nih\.gov/pubmed/(\d+)", r"\bPMID[:\s]+(\d{5,})\b"))
#: Words of services in lists, files of supplements, names of meta tags with references.
_SERVICE = re.compile(r"(?i)\b(?:Google Scholar|CrossRef|PubMed|Article|CAS|PubMed Central|DOI|View Article)\b")
_SUPPLEMENT = re.compile(r"(?i)/doi/suppl/|/suppl_file/|supplementary-materials|core-supplementary-material|\.docx?\b|\.xlsx?\b|\.pptx?\b|\.zip\b")
_META_NAMES = r"citation_reference|dc\.reference|dcterms\.bibliographiccitation|bepress_citation_reference|article_references?"


def find_doi(text: str) -> str:
    m = _DOI.search(unquote(text))
    return m[0].rstrip(")].,;") if m else ""


def find_pmid(text: str) -> str:
    return next((m[1] for p in _PMIDS if (m := p.search(text))), "")


def _clean(text: str) -> str:
    return " ".join(_SERVICE.sub(" ", text).split())


def _links(node: Node, url: str) -> list[str]:
    return [urljoin(url or "https://example.org", h) for a in node.find("a") if (h := a.attrs.get("href"))]


def _record(number: int, text: str, url: str, links: list[str], doi: str = "", pmid: str = "") -> dict:
    hay = " ".join([text, *links])
    doi, pmid = doi or find_doi(hay), pmid or find_pmid(hay)
    marks = ("pubmed", r"scholar\.google", "scholar_lookup", r"doi\.org|/doi/")
    href = next((h for m in marks for h in links if re.search(m, h, re.I)), _first(links))
    href = href or (f"https://pubmed.ncbi.nlm.nih.gov/{pmid}/" if pmid else f"https://doi.org/{doi}" if doi else url)
    return {"ref_index": number, "text": text or href, "href": href, "doi": doi, "pmid": pmid}


def distinct_records(records: list[dict]) -> list[dict]:
    """First of each PMID, else DOI, else beginning of the text; numbered anew."""
    seen: dict[str, dict] = {}
    for r in records:
        key = r["pmid"] or r["doi"].lower() or r["text"].lower()[:100]
        if key:
            seen.setdefault(key, r)
    return [{**r, "ref_index": i} for i, r in enumerate(seen.values(), 1)]


def _by_mark(root: Node, url: str, tag: str, attribute: str, pattern: str) -> list[dict]:
    """Elements whose attribute carries the reference's number."""
    out = []
    for n in root.find(tag):
        m = re.search(pattern, n.attrs.get(attribute, ""), re.I)
        if m and (attribute != "id" or n.has("class", r"\bcitations\b")):
            inner = next((c for c in n.walk() if c.has("class", "citation-content")), n)
            drop = [c for c in inner.walk() if c.tag == "span" and c.attrs.get("class") == "label" or c.has("class", "extra-links")]
            for c in drop:
                c.children = []
            links = _links(n, url)
            joined = " ".join(links)
            key = re.search(r"(?:scholar_lookup\?[^\s]*[?&]doi=|[?&](?:key|refDoi|doiOfLink)=)(10\.[^&\s]+)", joined, re.I)
            direct = re.search(r"doi\.org/(10\.\d{4,9}/[^\s<]+)", joined, re.I)
            mark = next((c.plain() for c in n.walk() if c.has("class", "data-doi")), "")
            doi = find_doi(mark or (direct[1] if direct else "") or (key[1] if key else ""))
            out.append(_record(int(m[1]), _clean(re.sub(r"^\d+\s+", "", inner.plain())), url, [h for h in links if "pubmed" in h], doi, find_pmid(joined)))
    return out


def _from_meta(root: Node, url: str) -> list[dict]:
    out = []
    for text in map(_clean, metas(root, _META_NAMES)):
        r = _record(len(out) + 1, text, url, [])
        if text and not _SUPPLEMENT.search(text) and (r["doi"] or r["pmid"] or len(text) >= 30):
            out.append(r)
    return distinct_records(out)


def _science(root: Node, url: str) -> list[dict]:
    out = []
    for i, n in enumerate((n for n in root.find("div") if n.has("class", "biblioentry")), 1):
        text = n.plain()
        if len(text) >= 10:
            links = [h for h in _links(n, url) if not re.search(r"google\.com/scholar|webofscience\.com|crossref\.org", h, re.I)]
            out.append({**_record(i, text, url, links), "text": text})
    return out


def _numbered(root: Node, url: str) -> list[dict]:
    """A heading 'References' and paragraphs '[n] ...' with their continuations; the longest such list."""
    blocks = [(n.tag, n.plain()) for n in root.find("h1", "h2", "h3", "h4", "p")]
    best: list[dict] = []
    for i, (_, text) in enumerate(blocks):
        if not re.fullmatch("(?i)(?:References?|Bibliography|Cited Literature)", text):
            continue
        out: list[dict] = []
        for tag, raw in blocks[i + 1 :]:
            t = _clean(raw)
            if tag != "p" or not t:
                continue
            new = re.match(r"(?:\[(\d{1,4})\]|(\d{1,4})[.)])\s+.", t)
            if new:
                out.append({"ref_index": int(new[1] or new[2]), "text": t, "href": url, "doi": find_doi(t), "pmid": find_pmid(t)})
            elif out:
                if re.match(r"(?i)(?:Acknowledg|Funding|Author Contributions|Conflict|Supplementary|Figure|Table)\b", t):
                    break
                out[-1]["text"] = _clean(f"{out[-1]['text']} {t}")
        out = distinct_records(out)
        best = out if len(out) > len(best) else best
    return best


def _generic(root: Node, url: str) -> list[dict]:
    """List items or marked blocks with reference links, else single links, else long paragraphs."""
    sign = re.compile(r"(?i)doi\.org|pubmed|scholar_lookup|crossref|scholar\.google|10\.\d{4,9}/")
    for pick in (lambda n: n.tag == "li", lambda n: n.tag in ("div", "p") and any(n.has(a, "reference|citation|ref-list|refItem|NLM_citation") for a in ("class", "id"))):
        out = []
        for n in root.walk():
            if pick(n):
                links = _links(n, url)
                hay = " ".join([n.plain(), *links])
                if sign.search(hay) and not _SUPPLEMENT.search(hay):
                    out.append(_record(len(out) + 1, _clean(n.plain()), url, links))
        if len(out := distinct_records(out)) > 1:
            return out
    out = []
    for a in root.find("a"):
        links = _links(a, url) if a.find("a") else []
        text = _clean(a.plain())
        hay = " ".join([*links, text])
        if links and not _SUPPLEMENT.search(hay) and (sign.search(hay) or re.search(r"(?i)\bPMID\b|\bDOI\b", text)) and text.lower() != "skip to main content":
            out.append(_record(len(out) + 1, text, url, links))
    if len(out := distinct_records(out)) > 1:
        return out
    texts = [_clean(p.plain()) for p in root.find("p")]
    return distinct_records([r for i, t in enumerate(texts, 1) if t and not _SUPPLEMENT.search(t) and ((r := _record(i, t, url, []))["doi"] or r["pmid"] or len(t) >= 30)])


#: Signs of the publishers whose pages have lists of their own form.
FAMILIES = (("sage", "sagepub|sage publications|american journal of sports medicine"), ("wiley", r"wiley|journal of orthopaedic research"), ("science", r"science\.org"))


def page_family(root: Node, url: str) -> str:
    hay = f"{url} " + " ".join(metas(root, r"citation_publisher|citation_journal_title|dc\.publisher"))
    for family, sign in FAMILIES:
        if re.search(sign, hay, re.I):
            return family
    return "metadata" if metas(root, _META_NAMES) else "generic"


def references_of_page(html: str, url: str) -> list[dict]:
    """References by the first extractor, in the order that suits the page's publisher, that finds more than one."""
    extractors = {
        "sage": lambda r: _by_mark(r, url, "div", "id", r"^bibr(\d+)-"), "wiley": lambda r: _by_mark(r, url, "li", "data-bib-id", r"\bbib-(\d+)"),
        "science": lambda r: _science(r, url), "metadata": lambda r: _from_meta(r, url), "numbered": lambda r: _numbered(r, url), "any": lambda r: _generic(r, url),
    }
    order = {
        "sage": ("sage", "metadata", "numbered"), "wiley": ("wiley", "metadata", "numbered"), "science": ("science", "metadata", "numbered"),
        "metadata": ("metadata", "sage", "wiley", "numbered"), "generic": ("sage", "wiley", "metadata", "numbered"),
    }
    root = read(html)
    for name in order[page_family(root, url)]:
        if len(found := extractors[name](root)) > 1:
            return found
    return extractors["any"](root)


# --- columns ----------------------------------------------------------------------------------------------------------------------

_SUB = "struct<title:string,content:string,paragraphs:array<string>>"
ARTICLE = (
    "struct<title:string,authors:array<string>,journal:string,year:string,doi:string,"
    f"sections:array<struct<title:string,type:string,content:string,paragraphs:array<string>,subsections:array<{_SUB}>>>>"
)
REFERENCES = "array<struct<ref_index:int,text:string,href:string,doi:string,pmid:string>>"


def article_rows(pages: pd.Series, urls: pd.Series) -> pd.DataFrame:
    rows = []
    for html, url in zip(pages, urls):
        root = read(html or "")
        rows.append({"title": title_of(root), "authors": authors_of(root), **meta_of(root, url or ""), "sections": sections_of_page(root) if html else []})
    return pd.DataFrame(rows, columns=["title", "authors", "journal", "year", "doi", "sections"])


@vectorised(ARTICLE)
def article_of(pages: pd.Series, urls: pd.Series) -> pd.DataFrame:
    """Article set of each page."""
    return article_rows(pages, urls)


@vectorised(f"struct<article:{ARTICLE},records:{REFERENCES}>")
def page_of(pages: pd.Series, urls: pd.Series) -> pd.DataFrame:
    """article_of and references_of of each page in one step."""
    articles = article_rows(pages, urls)
    records = [references_of_page(h, u or "") if h else [] for h, u in zip(pages, urls)]
    return pd.DataFrame({"article": articles.to_dict("records"), "records": pd.Series(records, dtype=object)})


@vectorised(REFERENCES)
def references_of(pages: pd.Series, urls: pd.Series) -> pd.Series:
    """Reference records of each page."""
    return pd.Series([references_of_page(h, u or "") if h else [] for h, u in zip(pages, urls)], dtype=object)


@vectorised("string")
def entities_decoded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else decode_entities(t))


def _decoded(value: object) -> object:
    if isinstance(value, str):
        return decode_entities(value)
    if isinstance(value, list):
        return [_decoded(v) for v in value]
    return {k: _decoded(v) for k, v in value.items()} if isinstance(value, dict) else value


@vectorised("string")
def json_decoded(texts: pd.Series) -> pd.Series:
    """JSON with the entities of every string in it decoded, at any depth; unreadable JSON as it is."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(_decoded(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return text

    return texts.map(one)


@vectorised("string")
def tags_stripped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else strip_tags(t))


@vectorised("string")
def absolute_url(links: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([None if a is None else urljoin(b or "https://example.org", a) for a, b in zip(links, bases)], dtype=object)


def figure_parts(content: Column) -> Column:
    """STRUCT<image_url, legend> of a figure section's content."""
    url = F.regexp_extract(content, r"\A\[Image URL: ([^\]]+)\]", 1)
    return F.struct(url.alias("image_url"), F.trim(F.regexp_replace(content, r"\A\[Image URL: [^\]]+\]\s*", "")).alias("legend"))
