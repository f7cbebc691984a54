"""Column functions on note texts, section titles and identifiers. All are built-in expressions and stay in the JVM.

Null in gives null out unless said otherwise; empty texts are allowed everywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordered rules from parts of a lower-cased title to a section type, for each source of titles. '=x' must match whole, '^x' a pattern at the start.
SECTION_RULES: dict[str, tuple[tuple[str, tuple[str, ...]], ...]] = {
    "note": (
        ("abstract", ("abstract",)), ("intro", ("introduction", "=intro", "background")), ("keywords", ("keyword",)),
        ("abbreviations", ("abbreviation",)), ("materials|methods", ("method", "material", "patient")), ("results", ("result",)),
        ("discussion", ("discussion",)), ("conclusion", ("conclusion",)), ("references", ("reference",)),
        ("cited_by", ("cited by", "citing")), ("acknowledgements", ("acknowledgement", "acknowledgment")),
    ),
    "single": (
        ("abstract", ("abstract",)), ("intro", ("introduction", "=intro")), ("materials|methods", ("method", "material", "patient")),
        ("results", ("result",)), ("discussion", ("discussion",)), ("conclusion", ("conclusion",)), ("references", ("reference",)),
    ),
    "html": (
        ("materials|methods", ("method", "material", "study design")), ("results", ("result",)), ("discussion", ("discussion",)),
        ("conclusion", ("conclusion",)), ("intro", ("introduction", "=intro")), ("abstract", ("abstract",)), ("references", ("reference",)),
        ("acknowledgements", ("acknowledg",)),
        ("excluded", ("outline", "cited by", "article metrics", "recommended articles", "keywords", "cookie")),
    ),
    "numbered": (
        ("intro", ("^1\\.", "introduction")), ("methods", ("^2\\.", "method", "material", "experimental")), ("results", ("^3\\.", "result", "finding")),
        ("discussion", ("^4\\.", "discussion", "conclusion")),
    ),
    "review": (("acknowledgements", ("acknowledgement", "acknowledgment")), ("references", ("reference",))),
}
#: Section types left out by each step.
EXCLUDED = {
    "convert": ("references", "acknowledgements", "abstract", "cited_by"),
    "index": ("references", "acknowledgements", "abbreviations", "keywords", "other"),
    "index_mac": ("references", "acknowledgements"),
    "search_targets": ("intro", "materials|methods", "results", "discussion", "conclusion"),
}
#: Titles of back matter, and the letters of Japanese.
_BACK_MATTER = (
    "abstract", "acknowledgements", "acknowledgments", "conflict of interest", "conflicts of interest", "funding", "author contributions",
    "supplementary material", "data availability",
)
SKIPPED_TITLES = {"xml": _BACK_MATTER, "html": (*_BACK_MATTER, "significance", "footnotes", "associated data")}
JAPANESE = r"[぀-ヿ㐀-䷿一-鿿]"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends (the engine's trim takes blanks only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """White space runs become one blank, ends are cut."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def newlines(text: Column) -> Column:
    """CR LF and CR become LF."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def either(*columns: Column) -> Column:
    """The first value that is neither null nor empty, else an empty string."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def either_list(*columns: Column) -> Column:
    """The first array that is neither null nor empty, else an empty one."""
    return F.coalesce(*(F.when(F.size(c) > 0, c) for c in columns), F.array().cast("array<string>"))


def section_type(title: Column, rules: str = "note") -> Column:
    """Type of a section by its title; 'other' ('review' for the rules of reviews) if no rule holds or the title is null."""
    low = F.lower(F.coalesce(title, F.lit("")))
    if rules == "html":
        low = F.trim(F.regexp_replace(low, ":$", ""))

    def holds(part: str) -> Column:
        if part[0] == "=":
            return low == part[1:]
        return low.rlike(part) if part[0] == "^" else low.contains(part)

    out = None
    for name, parts in SECTION_RULES[rules]:
        test = reduce(lambda a, b: a | b, map(holds, parts))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("review" if rules == "review" else "other")


def is_review(flag: Column, tags: Column) -> Column:
    """The flag if there is one, else whether the tags name a review; false for neither."""
    return F.coalesce(flag, F.array_contains(tags, "review"), F.lit(False))


def tag_list(tags: Column) -> Column:
    """A string becomes a list of one, null an empty list."""
    return F.when(tags.isNull(), F.array().cast("array<string>")).otherwise(F.array(tags))


def excluded_paragraph(text: Column) -> Column:
    """A paragraph that mentions references or 'cited by' anywhere."""
    low = F.lower(text)
    return low.contains("references") | low.contains("cited by")


def paragraphs(text: Column, pattern: str = "\n\n") -> Column:
    """Stripped parts that are not blank; pattern is a regular expression. A null text has none."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), pattern), strip)
    return F.filter(parts, lambda p: p != "")


def capital_key(key: Column) -> Column:
    """Trimmed, first character upper-cased, the rest left alone."""
    own = strip(key)
    return F.concat(F.upper(F.substring(own, 1, 1)), F.substring(own, 2, 2**30))


def first_author(authors: Column) -> Column:
    """Text before the first comma of the first author; empty if there is none."""
    return F.coalesce(F.trim(F.substring_index(F.try_element_at(authors, F.lit(1)), ",", 1)), F.lit(""))


def citation(authors: Column, year: Column, key: Column) -> Column:
    """'First year', or the key if neither is known."""
    label = F.trim(F.concat_ws(" ", first_author(authors), F.coalesce(year, F.lit(""))))
    return F.when(label != "", label).otherwise(F.coalesce(key, F.lit("")))


def joined(items: Column, separator: str = ", ") -> Column:
    """Elements joined, nulls left out; empty for a null array."""
    return F.coalesce(F.array_join(items, separator), F.lit(""))


def without_urls_and_tags(text: Column) -> Column:
    """Without '(http...)' and anything in angle brackets."""
    return F.regexp_replace(F.regexp_replace(text, r"\(https?://[^)]+\)", ""), r"<[^>]+>", "")


def unlinked(text: Column) -> Column:
    """Bracketed citation links go, other Markdown links leave their label."""
    cut = F.regexp_replace(text, r"\\\[.*?\]\(https?://[^\)]+\)\\\]", "")
    return strip(F.regexp_replace(cut, r"\[([^\]]*)\]\(https?://[^\)]+\)", "$1"))


def without_links(text: Column) -> Column:
    """Markdown links go with their label; white space squeezed."""
    return squeeze(F.regexp_replace(text, r"\[[^\]]*\]\(https?://[^\)]+\)", ""))


def without_images(text: Column) -> Column:
    return F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", "")


def cleaned_note(text: Column) -> Column:
    """Without image links (and the white space after them) and doubly bracketed links (and that before them)."""
    return F.regexp_replace(F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)\s*", ""), r"\s*\[\[[^\]]+\]\([^)]*\)\]", "")


def cleanup_counts(text: Column) -> Column:
    """STRUCT<figure_urls, ref_links>: what cleaned_note removes."""
    count = lambda p: F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0))
    return F.struct(count(r"!\[[^\]]*\]\([^)]*\)").alias("figure_urls"), count(r"\[\[[^\]]+\]\([^)]*\)\]").alias("ref_links"))


def compact_legends(text: Column) -> Column:
    """No blank lines after figure marks, figure images and full-size links."""
    for mark in (r"\*\*Figure \d+\*\*", r"!\[Figure [^\]]*\]\([^)]+\)", r"\[Full size image\]\([^)]+\)"):
        text = F.regexp_replace(text, f"({mark})\n+", "$1\n")
    return text


#: Labels of links in reference lists that lead to services.
SERVICE_LABELS = ("Google Scholar", "Crossref", "View in Scopus", "View PDF", "View article")


def without_web_addresses(text: Column) -> Column:
    """Link targets and bare addresses go, but for hosts that begin with 'ars.'; emptied service links go whole."""
    text = F.regexp_replace(text, r"\[([^\]]*)\]\(https?://(?!ars\.)[^\s)]+\)", "[$1]()")
    text = F.regexp_replace(text, r"https?://(?!ars\.)[^\s)\"'<>]+", "")
    return F.regexp_replace(text, r"\t?\[(?:" + "|".join(SERVICE_LABELS) + r")\]\(\)", "")


def removed_addresses(text: Column) -> Column:
    """The addresses that without_web_addresses takes away, in order."""
    return F.regexp_extract_all(text, F.lit(r"(https?://(?!ars\.)[^\s)\"'<>]+)"), 1)


#: Labels of links that publishers add to references.
PUBLISHER_LABELS = ("Article", "CAS", "PubMed", "PubMed Central", "Full size table")
_LIST_HEAD = r"(?im)^##\s+(?:References?|Bibliography)\b"


def clean_reference_links(text: Column) -> Column:
    """From the reference heading on: publisher links, blanks at line ends and surplus empty lines go. Unchanged without such links."""
    link = r"(?i)\[(?:" + "|".join(PUBLISHER_LABELS) + r")\]\([^)]+\)"
    head = F.regexp_extract(text, r"(?ims)\A(.*?)(?=^##\s+(?:References?|Bibliography)\b)", 1)
    tail = F.substring(text, F.char_length(head) + 1, F.char_length(text))
    body = F.regexp_replace(tail, link, "")
    body = F.regexp_replace(F.regexp_replace(body, r"(?m)[ \t]+$", ""), r"\n{3,}", "\n\n")
    body = F.regexp_replace(body, r"(\[\^\d+\]:[^\n]+)\n\n+", "$1\n")
    return F.when(text.rlike(_LIST_HEAD) & tail.rlike(link), F.concat(head, body)).otherwise(text)


def normal_headings(text: Column) -> Column:
    """'%%' comments go; a newline stands before each heading."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)%%.*?%%", ""), r"(?m)^(#{1,6}\s)", "\n$1")


def wikilinks(text: Column) -> Column:
    """Distinct targets of [[...]] in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[\[(.*?)\]\]"), 1))


def stem_author(stem: Column) -> Column:
    return F.when(stem.rlike(r"[0-9]{4}\z"), F.substring(stem, 1, F.greatest(F.char_length(stem) - 4, F.lit(0)))).otherwise(stem)


def stem_year(stem: Column) -> Column:
    """The last four digits of a file's stem, else 'N/A'."""
    return F.when(stem.rlike(r"[0-9]{4}\z"), F.substring(stem, -4, 4)).otherwise("N/A")


def is_japanese(text: Column) -> Column:
    return F.coalesce(text.rlike(JAPANESE), F.lit(False))


def highlighted(text: Column, keywords: list[str]) -> Column:
    """Each keyword in turn stands in bold, in the keyword's own case."""
    for word in keywords:
        pattern = "(?i)" + "".join(c if c.isalnum() or c == " " else "\\" + c for c in word)
        text = F.regexp_replace(text, pattern, "**" + word.replace("\\", "\\\\").replace("$", "\\$") + "**")
    return text


def answer_part(response: Column) -> Column:
    """The text between ANSWER: and KEYWORDS:, or all of it if one is missing."""
    both = response.contains("ANSWER:") & response.contains("KEYWORDS:")
    return F.when(both, strip(F.replace(F.substring_index(response, "KEYWORDS:", 1), F.lit("ANSWER:"), F.lit("")))).otherwise(response)


def keyword_part(response: Column) -> Column:
    both = response.contains("ANSWER:") & response.contains("KEYWORDS:")
    return F.when(both, strip(F.element_at(F.split(response, "KEYWORDS:"), 2))).otherwise("")


def info_field(text: Column, name: str) -> Column:
    """A field of the note's Info callout; empty if there is none. Authors' fields end at '>'."""
    block = F.regexp_extract(text, r"(?s)>\s*\[!Info\](.*?)(?=\n(?!>)|\z)", 1)
    if name in ("FirstAuthor", "Author"):
        return F.trim(F.regexp_extract(block, rf"\*\*{name}\*\*::\s*([^>]+?)(?:\s*>|\s*\z)", 1))
    body = {"Year": r"(\d+)", "Journal": r"\*?([^\n*]+)\*?"}.get(name, r"([^\n]+)")
    return strip(F.regexp_extract(block, rf">\s*\*\*{name}\*\*:\s*{body}", 1))


def info_authors(text: Column) -> Column:
    block = F.regexp_extract(text, r"(?s)>\s*\[!Info\](.*?)(?=\n(?!>)|\z)", 1)
    return F.filter(F.transform(F.regexp_extract_all(block, F.lit(r"\*\*(?:First)?Author\*\*::\s*([^>]+?)(?:\s*>|\s*\z)"), 1), strip), lambda a: a != "")


def abstract_callout(text: Column, form: str = "loose") -> Column:
    """The Abstract callout. loose: any spacing, quote marks and blank runs cut; strict: lines without '> ', blank ones dropped; raw: blank ones kept."""
    mark = r">\s*\[!Abstract\]\s*\n" if form == "loose" else r"> \[!Abstract\]\n"
    block = F.regexp_extract(text, mark + r"((?:>[^\n]*\n?)*)", 1)
    if form == "loose":
        return F.regexp_replace(F.regexp_replace(strip(block), r"(?m)^>\s*", ""), r"\n\s*\n+", "\n\n")
    lines = F.transform(F.split(block, "\n"), lambda x: F.regexp_replace(x, r"\A> ", ""))
    if form == "strict":
        lines = F.filter(lines, lambda x: strip(x) != "")
    return strip(F.array_join(lines, "\n"))


def main_text(note: Column) -> Column:
    """What follows '# 4 Main Text' up to a line that begins with '#' and neither '#' nor white space; null if there is no such heading."""
    body = F.regexp_extract(note, r"(?is)# 4 Main Text\s*\r?\n(.*?)(?=\n#(?![#\s])|\z)", 1)
    return F.when(note.rlike(r"(?is)# 4 Main Text\s*\r?\n"), F.nullif(strip(body), F.lit("")))


def replace_main_text(note: Column, body: Column, force: bool = False) -> Column:
    """The note with body below '# 4 Main Text', if nothing stands there or force is set; unchanged without that heading."""
    head = F.regexp_extract(note, r"(?s)\A(.*?# 4 Main Text[^\n]*\n?)", 1)
    rest = F.substring(note, F.char_length(head) + 1, F.char_length(note))
    free = F.lit(True) if force else (strip(rest) == "")
    return F.when((head != "") & free, F.concat(F.regexp_replace(head, r"\n\z", ""), F.lit("\n\n"), body, F.lit("\n"))).otherwise(note)


def natural_key(name: Column) -> Column:
    """Sort key that takes digits as numbers and letters in lower case."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), 1)
    return F.transform(parts, lambda p: F.when(p.rlike(r"\A\d"), F.lpad(F.regexp_replace(p, r"\A0+(?=\d)", ""), 20, "0")).otherwise(p))


def percent(score: Column) -> Column:
    """A similarity as whole percents from 0 to 100."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(score * 100).cast("int")))
