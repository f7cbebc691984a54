"""Column functions on reference texts, links and identifiers. Built-in expressions unless marked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papergrid.functions.text import either, squeeze

DOI = r"(?i)\b(10\.\d{4,9}/[-._;()/:A-Z0-9]+)"
#: Words without weight in the comparison of titles.
TITLE_STOPWORDS = ("the", "and", "for", "with", "from", "into", "that", "this", "using", "based", "study", "analysis", "review", "clinical", "patients",
                   "versus", "after", "among")
#: Service words that stand among references.
SERVICE_WORDS = ("Google Scholar", "CrossRef", "PubMed", "Article", "CAS", "PubMed Central", "DOI", "View Article")


def percent_decoded(text: Column) -> Column:
    """URL-decoded; plus signs stay, and text that can't be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def doi(text: Column) -> Column:
    """The first DOI, without punctuation at its end; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(percent_decoded(text), DOI, 1), r"[)\].,;]+\z", "")


def pmid(text: Column) -> Column:
    """From a PubMed link, an older one, or 'PMID: n'; empty if there is none."""
    forms = (r"(?i)pubmed\.ncbi\.nlm\.nih\.gov/(\d+)", r"(?i)ncbi\.nlm\.nih\.gov/pubmed/(\d+)", r"(?i)\bPMID[:\s]+(\d{5,})\b")
    return either(*(F.regexp_extract(text, f, 1) for f in forms))


def clean_reference(text: Column) -> Column:
    """Without service words, white space squeezed."""
    return squeeze(F.regexp_replace(text, r"(?i)\b(?:" + "|".join(SERVICE_WORDS) + r")\b", " "))


def slug(text: Column, default: str = "reference-set") -> Column:
    """Lower case, without scheme, other characters a dash, at most 64 characters."""
    low = F.regexp_replace(F.lower(text), r"https?://", "")
    cut = F.substring(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, 64)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit(default))


def supplementary(text: Column) -> Column:
    """A link to supplementary material or an office file."""
    return text.rlike(r"(?i)/doi/suppl/|/suppl_file/|supplementary-materials|core-supplementary-material|\.docx?\b|\.xlsx?\b|\.pptx?\b|\.zip\b")


def useful_link(href: Column, text: Column) -> Column:
    """A link that can lead to a reference."""
    both = F.concat_ws(" ", href, text)
    return (
        (pmid(both) != "") | (doi(both) != "") | text.rlike(r"(?i)\bPMID\b|\bDOI\b")
        | href.rlike(r"(?i)pubmed|doi\.org|crossref|ncbi\.nlm\.nih\.gov|/doi/|scholar\.google|scholar_lookup")
    )


def boilerplate(text: Column) -> Column:
    return F.trim(text).rlike(r"(?i)\Ahttps?://(?:dx\.)?doi\.org/10\.\d{4,9}/\S+\s+Digital Object Identifier \(DOI\)\z")


def record_key(pmid_: Column, doi_: Column, text: Column, length: int = 100, tagged: bool = False) -> Column:
    """Key of a reference: its PMID, else its DOI in lower case, else the beginning of its text in lower case."""
    cut = F.substring(F.lower(F.coalesce(text, F.lit(""))), 1, length)
    if not tagged:
        return either(pmid_, F.lower(doi_), cut)
    tag = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name), c))
    return F.coalesce(tag("pmid:", pmid_), tag("doi:", F.lower(doi_)), F.concat(F.lit("text:"), cut))


def record_score(text: Column, href: Column, pubmed: Column, error: Column) -> Column:
    """How well a reference record is filled."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    points = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    return (
        points(has(pubmed["abstract"]), 100) + points(has(pubmed["title"]), 20) + points(F.size(pubmed["authors"]) > 0, 10)
        + points(has(text) & ~text.rlike(r"(?i)\Ahttps?://"), 8) + points(href.rlike("(?i)pubmed"), 4)
        + points(href.rlike(r"(?i)doi\.org|/doi/"), 2) - points(has(error), 20)
    )


def publisher_family(url: Column, metadata: Column, has_meta_references: Column) -> Column:
    """Which extractor suits a page: sage, wiley, science, metadata or generic."""
    hay = F.concat_ws(" ", url, metadata)
    return (
        F.when(hay.rlike("(?i)sagepub|sage publications|american journal of sports medicine"), "sage")
        .when(hay.rlike(r"(?i)onlinelibrary\.wiley|wiley|journal of orthopaedic research"), "wiley")
        .when(hay.rlike(r"(?i)science\.org"), "science").when(has_meta_references, "metadata").otherwise("generic")
    )


def author_year(text: Column) -> Column:
    """STRUCT<author, year>: 'Surname I' of the first author and a year from 1900 on; null without a year or with a single word."""
    clean = clean_reference(text)
    year = F.regexp_extract(clean, r"(?:\b|\()((?:19|20)\d{2})(?:\b|\))", 1)
    lead = F.regexp_replace(clean, r"\A\[?\d+\]?\.?\s*", "")
    first = F.element_at(F.split(lead, r"(?i),| and "), 1)
    first = F.when(first.contains(" "), first).otherwise(F.array_join(F.slice(F.split(lead, r"\s+"), 1, 3), " "))
    words = F.filter(F.split(first, r"[\s.]+"), lambda w: (w != "") & ~w.rlike(r"(?i)\A(?:MD|PhD|MSc|Jr|Sr)\z"))
    initials_first = F.get(words, 0).rlike(r"\A[A-Z]{1,4}\z")
    surname = F.regexp_replace(F.when(initials_first, F.element_at(words, -1)).otherwise(F.get(words, 0)), r"[^\w\-]", "")
    initial = F.substring(F.when(initials_first, F.get(words, 0)).otherwise(F.get(words, 1)), 1, 1)
    return F.when((year != "") & (F.size(words) >= 2), F.struct(F.concat_ws(" ", surname, initial).alias("author"), year.alias("year")))


def title_tokens(text: Column) -> Column:
    """Lower-case words of at least four characters that carry weight."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+)"), 1)
    return F.filter(words, lambda w: (F.char_length(w) >= 4) & ~w.isin(*TITLE_STOPWORDS))


def citation_title(text: Column) -> Column:
    """The title in 'A. Author, B. Author, Title. Journal 1 (2020) 1-2.'; the whole text where that form isn't met."""
    lead = F.regexp_replace(clean_reference(text), r"\A\[?\d+\]?\.?\s*", "")
    head = F.coalesce(F.nullif(F.regexp_extract(lead, r"\A(.*?)\.\s+[^.]*\(\d{4}\)[^.]*\.?\s*\z", 1), F.lit("")), lead)
    return F.trim(F.regexp_replace(head, r"\A(?:\s*(?:and\s+)?(?:[A-Z]\.[- ]?){1,4}[A-Z][A-Za-z'’.\-]+\s*,\s*)+", ""))


def overlap(tokens: Column, text: Column) -> Column:
    """Share of the tokens that stand in the text; null for no tokens."""
    low = F.lower(text)
    return F.size(F.filter(tokens, lambda t: low.contains(t))) / F.nullif(F.size(tokens), F.lit(0))


def article_type(types: Column) -> Column:
    """review, original or other, by the publication types."""
    low = F.transform(F.coalesce(types, F.array().cast("array<string>")), F.lower)
    return F.when(F.exists(low, lambda t: t.contains("review")), "review").when(F.exists(low, lambda t: t.contains("journal article")), "original").otherwise("other")


def is_review_type(types: Column) -> Column:
    """Reviews and meta-analyses."""
    return F.coalesce(F.exists(F.transform(types, F.lower), lambda t: t.contains("review") | t.contains("meta-analysis")), F.lit(False))


def citation_label(authors: Column, year: Column, number: Column) -> Column:
    """First word of the first author and the year, 'RefN' and 'n.d.' standing in for what is missing."""
    fallback = F.concat(F.lit("Ref"), F.coalesce(number.cast("string"), F.lit("")))
    name = F.regexp_replace(either(F.trim(F.substring_index(authors, ",", 1)), fallback), r"(?i)\bet\s+al\.?\z", "")
    word = F.regexp_extract(F.trim(F.regexp_replace(name, r"[^\p{L}\p{N}\s-]", "")), r"\A(\S+)", 1)
    return F.concat(either(word, fallback), either(F.regexp_extract(F.coalesce(year, F.lit("")), r"(\d{4})", 1), F.lit("n.d.")))


def citation_base(author: Column, year: Column, fallback: Column) -> Column:
    """Surname, its first letter upper-cased, and year; the fallback without both."""
    apart = F.trim(F.regexp_replace(F.regexp_replace(author, r"([a-z])([A-Z])", "$1 $2"), r"(?i)\b(?:MD|PhD|MSc|FRCS|MBA|DO|DDS|DVM)\b\.?", ""))
    name = F.when(apart.contains(","), F.substring_index(apart, ",", 1)).otherwise(F.element_at(F.split(apart, r"\s+"), -1))
    name = F.regexp_replace(F.coalesce(name, F.lit("")), r"[^A-Za-z0-9-]", "")
    base = F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 2**30), F.coalesce(year, F.lit("")))
    spare = F.regexp_replace(fallback, r"(?i)-(?:sciencedirect|direct)\z", "")
    return either(F.regexp_replace(base, r"[^A-Za-z0-9_.-]", ""), spare, F.lit("Article"))


def base_of_set(set_id: Column) -> Column:
    """A set's id without the number that tells repeated ones apart."""
    return F.regexp_replace(set_id, r"-\d+\z", "")


def safe_id(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_.-]", "")


def citation_info(text: Column, pubmed: Column) -> Column:
    """STRUCT<authors, year, journal, title>: from the pubmed entry, else guessed from the text."""
    parts = F.split(F.regexp_replace(text, r"\A\[\d+\]\s*", ""), r"\.")
    part = lambda i: F.trim(F.coalesce(F.get(parts, i), F.lit("")))
    guess_year = either(F.regexp_extract(text, r"\((\d{4})\)", 1), F.regexp_extract(text, r"(\d{4})", 1))
    own = lambda known, guess: F.when(pubmed.isNotNull(), F.coalesce(known, F.lit(""))).otherwise(guess)
    return F.struct(
        own(F.try_element_at(pubmed["authors"], F.lit(1)), F.substring(F.trim(F.substring_index(part(0), ",", 1)), 1, 50)).alias("authors"),
        own(pubmed["pub_year"], guess_year).alias("year"),
        own(pubmed["journal"], F.substring(part(1), 1, 100)).alias("journal"),
        own(pubmed["title"], F.substring(part(0), 1, 150)).alias("title"),
    )


def cited_numbers(text: Column) -> Column:
    """Numbers of in-text citations '[1, 4-6]', ranges written out (those over 200 long keep their ends), distinct, in order."""
    groups = F.regexp_extract_all(text, F.lit(r"\[(\d{1,4}(?:\s*[,;–—-]\s*\d{1,4})*)\]"), 1)
    parts = F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*[,;]\s*")))

    def numbers(p: Column) -> Column:
        ends = F.transform(F.split(p, r"\s*[–—-]\s*"), lambda x: x.cast("int"))
        a, b = F.element_at(ends, 1), F.element_at(ends, -1)
        return F.when((a <= b) & (b - a <= 200), F.sequence(a, F.greatest(a, b))).otherwise(F.array(a, b))

    return F.array_distinct(F.flatten(F.transform(parts, numbers)))


#: Fixed value: the publisher whose lists carry links that are cleaned away.
LINKED_PUBLISHER = "Springer Science and Business Media LLC"


def of_linked_publisher(publisher: Column) -> Column:
    """Whether a note's lists are to be freed of links: its publisher, trimmed, is exactly that one."""
    return F.coalesce(F.trim(publisher) == LINKED_PUBLISHER, F.lit(False))
