"""Text quality: counts of each text, and which texts are lists, tables or junk and not prose.

A text falls into units: runs of lines of one layout between blank lines. Each unit gives a
distribution of its characters over classes (letters in function words, in other words by their
case, digits, sentence ends, separators, brackets, scripts, ...). The unit takes the nearest of
the structural profiles below by Jensen-Shannon divergence, and a text is no prose if more than
half of the characters of its units lie in units of profiles that are lists, tables or junk.

Defined results: null and blank texts have counts of 0, ratios of null, no profile, and are no
case; every row gives one row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of the corpus languages that are written with spaces.
FUNCTION_WORDS = {
    "en": """the of and in to a is was were that for with by on at from as it not be are this which or an but no when than both had has who each
        all since whether so other more can only under does did do they we our their its into between after although because if while where these
        those been have may might would could should there here what why how""",
    "de": """der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei
        einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wurden jedoch keine beim""",
    "fr": """de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux été mais chez entre après
        ou cette ces nous leur sans comme était ont""",
    "es": """de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha sin sobre este entre cuando muy desde
        todo nos durante fue estos esta ambos""",
}
#: Frequent particles and endings of Japanese, as runs of hiragana between other signs.
JAPANESE_WORDS = """の は が を に で と も へ や か から まで より など には では とは でも にも この その これ それ ある いる する した して される された されている
    である であった です ます ました ない また および ため こと もの よう として において による により における について"""
_WORDS = frozenset(w for words in FUNCTION_WORDS.values() for w in words.split())
#: Frequent function words of further languages, so that their prose has the same shape; no document of the corpus is in one of these.
OTHER_WORDS = {
    "it": "il lo la i gli le un uno una di del della dei delle da dal in nel nella con su per tra fra e o ma che non è sono stata stato stati ha hanno si come più anche al alla",
    "pt": "o a os as um uma de do da dos das em no na nos nas com por para e ou mas que não é são foi foram há se como mais ao à pelo pela também",
    "nl": "de het een en of maar van in op te ten met voor door bij uit naar dat die dit is zijn was werd werden niet ook aan als om nog er twee",
    "pl": "i w z na do od po przez dla nie się jest są był było oraz ale że który która które jak to o a między przed ich",
    "ru": "и в во на с со не что он она они к по за из от для как это был была было были а но же у до при между в течение",
    "el": "ο η το οι τα των του της και σε στο στη στην στις με για από που δεν είναι ήταν ένα μια δύο ως τον την",
    "sv": "och i att det som en ett på är av för med den till inte om har de var från men vid under",
    "tr": "ve bir bu için ile de da ne o gibi daha çok olarak olan ise ya en kadar sonra",
}
_PROSE_WORDS = _WORDS | frozenset(w for words in OTHER_WORDS.values() for w in words.split() if len(w) > 1)

CLASSES = ("fw", "low", "cap", "code", "num", "end", "comma", "colon", "sep", "brk", "sym", "kana", "han", "high", "line", "mark")
_AT = {name: i for i, name in enumerate(CLASSES)}


@lru_cache(maxsize=1)
def _table() -> np.ndarray:
    """Class of each code point: letters of words get 255 (they are counted by word), blanks 254."""
    import sys

    out = np.full(sys.maxunicode + 1, _AT["sym"], np.uint8)
    for c in range(0x3400):
        kind = unicodedata.category(chr(c))
        if kind[0] in "LM":
            out[c] = 255
        elif kind[0] == "N":
            out[c] = _AT["num"]
        elif kind[0] in "ZC":
            out[c] = 254
    out[0x80:0xC0][out[0x80:0xC0] != 254] = _AT["high"]
    out[0x80:0xA0] = _AT["high"]
    out[0x3040:0x3100], out[0x3400:0xA000], out[0xF900:0xFB00] = _AT["kana"], _AT["han"], _AT["han"]
    out[0xA000:0xD7A4] = 255
    for name, chars in (("end", ".!?。…！？।؟"), ("comma", ",;、；،"), ("colon", ":=："), ("sep", "|\t"), ("brk", "()[]{}<>「」（）"), ("line", "\n")):
        for ch in chars:
            out[ord(ch)] = _AT[name]
    return out


@lru_cache(maxsize=1)
def _patterns():
    import regex

    return (
        regex.compile(r"[\p{L}--[\p{Han}\p{Hiragana}\p{Katakana}]][\p{L}\p{M}'’]*", regex.V1).findall,
        regex.compile(r"\r\n?|[  \x85]").sub,
        regex.compile(r"\s*(?:[-*•–+]|\(?\d{1,3}[.)]|\[\d{1,3}\])\s").match,
        regex.compile(r"[\uff21-\uff5a]").search,
    )


def _structured(line: str) -> bool:
    """A line that begins as a list item, or has cells."""
    if _patterns()[2](line):
        return True
    return "\t" in line or "  " in line.strip() or "...." in line or line.count(",") - line.count(", ") > 1 or line.count("|") > 1 or "<t" in line


def units(text: str) -> list[str]:
    """Runs of lines of one layout between blank lines."""
    out: list[str] = []
    run: list[str] = []
    flag = False
    for line in _patterns()[1]("\n", text).split("\n"):
        if line.isspace() or not line:
            if run:
                out.append("\n".join(run))
            run = []
            continue
        own = _structured(line)
        if run and own != flag:
            out.append("\n".join(run))
            run = []
        flag = own
        run.append(line)
    if run:
        out.append("\n".join(run))
    return out


def distribution(unit: str) -> np.ndarray:
    """Shares of the classes among the unit's characters that are not blank."""
    if _patterns()[3](unit):
        unit = unicodedata.normalize("NFKC", unit)
    codes = np.frombuffer(unit.encode("utf-32-le", "replace"), np.uint32)
    count = np.bincount(_table()[codes], minlength=256)[: len(CLASSES)].astype(float)
    fw = low = cap = code = 0
    for w in _patterns()[0](unit):
        n = len(w)
        if w.lower() in _PROSE_WORDS:
            fw += n
        elif w.islower() or not (n > 1 and w[0] != w[0].lower()) and w == w.lower() and not w.isascii():  # scripts without cases, too
            low += n
        elif n == 1 or w[1:].islower():
            cap += n
        else:
            code += n
    count[:4] += fw, low, cap, code
    count[_AT["sep"]] += unit.count("  ")
    return count / max(count.sum(), 1)


#: Shares of the classes in units of each structural profile, in hundredths, as measured on such units.
PROFILES = {
    "prose": [
        "low 64 fw 23 cap 5 num 3 code 2 end 2 comma 1", "low 60 fw 24 num 5 cap 4 code 3 end 2 comma 1 brk 1", "low 67 fw 18 cap 8 num 3 end 2 comma 1 brk 1",
        "low 79 fw 16 num 2 end 1 comma 1", "low 49 fw 25 num 9 cap 9 code 4 end 2 brk 1", "low 54 fw 20 num 10 cap 5 end 4 code 3 brk 2", "low 57 fw 36 comma 2 num 2 end 2",
        "cap 34 low 31 fw 26 num 4 code 3 end 1 comma 1", "low 46 num 19 fw 16 end 7 brk 3 cap 3 comma 3 high 2", "low 26 cap 23 num 18 fw 18 end 6 brk 3 comma 2 high 2 code 2",
        "low 38 cap 17 num 17 fw 17 end 6 brk 3 comma 2",
        "low 92 cap 3 end 3 comma 2", "low 95 end 3 comma 2",
        "kana 31 han 26 low 16 code 12 num 6 cap 5 end 2 comma 2", "kana 45 han 38 num 6 end 4 comma 4", "code 72 fw 20 num 3 end 2 comma 2",
    ],
    "markup": ["cap 24 low 18 sym 16 code 13 num 9 brk 8 line 7 colon 6", "cap 85 sym 15"],
    "list": [
        "low 71 num 9 code 6 sym 4 line 4 cap 2 colon 1 brk 1", "low 70 code 8 num 6 sym 4 colon 3 line 3 cap 3", "cap 37 num 26 brk 25 line 6 sym 3 low 2",
        "cap 34 low 29 num 13 fw 9 end 4 code 3 comma 3 brk 2", "low 40 cap 25 num 14 fw 9 end 5 comma 3 brk 2", "low 58 cap 20 fw 12 line 5 end 3 sym 2",
        "low 50 cap 20 fw 11 num 6 brk 4 line 4 end 3 comma 2", "cap 73 low 16 comma 4 sym 4 num 2 brk 1", "end 56 cap 23 low 12 num 6 line 3",
    ],
    "table": [
        "num 33 low 28 end 14 sep 11 comma 4 line 3 code 3 high 3", "num 32 low 30 end 14 comma 13 line 4 code 3 high 3", "sep 41 num 23 low 19 end 10 line 2 code 2 high 2",
        "low 62 num 14 colon 8 end 6 line 5 high 2", "low 42 brk 29 num 12 sym 7 end 5 line 1", "low 40 num 20 sep 18 sym 12 end 6 line 2", "low 53 sep 26 num 13 end 6 line 1",
        "low 85 comma 12 line 2",
    ],
    "junk": [
        "code 72 num 11 cap 6 low 5 sym 3 line 1", "cap 24 code 19 num 16 sym 13 brk 12 low 7", "low 48 cap 30 fw 12 line 5 sym 3", "cap 46 low 34 fw 10 sep 9", "num 100", "fw 92 low 8", "low 98 cap 2",
        "low 55 sym 12 comma 8 end 8 sep 5 colon 5 num 4 fw 3", "sym 58 low 26 code 8 cap 5", "sym 98", "end 98", "high 57 low 36 num 3 code 2 cap 2",
    ],
}
#: Profiles whose characters count against a text.
AGAINST = ("list", "table", "junk")


@lru_cache(maxsize=1)
def _profiles() -> tuple[list[str], np.ndarray]:
    names, rows = [], []
    for name, lines in PROFILES.items():
        for line in lines:
            words = line.split()
            row = np.zeros(len(CLASSES))
            row[[_AT[w] for w in words[::2]]] = [float(x) for x in words[1::2]]
            names.append(name)
            rows.append(row / row.sum())
    return names, np.array(rows)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergences (units, profiles), in bits."""
    entropy = lambda x: -np.where(x > 0, x * np.log2(np.where(x > 0, x, 1)), 0).sum(-1)
    return entropy((p[:, None] + q[None]) / 2) - (entropy(p)[:, None] + entropy(q)[None]) / 2


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names, rows = _profiles()
    kinds = list(PROFILES)
    kind_of = np.array([kinds.index(n) for n in names])
    for pdf in batches:
        for at in range(0, len(pdf), 500):
            part = pdf.iloc[at : at + 500]
            split = [units(t) if t else [] for t in part["text"]]
            owner = np.repeat(np.arange(len(split)), [len(u) for u in split])
            weight = np.zeros((len(split), len(kinds)))
            if len(owner):
                shares = np.array([distribution(u) for us in split for u in us])
                nearest = kind_of[divergence(shares, rows).argmin(1)]
                np.add.at(weight, (owner, nearest), [len(u) for us in split for u in us])
            total = weight.sum(1)
            against = weight[:, [kinds.index(k) for k in AGAINST]].sum(1) / np.maximum(total, 1)
            yield pd.DataFrame({
                "k": part["k"], "profile": [kinds[i] if n else None for i, n in zip(weight.argmax(1), total)],
                "no_prose": [float(a) if n else None for a, n in zip(against, total)],
            })


def structure(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, profile, no_prose): the profile with most of the text's characters, and the share of those in lists, tables and junk."""
    kept = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    kind = kept.schema["k"].dataType.simpleString()
    return kept.mapInPandas(_judge, f"k {kind}, profile string, no_prose double").withColumnRenamed("k", key)


def language_profiles(df: DataFrame, text: str, language: str) -> DataFrame:
    """(language, word, share): for each language with a list the distribution of its function words over all of its texts, by the given language column."""
    lists = F.create_map(*(x for name, words in FUNCTION_WORDS.items() for x in (F.lit(name), F.array(*map(F.lit, sorted(set(words.split())))))))
    own = df.select(F.col(language).alias("language"), F.transform(_words(F.coalesce(F.col(text), F.lit(""))), F.lower).alias("w")).where(F.col("language").isin(*FUNCTION_WORDS))
    each = own.select("language", F.explode(F.filter("w", lambda x: F.array_contains(lists[F.col("language")], x))).alias("word"))
    counts = each.groupBy("language", "word").agg(F.count("*").alias("n"))
    total = counts.groupBy("language").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), "language").select("language", "word", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def _nearest_language(profiles: pd.DataFrame, least: int):
    vocabulary = {w: i for i, w in enumerate(sorted(set(profiles["word"])))}
    names = sorted(set(profiles["language"]))
    rows = np.zeros((len(names), len(vocabulary)))
    for name, word, share in profiles.itertuples(index=False):
        rows[names.index(name), vocabulary[word]] = share

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf["text"]:
                own = np.bincount([vocabulary[w] for x in _patterns()[0](t or "") if (w := x.lower()) in vocabulary], minlength=len(vocabulary)).astype(float)
                if own.sum() < least or not names:
                    out.append((None, None))
                    continue
                far = divergence((own / own.sum())[None], rows)[0]
                out.append((names[int(far.argmin())], round(float(far.min()), 6)))
            yield pd.DataFrame({"k": pdf["k"], "language": [o[0] for o in out], "divergence": pd.array([o[1] for o in out], "Float64")})

    return run


def languages(df: DataFrame, key: str, text: str, language: str, least: int = 8) -> DataFrame:
    """(key, language, divergence): the language whose function-word profile, measured on all texts by the language column, is nearest to the text's own words by
    Jensen-Shannon divergence; null for texts with fewer than least function words. The profiles have at most one row for each word of the lists."""
    profiles = language_profiles(df, text, language).toPandas()[["language", "word", "share"]]
    kept = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    kind = kept.schema["k"].dataType.simpleString()
    return kept.mapInPandas(_nearest_language(profiles, least), f"k {kind}, language string, divergence double").withColumnRenamed("k", key)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), 1)


def counts(df: DataFrame, key: str, text: str, language: str | None = "en") -> DataFrame:
    """(key, n_words, mean_word_length, symbol_ratio, end_share, common_share) of each text, all in built-in functions.

    A word is a run of letters or digits; symbols are characters that are none of these and no white space; end_share is of the lines
    that are not blank; common words are the language's function words. Without a
    language they are those of any language; for this share a run of Japanese letters falls into its runs of hiragana and of other signs."""
    common = F.array(*map(F.lit, sorted(set(FUNCTION_WORDS[language].split()) if language else _WORDS | set(JAPANESE_WORDS.split()))))
    split = F.col("_w") if language else _words(F.regexp_replace("_t", r"([\p{IsHan}\p{IsKatakana}ー]+|\p{IsHiragana}+)", " $1 "))
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(F.regexp_replace("_t", r"\r\n?", "\n"), "\n"), lambda x: x.rlike(r"[^ \t\n\f\r]"))
    share = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    return (
        df.select(F.col(key), body.alias("_t")).withColumn("_w", _words(F.col("_t"))).withColumn("_l", lines).withColumn("_c", split)
        .select(
            key, F.size("_w").cast("bigint").alias("n_words"), share(F.char_length(F.array_join("_w", "")), F.size("_w")).alias("mean_word_length"),
            share(F.char_length(F.regexp_replace("_t", r"[\p{L}\p{N}\s]+", "")), F.char_length("_t")).alias("symbol_ratio"),
            share(F.size(F.filter("_l", lambda x: F.rtrim(x).rlike(r"[.!?。]\z"))), F.size("_l")).alias("end_share"),
            share(F.size(F.filter("_c", lambda x: F.array_contains(common, F.lower(x)))), F.size("_c")).alias("common_share"),
        )
    )
