"""Text functions.  Column expressions where Spark has the parts, one Arrow batch function for Unicode folding.

F1 normalize_space, F2 fold, F4 trigrams, F5 jaccard, F7 sentence_case, F8
to_boolean, F12 html_text, F13 fold_passage, F14 clean_passage, F16 graphemes,
F20 transliteration, F21 clean_file, F23 quote_xml, F34 squeeze.
"""

from __future__ import annotations

import html.parser
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# ---- Column expressions


def squeeze(c: Column) -> Column:
    """runs of white space (any of Unicode's) as one space."""
    return F.regexp_replace(c, r"(?U)\s+", " ")


def normalize_space(c: Column) -> Column:
    """F1."""
    return F.trim(squeeze(c))


def trigrams(c: Column) -> Column:
    """the distinct substrings of three code points; none of shorter texts (``sequence`` would count down)."""
    # By characters' array: a substring is found by counting from the start of the text, which is quadratic.
    listed = lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - 3), lambda i: F.concat(x[i], x[i + 1], x[i + 2]))
    found = F.transform(F.array(F.split(c, "")), listed)[0]
    return F.when(F.length(c) >= 3, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """of two trigram sets; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def sentence_case(c: Column) -> Column:
    """the first word capitalised, all else as it is."""
    first = F.regexp_extract(c, r"^\s*(\S*)", 1)
    return F.concat(F.initcap(first), F.substr(F.ltrim(c), F.length(first) + 1))


def to_boolean(c: Column, default: bool | None = None) -> Column:
    """F8."""
    low = F.lower(F.trim(c))
    return F.when(low.isin("true", "yes", "on", "1"), True).when(low.isin("false", "no", "off", "0"), False).otherwise(F.lit(default))


def quote_xml(c: Column) -> Column:
    """F23."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def quote_html(c: Column) -> Column:
    """As F23, and the apostrophe."""
    return F.replace(quote_xml(c), F.lit("'"), F.lit("&#x27;"))


def graphemes(c: Column) -> Column:
    """F16: extended grapheme clusters."""
    return F.regexp_extract_all(c, F.lit(r"(\X)"), F.lit(1))


def glob(c: Column, pattern: str) -> Column:
    """P5: case-sensitive GLOB with ``*``, ``?`` and ``[...]`` (``[^...]`` negates)."""
    return c.rlike(glob_regex(pattern))


def glob_regex(pattern: str) -> str:
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        end = pattern.find("]", i + 2) if ch == "[" else -1
        if end > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[{inner}]")
            i = end
        else:
            out.append({"*": "(?s:.*)", "?": "(?s:.)"}.get(ch, re.escape(ch)))
        i += 1
    return rf"\A{''.join(out)}\z"


# ---- plain functions, and Arrow batch functions around them

ARRAY_GAP = "!!!!!"  # fixed value: keeps matches from crossing elements


def fold_text(s: str | list[str] | None) -> str:
    """searchable form: no combining marks, case folded, œ æ đ spelled out."""
    if s is None:
        return ""
    if not isinstance(s, str):
        s = ARRAY_GAP.join(s)
    if s.isascii():
        return s.lower().strip()
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).casefold()
    return unicodedata.normalize("NFC", s.replace("œ", "oe").replace("æ", "ae").replace("đ", "d").strip())


#: Spellings of one sound, longest first.
PASSAGE_SPELLINGS = [("r̥̄", "ṝ"), ("l̥̄", "ḹ"), ("r̥", "ṛ"), ("l̥", "ḷ"), ("m̐", "ṃ"), ("ṁ", "ṃ")]


def fold_passage_text(s: str) -> str:
    """lower case, one spelling of each sound, letters, marks and spaces only; an apostrophe stands for ``a``."""
    s = s.lower()
    for spelling, chosen in PASSAGE_SPELLINGS:
        s = s.replace(spelling, chosen)
    kept = ("a" if c == "’" else c for c in s if c == "’" or c.isspace() or c.isalpha() or unicodedata.combining(c))
    return "".join(kept).strip()


# Editorial numbers in brackets; punctuation that goes, and characters with another spelling.
_BRACKETS = re.compile(r"\[\d+.*?\]")
_PUNCTUATION = str.maketrans({**dict.fromkeys("◉◆“”.+\\,|/\"॥।*!"), "_": " ", "ә": "ə", "'": "’", "ʼ": "’"})


def clean_passage_text(s: str) -> str:
    """no editorial marks, one kind of apostrophe, single spaces."""
    s = _BRACKETS.sub("", unicodedata.normalize("NFC", s)).replace("[]", "")
    return " ".join(s.translate(_PUNCTUATION).split())


def clean_file_text(s: str) -> str:
    """no byte-order mark, no trailing blanks or blank edges, one final line feed, NFC."""
    lines = [x.rstrip() for x in s.removeprefix("﻿").splitlines()]
    while lines and not lines[-1]:
        lines.pop()
    while lines and not lines[0]:
        lines.pop(0)
    return unicodedata.normalize("NFC", "".join(x + "\n" for x in lines)).replace("ә", "ə")


class _Text(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def html_text_of(s: str | None) -> str:
    """what is left of markup without its tags."""
    parser = _Text()
    parser.feed(s or "")
    parser.close()
    return "".join(parser.parts)


# Scripts by the start of their letters' names; clusters of Latin letters that have no script but are in order.
SCRIPT_NAMES = ("TAMIL", "TELUGU", "KHMER", "DEVANAGARI", "GRANTHA", "KANNADA", "BALINESE")
VALID_CLUSTERS = (
    "r\u0325", "L\u0325", "R\u0325", "m\u0303", "ə\u0304", "l\u0325", "m\u0310",
    "r\u0325\u0304", "L\u0325\u0304", "R\u0325\u0304", "l\u0325\u0304", "n\u0306",
)
#: The one Cyrillic letter that counts as valid.
CYRILLIC_SCHWA = "ә"


@lru_cache(maxsize=None)
def letters_named(start: str) -> str:
    """A regular expression's class of all characters whose names begin with ``start`` and a space."""
    at = [c for c in range(0x80, 0x1F000) if unicodedata.name(chr(c), "").startswith(start + " ")]
    edges = [(g[0], g[-1]) for g in _stretches(at)]
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in edges) + "]"


def _stretches(numbers: list[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for n in numbers:
        if out and out[-1][-1] == n - 1:
            out[-1].append(n)
        else:
            out.append([n])
    return out


def script(c: Column) -> Column:
    """the script that all of a cluster's characters belong to by their names, in upper case; else null."""
    out = F.lit(None).cast("string")
    for name in reversed(SCRIPT_NAMES):
        out = F.when(c.rlike(rf"\A{letters_named(name)}+\z"), name).otherwise(out)
    return out


def is_valid_cluster(c: Column) -> Column:
    """a single character must not be Cyrillic (but for the small schwa); several need one script, or be in the list; in NFC."""
    single = (c == CYRILLIC_SCHWA) | ~c.rlike(letters_named("CYRILLIC"))
    return F.when(F.length(c) == 1, single).otherwise(script(c).isNotNull() | c.isin(*VALID_CLUSTERS))


def char_name_of(c: str) -> str:
    return unicodedata.name(c, f"U+{ord(c):04X}")


# Tamil letters and what stands for each; the vowel a is what a consonant has without a sign.
TAMIL_INHERENT = "அ"
TAMIL_VOWELS = {"அ": "a", "ஆ": "ā", "இ": "i", "ஈ": "ī", "உ": "u", "ஊ": "ū", "எ": "e", "ஏ": "ē", "ஐ": "ai", "ஒ": "o", "ஓ": "ō", "ஔ": "au"}
TAMIL_SIGNS = {"ா": "ā", "ி": "i", "ீ": "ī", "ு": "u", "ூ": "ū", "ெ": "e", "ே": "ē", "ை": "ai", "ொ": "o", "ோ": "ō", "ௌ": "au"}
TAMIL_CONSONANTS = {
    "க": "k", "ங": "ṅ", "ச": "c", "ஜ": "j", "ஞ": "ñ", "ட": "ṭ", "ண": "ṇ", "த": "t", "ந": "n", "ன": "ṉ", "ப": "p", "ம": "m",
    "ய": "y", "ர": "r", "ற": "ṟ", "ல": "l", "ள": "ḷ", "ழ": "ḻ", "வ": "v", "ஶ": "ś", "ஷ": "ṣ", "ஸ": "s", "ஹ": "h",
}
TAMIL_OTHERS = {"ஂ": "ṃ", "ஃ": "ḥ", "ௐ": "oṃ", **dict(zip("௦௧௨௩௪௫௬௭௮௯", "0123456789", strict=True)), "௰": "10", "௱": "100", "௲": "1000"}
TAMIL_VIRAMA = "்"


def tamil_to_latin(c: Column) -> Column:
    """a consonant has the vowel a unless a sign or the virama follows; what is no Tamil letter stays."""
    voiced = F.regexp_replace(c, f"([{''.join(TAMIL_CONSONANTS)}])(?![{''.join(TAMIL_SIGNS)}{TAMIL_VIRAMA}])", f"$1{TAMIL_INHERENT}")
    every = TAMIL_VOWELS | TAMIL_SIGNS | TAMIL_CONSONANTS | TAMIL_OTHERS
    for letter, latin in every.items():
        if len(latin) > 1:
            voiced = F.replace(voiced, F.lit(letter), F.lit(latin))
    single = {k: v for k, v in every.items() if len(v) == 1}
    return F.translate(voiced, "".join(single) + TAMIL_VIRAMA, "".join(single.values()))


class Batched:
    """A string function as a Column function; the Arrow function is made when first used, as that takes a session."""

    def __init__(self, function):
        self.function, self._udf = function, None

    @property
    def udf(self):
        if self._udf is None:
            function = self.function

            def run(s: pd.Series) -> pd.Series:
                return s.map(function)

            self._udf = pandas_udf(run, "string")
        return self._udf

    def __call__(self, c: Column) -> Column:
        return self.udf(c)


def _null_safe(function):
    return lambda s: None if s is None else function(s)


fold = Batched(fold_text)
fold_passage = Batched(_null_safe(fold_passage_text))
clean_passage = Batched(_null_safe(clean_passage_text))
clean_file = Batched(_null_safe(clean_file_text))
html_text = Batched(html_text_of)
nfc = Batched(_null_safe(lambda s: unicodedata.normalize("NFC", s)))
char_names = Batched(_null_safe(lambda s: ", ".join(map(char_name_of, s))))


def register(spark) -> None:
    """UD: the functions under their names in SQL; those that are expressions are made SQL functions, so the optimiser sees through them."""
    for name, function in (("fold", fold), ("fold_passage", fold_passage), ("clean_passage", clean_passage), ("clean_file", clean_file), ("html_text", html_text), ("nfc", nfc)):
        spark.udf.register(name, function.udf)
    grams = "case when length({0}) >= 3 then array_distinct(transform(sequence(1, length({0}) - 2), i -> substring({0}, i, 3))) else cast(array() as array<string>) end"
    a, b = grams.format("a"), grams.format("b")
    both = f"size(array_intersect({a}, {b}))"
    spark.sql(f"create or replace temporary function jaccard(a string, b string) returns double return case when length(a) < 3 and length(b) < 3 then 0.0D else {both} / (size({a}) + size({b}) - {both}) end")
    spark.sql(r"create or replace temporary function page_from_url(url string) returns int return try_cast(nullif(regexp_extract(url, r'[?&]page=(\d+)', 1), '') as int)")
    quoted = "replace(replace(url_encode(printf(format, a)), '%2F', '/'), '%3A', ':')"
    spark.sql(f"create or replace temporary function format_url(format string, a string) returns string return replace({quoted}, '+', '%20')")
