"""Text of html and of tokens, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawlkit.functions import rules
from trawlkit.functions.rules import java

_SILENT = "|".join(sorted(rules.SILENT_TAGS))
_BLOCK = "|".join(sorted(rules.BLOCK_TAGS))
#: (pattern, replacement) in order; read alike by Java and RE2.
FLATTEN = (
    (r"(?s)<!--.*?-->", ""),
    *((rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", "") for t in sorted(rules.SILENT_TAGS)),
    (r"(?i)<br\b[^>]*>", "\n"),
    (rf"(?i)</?(?:{_BLOCK})\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
)
ENTITIES = (("&nbsp;?", " "), ("&middot;?", "·"), ("&copy;?", "©"), ("&quot;?", '"'), ("&lt;?", "<"), ("&gt;?", ">"), ("&#0*39;?", "'"), ("&amp;?", "&"))
SQUEEZE = (("[ \t ]+", " "), (" ?\n ?", "\n"), ("\n{2,}", "\n"))


def html_text(html: Column) -> Column:
    """Flattened text: block elements break lines, inline ones join; for markup without nested silent elements."""
    for pattern, by in (*FLATTEN, *ENTITIES, *SQUEEZE):
        html = F.regexp_replace(html, pattern, by)
    return F.regexp_replace(html, r"^\s+|\s+$", "")


def unescape_basic(text: Column) -> Column:
    plain = text
    for pattern, by in ENTITIES:
        plain = F.regexp_replace(plain, pattern, by)
    return F.when(text.contains("&"), plain).otherwise(text)


def scan_safe(text: Column) -> Column:
    """Without tokens too long to be contact data; they would make the patterns backtrack."""
    return F.regexp_replace(text, rf"(?U)\S{{{rules.LONG_TOKEN + 1},}}", " ")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def percent_decoded(text: Column) -> Column:
    """Percent-codes undone; plus signs stay, broken codes leave the text as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def fold_accents(text: Column) -> Column:
    """Letters without their accents, for exports that ask for plain English letters."""
    marked = "áàâäãåāăąçćčďđéèêëēėęěíìîïīįłñńňóòôöõøōőŕřśšșťțúùûüūůűųýÿžźż"
    plain = "aaaaaaaaacccddeeeeeeeeiiiiiilnnnoooooooorrsssttuuuuuuuuyyzzz"
    assert len(marked) == len(plain)
    return F.translate(text, marked + marked.upper(), plain + plain.upper())


def in_any(text: Column, words) -> Column:
    return text.rlike(java("|".join(words)))
