"""E-mail addresses: detection, decoding and what is no real address."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trawlkit.functions import rules
from trawlkit.functions.rules import java
from trawlkit.functions.session import once


def found_emails(text: Column, pattern: str = rules.EMAIL) -> Column:
    """All addresses in scan-safe text, in order."""
    # a text without the sign holds no address, and most texts have none
    return F.when(text.contains("@"), F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(0))).otherwise(F.array().cast("array<string>"))


def is_email(value: Column) -> Column:
    return value.rlike(r"(?i)^(?:" + rules.EMAIL + r")\z")


def false_email(value: Column) -> Column:
    """Asset names, build hashes, placeholder domains, impossible endings; ``value`` is lower-case."""
    local = F.regexp_extract(value, r"^(.*)@", 1)
    domain = F.substring_index(value, "@", -1)
    placeholder = F.lit(False)
    for blocked in rules.PLACEHOLDER_DOMAINS:
        placeholder = placeholder | (domain == blocked) | domain.endswith("." + blocked)
    return value.rlike(java(rules.ASSET_TAIL)) | (F.length(local) > 64) | local.rlike("[0-9a-f]{24}") | placeholder | ~F.substring_index(domain, ".", -1).rlike(r"^[a-z]{2,24}\z")


def mailto_address(href: Column) -> Column:
    from trawlkit.functions.text import percent_decoded

    return F.trim(F.substring_index(percent_decoded(F.regexp_replace(href, java(rules.MAILTO), "")), "?", 1))


def decoded_cfemail(code: Column) -> Column:
    """Addresses written as hex bytes, each combined with the first byte by exclusive or; null if no such code."""
    number = lambda two: F.conv(two, 16, 10).cast("int")
    cut = F.struct(F.regexp_extract_all(code, F.lit("[0-9a-fA-F]{2}"), F.lit(0)).alias("bytes"), number(F.substring(code, 1, 2)).alias("key"))
    text = once(cut, lambda c: F.array_join(F.transform(F.slice(c["bytes"], 2, F.size(c["bytes"]) - 1), lambda two: F.chr(number(two).bitwiseXOR(c["key"]))), ""))
    return F.when(code.rlike("^(?:[0-9a-fA-F]{2}){2,}$"), text)


#: What a disguised address cannot do without; other texts need no second look.
DISGUISE = java("[" + "".join(rules.LOOKALIKES) + r"]|&|[\[({]\s*(?:arobase|at|dot|punkt)\s*[\])}]|\sdot\s|\sat\s+\S+\.\w")
_BRACKET_AT = re.compile(r"\s*[\[({]\s*(?:arobase|at)\s*[\])}]\s*", re.I)
_BRACKET_DOT = re.compile(r"\s*[\[({]\s*(?:punkt|dot)\s*[\])}]\s*", re.I)
_PIECE = r"[\w@]+"
_WORDY = f"{_PIECE}(?:[.+-]{_PIECE})*"
_SPELLED = re.compile(rf"{_WORDY}(?:\s+(?:dot|at)\s+{_WORDY})+", re.I)
_FULL = re.compile(rules.EMAIL, re.I | re.A)


def _spelled_out(m: re.Match) -> str:
    whole = m[0]
    for word, sign in (("at", "@"), ("dot", ".")):
        whole = re.sub(rf"(?<=\w)\s+{word}\s+(?=\w)", sign, whole, flags=re.I)
    return whole if _FULL.fullmatch(whole) else m[0]


def plain_address_text(text: str) -> str:
    """Look-alike signs, bracketed and spelled-out ``at`` and ``dot`` undone."""
    text = html.unescape(text).translate(str.maketrans(rules.LOOKALIKES))
    text = _BRACKET_DOT.sub(".", _BRACKET_AT.sub("@", text))
    return _SPELLED.sub(_spelled_out, text)


@F.pandas_udf(T.StringType())
def deobfuscated(texts: pd.Series) -> pd.Series:
    """:func:`plain_address_text`; the spelled-out form is kept only if it all becomes an address, which no expression can say."""
    return texts.map(plain_address_text, na_action="ignore")


def email_bonus(value: Column, site_domain: Column) -> Column:
    """4 for the site's own domain, 1 for a generic mailbox, -2 for free mail."""
    from trawlkit.functions.urls import registrable_host

    host = F.substring_index(value, "@", -1)
    own = registrable_host(host)
    free = F.substring_index(own, ".", 1).isin(*rules.FREE_MAIL) | own.isin(*rules.FREE_MAIL_DOMAINS)
    return F.when((own != "") & (own == site_domain), 4).otherwise(0) + F.when(F.regexp_extract(value, "^(.*)@", 1).isin(*rules.GENERIC_LOCALS), 1).otherwise(0) - F.when(free, 2).otherwise(0)
