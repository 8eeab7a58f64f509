"""Visible text and fingerprint of a page.

Markup is removed by JVM regular expressions. Only pages that hold a noise element
(whose end depends on nesting) or an unusual entity are sent to Python, in Arrow batches.
"""

from __future__ import annotations

import html as html_lib
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagekin import constants as C

# One tag: quoted attribute values may hold '>'.
_TAG = r"""<[/!?a-zA-Z][^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>"""
_UNSEEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_TO_BODY = r"(?is)^.*?<body\b[^>]*>"
_FROM_BODY_END = r"(?is)</body\s*>.*$"
_HEAD = r"(?is)<head\b.*?</head\s*>"
# Common entities are replaced in the JVM; '&' comes last so that nothing is decoded twice.
_NAMES = "lt gt quot apos nbsp copy reg trade middot bull hellip ndash mdash lsquo rsquo ldquo rdquo laquo raquo amp"
_ENTITIES = {f"&{name};": html_lib.unescape(f"&{name};") for name in _NAMES.split()}
_OTHER_ENTITY = rf"&(?!(?:{_NAMES.replace(' ', '|')});)[#a-zA-Z]"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ATTRIBUTE = re.compile(r"""\b(class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NAME = re.compile(r"</?\s*([a-zA-Z][^\s/>]*)")


def _is_noise(tag: str) -> bool:
    for name, *values in _ATTRIBUTE.findall(tag):
        value = "".join(values)
        if name.lower() == "class":
            if C.NOISE_CLASS_PART in value:
                return True
        elif value in C.NOISE_IDS or C.NOISE_ID_PART in value:
            return True
    return False


def _text_without_noise(markup: str) -> str:
    """Text between tags, leaving out every noise element with all it contains."""
    pieces, at, skipped, depth = [], 0, None, 0
    for match in re.finditer(_TAG, markup):
        if skipped is None:
            pieces.append(markup[at : match.start()])
        at = match.end()
        tag = match.group()
        found = _NAME.match(tag)
        name = found.group(1).lower() if found else ""
        if skipped is not None:
            if name == skipped:
                depth += -1 if tag.startswith("</") else 0 if tag.endswith("/>") else 1
                if depth == 0:
                    skipped = None
        elif not tag.startswith("</") and name not in _VOID and not tag.endswith("/>") and _is_noise(tag):
            skipped, depth = name, 1
    if skipped is None:
        pieces.append(markup[at:])
    return html_lib.unescape(" ".join(pieces))


@F.pandas_udf(T.StringType())
def _noisy_text(markup: pd.Series) -> pd.Series:
    return markup.map(_text_without_noise, na_action="ignore")


#: What is cut out of a page, and texts of which each match holds one, in small letters; most pages have a body.
_CUTS = ((_UNSEEN, " ", ("!--", "script", "style")), (_HEAD, " ", ("head",)), (_TO_BODY, "", ()), (_FROM_BODY_END, "", ()))


def with_body(pages: DataFrame, html: str, name: str) -> DataFrame:
    """Adds the body without comments, scripts and styles; a page without a body tag is all body.

    A pattern with ``signs`` runs only on pages that hold one of them, which a plain search finds faster. No cut makes
    a sign: a space or nothing but the page's end takes its place.
    """
    small = F.lower(html)
    there = {f"_there_{k}": reduce(Column.__or__, [small.contains(sign) for sign in signs])
             for k, (_, _, signs) in enumerate(_CUTS) if signs}
    found = pages.withColumns({name: F.col(html), **there})
    for k, (pattern, by, signs) in enumerate(_CUTS):
        cut = F.regexp_replace(name, pattern, by)
        found = found.withColumn(name, F.when(F.col(f"_there_{k}"), cut).otherwise(F.col(name)) if signs else cut)
    return found.drop(*there)


def with_visible_text(pages: DataFrame, html: str, name: str) -> DataFrame:
    """Adds the visible text. Each step is a column, so that no pattern runs twice on a page."""
    body = F.col("_body")
    entity = body.contains("&") & body.rlike(_OTHER_ENTITY)
    special = body.contains(C.NOISE_CLASS_PART) | body.contains(C.NOISE_IDS[0]) | entity
    plain = F.regexp_replace(body, _TAG, " ")
    decoded = F.col("_plain")
    for name_of, char in _ENTITIES.items():
        decoded = F.replace(decoded, F.lit(name_of), F.lit(char))
    marked = with_body(pages, html, "_body").withColumn("_special", special)
    # The null input keeps ordinary pages out of the Python worker.
    parsed = marked.withColumn("_parsed", _noisy_text(F.when(F.col("_special"), body)))
    plained = parsed.withColumn("_plain", F.when(~F.col("_special"), plain))
    text = F.when(F.col("_special"), F.col("_parsed")).when(~F.col("_plain").contains("&"), F.col("_plain")).otherwise(decoded)
    return plained.withColumn(name, text).drop("_body", "_special", "_parsed", "_plain")


def with_fingerprint(pages: DataFrame, html: str = "html", name: str = "html_sha256") -> DataFrame:
    """Adds the SHA-256 of the visible text, free of the page-load timer and of spacing."""
    text = F.col("_text")
    plain = F.octet_length(text) == F.length(text)  # the spaces of ASCII are a short list
    spaced = F.when(plain, F.regexp_replace(text, r"[\t-\r ]++", " ")).otherwise(F.regexp_replace(text, r"(?U)\s+", " "))
    untimed = F.when(text.contains(C.PAGELOAD_START), F.regexp_replace(text, C.PAGELOAD_TIMER, "")).otherwise(text)
    found = with_visible_text(pages, html, "_text").withColumn("_text", untimed).withColumn("_text", spaced)
    return found.withColumn(name, F.sha2(F.trim("_text"), 256)).drop("_text")


def is_challenge(html: Column) -> Column:
    """Interstitial page returned in place of the content."""
    first, *rest = [html.contains(marker) for marker in C.CHALLENGE_MARKERS]
    for test in rest:
        first = first | test
    return F.coalesce(first, F.lit(False))


@F.pandas_udf(T.StringType())
def gunzip_text(packed: pd.Series) -> pd.Series:
    """Text of gzip bytes written by an earlier system."""
    import gzip

    return packed.map(lambda data: gzip.decompress(data).decode("utf-8"), na_action="ignore")


@F.pandas_udf(T.BinaryType())
def gzip_text(text: pd.Series) -> pd.Series:
    import gzip

    return text.map(lambda value: gzip.compress(value.encode("utf-8"), mtime=0), na_action="ignore")
