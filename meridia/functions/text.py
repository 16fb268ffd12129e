"""Small text functions of manifests, workflow graphs and drawings."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Socket type aliases and units with their metres.
SOCKET_ALIASES = {"BOOL": "BOOLEAN", "MODEL_PATCH": "MODEL"}
METRES = {"millimeter": 0.001, "centimeter": 0.01, "meter": 1.0, "kilometer": 1000.0, "inch": 0.0254, "foot": 0.3048}


def ascii_lower(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def normalised(text: Column) -> Column:
    """Trimmed, A-Z folded."""
    return ascii_lower(F.trim(text))


def upload_date(text: Column) -> Column:
    """The digits if there are just eight, else NULL."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(digits) == 8, digits)


def item_id(text: Column) -> Column:
    """Letters, digits, - and _; other runs become one -, none at the ends; "collection" if nothing is left."""
    squeezed = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_-]+", "-"), "-+", "-")
    bare = F.regexp_replace(squeezed, "^-+|-+$", "")
    return F.when(bare == "", "collection").otherwise(bare)


def source_url(*candidates: Column, fallback: Column) -> Column:
    """The first http(s) address, or a built one."""
    return F.coalesce(*(F.when(c.rlike("^https?://"), c) for c in candidates), fallback)


def frame_number(name: Column) -> Column:
    """The last run of digits, or NULL."""
    return F.try_element_at(F.regexp_extract_all(name, F.lit("([0-9]+)"), F.lit(1)), F.lit(-1)).try_cast("long")


def socket_type(text: Column) -> Column:
    upper = F.upper(F.trim(text))
    known = F.create_map(*(F.lit(v) for v in chain.from_iterable(SOCKET_ALIASES.items())))
    return F.coalesce(F.try_element_at(known, upper), upper)


def short_number(value: Column) -> Column:
    """Three decimals without trailing zeros."""
    text = F.regexp_replace(F.format_string("%.3f", value), r"\.?0+$", "")
    return F.when(text.isin("-0", ""), "0").otherwise(text)


def escape_xml(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def shell_quote(text: Column) -> Column:
    """Quoted unless all characters are plain."""
    plain = text.rlike(r"^[A-Za-z0-9_./:=+-]+$")
    inner = F.replace(text, F.lit("'"), F.lit("'\\''"))
    return F.when(plain, text).otherwise(F.concat(F.lit("'"), inner, F.lit("'")))


def query_escape(text: Column) -> Column:
    """Form encoding that leaves letters, digits and - _ . ~."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def metres_per_unit(unit: Column) -> Column:
    table = F.create_map(*(F.lit(v) for v in chain.from_iterable(METRES.items())))
    return F.try_element_at(table, unit)


def is_red(r: Column, g: Column, b: Column, colour: Column) -> Column:
    """Said to be red, or clearly so by its mean colour."""
    return F.coalesce(F.lower(colour) == "red", F.lit(False)) | ((r >= 96) & (r >= 1.35 * g) & (r >= 1.35 * b))
