"""Text and price clean-up as native columns. Nothing raises; a missing or unreadable value is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode and the four separators that regular expressions of other languages count as well.
BLANK = r"(?U)[\s\x1c-\x1f]"
#: Symbols looked for in a price, in this order, and their currencies.
CURRENCIES = (("£", "GBP"), ("$", "USD"), ("€", "EUR"))
PRICE = r"([^\d\s]*)\s*(\d+(?:[.,]\d+)?)"
TEASER_CHARS, TEASER_END = 40, "...more"


def present(c) -> Column:
    """The string, or NULL if it is empty."""
    return F.nullif(_col(c), F.lit(""))


def stripped(c) -> Column:
    return F.regexp_replace(_col(c), rf"^{BLANK}+|{BLANK}+$", "")


def collapsed(c) -> Column:
    return F.regexp_replace(_col(c), rf"{BLANK}+", " ")


def clean_text(parts) -> Column:
    """Non-empty parts joined by a space, white space collapsed and cut at the ends; NULL if nothing is left."""
    kept = F.filter(_col(parts), lambda p: p.isNotNull() & (p != ""))
    return present(F.trim(collapsed(F.array_join(kept, " "))))


def clean_one(c) -> Column:
    """clean_text of a single string."""
    return present(F.trim(collapsed(_col(c))))


def parse_price(raw) -> Column:
    """STRUCT<price DOUBLE, currency STRING> of the leftmost number and the symbol before it.

    A comma is a decimal point; a number before its symbol has no currency.
    """
    raw = _col(raw)
    amount = present(F.regexp_extract(raw, PRICE, 2))
    symbol = F.regexp_extract(raw, PRICE, 1)
    code = F.coalesce(*(F.when(symbol.contains(s), F.lit(k)) for s, k in CURRENCIES))
    price = F.translate(amount, ",", ".").try_cast("double")
    return F.struct(price.alias("price"), F.when(amount.isNotNull(), code).alias("currency"))


def strip_preview(text) -> Column:
    """The text without a cut teaser before it: it restarts where its first characters come a second time."""
    text = _col(text)
    n = len(TEASER_END)
    body = stripped(F.when(F.endswith(text, F.lit(TEASER_END)), F.left(text, F.length(text) - n)).otherwise(text))
    again = F.call_function("locate", F.left(body, F.lit(TEASER_CHARS)), body, F.lit(2))
    cut = F.when((F.length(body) > 0) & (again > 0), F.substr(body, again)).otherwise(body)
    return present(stripped(cut))


def title_case(c) -> Column:
    """Capitals at the start of every run of letters, small letters elsewhere, as titles have them."""
    runs = F.split(_col(c), r"(?<=\P{L})(?=\p{L})")
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substr(x, F.lit(2))))), "")


def decoded_plus(c) -> Column:
    """Percent and plus decoding; a percent sign without two hexadecimal digits stays."""
    return F.try_url_decode(F.regexp_replace(_col(c), r"%(?![0-9A-Fa-f]{2})", "%25"))


def without_tags(c) -> Column:
    return F.regexp_replace(_col(c), "<[^>]+>", "")


def without_query(c) -> Column:
    return F.regexp_replace(_col(c), r"(?s)\?.*$", "")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
