"""String columns shared by many operators."""

from __future__ import annotations

import html.entities
import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every white-space character.
SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


#: The named entities of HTML 5 that end in a semicolon.
_NAMED = {n[:-1]: t.replace("\xa0", " ") for n, t in html.entities.html5.items() if n.endswith(";")}


def strip(c: Column) -> Column:
    """Drop all leading and trailing white space, not only blanks."""
    return F.btrim(c, F.lit(SPACE))


def quoted(c: Column) -> Column:
    """The text as a quoted literal: single quotes unless only those occur inside."""
    escaped = c
    for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    double = c.contains("'") & ~c.contains('"')
    single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(single)


def iso_utc(ts: Column) -> Column:
    """ISO-8601 with offset; the fraction is written only when there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(
        whole,
        F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise(F.lit("")),
        F.lit("+00:00"),
    )


def filled(c: Column) -> Column:
    """True when the text is neither null nor empty."""
    return c.isNotNull() & (c != "")


def contains_any(c: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(p) for p in phrases))


def json_scalar(c: Column) -> Column:
    """One string as a JSON literal (to_json itself takes only containers)."""
    inside = F.to_json(F.array(c))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def decode_entities(c: Column) -> Column:
    """Replace &#N;, &#xN; and all named entities by their text, in one pass.

    A number no character has becomes U+FFFD; what is no entity stays. A no-break space
    becomes a blank.
    """
    pieces = F.split(c, "&")
    names = F.from_json(F.lit(json.dumps(_NAMED)), "map<string,string>")

    def decoded(piece: Column) -> Column:
        token = F.regexp_extract(piece, r"\A(#(?:[0-9]+|[xX][0-9a-fA-F]+);|[a-zA-Z][a-zA-Z0-9]*;)", 1)
        digits = F.regexp_replace(token, "^#[xX]?0*|;", "")
        hexed = token.rlike(r"\A#[xX]")
        short = F.length(digits) <= F.when(hexed, 6).otherwise(7)
        value = F.lpad(F.when(hexed, digits).otherwise(F.hex(digits.try_cast("long"))), 8, "0")
        code = F.when(short, F.conv(value, 16, 10).cast("long")).otherwise(-1)
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        number = F.when(valid, F.decode(F.unhex(value), "UTF-32")).otherwise(F.lit("\ufffd"))
        named = F.try_element_at(names, F.substring(token, F.lit(1), F.length(token) - 1))
        char = F.when(F.startswith(token, F.lit("#")), number).otherwise(named)
        rest = F.substring(piece, F.length(token) + 1, F.length(piece))
        plain = (token == "") | char.isNull()
        return F.when(plain, F.concat(F.lit("&"), piece)).otherwise(F.concat(char, rest))

    tail = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), decoded)
    whole = F.concat(F.element_at(pieces, 1), F.array_join(tail, ""))
    return F.when(c.contains("&"), whole).otherwise(c)
