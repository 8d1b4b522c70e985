"""Character references of HTML as column expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F


def unescape(c: Column) -> Column:
    """The text with its numeric references and the names of HTML 4 (and &apos;) decoded; what is none
    stays as it is. A code point that cannot stand in a text becomes U+FFFD."""
    names = F.create_map(*(F.lit(x) for name, code in sorted({**name2codepoint, "apos": 39}.items()) for x in (name, code)))

    def decoded(piece: Column) -> Column:
        body = F.regexp_extract(piece, "^(#[0-9]{1,8}|#[xX][0-9A-Fa-f]{1,8}|[A-Za-z][A-Za-z0-9]{1,30});", 1)
        hexa = F.conv(F.substring(body, 3, 8), 16, 10).cast("long")
        code = F.when(body.rlike("^#[xX]"), hexa).when(body.startswith("#"), F.substring(body, 2, 8).cast("long")).otherwise(F.try_element_at(names, body))
        sound = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(sound, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        rest = F.substring(piece, F.length(body) + 2, F.length(piece))
        return F.when((body != "") & code.isNotNull(), F.concat(char, rest)).otherwise(F.concat(F.lit("&"), piece))

    pieces = F.split(c, "&", -1)
    more = F.transform(F.slice(pieces, 2, F.size(pieces)), decoded)
    return F.when(F.contains(c, F.lit("&")), F.concat(pieces[0], F.array_join(more, ""))).otherwise(c)
