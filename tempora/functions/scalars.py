"""Column functions: years, quantities, names and match scores."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Knots of the timeline, year and position.
TIMELINE = ((-3400, 0.0), (-2000, 0.07), (-500, 0.22), (500, 0.42), (1500, 0.7), (1800, 0.84), (2025, 1.0))


def year_text(y: Column) -> Column:
    """A year with its era; nothing for null and 0. A comma stands from 10,000 on."""
    n = F.abs(y)
    digits = F.when(n >= 10000, F.format_number(n, 0)).otherwise(n.cast("string"))
    return F.when(y.isNull() | (y == 0), "—").otherwise(F.concat(digits, F.when(y < 0, " BCE").otherwise(" CE")))


def parsed_year(text: Column) -> Column:
    """A year from text: an era before or after, not both; commas only between groups of three; no year 0."""
    era = r"(?:BCE|BC|CE|AD)"
    t = F.upper(F.trim(F.regexp_replace(F.regexp_replace(text, "[−–]", "-"), r"\.", "")))
    m = rf"^({era})?\s*(-?[0-9]{{1,3}}(?:,[0-9]{{3}})+|-?[0-9]+)\s*({era})?$"
    before, digits, after = (F.regexp_extract(t, m, i) for i in (1, 2, 3))
    n = F.regexp_replace(digits, ",", "").try_cast("int")
    mark = F.when(before != "", before).otherwise(after)
    value = F.when(mark.isin("BCE", "BC"), -F.abs(n)).when(mark.isin("CE", "AD") & (n < 0), F.lit(None)).otherwise(n)
    return F.when((digits == "") | ((before != "") & (after != "")) | (n == 0), F.lit(None)).otherwise(value).cast("int")


def area_text(a: Column) -> Column:
    return F.when(a >= 1_000_000, F.concat(F.format_number(a / 1e6, 2), F.lit("M km²"))).otherwise(F.concat(F.format_number(F.floor(a + 0.5), 0), F.lit(" km²")))


def population_text(n: Column) -> Column:
    return (
        F.when(n >= 1e9, F.concat(F.format_number(n / 1e9, 1), F.lit("B")))
        .when(n >= 1e6, F.concat(F.format_number(n / 1e6, 1), F.lit("M")))
        .when(n >= 1000, F.concat(F.format_number(F.floor(n / 1000 + 0.5), 0), F.lit("k")))
        .otherwise(n.cast("long").cast("string"))
    )


def name_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z]", "")


@lru_cache
def decompositions() -> tuple[str, str, dict[str, str]]:
    """From Unicode's compatibility decompositions without combining marks: characters that become one other, what they become, and
    the Latin ones that become several. Hangul and ideographs are left out: both sides of a comparison keep them."""
    one, other, several = [], [], {}
    for c in map(chr, [*range(0x80, 0x3000), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not 0x300 <= ord(x) <= 0x36F)
        if len(plain) == 1 and plain != c:
            one.append(c)
            other.append(plain)
        elif len(plain) > 1 and plain.isalnum() and plain.isascii():
            several[c] = plain
    return "".join(one), "".join(other), several


def undecorated(text: Column) -> Column:
    """Letters without accents, ligatures taken apart, in generated code."""
    one, other, several = decompositions()
    spelt = F.regexp_replace(F.translate(text, one, other), "[\u0300-\u036f]", "")
    # Texts without such a character, which are nearly all, skip the replacements.
    apart = spelt
    for c, plain in several.items():
        apart = F.replace(apart, F.lit(c), F.lit(plain))
    return F.when(spelt.rlike("[" + "".join(several) + "]"), apart).otherwise(spelt)


def folded(text: Column) -> Column:
    """Lower case without accents, everything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(undecorated(text)), r"[^\p{L}\p{N}]+", " "))


def match_score(candidate: Column, needle: Column) -> Column:
    """0 equal, 1 begins with, 2 contains, 3 holds every token, 3.5 holds the stem of every token of 6 or more letters, else null."""
    n = folded(needle)
    tokens = F.split(n, " ")
    stem = lambda t: F.substring(t, F.lit(1), F.greatest(F.lit(5), F.length(t) - 2))

    def score(c: Column) -> Column:
        stems = F.forall(tokens, lambda t: (F.length(t) >= 6) & c.contains(stem(t)))
        return F.when(n == "", None).when(c == n, 0.0).when(c.startswith(n), 1.0).when(c.contains(n), 2.0).when(F.forall(tokens, lambda t: c.contains(t)), 3.0).when(stems, 3.5)

    return F.transform(F.array(folded(candidate)), score)[0]  # a variable, as every use of an expression is worked out again


def timeline_position(y: Column) -> Column:
    """Piecewise linear over TIMELINE, held at both ends."""
    out = F.when(y <= TIMELINE[0][0], TIMELINE[0][1])
    for (y0, p0), (y1, p1) in zip(TIMELINE, TIMELINE[1:]):
        out = out.when(y <= y1, F.lit(p0) + (y - y0) * (p1 - p0) / (y1 - y0))
    return out.otherwise(TIMELINE[-1][1])


def palette_index(text: Column, colours: int = 10) -> Column:
    """FNV-1a over the 16-bit code units of a text, modulo the number of colours."""
    step = lambda h, u: (h.bitwiseXOR(u) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF))
    codes = F.transform(F.split(F.hex(F.encode(text, "UTF-16BE")), "(?<=\\G.{4})"), lambda x: F.conv(x, 16, 10).cast("long"))
    return (F.aggregate(F.filter(codes, lambda u: u.isNotNull()), F.lit(2166136261).cast("long"), step) % colours).cast("int")


def great_circle(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    a, b = F.radians(lat0), F.radians(lat1)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon1) - F.radians(lon0)) / 2), 2)
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def timeline_year(position: Column) -> Column:
    """The year at a position, the reverse of timeline_position()."""
    out = F.lit(float(TIMELINE[-1][0]))
    for (y0, p0), (y1, p1) in reversed(list(zip(TIMELINE[:-1], TIMELINE[1:], strict=True))):
        out = F.when(position <= p1, y0 + (position - p0) / (p1 - p0) * (y1 - y0)).otherwise(out)
    return F.when(position <= TIMELINE[0][1], float(TIMELINE[0][0])).otherwise(out)
