"""Character references of HTML to text, in the JVM: what html.unescape gives."""

from __future__ import annotations

import html
from collections.abc import Mapping
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Names that need no semicolon, by length: only these may end inside a longer word.
BARE = {name: text for name, text in html5.items() if not name.endswith(";")}
LENGTHS = sorted({len(name) for name in BARE}, reverse=True)
#: The most common references but &amp; itself. What they stand for begins no reference, so they may go before all others.
COMMON = ("lt;", "gt;", "quot;", "nbsp;", "#39;")
OTHERS = REFERENCE.replace("&", "&(?!amp;)", 1)


def _table(pairs: Mapping[str, str]) -> Column:
    """A map that is one constant, however many entries it has."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in pairs.items())), F.lit("\x01"), F.lit("\x02"))


def _named(name: Column) -> Column:
    """Text of what stands after the &: the name, else the longest bare name that it begins with and the rest, else itself."""
    bare = _table(BARE)
    longest = [F.when(F.length(name) > n, F.concat(F.try_element_at(bare, F.substring(name, 1, n)), F.substr(name, F.lit(n + 1)))) for n in LENGTHS]
    found = F.coalesce(F.try_element_at(_table(html5), name), *longest, F.concat(F.lit("&"), name))
    return F.when(name == "amp;", "&").otherwise(found)


def _numbered(digits: Column, base: int) -> Column:
    """The character of that number; those that no text holds are replaced or left out as browsers do."""
    bare = F.regexp_replace(digits, r"\A0+(?=.)", "")
    number = F.when(F.length(bare) < 11, F.conv(bare, base, 10).cast("long")).otherwise(F.lit(1 << 40))
    replaced = F.try_element_at(_table({str(k): v for k, v in html._invalid_charrefs.items()}), number.cast("string"))
    none = number.cast("int").isin(*sorted(set(html._invalid_codepoints) - set(html._invalid_charrefs)))
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when((number > 0x10FFFF) | number.between(0xD800, 0xDFFF), "�").when(replaced.isNotNull(), replaced).when(none, "").otherwise(char)


def _text(reference: Column) -> Column:
    name = F.substr(reference, F.lit(2))
    digits = F.regexp_extract(name, r"\A#(?:[xX])?([0-9a-fA-F]+)", 1)
    return F.when(name.rlike(r"\A#[xX]"), _numbered(digits, 16)).when(F.startswith(name, F.lit("#")), _numbered(digits, 10)).otherwise(_named(name))


def unescaped(c: Column) -> Column:
    """Text with every character reference replaced; null stays."""
    for name in COMMON:
        c = F.replace(c, F.lit(f"&{name}"), F.lit(html.unescape(f"&{name}")))

    plain = lambda text: F.replace(text, F.lit("&amp;"), F.lit("&"))

    def whole(text: Column) -> Column:
        # other references are few, so the text is taken apart at these
        held = F.transform(F.regexp_extract_all(text, F.lit(OTHERS), F.lit(0)), _text)
        pieces = F.zip_with(F.split(text, OTHERS, -1), held, lambda between, to: F.concat(plain(between), F.coalesce(to, F.lit(""))))
        return F.when(text.rlike(OTHERS), F.array_join(pieces, "")).otherwise(plain(text))

    return F.get(F.transform(F.array(c), whole), 0)  # a lambda's argument, so that the text is worked out once


def unescaped_twice(c: Column) -> Column:
    return unescaped(unescaped(c))
