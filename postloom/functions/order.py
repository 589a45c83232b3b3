"""Natural order of text: runs of digits by their value, what stands between them by a collation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of the length of a run of digits.
LENGTHS = 9
PAIR = r"([^0-9]*)([0-9]*)"


def natural_key(c: Column, language: str = "zh") -> Column:
    """A struct that sorts as text with numbers does: 第2楼 before 第10楼, 7 and 007 side by side.

    Text counts without case and accents at first, then with them; digits by their value, however
    many there are. The text itself settles what is left. Null sorts first.
    """
    texts, runs = (F.regexp_extract_all(c, F.lit(PAIR), F.lit(k)) for k in (1, 2))
    bare = F.transform(runs, lambda d: F.regexp_replace(d, r"\A0+(?=.)", ""))
    sized = F.transform(bare, lambda d: F.concat(F.lpad(F.length(d).cast("string"), LENGTHS, "0"), d))
    by = lambda collation: F.zip_with(texts, sized, lambda t, d: F.struct(F.collate(t, collation).alias("text"), d.alias("number")))
    return F.struct(by(f"{language}_CI_AI").alias("letters"), by(language).alias("forms"), c.alias("itself"))
