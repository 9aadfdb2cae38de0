"""Names in several languages and search scores, as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Initial consonants in syllable order, the first syllable, and syllables to each initial.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
FIRST, LAST, EACH = 0xAC00, 0xD7A3, 588
#: Full-width ASCII forms and the characters that they stand for.
WIDE, NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　", "".join(map(chr, range(0x21, 0x7F))) + " "


def localized(names: Column, name: Column, locale: Column) -> Column:
    """The name in a language, else in its base language, else the plain one, else ''."""
    found = lambda tag: F.nullif(F.try_element_at(names, tag), F.lit(""))
    return F.coalesce(found(locale), found(F.split_part(locale, F.lit("-"), F.lit(1))), name, F.lit(""))


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """NFKC, but for runs of single Korean letters."""
    import re
    import unicodedata

    keep = re.compile("[^ㄱ-ㅎ]+")
    return text.map(lambda t: None if t is None else keep.sub(lambda m: unicodedata.normalize("NFKC", m[0]), t))


def fold(text: Column) -> Column:
    """NFKC.  Only text with other characters than ASCII, Korean syllables and full-width ASCII leaves the JVM."""
    plain = text.rlike(f"^[\\x00-\\x7f가-힣{WIDE[0]}-{WIDE[-2]}　]*$")
    return F.coalesce(folded(F.when(~plain, text)), text)


def normalized(text: Column) -> Column:
    """Full-width forms narrowed, lower case, no blanks; ``text`` is folded where it may hold other forms."""
    return F.regexp_replace(F.lower(F.translate(text, WIDE, NARROW)), r"\s+", "")


def initials(text: Column) -> Column:
    """Each Korean syllable replaced by its initial consonant."""
    letters = F.array(*[F.lit(x) for x in INITIALS])
    one = lambda ch: F.when(F.ascii(ch).between(FIRST, LAST), F.get(letters, F.floor((F.ascii(ch) - FIRST) / EACH).cast("int"))).otherwise(ch)
    return F.array_join(F.transform(F.split(text, ""), one), "")


def score(candidate: Column, asked: Column) -> Column:
    """100 equal, 80 prefix, 60 prefix of a word, 40 inside, 30 by initials, else 0.  ``asked`` is normalised."""
    text = normalized(candidate)
    words = F.split(F.lower(candidate), r"[\s\-_/()·]+")
    by_word = F.exists(words, lambda w: F.startswith(normalized(w), asked))
    by_initials = asked.rlike("^[ㄱ-ㅎ]+$") & F.contains(initials(text), asked)
    value = F.when(text == "", 0).when(text == asked, 100).when(F.startswith(text, asked), 80).when(by_word, 60).when(F.contains(text, asked), 40).when(by_initials, 30).otherwise(0)
    return F.coalesce(value, F.lit(0))
