"""Problem 6: text that looks the same but is made of different characters.

The skeleton of a string is what is left when it is decomposed, every character
is replaced by the prototype of its look-alikes, and the result is decomposed
again. Strings that look the same have equal skeletons.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of other scripts drawn like a Latin letter, by prototype; what follows from these by rule is below.
LOOKALIKES = {
    "A": "ΑАᎪᗅꓮ", "B": "ΒВᏴꓐ𐊡", "C": "СϹⅭᏟꓚⲤ", "D": "ᎠⅮꓓ", "E": "ΕЕᎬꓰ",
    "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "ΗНᎻꓧ", "I": "ΙІӀⅠᏆꓲ", "J": "ЈͿᎫꓙ", "K": "ΚКᏦKꓗ",
    "L": "ⅬᏞꓡ", "M": "ΜМⅯᎷꓟ", "N": "Νꓠ", "O": "ΟОՕꓳ", "P": "ΡРᏢꓑ", "Q": "Ԛ", "R": "ᎡᏒꓣ",
    "S": "ЅՏᏚꓢ", "T": "ΤТᎢꓔ", "U": "Սꓴ", "V": "ⅤᏙѴꓦ", "W": "ԜᎳꓪ", "X": "ΧХⅩꓫ", "Y": "ΥҮᎩꓬ",
    "Z": "ΖᏃꓜ", "a": "ɑαа", "b": "Ьƅ", "c": "ϲсⅽⲥ", "d": "ԁⅾ", "e": "е℮", "g": "ɡց", "h": "һհ",
    "i": "ıιіⅰɩ", "j": "ϳј", "k": "κк", "l": "ӏⅼ", "m": "ⅿ", "n": "ո", "o": "οоօσ",
    "p": "ρр", "q": "ԛ", "r": "г", "s": "ѕ", "u": "υս", "v": "νѵⅴ", "w": "ԝѡ", "x": "хχⅹ", "y": "уγү",
    "'": "‘’ʼʹ′´`", "\"": "“”″", "-": "‐‑‒–−﹣", ".": "․٠", ",": "‚", "/": "⁄∕", ":": "։∶", "f": "ƒ",
}

#: Invisible characters besides those of category Cf: fillers, selectors, the combining grapheme joiner.
_BLANK = re.compile("[͏ᅟᅠ឴឵᠋-᠏ㅤ︀-️ﾠ]|[\U000E0100-\U000E01EF]")
_KEEPS_LOOK = {"<wide>", "<narrow>", "<font>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}


#: Letters whose capital is drawn as the small letter, but larger: a small capital of one looks like it.
_SAME_BOTH = "cosuvwxz"


@lru_cache(maxsize=None)
def _prototypes() -> dict[str, str]:
    return {other: base for base, others in LOOKALIKES.items() for other in others}


def _by_rule(ch: str) -> str | None:
    """The prototype of letters that follow from others: small Cherokee letters from their capitals, small capitals, and Coptic letters from the Greek ones they are named after."""
    name = unicodedata.name(ch, "")
    if name.startswith("CHEROKEE SMALL LETTER"):
        return _prototypes().get(ch.upper(), "").lower() or None
    if name.startswith("LATIN LETTER SMALL CAPITAL "):
        small = name.rsplit(" ", 1)[1].lower()
        return small if small in _SAME_BOTH else None
    if name.startswith("COPTIC") and " LETTER " in name:
        kind, _, letter = name.partition(" LETTER ")
        greek = _COPTIC.get(letter, letter)
        try:
            return _prototypes().get(unicodedata.lookup(f"GREEK {kind.split()[-1]} LETTER {greek}"))
        except KeyError:
            return None
    return None


# Names of Coptic letters that aren't those of the Greek letters they look like.
_COPTIC = {"ALFA": "ALPHA", "VIDA": "BETA", "EIE": "EPSILON", "ZATA": "ZETA", "HATE": "ETA", "IAUDA": "IOTA", "KAPA": "KAPPA", "MI": "MU", "NI": "NU", "O": "OMICRON", "RO": "RHO", "UA": "UPSILON", "KHI": "CHI"}


@lru_cache(maxsize=65_536)
def prototype(ch: str) -> str:
    """What stands for one decomposed character: nothing when invisible, its look-alikes' prototype else.

    Width and style variants come from the Unicode decomposition tags. ``I``, ``l``
    and ``1`` stay apart, as do ``O`` and ``0``, ``m`` and ``rn``: between ASCII
    characters a difference is one of case or spelling.
    """
    if unicodedata.category(ch) == "Cf" or _BLANK.match(ch):
        return ""
    if ch.isspace() or unicodedata.category(ch) in ("Zs", "Zl", "Zp", "Cc"):
        return " "
    known = _prototypes().get(ch) or _by_rule(ch)
    if known is not None:
        return known
    tag, *points = unicodedata.decomposition(ch).split() or [""]
    if tag in _KEEPS_LOOK:
        return "".join(prototype(chr(int(p, 16))) for p in points)
    return ch


def skeleton_of(text: str | None) -> str | None:
    """Skeleton of one string; null stays null, a text of invisible characters becomes ''.

    Blanks of any kind and number count as one blank, leading and trailing ones as none.
    """
    if text is None:
        return None
    if not text.isascii():
        text = unicodedata.normalize("NFD", "".join(map(prototype, unicodedata.normalize("NFD", text))))
    return " ".join(text.split())


@F.pandas_udf(StringType())
def skeleton(texts: pd.Series) -> pd.Series:
    return texts.map(skeleton_of, na_action="ignore")


def consistent_form(df: DataFrame, column: str | Column, out: str = "skeleton") -> DataFrame:
    """``df`` with the skeleton of ``column``; rows and other columns stay as they are."""
    return df.withColumn(out, skeleton(F.col(column) if isinstance(column, str) else column))


def group_lookalikes(names: DataFrame, column: str, scope: list[str]) -> DataFrame:
    """(scope, spelling, skeleton, n_spellings): every different spelling with its look and the number of spellings of that look.

    One row a spelling; nothing is gathered into lists.
    """
    forms = names.where(F.col(column).isNotNull()).select(*scope, column).distinct()
    look = Window.partitionBy(*scope, "skeleton")
    return consistent_form(forms, column).select(*scope, F.col(column).alias("spelling"), "skeleton", F.count("*").over(look).alias("n_spellings"))


def match_lookalikes(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(mention_id, entity_id): names that look like an entity's of the same source_id without being equal.

    Null names, ids or sources match nothing, nor does an empty skeleton. Repeated
    rows give one pair. Skeletons are made once per distinct spelling.
    """
    named = lambda df, key, name: df.where(f"{key} is not null and {name} is not null and source_id is not null").select("source_id", F.col(name).alias("name"), key).distinct()
    m = named(mentions, "mention_id", "name")
    e = named(entities, "entity_id", "canonical_name")
    m = consistent_form(m, "name").where("skeleton <> ''")
    e = consistent_form(e, "name").where("skeleton <> ''").withColumnRenamed("name", "canonical_name")
    return m.join(e, ["source_id", "skeleton"]).where("name <> canonical_name").select("mention_id", "entity_id").distinct()
