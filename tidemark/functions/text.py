"""Text expressions: normal forms, tokens, shingles, hashes, Korean amounts, sequence distances."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StringType

from tidemark.functions.answers import won  # noqa: F401


#: What counts as a character of normalised text, and as a token.
NOT_TEXT = "[^0-9a-zA-Z가-힣 ]"
TOKEN = "[가-힣]+|[a-z]+|[0-9]+(?:[.,][0-9]+)*"


def normalized(text: Column) -> Column:
    """Lower case, other characters to spaces, spaces squeezed and trimmed. Null stays null."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), NOT_TEXT, " "), " +", " "))


def words(text: Column) -> Column:
    """Words of normalised text; an empty text has none."""
    clean = normalized(text)
    return F.when(F.length(clean) > 0, F.split(clean, " ")).otherwise(F.expr("cast(array() as array<string>)"))


def shingles(words_: Column, width: int = 3) -> Column:
    """Distinct runs of ``width`` words; none if there are fewer words."""
    n = F.size(words_) - (width - 1)
    runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(words_, i, F.lit(width)), " "))
    return F.when(n > 0, F.array_distinct(runs)).otherwise(F.expr("cast(array() as array<string>)"))


def tokens(text: Column) -> Column:
    """Lower-cased Hangul runs, Latin runs and numbers, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def is_substantive(text: Column) -> Column:
    """At least 12 characters without spaces, or five words."""
    compact = F.length(F.regexp_replace(text, r"\s+", ""))
    return (compact >= 12) | (F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")) >= 5)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^0-9a-z]+", "_"), "^_+|_+$", "")


def token_estimate(text: Column) -> Column:
    """An estimate for budgets: characters by 2.5, rounded up."""
    return F.ceil(F.length(text) / F.lit(2.5))


def hash_pick(seed: str | int, *keys: Column) -> Column:
    """A hex string that orders rows at random, the same in every engine: sha256 of seed and keys joined by colons."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]), 256)


def hash_mod(hex_: Column, span: int | Column) -> Column:
    """The first four bytes of a hex digest, big-endian, modulo ``span``."""
    return F.pmod(F.conv(F.substring(hex_, 1, 8), 16, 10).cast("long"), span if isinstance(span, Column) else F.lit(span))


def public_id(session_id: Column, prefix_from: str = "S", prefix_to: str = "D") -> Column:
    """S042 to D042 and the like; an id of another form is an error."""
    digits = F.regexp_extract(session_id, f"^{prefix_from}([0-9]{{3,}})$", 1)
    bad = F.raise_error(F.concat(F.lit("not a session id: "), F.coalesce(session_id, F.lit("null")))).cast("string")
    return F.when(F.length(digits) > 0, F.concat(F.lit(prefix_to), digits)).otherwise(bad)


def session_number(session_id: Column) -> Column:
    """The number of a session id; sessions are ordered by it and not by the id's text."""
    return F.regexp_extract(session_id, "([0-9]+)$", 1).cast("int")


def longest_phrase(text: Column, phrases: Sequence[str]) -> Column:
    """The longest of ``phrases`` that the text contains, ties to the one listed first; else null."""
    ordered = sorted(phrases, key=len, reverse=True)
    return F.coalesce(*[F.when(text.contains(p), F.lit(p)) for p in ordered])


def json_object(raw: Column) -> Column:
    """The JSON object in an answer: code fences are dropped, text around the outermost braces too; else null."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(raw, r"^\s*```[a-zA-Z]*", ""), r"```\s*$", ""))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    fits = lambda c: F.try_parse_json(c).isNotNull()
    return F.when(fits(bare), bare).when((F.length(inner) > 0) & fits(inner), inner)


def answer_tag(raw: Column) -> Column:
    """What stands in the last <answer> tag, trimmed; null without one."""
    return F.trim(F.try_element_at(F.regexp_extract_all(raw, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1)), F.lit(-1)))


# -- functions for which there is no built-in form ----------------------------


@pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, trimmed, white space squeezed. Null stays null."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()), na_action=None)


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence of two id sequences: a bit for each item of ``a``, whole rows at a time."""
    places: dict = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    whole = (1 << len(a)) - 1
    row = whole
    for y in b:
        at = row & places.get(y, 0)
        row = (row + at | row - at) & whole
    return len(a) - row.bit_count()


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Insertions, deletions and replacements between two id sequences, a row of the table at a time."""
    codes: dict = {}
    a, b = (np.array([codes.setdefault(x, len(codes)) for x in s], np.int64) for s in (a, b))
    place = np.arange(len(b) + 1)
    row = place
    for i, x in enumerate(a, 1):
        new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (b != x))])
        row = np.minimum.accumulate(new - place) + place  # insertions go on from the cell before
    return int(row[-1])


@pandas_udf(IntegerType())
def sequence_lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(x if x is not None else (), y if y is not None else ()) for x, y in zip(a, b)])


@pandas_udf(IntegerType())
def sequence_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([edit_distance(x if x is not None else (), y if y is not None else ()) for x, y in zip(a, b)])
