"""Answers in free text, in a form that can be compared, and what a text states in numbers.

Unicode normal forms have no built-in expression and are Arrow-batched functions,
and so are answers whose form depends on their kind. Numerals and everything else
are plain column expressions.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DataType, LongType, StringType

NONE = "__none__"
#: Surfaces of "nothing", Korean digits, small units, large units.
NONE_SURFACES = frozenset({"", "none", "null", "n/a", "없음", "해당없음", "정보없음", "등록없음"})
DIGITS = {"영": 0, "공": 0, "일": 1, "이": 2, "삼": 3, "사": 4, "오": 5, "육": 6, "칠": 7, "팔": 8, "구": 9}
SMALL_UNITS = {"십": 10, "백": 100, "천": 1_000}
LARGE_UNITS = {"억": 100_000_000, "만": 10_000}

def squashed(text: str) -> str:
    """Compatibility form, lower case, without any white space."""
    return "".join(unicodedata.normalize("NFKC", text).lower().split())


def first_integer(text: str) -> int | None:
    """The first signed run of digits, commas left out."""
    m = re.search(r"-?\d+", unicodedata.normalize("NFKC", text).replace(",", ""))
    return int(m[0]) if m else None


def as_list(text: str) -> list[str]:
    """Elements of a JSON array, or the parts between commas, slashes, middle dots, "및" and "그리고"."""
    try:
        found = json.loads(text)
    except ValueError:
        found = None
    if isinstance(found, list):
        return [x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in found]
    return [p for p in (x.strip() for x in re.split(r"[,/·]|\s+(?:및|그리고)\s+", text.strip())) if p]


def normalize_answer(text: str | None, kind: str | None, aliases: Mapping[str, str] | None = None) -> str:
    """One comparable string for an answer; ``kind``: integer, integer_list, string_list or any other for text."""
    if text is None or squashed(text) in NONE_SURFACES:
        return NONE
    known = {squashed(k): v for k, v in (aliases or {}).items()}
    canonical = lambda t: squashed(known.get(squashed(t), t))
    packed = lambda xs: json.dumps(sorted(xs), ensure_ascii=False, separators=(",", ":"))
    if kind == "integer":
        n = first_integer(text)
        return NONE if n is None else str(n)
    if kind == "integer_list":
        return packed(n for n in map(first_integer, as_list(text)) if n is not None)
    return packed(map(canonical, as_list(text))) if kind == "string_list" else canonical(text)


def _typed(f: Callable, kind: DataType) -> Callable:
    """A column function of a plain function of one text."""
    dtype = "Int64" if isinstance(kind, LongType) else object

    @pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([f(t) for t in s], dtype=dtype)

    return run


_nullable = lambda f: lambda t: None if t is None else f(t)
compatible = _typed(_nullable(lambda t: unicodedata.normalize("NFKC", t)), StringType())
normal_text = _typed(_nullable(squashed), StringType())
integer_of = _typed(_nullable(first_integer), LongType())
list_of = _typed(_nullable(as_list), ArrayType(StringType()))


def normalized_answer(answer: Column, kind: Column, aliases: Mapping[str, str] | None = None) -> Column:
    """``normalize_answer`` of two columns, and amounts for the kind krw; the aliases are a small stated table."""

    @pandas_udf(StringType())
    def run(a: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([normalize_answer(x, y, aliases) for x, y in zip(a, k)])

    return F.when(kind == "krw", F.coalesce(won(answer).cast("string"), F.lit(NONE))).otherwise(run(answer, kind))


def choice_key(value: Column, aliases: Mapping[str, str]) -> Column:
    """The key of a choice: null is ``__none__``, booleans are true and false, then aliases apply."""
    key = F.coalesce(value.cast("string"), F.lit(NONE))
    for surface, canonical in aliases.items():
        key = F.when(F.coalesce(value.cast("string"), F.lit(NONE)) == surface, canonical).otherwise(key)
    return key


# -- numerals ------------------------------------------------------------------

#: Units behind a number in digits, as powers of ten; words before a magnitude that make it vague.
NUMBER_UNITS = {"천만": 7, "백만": 6, "십만": 5, "억": 8, "만": 4, "천": 3, "백": 2}
VAGUE = ("몇", "수", "여러")
_ATOM = rf"\d+(?:\.\d+)?|[{''.join(DIGITS)}{''.join(SMALL_UNITS)}]"
_SMALL = f"[{''.join(SMALL_UNITS)}]"


def numeral(text: Column) -> Column:
    """A numeral below 만, in digits or Hangul or both, as a double: null if it is none.

    One token after the other changes (sum, number that waits for a unit): a
    number waits, a unit takes what waits, or one. Without units a row of Hangul
    digits is a number in digits.
    """
    names, units = "".join(DIGITS), F.create_map(*[F.lit(x) for kv in SMALL_UNITS.items() for x in kv])
    plain = F.translate(text, names, "".join(map(str, DIGITS.values())))

    def step(acc: Column, token: Column) -> Column:
        unit = F.try_element_at(units, token)
        waits = F.translate(token, names, "".join(map(str, DIGITS.values()))).try_cast("double")
        return F.struct(F.when(unit.isNull(), acc["sum"]).otherwise(acc["sum"] + F.coalesce(acc["waits"], F.lit(1.0)) * unit).alias("sum"), F.when(unit.isNull(), waits).alias("waits"))

    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("waits"))
    summed = F.aggregate(F.regexp_extract_all(text, F.lit(f"({_ATOM})")), start, step, lambda acc: acc["sum"] + F.coalesce(acc["waits"], F.lit(0.0)))
    return F.when(text.rlike(_SMALL), F.when(text.rlike(f"^(?:{_ATOM})+$"), summed)).when(text.rlike(rf"^(?:\d+(?:\.\d+)?|[{names}]+)$"), plain.try_cast("double"))


def won(text: Column) -> Column:
    """An amount in won as a long, or null.

    Commas, spaces and 원 are left out, "약" or "대략" in front and "정도" or "쯤"
    behind too. What stands before 억, between it and 만, and behind, is a numeral
    each, nothing before a unit being one; what cannot be read so falls back to
    its first integer. Null and surfaces of "nothing" give null, and so does what
    64 bits do not hold.
    """
    t = F.regexp_replace(F.lower(compatible(text)), "[, 원]", "")
    t = F.regexp_replace(F.regexp_replace(t, "^(?:약|대략)", ""), "(?:정도|쯤)$", "")
    return _bound(t, _won)


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a column that is worked out once, however often ``f`` names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _won(t: Column) -> Column:
    parts = F.struct(*[F.regexp_extract(t, r"^(-?)(?:([^억]*)(억))?(?:([^만]*)(만))?(.*)$", k).alias(f"p{k}") for k in range(1, 7)])

    def worth(p: Column) -> Column:
        read = lambda k: _bound(p[f"p{k}"], numeral)
        head = lambda k: F.when(p[f"p{k + 1}"] == "", F.lit(0.0)).when(p[f"p{k}"] == "", F.lit(1.0)).otherwise(read(k))
        tail = F.when((p["p6"] == "") & (F.concat(p["p3"], p["p5"]) != ""), F.lit(0.0)).otherwise(read(6))
        return F.when(p["p1"] == "-", F.lit(-1.0)).otherwise(F.lit(1.0)) * (head(2) * LARGE_UNITS["억"] + head(4) * LARGE_UNITS["만"] + tail)

    first = F.regexp_extract(t, r"^-?(.*)$", 1)
    whole = _bound(_bound(parts, worth), lambda w: F.when(F.abs(w) < 9.2e18, w).cast("long"))
    read = F.coalesce(whole, F.regexp_extract(F.when(t.rlike(r"^-?\d+(?:\.\d+)?$"), t).otherwise(first), r"-?\d+", 0).try_cast("long"))
    nothing = F.regexp_replace(t, r"\s", "").isin(*NONE_SURFACES)
    return F.when(~nothing, read)


def _shifted(number: Column, places: Column) -> Column:
    """A decimal in digits times ten to the power of ``places``, exact whatever its length, without needless zeros."""
    whole, rest = F.substring_index(number, ".", 1), F.when(number.contains("."), F.substring_index(number, ".", -1)).otherwise("")
    rest = F.rpad(rest, F.greatest(F.length(rest), places), "0")
    up = F.regexp_replace(F.concat(whole, F.substring(rest, F.lit(1), places)), r"^0+(?=\d)", "")
    down = F.regexp_replace(F.substring(rest, places + 1, F.length(rest)), "0+$", "")
    return F.when(down == "", up).otherwise(F.concat_ws(".", up, down))


def numbers_in(text: Column) -> Column:
    """All numbers of a text, exact, as plain decimals: those in digits with their unit, then amounts of won in Hangul that are not vague."""
    digits = rf"(?<![0-9A-Za-z_])(\d[\d,]*(?:\.\d+)?)\s*({'|'.join(NUMBER_UNITS)})?"
    powers = F.create_map(*[F.lit(x) for kv in NUMBER_UNITS.items() for x in kv])
    found = lambda pattern, k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))
    plain = F.zip_with(found(digits, 1), found(digits, 2), lambda n, u: _shifted(F.replace(n, F.lit(","), F.lit("")), F.coalesce(F.try_element_at(powers, u), F.lit(0))))
    spelt = f"[{''.join(d for d, n in DIGITS.items() if n)}{''.join(SMALL_UNITS)}]{{1,8}}"
    amount = rf"({'|'.join(VAGUE)})?\s*(?<![0-9가-힣])({spelt})\s*(억|만)\s*(?:({spelt})\s*)?원"
    large = F.create_map(*[F.lit(x) for kv in LARGE_UNITS.items() for x in kv])
    value = lambda x: _last_digits(x["head"]) * F.element_at(large, x["unit"]) + F.when(x["tail"] == "", F.lit(0.0)).otherwise(_last_digits(x["tail"]))
    amounts = F.arrays_zip(found(amount, 1).alias("vague"), found(amount, 2).alias("head"), found(amount, 3).alias("unit"), found(amount, 4).alias("tail"))
    spelt_out = F.transform(F.filter(amounts, lambda x: x["vague"] == ""), lambda x: value(x).cast("long").cast("string"))
    return F.concat(plain, spelt_out)


def _last_digits(text: Column) -> Column:
    """``numeral`` of Hangul where of digits in a row only the last counts."""
    return numeral(F.regexp_replace(text, f"[{''.join(DIGITS)}]+([{''.join(DIGITS)}])", "$1"))


def grounded_numbers(text: Column, sources: Column) -> Column:
    """Numbers that both ``text`` and one of the texts in the array ``sources`` state, each once, in order."""
    none = F.expr("cast(array() as array<string>)")
    return F.array_intersect(F.coalesce(numbers_in(text), none), F.coalesce(numbers_in(F.array_join(sources, "\n")), none))


def ungrounded_numbers(text: Column, sources: Column) -> Column:
    """Numbers that ``text`` states and none of the texts in the array ``sources`` does, each once, in order."""
    return F.array_except(F.coalesce(numbers_in(text), F.expr("cast(array() as array<string>)")), F.coalesce(numbers_in(F.array_join(sources, "\n")), F.expr("cast(array() as array<string>)")))


# -- detectors -----------------------------------------------------------------

#: Fixed patterns: emoji, bare jamo, codes of failed actions; suffixes that may follow a label; what completes an action and what only seems to.
EMOJI = "[\U0001f300-\U0001faff\U00002600-\U000027bf\U0001f000-\U0001f02f❤️]"
JAMO = "[ㄱ-ㅎㅏ-ㅣ]{2,}"
FA_CODE = r"FA-[0-9]{2}"
LABEL_SUFFIX = "하|해|했|할|한|하는|하려|를|을|가|이|는|은|로|으로|와|과|에|도|부터|까지|계획|예정"
POLICY_CLAIMS = (
    ("joint_account:supported", "(공동명의|공동\\s*명의).{0,18}(가능|등록할 수|만들 수 있)"),
    ("joint_account:unsupported", "(공동명의|공동\\s*명의).{0,18}(불가능|지원하지 않|만들 수 없)"),
    ("joint_account:unsupported", "(대표\\s*명의|한\\s*명).{0,12}(필수|반드시|해야)"),
)


def has_emoji(text: Column) -> Column:
    return text.rlike(EMOJI)


def has_jamo(text: Column) -> Column:
    return text.rlike(JAMO)


def failure_codes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(FA_CODE), F.lit(0))


def names_label(text: Column, label: str) -> Column:
    """Whether the text has the label as a word or stem and not inside another word. An empty label is nowhere."""
    if not label:
        return F.lit(False)
    bare = re.escape(label)
    return F.coalesce(text.rlike(rf"(?<![0-9A-Za-z가-힣]){bare}(?=$|[^0-9A-Za-z가-힣]|(?:{LABEL_SUFFIX}))"), F.lit(False))


def policy_claims(text: Column) -> Column:
    """The policy claims that a text makes, each once, in order of name."""
    found = F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in POLICY_CLAIMS])
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def completion_turns(turns: Column, done: str, not_done: Sequence[str]) -> Column:
    """Indexes (from 0) of assistant turns that match ``done`` and hold none of ``not_done``; ``turns``: array of struct(speaker, text)."""
    excluded = "|".join(map(re.escape, not_done))

    def hit(t):
        fine = (t["speaker"] == "assistant") & t["text"].rlike(done)
        return F.coalesce(fine & ~t["text"].rlike(excluded) if not_done else fine, F.lit(False))

    return F.filter(F.transform(turns, lambda t, i: F.when(hit(t), i)), lambda i: i.isNotNull())


def leaks(text: Column, tokens: Sequence[str]) -> Column:
    """Which forbidden tokens a rendered text holds, in the order of ``tokens``, a short stated list."""
    return F.array_compact(F.array(*[F.when(text.contains(t), F.lit(t)) for t in tokens])) if tokens else F.expr("cast(array() as array<string>)")


def rendered(turns: Column, template: str = "{speaker}: {text}") -> Column:
    """Turns joined into one block, a line each; ``template`` names the two fields."""
    before, between, after = re.split(r"\{speaker\}|\{text\}", template)
    line = lambda t: F.concat(F.lit(before), F.coalesce(t["speaker"], F.lit("")), F.lit(between), F.coalesce(t["text"], F.lit("")), F.lit(after))
    return F.array_join(F.transform(turns, line), "\n")


# -- tolerant answers ------------------------------------------------------------


def outer_object(raw: Column) -> Column:
    """The answer if it is a JSON object, else what stands between its outermost braces if that is one; else null."""
    bare = F.trim(raw)
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    is_object = lambda c: F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))
    valid = F.try_parse_json(bare).isNotNull()
    return F.when(is_object(bare), bare).when(~valid & (F.length(inner) > 0) & is_object(inner), inner)


def choice_letter(raw: Column) -> Column:
    """The letter of a multiple-choice answer: the first character of the object's ``answer``, else the first letter that stands alone; else empty."""
    said = F.upper(F.trim(F.coalesce(F.get_json_object(outer_object(raw), "$.answer"), F.lit(""))))
    return F.when(F.length(said) > 0, F.substring(said, 1, 1)).otherwise(F.regexp_extract(F.upper(F.trim(F.coalesce(raw, F.lit("")))), r"\b([A-Z])\b", 1))


def free_response(raw: Column) -> Column:
    """struct(answer, given): the object's ``answer`` (a JSON null is a given answer), else the text itself; an empty text is not given."""
    obj = F.try_parse_json(outer_object(raw))
    named = F.coalesce(F.try_variant_get(obj, "$.answer", "variant").isNotNull(), F.lit(False))
    text = F.trim(F.coalesce(raw, F.lit("")))
    answer = F.when(named, F.try_variant_get(obj, "$.answer", "string")).when(F.length(text) > 0, text)
    return F.struct(answer.alias("answer"), (named | (F.length(text) > 0)).alias("given"))


def batch_answers(raw: Column) -> Column:
    """map of item id to answer (null: none given) from ``{"answers": ...}``, an object by id or a list of objects with item_id and answer."""
    obj = F.try_parse_json(outer_object(raw))
    by_id = F.try_variant_get(obj, "$.answers", "map<string,string>")
    listed = F.filter(F.try_variant_get(obj, "$.answers", "array<variant>"), lambda e: F.try_variant_get(e, "$.item_id", "string").isNotNull())
    pairs = F.transform(listed, lambda e: F.struct(F.try_variant_get(e, "$.item_id", "string").alias("key"), F.try_variant_get(e, "$.answer", "string").alias("value")))
    keys = F.transform(pairs, lambda p: p["key"])
    last = F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["key"]))  # a later answer replaces an earlier one
    return F.coalesce(by_id, F.map_from_entries(last), F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<string>))"))
