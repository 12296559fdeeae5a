"""Amounts and stated numbers: by hand, and numbers spelt in every way and read back."""

import random

from pyspark.sql import functions as F

from tidemark.functions import answers as A

WON = {
    "3억 5천만원": 350_000_000, "약 120만원 정도": 1_200_000, "삼천": 3_000, "1,500": 1_500, "없음": None, None: None, "삼천이백": 3_200, "1억2천만": 120_000_000, "약 3만원쯤": 30_000, "만": 10_000,
    "3.7": 3, "abc": None, "": None, "십이만 삼천사백오": 123_405, "억": 100_000_000, "-2만 5": -20_005, "-1,234": -1_234, "일이삼": 123, "1.5억": 150_000_000, "2천5백": 2_500, "대략 영원": 0, "３만": 30_000,
    "3만2억": 3, "x 15 y 20": 15, "이천오십구억삼백만": 205_903_000_000, "1 억": 100_000_000, "해당 없음": None, "오십이만원정도": 520_000, "1.2.3만": 1, "-": None, "99999999999999999999": None, "1-2": 1, "a-7": -7, "2천 3": 2_003, "삼이백": 200,
}
STATED = {
    "수 백만 원": [], "2천만 원과 1.50": ["20000000", "1.5"], "여러 삼백만원": [], "오백만원 나갔어요": ["5000000"], "3억5천": ["300000000", "5000"], "A1 b_2 x3": [], "1,234.50원": ["1234.5"], "0.05만": ["500"],
    "삼억 이천오원": ["300002005"], "몇 천만원": [], "007": ["7"], "0": ["0"], "0.00": ["0"], "123456789012345678901234567890.5백": ["12345678901234567890123456789050"], None: None, "": [], "이삼만원": ["30000"],
    "백만 원 2백": ["200", "1000000"], "1.2.3": ["1.2", "3"], "10 %": ["10"], "지난 회수 백만원": [], "이만원삼만원": ["20000"],
}


def read(spark, f, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("x")).collect()
    return [x for _, x in sorted((r["i"], r["x"]) for r in rows)] if all(r["x"] is not None for r in rows) else [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


def test_by_hand(spark):
    assert dict(zip(WON, read(spark, A.won, list(WON)))) == WON
    assert dict(zip(STATED, read(spark, A.numbers_in, list(STATED)))) == STATED


def spelt(n: int, rnd: random.Random) -> str:
    """A number below a trillion as it may be written: Hangul, digits with units, or both."""
    out = ""
    for unit, name in ((10**8, "억"), (10**4, "만"), (1, "")):
        part, n = divmod(n, unit)
        if not part:
            continue
        if rnd.random() < 0.4:
            word = str(part)
        else:
            word = ""
            for place, small in ((1000, "천"), (100, "백"), (10, "십"), (1, "")):
                d, part = divmod(part, place)
                if d:
                    word += ("" if d == 1 and small and rnd.random() < 0.7 else str(d) if rnd.random() < 0.3 else "일이삼사오육칠팔구"[d - 1]) + small
        out += word + name + rnd.choice(["", " "])
    return out + rnd.choice(["원", "", "원 정도"])


def test_spelt_numbers_come_back(spark):
    rnd = random.Random(9)
    numbers = [rnd.randint(1, 10 ** rnd.randint(1, 12) - 1) for _ in range(300)]
    assert read(spark, A.won, [spelt(n, rnd) for n in numbers]) == numbers


def test_grounded_or_not(spark):
    row = spark.createDataFrame([("2만원과 3개, 5", ["20000", "5번"]), (None, None)], "t string, s array<string>")
    got = row.select(A.grounded_numbers(F.col("t"), F.col("s")).alias("g"), A.ungrounded_numbers(F.col("t"), F.col("s")).alias("u")).collect()
    assert [tuple(r) for r in got] == [(["20000", "5"], ["3"]), ([], [])]


def test_normal_amounts(spark):
    rows = spark.createDataFrame([("3만", "krw"), ("없음", "krw"), (None, "krw"), ("3만", "integer"), ("나, 가", "string_list"), ("x", None)], "a string, k string")
    assert [r[0] for r in rows.select(A.normalized_answer(F.col("a"), F.col("k"))).collect()] == ["30000", A.NONE, A.NONE, "3", '["가","나"]', "x"]


def test_amounts_are_read_once(spark):
    """Each step of an amount stands in the plan a few times, not once for each use of what it gives."""
    plan = spark.createDataFrame([("3만",)], "t string").select(A.won(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp") + plan.count("RLIKE") < 60
