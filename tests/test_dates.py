"""Written dates, their roles, and the filter by day."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from docketlake.functions import dates

CASES = [
    ("en", "Published on 3 March 2020, the Act enters into force on 2020-05-01 and expires December 31st, 2025.", [("publication", "2020-03-03"), ("effective", "2020-05-01"), ("expiry", "2025-12-31")]),
    ("en", "Last amended 4/12/2019. Review due 13/2/2021", [("last_modified", "2019-04-12"), ("review", "2021-02-13")]),
    ("de", "Veröffentlicht am 2. März 2021; tritt am 01.04.2021 in Kraft und am 5/6/2022 außer Kraft", [("publication", "2021-03-02"), ("effective", "2021-04-01"), ("expiry", "2022-06-05")]),
    ("fr", "Publié au Journal officiel le 1er août 2019. Entre en vigueur le 15 janv. 2020", [("publication", "2019-08-01"), ("effective", "2020-01-15")]),
    ("es", "Publicada el 2 de marzo de 2018 y en vigor desde el 5 de abril del 2018; caduca el 1/2/2030", [("publication", "2018-03-02"), ("effective", "2018-04-05"), ("expiry", "2030-02-01")]),
    ("en", "A meeting took place on Feb 29, 2020 and Feb 30, 2020.", [("publication", "2020-02-29")]),
    ("en", "The consultation closes 1 May 2024", [("consultation_end", "2024-05-01")]),
    ("en", "1 June 2021 (effective date)", [("effective", "2021-06-01")]),
    ("en", "Published 2020-01-31. It takes effect 30 days after publication.", [("publication", "2020-01-31"), ("effective", "2020-03-01")]),
    ("fr", "Publié le 31 janvier 2020, applicable 1 mois après la publication", [("publication", "2020-01-31"), ("effective", "2020-02-29")]),
    ("en", "version 2020-13-01, 2020-01-012, a2020-01-01 and 99/99/2020", []), ("en", "30 days after publication", []), ("en", "", []), ("en", None, []), (None, "1/2/2020", [("publication", "2020-02-01")]), ("en", "may 2020 march", []),
]


def test_dates(spark):
    rows = spark.createDataFrame([(i, lang, t) for i, (lang, t, _) in enumerate(CASES)], "i int, lang string, t string").select("i", dates.typed_dates(F.col("t"), F.coalesce("lang", F.lit(""))).alias("d"))
    for r in rows.collect():
        assert [(x["kind"], str(x["date"])) for x in r["d"]] == CASES[r["i"]][2], CASES[r["i"]][1]


def test_confidence(spark):
    t = "Effective 2020-01-01. Published by the office for the whole of the member states of it 2020-01-02. Some 2020-01-03"
    d = spark.range(1).select(dates.typed_dates(F.lit(t), F.lit("en")).alias("d")).first()["d"]
    assert [(x["kind"], x["confidence"]) for x in d] == [("effective", 0.9), ("publication", 0.7), ("publication", 0.5)]


@pytest.mark.parametrize("lang", sorted(dates.MONTHS))
def test_every_day_and_month(spark, lang):
    days = [date(2020, m, 1 + (7 * m) % 28) for m in range(1, 13)]
    names = dates.MONTHS[lang].split()
    forms = lambda d: [f"{d.day} {names[d.month - 1]} {d.year}", f"{names[d.month - 1].title()} {d.day}, {d.year}", f"{d.day}. {names[d.month - 1]} {d.year}", f"{d:%Y-%m-%d}"]
    rows = [(str(d), f) for d in days for f in forms(d)]
    got = spark.createDataFrame(rows, "want string, t string").select("want", dates.typed_dates(F.col("t"), F.lit(lang)).alias("d")).collect()
    assert all([str(x["date"]) for x in r["d"]] == [r["want"]] for r in got)


def test_replies(spark):
    now = F.lit("2024-05-06").cast("timestamp")
    of = lambda reply: spark.range(1).select(dates.reply_dates(F.lit(reply), now).alias("d")).first()["d"]
    assert [tuple(x) for x in of('{"dates_found": [{"date": "2020-01-02T00:00:00", "confidence": 0.8, "original_text": "x"}, {"date_type": "expiry"}]}')] == [("publication", date(2020, 1, 2), 0.8, "x"), ("expiry", date(2024, 5, 6), 0.5, "")]
    assert of("{}") == [] and of('{"dates_found": [{"date_type": "birthday"}]}') is None and of("no json") is None and of(None) is None


def test_todays(spark):
    texts = [(1, "Published 2024-01-02"), (2, "Effective 2024-01-02, published 2023-12-01"), (3, "Expires 2024-01-02"), (4, None)]
    rows = spark.createDataFrame(texts, "id int, t string").withColumn("d", dates.typed_dates(F.col("t"), F.lit("en")))
    assert [(r["id"], r["published_today"], r["effective_today"]) for r in dates.todays(rows, "d", F.lit("2024-01-02").cast("date")).orderBy("id").collect()] == [(1, True, False), (2, False, True)]


def test_texts_that_may_name_a_day(spark):
    """No text that dates anything to the day is passed over; most that don't are."""
    texts = [(lang, t, str(d)) for lang, t, found in CASES if t for _, d in found] + [("en", f"{d} May 2020, {m} 7 2021", "1999-05-07") for d in (7, 17, 27) for m in ("June", "July")]
    rows = spark.createDataFrame(texts, "lang string, t string, day string").withColumn("on", F.to_date("day"))
    got = rows.select("t", "day", dates.may_name(F.col("t"), F.col("on")).alias("may")).collect()
    assert [r["may"] for r in got] == [r["day"] != "1999-05-07" for r in got]
    # the year 900, days of one and two digits, neighbours of a day's digits
    odd = [("Published 0900-01-02", "0900-01-02", True), ("Published 2020-01-12", "2020-01-02", False), ("Published 2. 1. 2020", "2020-01-02", True), ("On 22/1/2020", "2020-01-02", False), (None, "2020-01-02", None)]
    rows = spark.createDataFrame([(i, t, d) for i, (t, d, _) in enumerate(odd)], "i int, t string, d string")
    assert [r["m"] for r in rows.orderBy("i").select(dates.may_name(F.col("t"), F.to_date("d")).alias("m")).collect()] == [x for *_, x in odd]


@pytest.mark.parametrize("name", ["typed_dates", "todays_records"])
def test_dates_are_read_once(spark, sf_dir, name):
    """No condition of the plan reads the dates again."""
    from docketlake.plans import catalogue

    plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line[:200] for line in plan if "Filter" in line and "regexp" in line]


def test_letters_that_fold(spark):
    """What (?iu) takes for a small letter is one in cues too."""
    texts = ["PUBL\u0130SHED 2020-01-02", "EXP\u0131RES 2020-01-02", "\u212aonsultation endet 2020-01-02", "i\u017f\u017fued 2020-01-02"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", dates.typed_dates(F.col("t"), F.lit("en")).alias("d")).orderBy("id").collect()
    assert [[(x["kind"], x["confidence"]) for x in r["d"]] for r in rows] == [[("publication", 0.9)], [("expiry", 0.9)], [("consultation_end", 0.9)], [("publication", 0.9)]]
