"""Metadata of recognised texts against the patterns as Python reads them; ranges of pages."""

import random
import re

from pyspark.sql import functions as F

from docketlake import dictionaries as D
from docketlake.functions import recognised


def plain(text):
    dates = [m for p in D.RECOGNISED_DATES for m in re.findall(p, text)]
    number = next((m[0] for p in D.RECOGNISED_NUMBERS if (m := re.findall(p, text, re.IGNORECASE))), None)
    lines = [x.strip() for x in text.split("\n")]
    who = next((x for x in lines[:10] if any(k in x.lower() for k in D.AUTHORITY_WORDS) and len(x) > 10), None)
    title = next((x for x in lines[:5] if 10 < len(x) < 100 and (x.isupper() or any(w in x.lower() for w in D.TITLE_WORDS))), None)
    kind = next((k for k, words in D.RECOGNISED_TYPES.items() if any(w in text.lower() for w in words)), None)
    signs = [w for w in D.SIGNATURE_WORDS if w in text.lower()]
    first, second = [*dates, None, None][:2]
    return first, second, number, who, kind, title, signs, sum(x is not None for x in (first, who, kind, title)) / 4


def test_metadata(spark):
    r = random.Random(1)
    parts = ["DEPARTMENT OF SAFETY", "  Ministry of Trade, Office 4 ", "REGULATION ON TOYS", "Consumer Act of 1999", "No. 12-B", "Document Number: AB-1234", "dated 1/2/2020", "3 March 2021", "April 5, 2022 and 06-07-2023", "Signed by x", "APPROVED BY y", "short", "", "12 345", "the code of practice", "form 9", "Ünïcode LINE ÀÉ"]
    texts = ["", "\n\n"] + ["\n".join(r.choice(parts) for _ in range(r.randrange(1, 14))) for _ in range(120)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", recognised.document_metadata(F.col("t")).alias("m")).collect()
    for x in rows:
        assert tuple(x["m"]) == plain(texts[x["i"]]), texts[x["i"]]
    assert spark.range(1).select(recognised.document_metadata(F.lit(None).cast("string")).alias("m")).first()["m"]["confidence"] == 0


def test_page_ranges(spark):
    pages = spark.createDataFrame([("d", 1, "one"), ("d", 2, " \n"), ("d", 3, "three"), ("d", 4, None), ("d", 5, "five"), ("e", 1, ""), ("f", 9, "x")], "doc string, n int, t string")
    got = {x["doc"]: tuple(x)[1:] for x in recognised.page_range(pages, "doc", "n", "t", 1, 4).collect()}
    text = "\n--- Page 1 ---\none\n--- Page 3 ---\nthree"
    assert got == {"d": (4, len(text), text, True), "e": (1, 0, "", False)}
    assert recognised.page_range(pages, "doc", "n", "t").where("doc = 'd'").first()["pages_processed"] == 5


def test_long_numbers_against_sql(spark, sf_dir, tmp_path):
    """Keys of seven and more digits, as larger tables have."""
    import duckdb
    from test_catalogue import shown

    from docketlake.plans import catalogue

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").limit(40)
    orders.withColumn("o_orderkey", F.col("o_orderkey") * 99_999).write.parquet(f"{tmp_path}/orders.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    ours, sql = catalogue.QUERIES["recognised_metadata"](spark, str(tmp_path)).toPandas(), c.sql(catalogue.ORACLE_SQL["recognised_metadata"]).df()
    assert len(ours) == 40 and shown(ours) == shown(sql)
