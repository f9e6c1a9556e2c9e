import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHING = ["score", "ids", "decoded", "_fp", "n_lines", "n_dropped", "_frequent", "n_words", "n_removed", "kept_text", "_spans", "_hash", "email", "ip", "card", "phone", "_base", "_candidates", "n_email", "base_spans", "all_spans", "sequence_id", "offset", "length", "piece", "toxic", "trusted", "_trusted", "_doc", "_document", "_key", "_covered", "_whole", "_part", "_spans_", "_row", "_bands", "_size", "kind", "row", "spans", "whole", "base", "candidates", "n_ip", "n_card", "n_phone", "document", "digest", "segment", "at", "shard"]


def edge_texts():
    r = random.Random(7)
    vocabulary = ["alpha", "Beta", "gamma's", "élan", "ünter", "x1", "(delta)", "the", "of"]
    long = " ".join(r.choice(vocabulary) for _ in range(30_000))
    passage = " ".join(f"w{i}" for i in range(60))
    return [
        None, "", " ", "\n\n", "one", "two words", "Same line\nother", "z" * 5000, "é" * 3000, "1" * 4000, long, long + " end", "the " * 3000,
        "a b c d\n" + passage, passage + " tail", "before " + passage + " after\nSame line", "Mail me.x@y.org, +1 (555) 010-2030 or 4111 1111 1111 1111 at 10.0.0.256 and 10.0.0.25",
        "a@b.c_d@e.f 1.2.3.4.5.6.7.8 +12", "token = \"0a1b2c3d4e5f60718293a4b5c6d7e8f901234567\"", " nbsp em\x1cfs", "<|endoftext|> x", "# * $ % & | < >",
    ] + ["common line\nown %d" % i for i in range(12)] + ["exactly the same document text again"] * 15


@pytest.fixture(scope="session")
def docs(spark):
    """Odd documents with nulls in every column, repeated rows, and columns of clashing names."""
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else "s", None if i % 3 == 0 else 1) for i, t in enumerate(edge_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def cluttered(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
