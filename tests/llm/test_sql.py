"""Every query of this subpackage that has SQL gives what DuckDB gives, on all rows."""

import random

import duckdb
import pytest

from orbweave.llm.queries import ORACLES, QUERIES
from tests.duck import connect, differences


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert rows and not differences(connect(sf_dir), ORACLES[name], df.columns, rows)


WORDS = ["a", "b", "C", "c", "é", "x1", "The", "end."]


def corpus(seed):
    """Texts that share words, shingles and windows, some null, empty, blank or equal."""
    rnd = random.Random(seed)
    base = [" ".join(rnd.choices(WORDS, k=rnd.randrange(40))) for _ in range(12)]
    rows = []
    for i in rnd.sample(range(-40, 400), 120):
        text = rnd.choice([None, "", " \t\n", rnd.choice(base), rnd.choice(base) + rnd.choice([" ", "\n"]) + rnd.choice(base), rnd.choice(base).upper(), "<P>" + rnd.choice(base)])
        rows.append((i, text, rnd.choice(["s1", "s2", "s3", "é", "", None])))
    return rows


@pytest.mark.parametrize("name", ["op5_ngram_jaccard", "op7_substring_dedup", "op8_sharding", "op9_mixing", "op11_fill_in_middle"])
@pytest.mark.parametrize("seed", [1, 2])
def test_documents_of_any_kind(spark, tmp_path, name, seed):
    at = str(tmp_path / "documents.parquet")
    spark.createDataFrame(corpus(seed), "doc_id long, text string, source string").repartition(3).write.parquet(at)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/*.parquet'")
    df = QUERIES[name](spark, str(tmp_path))
    bad = differences(duck, ORACLES[name], df.columns, df.collect())
    assert not bad, bad[:3]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_conversations_of_any_kind(spark, tmp_path, seed):
    rnd, rows = random.Random(seed), []
    for c in [None, *range(50)]:
        for _ in range(rnd.randint(1, 9)):
            rows.append((c, rnd.choice([None, None, 1, 2, 3, 9, -4]), rnd.choice([None, "user", "assistant", "system", "tool", "", "User"]), rnd.choice([None, "", " \t", "yes.", "yes.", "no", "what?  ", "é中"])))
    at = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(at)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{at}/*.parquet'")
    df = QUERIES["op13_conversation_repair"](spark, str(tmp_path))
    bad = differences(duck, ORACLES["op13_conversation_repair"], df.columns, df.collect())
    assert not bad, bad[:3]
