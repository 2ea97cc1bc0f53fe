"""What is relevant to an item, for items of every shape, against DuckDB."""

import duckdb

from sieveline.plans import oracle, queries

TEXTS = ["one two three four", "onetwo threefour", "a one two b", "一二三四五六七八", "x一二三y", "tab\tone\nnew", "", None, "two", " lone ", "lone", "one  two", "twenty-one two-fold"]
ITEMS = ["one two three", "one two", "one", "二三", "", None, "lone ", " lone", " lone ", "\tone\n", "a one two b", "absent", "absent words here", "ne tw", "-one two-"]


def test_items_without_a_word_between_blanks(spark, tmp_path):
    docs = [(i if t != "a one two b" else None, t, "en", "web") for i, t in enumerate(TEXTS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = set(con.execute(f"WITH {oracle.MEM}, {oracle.ITEMS}, {oracle.ITEM_RELS} SELECT DISTINCT query_id, doc_id FROM rel").fetchall())
    got = [tuple(r) for r in queries.item_qrels(spark, str(tmp_path)).collect()]
    assert len({q for q, _ in want}) > 10  # items of every shape have something relevant
    assert len(got) == len(set(got)) and set(got) == want
