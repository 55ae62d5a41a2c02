"""Queries against their SQL over texts that the driver tables hold seldom or not at all."""

import pytest

import __spark_entry__ as entry_module
from tests.compare import compare

QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()
LONG = "a line that is long enough to be kept"
SECTIONS = ["", " ", "\n", None, "x", LONG, f"{LONG}\n", f"{LONG}\n\n", f"{LONG}\n \t", f"\n{LONG}", f"{LONG}\n\n{LONG}\nshort\n{LONG}", f"{LONG} \n{LONG}\x0b",
            f"  {LONG} \r\n{LONG}\x1f", f"Section 9: {LONG}\n12. {LONG}", f"{LONG} \n　　{LONG}", "word " * 1200 + f" \n{LONG}", "1\n2\n3"]
COPIES = ["groß", "gross", "GROSS", "Groß", "GROẞ", "größer als", "grösser als", "", None, "...", "Été", "ete", "ÉTÉ", "ŉ a", "ǰ b", "ᾳ c", "a b", "a  b", "A-B"]


@pytest.mark.parametrize(("name", "texts"), [("chunk_sections", SECTIONS), ("ingest_flags", COPIES)])
def test_as_sql(spark, tmp_path, name, texts):
    import duckdb
    con = duckdb.connect()
    rows = [(k, t, "en", f"src{k % 2}", None if t is None else len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 0, 0) for k in range(len(texts))], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    for table in ("documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    ok, message = compare(QUERIES[name](spark, str(tmp_path)), con, ORACLES[name])
    assert ok, message
