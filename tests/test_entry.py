import glob
import os
from collections import Counter

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_core_queries_against_sql(spark):
    import duckdb

    from weftline.plans.oracle import SQL
    from weftline.plans.queries import QUERIES

    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")

    def plain(frame):
        cols = sorted(frame.columns)
        return cols, Counter(tuple("null" if v is None or v != v else round(float(v), 4) if isinstance(v, float) else str(v) for v in r) for r in frame[cols].itertuples(index=False))

    for name in ("clean_text", "chunk_spans", "parse_json_array", "rrf_fusion", "span_overlap", "verdict_strict", "threshold_sweep", "retrieval_metrics", "ledger_fingerprint", "mentions", "qualifier_tags", "quote_exact", "stratified_sample"):
        assert plain(QUERIES[name](spark, SMALL).toPandas()) == plain(con.execute(SQL[name]).df()), name


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    r = e.entry(spark).collect()
    assert len(r) > 0 and {x.verdict for x in r} <= {"CONSISTENT", "CONTRADICTORY", "INSUFFICIENT_EVIDENCE"}


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_embedding_of_chunks_against_sql(spark):
    import duckdb

    from weftline.plans.oracle import SQL
    from weftline.plans.queries import QUERIES

    con = duckdb.connect()
    con.execute(f"create view document_chunks as select * from '{SMALL}/document_chunks.parquet'")
    got, want = QUERIES["hashed_embedding_chunks"](spark, SMALL).toPandas(), con.execute(SQL["hashed_embedding_chunks"]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) > 0
    assert Counter(got[cols].round(4).itertuples(index=False, name=None)) == Counter(want[cols].round(4).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_mentions_of_documents_against_brute_force(spark):
    """Not against SQL, which cuts words at letters outside ASCII."""
    import re

    from weftline.functions.text import MENTION_STOPWORDS
    from weftline.plans.queries import QUERIES

    want = set()
    for doc, text in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        seen = []
        for run in re.findall(r"\b[A-Z][a-zA-Z]*\b(?:\s+[A-Z][a-zA-Z]*\b)*", text or ""):
            for part in " ".join("\n" if w in MENTION_STOPWORDS else w for w in run.split()).split("\n"):
                if len(part.strip()) >= 2 and part.strip() not in seen:
                    seen.append(part.strip())
        want |= {(doc, k, m) for k, m in enumerate(seen)}
    assert {tuple(r) for r in QUERIES["mentions_documents"](spark, SMALL).select("doc_id", "pos", "mention").collect()} == want
