"""Queries against their SQL over small tables with near ties, odd references and large archives."""

import numpy as np
import pandas as pd
import pytest

from quillmere import queries


@pytest.fixture
def held(spark, tmp_path):
    """Holds a query over tables given as data frames against its SQL in DuckDB, as bags of rows."""
    import duckdb

    def check(name, **tables):
        con = duckdb.connect()
        for table, rows in tables.items():
            rows.to_parquet(tmp_path / f"{table}.parquet", index=False)
            con.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet')")
        found = [tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(map(repr, found)) == sorted(map(repr, con.execute(queries.ORACLES[name]).fetchall()))
        return found

    return check


def test_answer_of_near_ties(held):
    """Vectors that differ from vector 0 in the last bits: their order is that of SQL's own digits."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=64)
    rows = [base.astype("f4")] + [(base * (1 + 3e-8 * rng.normal(size=64)) * rng.uniform(0.5, 2)).astype("f4") for _ in range(60)]
    held("global_answer", embeddings=pd.DataFrame({"vec_id": range(len(rows)), "embedding": rows, "label": np.int32(2)}))


@pytest.mark.parametrize("labels", [[4] * 12 + [1], [3] * 5, [4] * 9 + [1]])
def test_answer_without_summaries(held, labels):
    """Copies of vector 0, whose label gives no summary: more than are ranked, none that is ranked, and one less than are ranked."""
    rows = [np.linspace(1, 2, 8).astype("f4")] * len(labels)
    found = held("global_answer", embeddings=pd.DataFrame({"vec_id": range(len(rows)), "embedding": rows, "label": np.array(labels, "i4")}))
    assert (found == [(None,)]) == (labels.count(4) != 9)


def test_titles_with_other_references(held):
    """References other than those of <, > and & are plain text, as are ones cut off."""
    titles = ["a &lt;b&gt; &amp; c", "say &quot;x&quot;", "cut &amp", "cut &am", "&amp;lt; &amp;quot;", "&#65; &#x41; &eacute;", "&lt &nbsp;x", " two\n lines ", "&&amp;;"]
    held("page_title", pages=pd.DataFrame({"page_id": range(len(titles)), "html": [f"<html><head><title>{t}</title></head><body>b</body></html>" for t in titles]}))


def test_more_notes_than_an_archive_holds(spark, tmp_path):
    from quillmere.sources import archives

    notes = [(f"n{i:03}", "x" * i) for i in range(100)]
    limits = archives.Limits(entries=9, total=300, each=99)
    archives.write_archives(spark.createDataFrame(notes, archives.NOTE), f"file://{tmp_path}/a", 2, limits)
    read = archives.read_archives(spark, f"file://{tmp_path}/a", limits)
    assert sorted(map(tuple, read.collect())) == notes
    assert len(list((tmp_path / "a").iterdir())) > 12
    with pytest.raises(Exception, match="over a limit"):
        archives.write_archives(spark.createDataFrame([("big", "x" * 100)], archives.NOTE), f"file://{tmp_path}/b", 2, limits)
