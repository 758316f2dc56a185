"""Queries that write files and read them back."""

from pitloom.plans.ingest import sc5_price_files
from pitloom.sources.tables import bars

SF = "/root/testdata/sf0.001"


def test_price_files_go_to_a_folder_that_exists(spark):
    out = [sc5_price_files(spark, SF) for _ in range(2)]
    want = {(str(r.date), r.ticker, r.volume) for r in bars(spark, SF).collect()}
    for df in out:
        rows = df.collect()
        assert len(rows) == len(want) and {(r.date, r.ticker, r.volume) for r in rows} == want
