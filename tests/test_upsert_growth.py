"""A large upsert is written once."""

from runledger.config import LedgerConfig
from runledger.sources.store import MergedTable
from test_metrics import frame


def test_one_large_upsert_is_not_copied_before_compaction(spark, tmp_path, monkeypatch):
    table = MergedTable(spark, str(tmp_path / "t"), LedgerConfig(metrics=(), compact_rows=1))
    df = frame(spark, 40)
    table.replace(df)
    staged = []
    real = MergedTable.stage
    monkeypatch.setattr(MergedTable, "stage", lambda self, rows: staged.append(real(self, rows)) or staged[-1])
    part = table.stage(df.where("RawFileName < 'A_Sample_00020'"))
    table.upsert(part, 20, 0)
    assert len(staged) == 2 and table.read().count() == 40
