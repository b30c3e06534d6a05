"""What the fourth round's findings showed, on small inputs."""

import pytest

from siltstone.plans import catalogue
from siltstone.sources import workbook
from siltstone.sources.sinks import WorkbookSink


@pytest.mark.parametrize("most", [4, 5, 10])
def test_all_sheets_of_a_workbook_are_read(spark, duck, monkeypatch, most):
    """Ten rows over sheets of which the last is shorter, or has no rows."""
    from checking import SMALL, same_rows

    monkeypatch.setattr(WorkbookSink, "MOST_ROWS", most)
    same_rows(catalogue.QUERIES["workbook_items"](spark, SMALL), duck, catalogue.SQL["workbook_items"])


def test_sheets_one_after_the_other(spark, tmp_path, monkeypatch):
    import zipfile

    monkeypatch.setattr(WorkbookSink, "MOST_ROWS", 30)
    path = f"{tmp_path}/w.xlsx"
    WorkbookSink(path).write(spark.range(100).selectExpr("cast(id as string) as id", "'x' as note").coalesce(1))
    workbook.register(spark)
    read = spark.read.format("workbook").options(sheet="*", rows=20).load(path)
    assert read.rdd.getNumPartitions() == 7 and [r.id for r in read.collect()] == [str(k) for k in range(100)]
    assert spark.read.format("workbook").options(sheet="Data4").load(path).count() == 10

    other = f"{tmp_path}/o.xlsx"
    with zipfile.ZipFile(path) as have, zipfile.ZipFile(other, "w") as z:
        for n in have.namelist():
            z.writestr(n, have.read(n).replace(b">note<", b">remark<") if n.endswith("sheet2.xml") else have.read(n))
    with pytest.raises(Exception, match="remark"):
        spark.read.format("workbook").options(sheet="*").load(other).count()
    assert spark.read.format("workbook").load(other).count() == 30
