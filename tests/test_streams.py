"""Files are read and written as streams: what a task holds doesn't grow with a file or with the files of a batch."""

import tracemalloc

import pyarrow as pa

from ledgerloom.sources import package, workbook


def _batch(*contents):
    return pa.RecordBatch.from_arrays([pa.array([f"f{i}" for i in range(len(contents))]), pa.array(contents, pa.binary())], names=["path", "content"])


def _peak(run):
    tracemalloc.start()
    try:
        n = run()
        return n, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_linkbase_rows_of_many_files_are_handed_on_in_parts():
    inside = "".join(f'<l:loc x:type="locator" x:href="s.xsd#n{i}" x:label="l{i}"/>' for i in range(4_000))
    one = f'<l:linkbase xmlns:l="l" xmlns:x="http://www.w3.org/1999/xlink"><l:link x:type="extended" x:role="r">{inside}</l:link></l:linkbase>'.encode()

    def run():
        sizes = [b.num_rows for b in package._links(iter([_batch(one, one, one)]))]
        assert max(sizes) <= package.MOST_ROWS
        return sum(sizes)

    n, peak = _peak(run)
    assert n == 12_000
    assert peak < 8 << 20


def test_linkbase_rows_of_nested_elements_and_links():
    one = (
        b'<a xmlns="u" xmlns:x="http://www.w3.org/1999/xlink" xmlns:q="urn:q"><b><link x:type="extended" x:role="r"><n x:type="resource" x:label="n" x:role="z" order="2"><concept><qname>q:c</qname></concept>'
        b'<f dimension="q:d"><member><qname>q:m</qname></member></f></n><in x:type="extended" x:role="s"><loc x:type="locator" x:href="h"/></in>said</link></b></a>'
    )
    rows = [r for b in package._links(iter([_batch(one)])) for r in b.to_pylist()]
    got = {(r["role"], r["tag"]): r for r in rows}
    assert set(got) == {("r", "n"), ("r", "in"), ("s", "loc")}
    assert got["r", "n"]["parts"] == [{"tag": "qname", "text": "concept:{urn:q}c"}, {"tag": "qname", "text": "member:{urn:q}m"}, {"tag": "f", "text": "aspect:{urn:q}d={urn:q}m"}]
    assert got["r", "n"]["ord"] == 2.0 and dict(got["r", "n"]["attributes"]) == {"order": "2", "xlink:role": "z"}


def test_workbook_cells_are_handed_on_in_parts():
    book = workbook.file_of({"S": [["a", "b"] for _ in range(30_000)]})

    def run():
        sizes = [b.num_rows for b in workbook._read(iter([_batch(book)]))]
        assert max(sizes) <= workbook.MOST_CELLS
        return sum(sizes)

    n, peak = _peak(run)
    assert n == 60_000
    assert peak < 16 << 20


def test_workbooks_of_far_rows(spark):
    """A row's number costs nothing: a cell in the row 30,000,000 is one row of the file."""
    cells = [("p", "S", 30_000_000, 2, "x & y"), ("p", "S", 1, 0, "a"), ("p", "T", 0, 1, None), ("p", "T", 0, 2, "c"), ("q", "S", 5, 0, "a")]
    table = spark.createDataFrame(cells, workbook.CELLS).repartition(3)
    got = {tuple(r) for r in workbook.cells(workbook.files_of(table)).collect()}
    assert got == {c for c in cells if c[4]}
    sheets = {tuple(r) for r in workbook.cells(workbook.files_of(table)).select("path", "sheet").distinct().collect()}
    assert sheets == {("p", "S"), ("p", "T"), ("q", "S")}
