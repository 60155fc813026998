"""Instances that are read in splits against the reader of whole files."""

import random

from ledgerloom.sources import instance_xml


def written(path, n, seed):
    rng = random.Random(seed)
    out = ['<?xml version="1.0" encoding="utf-8"?>\n<xbrli:xbrl xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:xbrldi="http://xbrl.org/2006/xbrldi" xmlns:find="http://www.eurofiling.info/xbrl/ext/filing-indicators" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"\n xmlns:m="urn:m" xmlns:d="urn:d" xmlns:x="urn:x">']
    for c in range(n // 3):
        members = "".join(f'<xbrldi:explicitMember dimension="d:D{k}">x:é{rng.randint(0, 9)}</xbrldi:explicitMember>' for k in range(c % 4))
        members += f'<xbrldi:typedMember dimension="d:T"> <d:row>R &amp; {c} &lt;</d:row></xbrldi:typedMember>' if c % 5 == 0 else ""
        period = "<xbrli:startDate>2024-01-01</xbrli:startDate>\n<xbrli:endDate>2024-12-31</xbrli:endDate>" if c % 2 else "<xbrli:instant>2024-06-30</xbrli:instant>"
        out.append(f'  <xbrli:context id="c{c}">\n<xbrli:entity><xbrli:identifier scheme="s">LEI</xbrli:identifier></xbrli:entity><xbrli:period>{period}</xbrli:period>{"<xbrli:scenario>" + members + "</xbrli:scenario>" if members else ""}\n</xbrli:context>')
    out.append('<xbrli:unit id="u"><xbrli:measure>iso4217:GBP</xbrli:measure></xbrli:unit><find:fIndicators><find:filingIndicator contextRef="c0">C01.00</find:filingIndicator></find:fIndicators>')
    for i in range(n):
        ref = f"c{rng.randint(0, n // 3)}"  # the last one is in no file
        out.append([f'<m:a{i % 7} contextRef="{ref}" unitRef="u" decimals="-3">{i}.5</m:a{i % 7}>', f'<m:b id="f{i}" contextRef=\'{ref}\' decimals="INF">\n text &quot;{i}&quot; &amp;amp; é </m:b>', f'<m:c contextRef="{ref}" xsi:nil="true"/>', f'<m:d contextRef="{ref}" ></m:d>'][i % 4])
    path.write_text("\n".join([*out, "</xbrli:xbrl>"]), encoding="utf-8-sig")


def test_splits_give_the_rows_of_whole_files(spark, tmp_path):
    for i, n in enumerate((400, 9, 3)):
        written(tmp_path / f"i{i}.xbrl", n, i)
    whole = instance_xml.read_instances(spark, str(tmp_path))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str((tmp_path / "i0.xbrl").stat().st_size // 5))
        split = instance_xml.read_large_instances(spark, str(tmp_path))
        rows = lambda df: sorted((str(tuple(r)), r) for r in df.select(*whole.columns).collect())
        got = {(r.file, r.fact_id): r.asDict() for _, r in rows(split)}
        blocks = spark.read.option("lineSep", "</").text(str(tmp_path / "i0.xbrl")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {(r.file, r.fact_id): r.asDict() for _, r in rows(whole)}
    assert blocks >= 4 and len(want) == 412 and got.keys() == want.keys()
    for k in want:
        assert got[k] == want[k], k
