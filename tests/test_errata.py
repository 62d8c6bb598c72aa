import json

import pytest
from pyspark.sql import functions as F

from arcloom import fixed_values as V
from arcloom.operators import errata as E
from arcloom.plans.base import fill_records


@pytest.mark.parametrize("affects,installed,hit", [
    # own cases: ordering, equal releases of unequal length, all operators
    (["grab<=2.4"], {"grab": "2.3.9"}, True), (["grab<=2.4"], {"grab": "2.4.0.0"}, True), (["grab<=2.4"], {"grab": "2.10"}, False),
    (["grab>3,<=5"], {"grab": "5.0"}, True), (["grab>3,<=5"], {"grab": "3"}, False), (["grab!=7"], {"grab": "7.0.0"}, False),
    (["grab>=1", "store<4"], {"grab": "1", "store": "3.9"}, True), (["grab>=1", "store<4"], {"grab": "1"}, False),
    (["grab"], {"grab": "anything"}, True), (["grab>=1"], {"grab": "anything"}, False), (["grab==4.2"], {}, False),
    # pre-, post- and development releases
    (["grab<2"], {"grab": "1.9rc1"}, True), (["grab<2"], {"grab": "1.9.dev3"}, True), (["grab<2"], {"grab": "1.9.post1"}, True),
    (["grab<2"], {"grab": "v1.9"}, True), (["grab<2"], {"grab": "2.0rc1"}, False), (["grab<2rc2"], {"grab": "2.0rc1"}, True),
    (["grab>2"], {"grab": "2.0.post1"}, False), (["grab>2"], {"grab": "2.0.1"}, True), (["grab>=2"], {"grab": "2.0.post1"}, True),
    (["grab>=2"], {"grab": "2.0b4"}, False), (["grab>2a1"], {"grab": "2a2"}, True), (["grab>2.dev5"], {"grab": "2a1"}, True),
    (["grab<=2"], {"grab": "2+build.7"}, True), (["grab==2"], {"grab": "2.0+build.7"}, True), (["grab==2+b"], {"grab": "2"}, False),
    (["grab>9"], {"grab": "1!1"}, True),
    # prefixes and compatible releases
    (["grab==3.1.*"], {"grab": "3.1.8"}, True), (["grab==3.1.*"], {"grab": "3.10"}, False), (["grab==3.0.*"], {"grab": "3"}, True),
    (["grab!=3.*"], {"grab": "3.5"}, False), (["grab~=1.4"], {"grab": "1.9"}, True), (["grab~=1.4.2"], {"grab": "1.5"}, False),
    (["grab~=1.4"], {"grab": "2.0"}, False), (["grab~=1.4"], {"grab": "1.3"}, False),
    # any number of parts, any size
    (["grab==1"], {"grab": "1.0.0.0.0.0.0.0.1"}, False), (["grab>1"], {"grab": "1.0.0.0.0.0.0.0.1"}, True),
    (["grab>1"], {"grab": "20230101120000"}, True), (["grab>=20230101120000"], {"grab": "20230101120001.1"}, True),
])
def test_requirements(spark, affects, installed, hit):
    pairs = [x for k, v in installed.items() for x in (F.lit(k), F.lit(v))]
    matched = E.Erratum("u", "d", affects).matches(F.create_map(*pairs))
    assert spark.range(1).select(matched.alias("m")).first().m is hit


@pytest.mark.parametrize("text", ["a<x", "a<1.0;b", "<1", "a<1.0,~2", "a~=2", "a<1.*"])
def test_bad_requirements(text):
    with pytest.raises(ValueError):
        E.parse_requirement(text)


def test_lookup_by_id():
    known = E.builtin_errata("p")
    assert E.erratum_by_id(known, V.ERRATA_CONTENT_TYPE).fixable
    with pytest.raises(ValueError, match="exist"):
        E.erratum_by_id(known, "nope")
    with pytest.raises(ValueError, match="fixable"):
        E.erratum_by_id(known, V.ERRATA_PRE_RELEASE)
    assert E.erratum_by_id(known, V.ERRATA_PRE_RELEASE, only_fixable=False).uuid == V.ERRATA_PRE_RELEASE


def infos(spark, rows):
    df = spark.createDataFrame(rows, "file_seq INT, record_seq BIGINT, body STRING")
    return fill_records(df.select("file_seq", "record_seq", F.lit("warcinfo").alias("rec_type"),
                                  F.encode("body", "UTF-8").alias("payload"), F.lit("f").alias("file_path")))


def software(*packages, tool="t"):
    return json.dumps({"tool": tool, "software": {"self": [{"projectName": p, "version": v} for p, v in packages]}})


def fixed(*ids):
    return json.dumps({"tool": "fixer", "parameters": {"errata": list(ids)}})


def test_check_skips_what_is_foreign_or_already_fixed(spark):
    rows = [
        (0, 1, software(("p", "1.0.0"))), (0, 2, fixed(V.ERRATA_CONTENT_TYPE)), (0, 3, software(("p", "1.0"))),
        (0, 4, software(("p", "0.9"))), (1, 1, "plain text"), (1, 2, '{"tool": "x"}'), (1, 3, "[]"),
        (1, 4, software(("q", "0.1"), ("p", "0.5"), ("p", "1.0.0"))), (1, 5, software(("p", "2.0"))),
    ]
    found = E.check(infos(spark, rows), E.builtin_errata("p"), "fixer").collect()
    assert {(r.file_seq, r.record_seq, r.uuid) for r in found} == {
        (0, 1, V.ERRATA_CONTENT_TYPE), (0, 4, V.ERRATA_PRE_RELEASE), (1, 4, V.ERRATA_CONTENT_TYPE)}
    any_ = {r.file_seq: (r.n_errata, r.has_errata)
            for r in E.has_errata(infos(spark, rows + [(2, 1, "x")]), E.builtin_errata("p"), "fixer").collect()}
    assert any_ == {0: (2, True), 1: (1, True), 2: (0, False)}


def test_fix_changes_the_value_and_nothing_else(spark):
    from arcloom.operators.records import render_headers

    df = spark.createDataFrame(
        [(1, "application/json; encoding=utf-8"), (2, "text/html; charset=x"), (3, None)], "record_seq BIGINT, content_type STRING")
    recs = render_headers(fill_records(df.withColumn("payload", F.lit(b"x"))))
    fix = E.erratum_by_id(E.builtin_errata("p"), V.ERRATA_CONTENT_TYPE)
    out = {r.record_seq: r for r in E.fixed_records(recs, fix).collect()}
    assert out[1].content_type == "application/json; charset=utf-8"
    assert [h.value for h in out[1].headers if h.name == "Content-Type"] == ["application/json; charset=utf-8"]
    assert out[2].content_type == "text/html; charset=x" and out[3].content_type is None
    t = E.fix_totals(recs, fix).first()
    assert (t.fixed, t.processed) == (1, 3)
