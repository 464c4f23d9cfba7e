import json

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.operators import jsonnodes


def brute(key, texts):
    def refuse(_):
        raise ValueError

    out = set()

    def walk(v, path, near):
        if isinstance(v, tuple):
            out.add((key, path, near))
            for k, x in v[1]:
                walk(x, f"{path}/{k}", path)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}/{i}", near)

    for i, t in enumerate(texts or []):
        try:
            walk(json.loads(t, parse_constant=refuse, object_pairs_hook=lambda p: ("o", p)), str(i), "")
        except (ValueError, TypeError):
            pass
    return out


def kernel(lists, f=jsonnodes._node_batches):
    table = pa.table({"k": list(range(len(lists))), "t": pa.array(lists, pa.list_(pa.string()))})
    return [tuple(r.values()) for b in f(iter(table.to_batches())) for r in b.to_pylist()]


CASES = ["{}", "[]", '{"a":1}', '[{},{"a":[]}]', '{"a":{"b":[1,{"c":null}]}}', '{"a\\u0041\\n":{}}', "[1,]", "{,}", '{"a":1,}', "[NaN]", "01", '{"é":{"ü":[{}]}}', '"\\"', '"\\\\"', "{}{}", '{"a":tru}', "[1 2]", '{"a"b:1}', '"a"b', '{"k":{},"k":{}}', "", " {} ", '{"a":"\t"}', '{"a":"\\x"}', "{'a':1}", '{"a":{}}//x', "﻿{}"]


def test_cases_and_nulls():
    lists = [[c] for c in CASES] + [CASES, None, [], [None, "{}"]]
    want = set().union(*(brute(i, x) for i, x in enumerate(lists)))
    got = kernel(lists)
    assert set(got) == want and len(got) == len(want)


json_like = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=6), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=20)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(json_like.map(json.dumps) | st.text(alphabet='{}[]:,"\\ 1e-truefalsn', max_size=12), max_size=4), max_size=4))
def test_any_text_agrees_with_a_parser(lists):
    assert set(kernel(lists)) == set().union(set(), *(brute(i, x) for i, x in enumerate(lists)))


def test_deep_long_and_many_blocks(monkeypatch):
    deep = '{"a":' * 400 + "{}" + "}" * 400
    assert len(kernel([[deep]])) == 401
    monkeypatch.setattr(jsonnodes, "BLOCK", 50)
    lists = [['{"a":"' + "x" * 200 + '"}', "{}"], ["{", '{"b":[{}]}']] * 5
    assert set(kernel(lists)) == set().union(*(brute(i, x) for i, x in enumerate(lists)))


def test_values_keep_their_parent():
    got = {r[1:] for r in kernel([['{"a":[1,true,{"b":"x\\ny"},null]}']], jsonnodes._value_batches)}
    assert got == {("0/a/0", "0", "number", "1"), ("0/a/1", "0", "boolean", "true"), ("0/a/2/b", "0/a/2", "string", "x\ny"), ("0/a/3", "0", "null", "null")}


def test_frames(spark, data):
    df = spark.createDataFrame([(1, ['{"a":{}}'], 5), (1, ['{"a":{}}'], 6), (2, None, 7)], "page_id bigint, json_ld array<string>, node_path int")
    assert {tuple(r) for r in jsonnodes.json_nodes(df).collect()} == {(1, "0", ""), (1, "0/a", "0")}
    assert jsonnodes.json_nodes(df.where("false")).count() == 0
    from siltstone.plans.dataprep import p6_found

    rows = spark.read.parquet(f"{data}/html_docs.parquet").select("page_id", "json_ld").collect()
    assert {tuple(r) for r in p6_found(spark, data).collect()} == set().union(*(brute(r[0], r[1]) for r in rows))
