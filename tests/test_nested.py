import json

from deskmill.operators import nested


def rows(spark, payloads):
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(payloads)], "file_id BIGINT, payload STRING, kind STRING")
    return sorted(((r.file_id, r.kind, r.node_id, r.parent_id) for r in nested.flatten(df).collect()), key=str)


def ticket(comments, wrap=False):
    t = {"name": "n", "comments_list": comments}
    return json.dumps({"result": [t, {"comments_list": [{"id": "no"}]}] if wrap else t})


def test_broken_payloads_give_nothing(spark):
    assert rows(spark, [None, "", "  ", "<html>502</html>", '{"result": {"comments_list": [{"id": 1}', "null", "[]", "5", '{"result": []}', '{"result": 3}', ticket(None), ticket({}), ticket("ok"), ticket(7)]) == []


def test_shapes_of_lists(spark):
    one = {"id": 5}
    got = rows(spark, ["\ufeff \n" + ticket([one]), ticket({"items": [one]}), ticket(one), ticket(json.dumps([one])), ticket([None, "ok", 3, one], wrap=True), ticket({"0": one})])
    assert got == [(i, "comment", "5", "root") for i in range(6)]


def test_links_and_depth(spark):
    node = {"id": "r0"}
    for k in range(1, 5000):
        node = {"id": f"r{k}", "replies": [node]} if k % 2 else {"id": f"r{k}", "replies": {"items": [node]}}
    # too deep for a recursive encoder as well, hence by hand
    text, tail = '{"result": {"comments_list": [', "]}}"
    for k in range(4999, 0, -1):
        text += f'{{"id": "r{k}", "attachments": [{{"id": {k}}}, "нет", null], "replies": ['
        tail = "]}" + tail
    got = rows(spark, [text + '{"id": "r0"}' + tail])
    assert len(got) == 5000 + 4999
    assert (0, "reply", "r0", "r1") in got and (0, "comment", "r4999", "root") in got and (0, "attachment", "7", "r7") in got


def test_missing_and_repeated_ids(spark):
    got = rows(spark, [ticket([{"text": "a"}, {"id": 1}, {"id": 1}])])
    assert sorted(got, key=str) == sorted([(0, "comment", None, "root"), (0, "comment", "1", "root"), (0, "comment", "1", "root")], key=str)


def test_flat_parser_agrees():
    for text in ('{"a": [1, -2.5, true, null, {"b": "x\\n\\u0041"}], "c": {}}', "[]", '"s"', "[[], [1]]"):
        assert nested._parse_flat(text) == json.loads(text)
    for text in ("[1,]", '{"a" 1}', "[1", "{]", "1 2", '{"a": }'):
        try:
            nested._parse_flat(text)
        except (ValueError, IndexError):
            continue
        raise AssertionError(text)


def test_typed_tables_and_roundtrip(spark):
    payload = ticket([{"id": 1, "text": {"text": None, "html": "<b>h</b>"}, "cmf_owner_id": {"id": "u-1"}, "replies": [{"id": "2", "text": "t", "cmf_owner_id": "u-2", "attachments": {"id": "a", "name": "f", "size": 5, "meta": {"mime": "m", "pages": [{"id": 0}]}}}]}])
    tables = nested.tables(spark.createDataFrame([(1, payload)], "file_id BIGINT, payload STRING"))
    c, r, a = (tables[k].collect() for k in ("comment", "reply", "attachment"))
    assert [(x[0].ord, x[0].parent_ord) for x in (c, r, a)] == [(0, None), (1, 0), (2, 1)]
    assert (c[0].body, c[0].cmf_owner_id, r[0].body, r[0].cmf_owner_id, r[0].parent_id) == ("<b>h</b>", "u-1", "t", "u-2", "1")
    assert (a[0].name, a[0].size, a[0].mime, a[0].pages, a[0].parent_id) == ("f", "5", "m", 1, "2")


def test_empty_table(spark):
    assert rows(spark, []) == []


def test_keys_hold_where_ids_are_missing_or_repeated(spark):
    payload = ticket([{"replies": [{"id": 1, "attachments": [{"name": "a"}]}]}, {"replies": [{"id": 1, "attachments": [{"name": "b"}, {"name": "c"}]}]}])
    tables = nested.tables(spark.createDataFrame([(1, payload), (2, payload)], "file_id BIGINT, payload STRING"))
    reply, comment = (tables[k].select("file_id", "ord", "parent_ord").collect() for k in ("reply", "comment"))
    up = {(r.file_id, r.ord): r.parent_ord for r in reply}
    roots = {(r.file_id, r.ord): n for n, r in enumerate(sorted(comment))}
    got = sorted((r.file_id, r.name, roots[r.file_id, up[r.file_id, r.parent_ord]] % 2) for r in tables["attachment"].collect())
    assert got == [(1, "a", 0), (1, "b", 1), (1, "c", 1), (2, "a", 0), (2, "b", 1), (2, "c", 1)]
