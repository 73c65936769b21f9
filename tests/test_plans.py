import pytest

from millrace.plans.build import Context, build_graph, changed
from millrace.plans.specs import FieldSpec, InputSpec, JoinSpec, LookupSpec, NodeSpec, SpecError, StoreSpec, from_dict, key_lists, nodes_from_tables, option_lines, pairs, variable_sources


def node(n=1, source=10, from_node=False, fields=None, **more):
    return NodeSpec(n, f"n{n}", (InputSpec(1, source, from_node),), fields or (FieldSpec("k", "NUMBER", "k", key=True), FieldSpec("n", "NUMBER", method="COUNT")), **more)


def test_specs_are_checked():
    for bad in (
        lambda: NodeSpec(1, "x", (), ()),
        lambda: node(fields=(FieldSpec("a", value="a"), FieldSpec("a", value="b"))),
        lambda: node(fields=(FieldSpec("a", value="a"), FieldSpec("n", method="COUNT"))),
        lambda: NodeSpec(1, "x", (InputSpec(1, 1), InputSpec(2, 2)), (FieldSpec("a", value="a"),)),
        lambda: node(joins=(JoinSpec(5, {"k": "k"}, {}, parent=4),)),
        lambda: from_dict(NodeSpec, {"nope": 1}),
    ):
        with pytest.raises(SpecError):
            bad()


def test_small_grammars():
    assert pairs("a:b,c:d,bad,x:y:z") == {"a": "b", "c": "d"} and pairs(None) == {}
    assert key_lists("k1,k2;k3") == (("k1", "k2"), ("k3",))
    assert option_lines("a=1\n b = x=y \nnone\n=2") == {"a": "1", "b": "x=y"}


def test_graph_errors(spark):
    df = spark.createDataFrame([(1, 2)], "k int, v int")
    context = Context({10: df})
    for nodes in ([node(1, 2, True), node(2, 1, True)], [node(1, 9, True)], [node(1, 11)], [node(fields=(FieldSpec("x", value="missing"),))]):
        with pytest.raises(SpecError):
            build_graph(nodes, context)
    with pytest.raises(SpecError):
        build_graph([node(joins=(JoinSpec(5, {"k": "id"}, {}),))], context)
    spec = LookupSpec(5, "dim", (("id",),))
    with pytest.raises(SpecError):
        build_graph([node(joins=(JoinSpec(5, {"k": "other"}, {}),))], Context({10: df}, {5: (spec, df)}))


def test_several_inputs_need_a_key_value_each(spark):
    df = spark.createDataFrame([(1, 2)], "k int, v int")
    bad = NodeSpec(1, "x", (InputSpec(1, 10), InputSpec(2, 10)), (FieldSpec("k", "NUMBER", "1:k", key=True), FieldSpec("n", method="COUNT")))
    with pytest.raises(SpecError):
        build_graph([bad], Context({10: df}))


def test_merge_node_defers_columns_of_both_inputs(spark):
    a = spark.createDataFrame([(1, 10, 1), (2, 20, 1)], "k int, x int, at int")
    b = spark.createDataFrame([(1, 5, 1)], "j int, y int, at int")
    n = NodeSpec(1, "m", (InputSpec(1, 10), InputSpec(2, 11)), (FieldSpec("key", "NUMBER", "1:k;2:j", key=True), FieldSpec("x", "NUMBER", "x"), FieldSpec("y", "NUMBER", "y"), FieldSpec("xy", "NUMBER", "x * y")), arrival_order=("at",))
    result = build_graph([n], Context({10: a, 11: b}))[1]
    assert sorted(map(tuple, result.full.collect())) == [(1, 10, 5, 50), (2, 20, 0, None)]
    assert result.delta.count() == 3


def test_texts_are_not_touched_and_variables_tell_inputs_apart(spark):
    a = spark.createDataFrame([(1, 10, 1)], "k int, x int, at int")
    b = spark.createDataFrame([(1, 5, 2)], "j int, x int, at int")
    fields = (FieldSpec("key", "NUMBER", "1:k;2:j", key=True), FieldSpec("text", "VARCHAR", "concat(x, ' x at ', j, left('abc', k))"), FieldSpec("both", "NUMBER", "p - q", variables={"p": (0, 10, "x"), "q": (0, 11, "x")}), FieldSpec("own", "NUMBER", "p * 2", variables={"p": (0, 11, "x")}))
    n = NodeSpec(1, "m", (InputSpec(1, 10), InputSpec(2, 11)), fields, arrival_order=("at",))
    assert build_graph([n], Context({10: a, 11: b}))[1].full.first().asDict() == {"key": 1, "text": "10 x at 1a", "both": 5, "own": 10}
    assert variable_sources("p:0:10:x, q:2:5:name") == {"p": (0, 10, "x"), "q": (2, 5, "name")}
    for bad in ("p:3:1:x", "p:0:x", "p:0:y:x"):
        with pytest.raises(SpecError):
            variable_sources(bad)
    lost = NodeSpec(1, "m", n.inputs, (fields[0], FieldSpec("z", "NUMBER", "p - q", variables={"p": (0, 10, "x"), "q": (0, 11, "none")})), arrival_order=("at",))
    with pytest.raises(SpecError):
        build_graph([lost], Context({10: a, 11: b}))


def test_from_tables_and_dict_agree(spark):
    tables = {
        "node": spark.createDataFrame([(1, "n1", None)], "id int, name string, output_filter string"),
        "input": spark.createDataFrame([(1, 1, 10, "v > 0")], "node_id int, id int, source int, filter string"),
        "field": spark.createDataFrame([(1, 2, "n", "NUMBER", None, "COUNT", False), (1, 1, "k", "NUMBER", "k", "NONE", True)], "node_id int, position int, name string, type string, value string, method string, key boolean"),
        "store": spark.createDataFrame([(1, "t", "k:id,n:n", "id")], "node_id int, target string, mapping string, key string"),
    }
    (loaded,) = nodes_from_tables(tables)
    same = from_dict(NodeSpec, {"id": 1, "name": "n1", "inputs": [{"id": 1, "source": 10, "filter": "v > 0"}], "fields": [{"name": "k", "type": "NUMBER", "value": "k", "key": True}, {"name": "n", "type": "NUMBER", "method": "COUNT"}], "stores": [{"target": "t", "mapping": {"k": "id", "n": "n"}, "key": ["id"]}]})
    assert loaded == same
    df = spark.createDataFrame([(1, 1), (1, 0), (2, 3)], "k int, v int")
    assert sorted(map(tuple, build_graph([loaded], Context({10: df}))[1].full.collect())) == [(1, 1), (2, 1)]


def test_changed_nodes_restart_their_readers():
    old = [node(1), node(2, 1, True), node(3)]
    new = [node(1, output_filter="n > 1"), node(2, 1, True), node(3)]
    assert changed(old, new) == {1, 2}
    assert changed(old, old[:1]) == {2, 3}
    assert StoreSpec("a") == StoreSpec("a")
