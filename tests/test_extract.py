import pytest

from sparkward.sources.extract import Unreadable, facts_of


def callees(src):
    return [c["callee_text"] for c in facts_of(src)["calls"]]


def test_chained_calls_outer_before_inner():
    assert callees("a.create(x).then((r) => r.text);") == ["a.create(x).then", "a.create"]


def test_iife_and_new():
    assert callees("(function () { openai.run('a'); })(); const c = new OpenAI({}); new Foo(1).bar(2)") == ["(function () { openai.run('a'); })", "openai.run", "new Foo(1).bar"]


def test_comments_strings_and_regexes_hold_no_calls():
    assert callees("// f(1)\n/* g(2) */ const s = 'h(3)'; const r = /k\\(4\\)/.test(s); if (x) { y(); }") == ["/k\\(4\\)/.test", "y"]


def test_template_inside_template():
    f = facts_of("client.messages.create(`a ${b.c} ${d(`e ${g}`)}`)")
    assert [c["callee_text"] for c in f["calls"]] == ["client.messages.create", "d"]
    node = f["calls"][0]["args"][0]
    assert node["kind"] == "template" and node["identifiers"] == ["b", "c", "d", "g"]


def test_functions_and_params():
    f = facts_of("export async function a(req: Request, { x }) {}\nconst b = async (ctx) => 1;\nclass C { constructor(q) { z(); } m(p) { return p; } get v() { return 1; } }\nconst d = function (e) {};")
    assert [(x["kind"], [p["text"] for p in x["params"]]) for x in f["functions"]] == [("function_declaration", ["req", "{ x }"]), ("arrow", ["ctx"]), ("method", ["p"]), ("function_expression", ["e"])]
    assert f["functions"][0]["params"][1]["is_identifier"] is False


def test_declarations_and_request_access():
    d = facts_of("const a = req.body; let b = req.body.text, c = a; var e = ctx.request.body; const { g } = request.query; const h: string = 'x' + a;")["decls"]
    assert [(x["name_text"], x["init_kind"], x["init_is_req_access"]) for x in d] == [("a", "property", True), ("b", "property", False), ("c", "identifier", False), ("e", "property", True), ("{ g }", "property", True), ("h", "concat", False)]


def test_prompt_nodes():
    n = facts_of("openai.create({ model: 'm', 'prompt': 'a' + b, messages: [{ role: 'user', content: c }, { content: JSON.stringify(d) }, ...rest] })")["nodes"]
    assert [(x["detector"], x["node_text"]) for x in n if x["callee_text"] == "openai.create"] == [("AI001", "'a' + b"), ("AI004", "'a' + b"), ("AI004", "c"), ("AI004", "JSON.stringify(d)")]
    shorthand = facts_of("openai.create({ messages })")["nodes"]
    assert [(x["detector"], x["node_text"]) for x in shorthand] == [("AI004", "{ messages }")]


def test_plus_must_be_on_top():
    kinds = [facts_of(f"f({x})")["calls"][0]["args"][0]["kind"] for x in ("a + b", "(a + b)", "a + b || c", "a * b + c", "a + b * c", "a ? b : c + d", "-a")]
    assert kinds == ["concat", "other", "binary", "concat", "concat", "other", "other"]


def test_containment():
    f = facts_of("function a(req) { b(); const c = () => { d(); }; }\ne();")
    paths = {c["callee_text"]: c["fn_path"] for c in f["calls"]}
    inner = [x["fn_pos"] for x in f["functions"]]
    assert paths == {"b": inner[:1], "d": inner, "e": []}


def test_unreadable():
    with pytest.raises(Unreadable):
        facts_of("function (a { }")


def test_deeply_nested_templates(spark):
    from sparkward.sources import extract as X

    text = "const a = " + "`${" * 2000 + "f(1)" + "}`" * 2000 + ";"
    row = X.extract(spark.createDataFrame([("r", "a.ts", text)], "repo string, file string, text string")).first()
    assert row["error"] is None and [c["callee_text"] for c in row["calls"]] == ["f"]


def test_sources_of_one_partition_are_read_in_many_tasks(spark):
    """A small table of many sources is one task; its files are spread before they are read, and still all there."""
    from pyspark.sql import functions as F

    from sparkward.sources import extract as X

    files = spark.range(300, numPartitions=1).select(F.lit("r").alias("repo"), F.concat(F.lit("f"), "id").alias("file"), F.lit("const a = req.body; openai.create(`x ${a}`, [1])").alias("text"))
    rows = X.extract(files, ("calls",)).select("file", F.size("calls").alias("n"), F.size("decls").alias("d"), F.spark_partition_id().alias("task")).collect()
    assert len({r["task"] for r in rows}) >= 8
    assert {r["file"] for r in rows} == {f"f{k}" for k in range(300)} and {(r["n"], r["d"]) for r in rows} == {(1, 0)}


def test_facts_travel_whole(spark):
    """Facts come out of Spark as the extractor made them, empty files and unreadable ones included."""
    from sparkward.sources import extract as X

    texts = {"a.ts": "export async function f(req, { x }) { const t = req.body;\n openai.create({ prompt: 'é' + t, messages: [{ content: JSON.stringify(t) }] }); }", "b.ts": "", "c.ts": None, "d.ts": "f("}
    got = {r["file"]: r.asDict(recursive=True) for r in X.extract(spark.createDataFrame([("r", *x) for x in texts.items()], "repo string, file string, text string")).collect()}
    assert got.keys() == texts.keys() and got["d.ts"]["error"] and not got["d.ts"]["calls"]
    for name in ("a.ts", "b.ts", "c.ts"):
        assert {k: got[name][k] for k in X.KINDS} == facts_of(texts[name] or "") and got[name]["error"] is None
