import json

import pytest

from quern import cli
from quern.operators import catalog


def test_a_corpus_from_lines_to_export(spark, tmp_path, capsys):
    root = f"file://{tmp_path}/corpus"

    def do(command, *options):
        cli.main([command, "--path", root, *map(str, options)], spark)
        return json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    for name, n in (("a", 7), ("b", 5)):
        lines = [json.dumps({"text": f"Document {k} of {name}. It has two sentences.", "k": k}) for k in range(n)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join([*lines, "{bad", '{"text": "short"}']) + "\n")
    (tmp_path / "list.csv").write_text(f"name,input\nb,{tmp_path}/b.jsonl\nmissing,{tmp_path}/none.jsonl\n")

    do("create")
    assert do("add-source", "--name", "a", "--input", tmp_path / "a.jsonl")["documents"] == 7
    with pytest.raises(catalog.AlreadyThere):
        do("add-source", "--name", "a", "--input", tmp_path / "a.jsonl")
    got = do("batch-import", "--input", tmp_path / "list.csv")
    assert got[0]["documents"] == 5 and json.loads(got[0]["rejects"]) == {"generatorReturnedNone": 1, "missingDataKey": 0, "data<=10": 1, "hasDataError": 0}
    assert "failure" in got[1] and [s["name"] for s in do("list-sources")] == ["a", "b"]

    strategy = {"strategy_name": "bytes", "tokenizer_type": "bytes", "splitter_class": "aligned", "chunk_size": 34, "modality": "document"}
    do("register-strategy", "--strategy", json.dumps(strategy))
    assert do("pretokenise", "--strategy", "bytes", "--source", "a")["documents"] == 7
    assert [r.get("documents") for r in do("pretokenise-batch", "--strategy", "bytes")] == [7, 5]
    assert do("list-strategies")[0]["chunk_size"] == 34

    do("create-view", "--name", "few", "--selection", json.dumps({"a": 3, "b": "preserved"}))
    do("shuffle-view", "--name", "every")
    assert do("set-view", "--name", "few")["documents"] == 8 and do("set-view", "--name", "every")["documents"] == 12
    assert do("set-view", "--name", "default")["documents"] == 12
    assert {r["source_no"]: r["flag"] for r in do("export-view", "--name", "few")["links"]} == {1: "partial", 2: "preserved"}
    assert {v["view"] for v in do("list-views")} == {"default", "few", "every"}

    do("export-view-data", "--name", "few", "--output", f"file://{tmp_path}/out")
    rows = [json.loads(line) for p in sorted((tmp_path / "out").glob("part-*")) for line in p.read_text().splitlines()]
    assert len(rows) == 8 and sum(r["group"] == "b" for r in rows) == 5 and all(r["meta"] == {"k": int(r["text"].split()[1])} for r in rows)
    do("export-view-data", "--name", "default", "--output", f"file://{tmp_path}/head", "--limit", 3, "--without-meta")
    rows = [json.loads(line) for p in sorted((tmp_path / "head").glob("part-*")) for line in p.read_text().splitlines()]
    assert [(r["group"], set(r)) for r in rows] == [("a", {"group", "text"})] * 3

    assert do("delete-source", "--name", "a")["deleted"] == 1
    info = do("info")
    assert [s["name"] for s in info["sources"]] == ["b"] and info["bytes"] > 0
    assert {r["source_no"] for r in do("export-view", "--name", "few")["links"]} == {2}
    do("convert", "--input", tmp_path / "a.jsonl", "--output", f"file://{tmp_path}/parquet")
    assert spark.read.parquet(f"{tmp_path}/parquet").count() == 9
