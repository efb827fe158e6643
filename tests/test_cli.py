"""The command line over a small dataset and run."""

import json

import pytest

from pagemint import cli


@pytest.fixture
def folders(spark, tmp_path):
    text = lambda s: {"content": {"text": s, "max_diffs": 0}}
    test = lambda i, s: {"id": i, "test_type": "present", "output_type": "html", "derivation": "authored", "tags": ["eng"], "args": text(s), "settings": {}}
    (tmp_path / "gold").mkdir()
    (tmp_path / "run" / "predictions").mkdir(parents=True)
    rows = []
    for i in range(6):
        (tmp_path / "gold" / f"p{i}.json").write_text(json.dumps({"tests": [test(f"a{i}", "hello"), test(f"b{i}", "world")]}))
        rows.append((f"p{i}", f"d{i}", None, f"pages/p{i}.pdf", f"gold/p{i}.json", ["html"]))
        if i < 5:
            (tmp_path / "run" / "predictions" / f"p{i}.json").write_text(json.dumps({"pages": [{"html": "hello" if i else "hello world"}]}))
    schema = "page_id string, document string, suite string, doc_path string, gt_path string, outputs array<string>"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "manifest.parquet"))
    return str(tmp_path), str(tmp_path / "run")


def test_commands(folders, capsys):
    data, run = folders
    out = lambda *argv: (cli.main(list(argv)), json.loads(capsys.readouterr().out.splitlines()[-1]))
    assert out("check", data) == (0, {"ok": True, "pages": 6, "suites": {"other": 6}})
    with pytest.raises(SystemExit):
        cli.main(["grade", data, run])
    code, got = out("grade", data, run, "--partial")
    assert code == 0 and got["families"]["text"] == {"score": 0.6, "tests": 10, "documents": 5, "effective_documents": 5.0}
    code, got = out("intervals", run, "--resamples", "100")
    assert code == 0 and {r["slice"] for r in got} >= {"headline", "families", "per_tag"}
    code, got = out("compare", run, run, "--resamples", "100")
    assert code == 0 and got["pairing"]["documents_paired"] == 5 and all(r["gap"] == 0 for r in got["entries"])
    assert cli.main(["intervals", run, "--resamples", "10"]) == 1
    cli.main(["tests", data])
    assert len(capsys.readouterr().out.splitlines()) == 12


def test_one_page(spark, folders, tmp_path, capsys):
    (tmp_path / "page.html").write_text("<p>Hello</p>")
    assert cli.main(["score", f"{folders[0]}/gold/p0.json", str(tmp_path / "page.html")]) == 0
    got = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [(g["test_id"], g["result"]) for g in got] == [("a0", "pass"), ("b0", "fail")]
    (tmp_path / "answers").mkdir()
    (tmp_path / "answers" / "x.json").write_text(json.dumps({"blocks": [{"type": "title", "bbox": [0, 0, 1, 0.5], "content": "T"}]}))
    assert cli.main(["reread", str(tmp_path / "answers"), "--format", "mineru"]) == 0
    assert json.loads(capsys.readouterr().out)["blocks"] == [{"label": "heading", "bbox": [0.0, 0.0, 1.0, 0.5], "text": "T"}]
    assert cli.main(["systems"]) == 0


STUB = """
from pagemint.sources.systems import System, SystemFailed
import os


class Stub(System):
    name = "stub"
    supports = ("html",)

    def send(self, page, request, timeout):
        if page == b"down" and not os.path.exists({flag!r}):
            raise SystemFailed("out of order")
        return {{"said": page.decode()}}

    def parse(self, raw, request):
        return {{"html": raw["said"]}}
"""


def test_run_and_resume(spark, folders, tmp_path, capsys, monkeypatch):
    import sys

    data, _ = folders
    from pagemint.session import HERE

    module = tmp_path / "stub_service.py"  # workers import it from a folder on their path
    module.write_text(STUB.format(flag=str(tmp_path / "up")))
    env = spark.sparkContext.environment
    monkeypatch.setitem(env, "PYTHONPATH", f"{tmp_path}:{env.get('PYTHONPATH', HERE)}")
    monkeypatch.syspath_prepend(str(tmp_path))
    (tmp_path / "pages").mkdir()
    for i in range(6):
        (tmp_path / "pages" / f"p{i}.pdf").write_bytes(b"down" if i == 5 else b"hello world" if i % 2 else b"hello")
    out = lambda *argv: (cli.main(list(argv)), json.loads(capsys.readouterr().out.splitlines()[-1]))
    _, config = out("init", "stub_service:Stub", data)
    (tmp_path / "config.json").write_text(json.dumps(config))
    run = str(tmp_path / "new")
    _, got = out("run", str(tmp_path / "config.json"), run)
    assert got["families"]["text"]["tests"] == 12 and got["families"]["text"]["score"] == 7 / 12
    assert (got["coverage"]["scored"], got["coverage"]["failed_system"]) == (5, 1)
    assert cli.main(["run", str(tmp_path / "config.json"), run]) == 1 and cli.main(["resume", str(tmp_path / "pages")]) == 1
    (tmp_path / "up").write_text("")
    _, got = out("resume", run)
    assert got["coverage"]["scored"] == 5
    _, got = out("resume", run, "--retry-failed")
    assert got["coverage"]["scored"] == 6
    _, got = out("predict", "stub_service:Stub", str(tmp_path / "pages" / "p1.pdf"))
    assert got["html"] == "hello world" and got["error"] is None
    sys.modules.pop("stub_service", None)
