"""A tree's settings file, and the pages that show symbols and imports."""

import pytest

from quarrystone.project import Project
from quarrystone.sinks import render
from quarrystone.sources.config import NAME, Config, read_config


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("settings")
    files = {"a.ts": "import { b } from '~/b';\nexport function a() { return b(); }\n", "src/b.ts": "export function b() { return 1; }\nexport class C<T> {\n  run(x: number) {}\n}\n", "gen/c.ts": "export const skipped = 1;\n", "big.ts": "//" + "x" * 900 + "\n"}
    files[NAME] = '{\n  // our own\n  "ignore": ["gen"], "max_file_bytes": 500, "aliases": {"~/": "src/"}, "rules": {"exports": 1}, "gate": {"max_dead": 0},\n  "arch": [{"id": "no-src", "from": "*.ts", "forbid": "src/**"}],\n}\n'
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


@pytest.fixture(scope="module")
def project(spark, tree):
    return Project(spark, str(tree))


def test_settings_of_a_tree(project):
    assert {r["file"] for r in project.sources.collect()} == {"a.ts", "src/b.ts"}
    assert [tuple(r) for r in project.edges.collect()] == [("a.ts", "src/b.ts::b")]
    assert [(r["file"], r["rule"], r["value"]) for r in project.rules().collect()] == [("src/b.ts", "exports", 2.0)]
    assert project.rules(exports=5).count() == 0
    assert [tuple(r) for r in project.arch().collect()] == [("no-src", "a.ts", "src/b.ts")]
    assert [r["metric"] for r in project.gate().collect()] == ["dead"] and project.gate({"max_dead": 9}).count() == 0


def test_settings_that_are_wrong(tmp_path):
    assert read_config(None) == read_config(str(tmp_path)) == Config()
    for text in ('{"ignor": []}', '{"ignore": "gen"}', '{"max_file_bytes": true}'):
        (tmp_path / NAME).write_text(text)
        with pytest.raises(ValueError):
            read_config(str(tmp_path))


def test_pages(project):
    page = render.skeleton_page(project.symbols, ["src/b.ts", "none.ts"])
    assert "<b>C</b>" in page and "<b>run</b>" in page and "C&lt;T&gt;" in page and page.index("<b>C</b>") < page.index("<b>run</b>")
    drawn = render.graph_page(project.file_edges, project.coupling())
    assert drawn.count("<circle") == 2 and drawn.count("<line") == 1 and "src/b.ts: in 1, out 0" in drawn
