"""Every numbered query and the pipeline are registered; SQL exists where SQL can express them."""

import re

import __spark_entry__ as entry


def test_names():
    names = entry.queries()
    found = {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))}
    assert found == set(range(1, 14)) and "pipeline" in names
    assert {"op3_line_rules", "op4_warc", "op7_licenses", "op10_sharding", "op11_line_dedup", "op12_spelling", "op13_conversations"} <= set(entry.oracle_sql())


def test_nothing_else_imports_the_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    hits = [str(f) for f in root.joinpath("tracefuse").rglob("*.py")
            if "llm" not in f.relative_to(root).parts and "tracefuse.llm" in f.read_text()]
    assert not hits
    code = ("import sys; sys.modules['corpus_pipeline'] = None\n"
            "import importlib.abc\n"
            "class Gone(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, path, target=None):\n"
            "        if name == 'corpus_pipeline' or name.startswith('tracefuse.llm'):\n"
            "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
            "del sys.modules['corpus_pipeline']\nsys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())")
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.stdout.split()[1:] == ["False"], out.stderr
