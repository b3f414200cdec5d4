"""p4_found is registered, gives the files nobody wrote by hand, and ends."""

from __future__ import annotations

import signal

import pandas as pd
from compare import session

import __spark_entry__

from graphloom.llm.provenance import evidence

OWN = "\n".join(["import os", "", "def load(path):", "    with open(path) as f:", "        rows = f.read().split()", "    return [r for r in rows if r]", "", "print(load(os.getcwd()))"])
MADE = "// Code generated by protoc-gen-go. DO NOT EDIT.\n" + "\n".join(f"func get{i}() int {{ return {i} }}" for i in range(12))


def test_found(tmp_path):
    files = [("r1", "src/load.py", OWN), ("r1", "src/main.py", OWN + "\n# end"), ("r1", "api/types.pb.go", MADE), ("r1", "api/types.pb.go", MADE)]
    rows = pd.DataFrame(files, columns=["repo_id", "file_path", "content"]).assign(language="x", size_bytes=1, n_lines=1)
    rows.to_parquet(tmp_path / "source_files.parquet")
    found = __spark_entry__.queries()["p4_found"](session(), str(tmp_path))
    assert found.columns == ["repo_id", "file_path"]
    assert [tuple(r) for r in found.collect()] == [("r1", "api/types.pb.go")]


def test_evidence_ends_on_long_lines():
    signal.signal(signal.SIGALRM, lambda *_: (_ for _ in ()).throw(TimeoutError()))
    signal.alarm(5)
    try:
        evidence("src/a.py", "\n".join(["a_name_of_many_letters_indeed_and_more_of_them = 1"] * 3))
    finally:
        signal.alarm(0)
