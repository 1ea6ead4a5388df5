"""Source-level guards for the corpus operators: no cross joins, no RDD code, no local checkpoints, few broadcasts."""

import pathlib
import re

TOP = pathlib.Path(__file__).resolve().parents[2]
SOURCES = {p: p.read_text() for p in [*(TOP / "arrears" / "llm").glob("*.py"), TOP / "corpus_pipeline.py"]}
# broadcasts of data with a documented bound: ids of a sample of labelled rows
BOUNDED = {"quality_classifier.py", "toxicity.py"}


def _hits(pattern):
    return [f"{p.name}:{i + 1}" for p, text in SOURCES.items()
            for i, line in enumerate(text.splitlines()) if re.search(pattern, line)]


def test_no_cross_joins_rdds_or_local_checkpoints():
    assert _hits(r"\.crossJoin\(|how=['\"]cross['\"]|localCheckpoint|\.rdd\b|parallelize\(") == []


def test_broadcasts_are_bounded():
    assert {hit.split(":")[0] for hit in _hits(r"F\.broadcast\(")} <= BOUNDED


def test_nothing_else_imports_the_subpackage():
    base = [p for p in (TOP / "arrears").rglob("*.py") if "llm" not in p.relative_to(TOP / "arrears").parts]
    assert [p.name for p in base if re.search(r"arrears\.llm|from \.+llm", p.read_text())] == []
