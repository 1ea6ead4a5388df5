"""Source-level guards for the execution rules the library follows (see README, "Design for scale")."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parents[1] / "arrears"
SOURCES = {p: p.read_text() for p in ROOT.rglob("*.py") if "llm" not in p.relative_to(ROOT).parts}


def _hits(pattern):
    return [f"{p.relative_to(ROOT)}:{i + 1}" for p, text in SOURCES.items()
            for i, line in enumerate(text.splitlines()) if re.search(pattern, line)]


def test_no_cross_joins():
    assert _hits(r"\.crossJoin\(|how=['\"]cross['\"]") == []


def test_no_local_checkpoint_or_python_udfs():
    assert _hits(r"localCheckpoint|@udf|pandas_udf|F\.udf\(|\.rdd\b|mapInPandas|applyInPandas") == []


def test_no_broadcast_hints():
    assert _hits(r"F\.broadcast\(|broadcast_if_small") == []
