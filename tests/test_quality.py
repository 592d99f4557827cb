"""Parameter rules (V5) and dataset source formats."""

import json
import os
import tempfile

import pytest

from runlens.operators import quality as Q
from runlens.sources import sinks as SK


def test_validate_params():
    assert Q.validate_params(date="2025-08-29") == ("2025-08-29", "2025-08-29")
    assert Q.validate_params(start="2025-08-01", end="2025-08-03", eval_type="website") == ("2025-08-01", "2025-08-03")
    for kw in ({"date": "2025-13-01"}, {}, {"date": "2025-08-01", "start": "2025-08-01"},
               {"date": "2025-08-01", "eval_type": "other"},
               {"date": "2025-08-01", "eval_type": "website", "best_100": True}):
        with pytest.raises(ValueError):
            Q.validate_params(**kw)


def test_read_dataset_formats(spark):
    d = tempfile.mkdtemp(prefix="runlens-ds-")
    ex = [{"inputs": {"website_url": "a"}, "outputs": {"is_available": True}},
          {"inputs": {"website_url": "b"}, "outputs": {"is_available": False}}]
    with open(os.path.join(d, "l.jsonl"), "w") as f:
        f.write("\n".join(json.dumps(e) for e in ex))
    with open(os.path.join(d, "a.json"), "w") as f:
        json.dump(ex, f, indent=2)
    with open(os.path.join(d, "o.json"), "w") as f:
        json.dump({"name": "x", "examples": ex}, f, indent=2)
    for name in ("l.jsonl", "a.json", "o.json"):
        got = sorted(r["inputs"]["website_url"] for r in SK.read_dataset(spark, os.path.join(d, name)).collect())
        assert got == ["a", "b"], name
