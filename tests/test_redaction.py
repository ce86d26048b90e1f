"""Redaction of JSON of any shape against a recursive version."""

import json
import random

from earmark.operators import redaction


def brute(x):
    if isinstance(x, dict):
        return {k: brute(v) for k, v in sorted(x.items()) if k not in redaction.HIDDEN}
    if isinstance(x, list):
        return [brute(v) for v in x]
    return round(x, 2) if isinstance(x, float) else x


def made(r, depth):
    kind = r.randrange(8 if depth else 5)
    if kind < 5:
        return [r.randrange(1000), r.randrange(-(10**6), 10**6) / 1000 + 0.0001, r.choice(["", "x", 'q"\\é\n', "1.234"]), None, True][kind]
    if kind == 5:
        return [made(r, depth - 1) for _ in range(r.randrange(4))]
    names = ["a", "b", "threshold", "thresholds", "score", 'od"d', "é"]
    return {r.choice(names): made(r, depth - 1) for _ in range(r.randrange(5))}


def test_any_shape(spark):
    r = random.Random(5)
    docs = [(i, json.dumps(made(r, 5))) for i in range(120)] + [(900, None), (901, "no json"), (902, '{"a": {"threshold": 1}}'), (903, "3.14159"), (904, '{"threshold_base": [1]}')]
    got = {x.id: x.doc for x in redaction.public(spark.createDataFrame(docs, "id long, doc string"), "id", "doc").collect()}
    assert len(got) == len(docs) and got[900] is None and got[901] is None and got[902] == '{"a":{}}' and got[903] == "3.14" and got[904] == "{}"
    for i, d in docs[:120]:
        want = brute(json.loads(d))
        assert json.loads(got[i]) == want, (d, got[i])
        assert not any(f'"{h}"' in got[i] for h in redaction.HIDDEN)


def test_no_documents(spark):
    assert redaction.public(spark.createDataFrame([], "id long, doc string"), "id", "doc").collect() == []
