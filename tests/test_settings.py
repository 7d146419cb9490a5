"""Settings in layers, and embedders that answer late, wrongly or in another order."""

import time

import pytest

from notelake import api
from notelake.sources import settings

DEFAULTS = {"branch": "main", "maxHits": 5, "topicBoost": 0.05, "verbose": False, "remoteUrl": None}


def test_layers(tmp_path):
    file = tmp_path / "c.json"
    file.write_text('{"branch": "file", "maxHits": null, "other": 1}')
    env = {"NOTELAKE_BRANCH": "env", "NOTELAKE_MAX_HITS": "9", "NOTELAKE_TOPIC_BOOST": "x", "NOTELAKE_VERBOSE": "true", "NOTELAKE_REMOTE_URL": " "}
    assert settings.layered(DEFAULTS) == DEFAULTS
    assert settings.layered(DEFAULTS, env) == DEFAULTS | {"branch": "env", "maxHits": 9, "verbose": True}
    assert settings.layered(DEFAULTS, env, file=str(file)) == DEFAULTS | {"branch": "file", "maxHits": 9, "verbose": True, "other": 1}
    assert settings.layered(DEFAULTS, env, file=str(file), given={"branch": "me", "maxHits": None})["branch"] == "me"
    assert settings.layered(DEFAULTS, file=str(tmp_path / "no")) == DEFAULTS
    file.write_text("- a")
    with pytest.raises(ValueError):
        settings.layered(DEFAULTS, file=str(file))


def test_embedders(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "ccc")], "id long, text string").coalesce(1)
    shuffled = lambda ts: [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(ts)))]
    assert sorted(map(tuple, ((r["id"], r["embedding"][0]) for r in api.embed_with(texts, shuffled).collect()))) == [(1, 1.0), (2, 2.0), (3, 3.0)]
    for bad in ([{"index": 0, "embedding": []}, {"index": 0, "embedding": []}], [{"index": 1, "embedding": []}]):
        with pytest.raises(ValueError):
            api.in_order(bad)
    asked = []

    def fails_once(ts):
        asked.append(ts)
        if len(asked) == 1:
            raise ConnectionError("x")
        return [[1.0]] * len(ts)

    assert api.patient(fails_once, 5, retries=1, pause_s=0.01)(["a"]) == [[1.0]] and len(asked) == 2
    with pytest.raises(TimeoutError):
        api.patient(lambda ts: time.sleep(1), 0.05)(["a"])
    with pytest.raises(ConnectionError):
        api.patient(lambda ts: (_ for _ in ()).throw(ConnectionError("x")), 1, retries=2, pause_s=0.01)(["a"])
