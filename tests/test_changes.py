"""The stream of what changes in a folder."""

import os

from notelake.sources import changes
from notelake.streaming import watch


def put(path, text, at):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (at, at))


def test_listings_and_differences(tmp_path):
    put(tmp_path / "a.md", "1", 100)
    put(tmp_path / "sub/b.md", "22", 200)
    put(tmp_path / ".git/c.md", "3", 300)
    put(tmp_path / "d.txt", "4", 400)
    a, b = str(tmp_path / "a.md"), str(tmp_path / "sub/b.md")
    seen = changes.listing([str(tmp_path)], ".md", False)
    assert seen == {a: [100_000_000, 1], b: [200_000_000, 2]}
    assert changes.listing([a], "", False) == {a: [100_000_000, 1]} and changes.listing([str(tmp_path / "no")], "", False) == {}
    assert len(changes.listing([f"file://{tmp_path}"], "", True)) == 4
    now = {a: [150_000_000, 9], b: seen[b], "/new": [999_999_990, 1]}
    assert changes.settled(seen, now, 1_000_000_000, 300_000) == {a: [150_000_000, 9], b: seen[b]}  # the new one isn't settled
    assert changes.settled(seen, {a: [999_999_990, 9]}, 1_000_000_000, 300_000) == {a: seen[a]}  # nor the changed one; b is gone
    rows = changes.differences(seen, {a: [150_000_000, 9], "/new": [5_000_000, 1]}, 10_000_000)
    assert [(int(t.timestamp()), p, k) for t, p, k in rows] == [(5, "/new", "add"), (10, b, "unlink"), (150, a, "change")]


def test_stream_feeds_sessions(spark, tmp_path):
    """A file is added, one changed, one removed: three offsets, one stream into debounce; a restart goes on where it was."""
    box = tmp_path / "box"
    put(box / "old.md", "x", 1_700_000_000)
    put(box / "gone.md", "x", 1_700_000_000)
    changes.register(spark)
    source = lambda: spark.readStream.format("notelake_changes").option("suffix", ".md").load(str(box))
    seen, sessions = [], []

    def run(stream, rows, check):
        return stream.writeStream.foreachBatch(lambda df, _: rows.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / check)).start()

    q = run(source(), seen, "raw")
    s = run(watch.debounce(source(), watermark="0 seconds"), sessions, "sessions")
    steps = [lambda: put(box / "sub/new.md", "1", 1_700_000_100), lambda: put(box / "old.md", "longer", 1_700_000_103), lambda: put(box / "late.md", "1", 1_700_009_000)]
    for step in steps:
        for x in (q, s):
            x.processAllAvailable()
        step()
    for x in (q, s):
        x.processAllAvailable()
        x.stop()
    name = lambda p: p.rsplit("/", 1)[1]
    assert [(name(p), k) for _, p, k in seen] == [("new.md", "add"), ("old.md", "change"), ("late.md", "add")]
    assert [[name(p) for p in changed] for _, _, changed, _ in sessions[:1]] == [["old.md", "new.md"]]
    (box / "gone.md").unlink()  # while nothing watches
    seen.clear()
    q = run(source(), seen, "raw")
    q.processAllAvailable()
    q.stop()
    assert [(name(p), k) for _, p, k in seen] == [("gone.md", "unlink")]
