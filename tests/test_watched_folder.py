"""The watched folder: two equal listings, each version once, forgotten files, restarts, archive, errors, names."""

import os
import time

import pytest

from inkveil.operators.options import only
from inkveil.streaming import hotfolder
from inkveil.streaming.versions import advance, given_out, list_folder


def test_two_equal_listings_give_a_version_out_once():
    a, b, c = [1, 10], [1, 11], [5, 11]
    first = advance({}, {"f": a}, 9)
    assert given_out({}, first) == []
    grown = advance(first, {"f": b}, 9)
    assert given_out(first, grown) == []  # it has changed: a file still being written
    still = advance(grown, {"f": b}, 9)
    assert given_out(grown, still) == [("f", 1, 11)]
    assert advance(still, {"f": b}, 9) == still
    again = advance(advance(still, {"f": c}, 9), {"f": c}, 9)
    assert given_out(still, again) == [("f", 5, 11)]  # written anew


def test_what_has_left_is_forgotten_and_limits_hold():
    files = {f"f{i}": [10 - i, 1] for i in range(5)}
    first = advance({}, files, 2)
    second = advance(first, files, 2)
    assert [x[0] for x in given_out(first, second)] == ["f4", "f3"]  # the oldest
    third = advance(second, files, 2)
    assert [x[0] for x in given_out(second, third)] == ["f2", "f1"]
    assert set(advance(third, {"f1": files["f1"]}, 2)) == {"f1"} and advance(third, {}, 2) == {}
    assert given_out(first, advance(first, files, 9, latest_ns=7)) == [("f4", 6, 1), ("f3", 7, 1)]  # the others are too young


def test_listing_knows_files_only(tmp_path):
    for name in ("a.txt", ".hidden.txt", "_x.txt", "b.exe", "c.MD"):
        (tmp_path / name).write_text("x")
    (tmp_path / "d.txt").mkdir()
    assert set(list_folder(f"file://{tmp_path}")) == {"a.txt", "c.MD"} and list_folder(f"file://{tmp_path}/none") == {}


def test_names_never_meet():
    named = hotfolder.name_outputs(["/x/a.txt", "/x/a.eml", "/x/b.txt", "/x/c.md"], {"b.md": "/x/b.eml", "b-txt.md": "/y/b.txt"}, {"/x/c.md": "c.md"})
    assert named == {"/x/a.eml": "a.md", "/x/a.txt": "a-txt.md", "/x/b.txt": "b-txt-2.md", "/x/c.md": "c.md"}


@pytest.fixture
def watched(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()

    def run(**more):
        more = {"options": only("emails"), "once": True, "archive": f"file://{tmp_path}/done", **more}
        hotfolder.start(spark, f"file://{inbox}", f"file://{tmp_path}/out", f"file://{tmp_path}/state", **more).awaitTermination()
        if not (tmp_path / "out").exists():
            return []
        return sorted((r.name, r.redacted, r.output, r.error) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())

    return inbox, tmp_path, run


def test_files_are_read_once_and_archived(watched):
    inbox, top, run = watched
    assert run() == []
    for i in range(3):
        (inbox / f"f [{i}]*.txt").write_text(f"mail x{i}@y.org")
    found = run(most_files=2)  # all of them, two at a time
    assert [x[:2] for x in found] == [(f"f [{i}]*.txt", "mail {{EMAIL_1}}") for i in range(3)]
    assert sorted(os.listdir(top / "done")) == [f"f [{i}]*.txt" for i in range(3)] and os.listdir(inbox) == []
    assert run() == found
    (inbox / "f [1]*.txt").write_text("a new text")
    assert ("f [1]*.txt", "a new text", "f [1]*.md", None) in run() and len(run()) == 4


def test_a_file_that_is_gone_or_fails_is_a_row(watched, monkeypatch):
    inbox, top, run = watched
    (inbox / "a.txt").write_text("kept")
    (inbox / "b.txt").write_text("gone")
    (inbox / "c.pdf").write_text("x")
    plain = hotfolder._located

    def vanish(paths, archive):
        for p in paths:
            if p.endswith("b.txt"):
                os.remove(inbox / "b.txt")
        return plain(paths, archive)

    monkeypatch.setattr(hotfolder, "_located", vanish)
    assert run() == [("a.txt", "kept", "a.md", None), ("b.txt", None, "b.md", "the file is gone"), ("c.pdf", None, "c.md", "no reader for .pdf")]


def test_a_batch_that_runs_again_finds_moved_files(spark, watched):
    inbox, top, run = watched
    (inbox / "a.txt").write_text("x@y.org")
    first = run()
    # the commit of the last batch is lost: the engine runs it again, from the archive
    commits = sorted((top / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        p.unlink(missing_ok=True)
    assert run() == first


def test_only_chosen_files_are_read(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"{i}.txt").write_text("x" * 1000)
    one = hotfolder.contents(spark, {f"file://{tmp_path}/7.txt": f"file://{tmp_path}/7.txt"})
    assert [r.path for r in one.collect()] == [f"file://{tmp_path}/7.txt"] and len(one.inputFiles()) == 1


def test_a_young_file_waits(watched):
    inbox, top, run = watched
    (inbox / "a.txt").write_text("new")
    assert run(settled_seconds=60) == []
    os.utime(inbox / "a.txt", (time.time() - 100, time.time() - 100))
    assert len(run(settled_seconds=60)) == 1
    with pytest.raises(ValueError):
        run(interval=0.1)
