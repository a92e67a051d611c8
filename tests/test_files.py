"""Sets of sessions, and images given by path."""

import base64

import pytest
from pyspark.sql import functions as F

from gleaner.sources import files

TURNS = "session_id string, turn long, role string, content string, clash int"


def turns(spark, *rows):
    return spark.createDataFrame([(*r, 1) for r in rows], TURNS)


def stored(spark, path):
    return sorted(map(tuple, files.read_stored_sessions(spark, path).collect()))


def test_a_set_of_sessions_replaces_only_its_own(spark, tmp_path):
    path = str(tmp_path / "sessions")
    files.write_sessions(turns(spark, ("a", 0, "user", "hi"), ("a", 1, "assistant", "é\n{}"), ("b", 0, "user", None), ("7", 0, "user", "number"), ("007", 0, "user", "zeros")), path)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "sessions").rglob("part-*")}
    files.write_sessions(turns(spark, ("a", 0, "user", "again"), ("c", 0, "user", "new")), path)
    assert stored(spark, path) == [("007", 0, "user", "zeros"), ("7", 0, "user", "number"), ("a", 0, "user", "again"), ("b", 0, "user", None), ("c", 0, "user", "new")]
    assert all(p.exists() and p.stat().st_mtime_ns == t for p, t in before.items() if "session_id=a" not in str(p))
    files.write_sessions(turns(spark), path)
    assert len(stored(spark, path)) == 5


@pytest.mark.parametrize("odd", ["../x", "", None, "a b"])
def test_odd_session_ids_raise_and_write_nothing(spark, tmp_path, odd):
    with pytest.raises(ValueError, match="session id"):
        files.write_sessions(turns(spark, ("a", 0, "user", "hi"), (odd, 0, "user", "hi")), str(tmp_path / "s"))
    assert not (tmp_path / "s").exists()


def test_bytes_of_images(spark, tmp_path):
    box = tmp_path / "box"
    (box / "deep").mkdir(parents=True)
    (box / "deep" / "one.png").write_bytes(b"PNG1")
    (box / "two.JPG").write_bytes(b"JPEG")
    (tmp_path / "out.png").write_bytes(b"OUT")
    raw = base64.b64encode(b"a whole image").decode()
    given = [f"{box}/deep/one.png", f"{box}/two.JPG", f"{box}/none.png", f"{box}/../out.png", f"{tmp_path}/out.png", f"data:image/gif;base64,{raw}", f"data:image/gif;name=x,{raw}", raw, None, "short"]
    df = spark.createDataFrame(list(enumerate(given)), "n int, content string").withColumn("bytes_of", F.lit(1))
    got = {r["n"]: (bytes(r["bytes"]) if r["bytes"] is not None else None, r["mime"], r["error"]) for r in files.image_bytes(df, str(box)).collect()}
    assert got[0] == (b"PNG1", "image/png", None) and got[1] == (b"JPEG", "image/jpeg", None)
    assert got[2] == (None, None, "no such file")
    assert got[3][2] and got[4][2] and got[8][2] and got[9][2]
    assert got[5] == got[6] == (b"a whole image", "image/gif", None) and got[7] == (b"a whole image", "image/png", None)


def test_a_data_url_is_cut_at_its_first_comma(spark):
    df = spark.createDataFrame([("data:image/png;base64,YWJjZGVmZ2hpamts",), ("data:image/png,YWJj,ZGVm",)], "content string")
    got = [r["bytes"] for r in files.read_images(df, "/box").collect()]
    assert bytes(got[0]) == b"abcdefghijkl" and (got[1] is None or bytes(got[1]) != b"def")
