import io
import tarfile
import zipfile

import pytest

from tessera.sources import archives

ROWS = [(f"d/{i}.txt", f"text {i} é".encode() * 40) for i in range(60)] + [("x.bin", b"\0\1"), ("__MACOSX/a.txt", b"no"), ("../up.txt", b"no"), ("empty.txt", b""), ("odd.pdf", b"not a pdf")]


def packed(kind):
    out = io.BytesIO()
    if kind == "zip":
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in ROWS:
                z.writestr(name, data)
    else:
        with tarfile.open(fileobj=out, mode="w:gz" if kind == "tgz" else "w") as t:
            for name, data in ROWS:
                info = tarfile.TarInfo(name)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    return out.getvalue()


@pytest.mark.parametrize("kind", ["zip", "tar", "tgz"])
def test_members_are_read_by_lots(spark, tmp_path, kind):
    (tmp_path / f"a.{kind}").write_bytes(packed(kind))
    out = archives.members(spark, str(tmp_path), ["*.txt", "*.pdf"], lot_bytes=3000)
    want = {name: data for name, data in ROWS if name.startswith("d/") or name in ("empty.txt", "odd.pdf")}
    rows = out.collect()
    assert {r["member"]: bytes(r["content"]) for r in rows} == want and len(rows) == len(want) and {r["size"] for r in rows} == set(map(len, want.values()))
    assert out.rdd.getNumPartitions() == 1 if kind == "tgz" else out.rdd.getNumPartitions() > 5
    read = {r["member"]: (r["text"], r["error"]) for r in archives.texts(out).collect()}
    assert read["d/7.txt"] == ("text 7 é" * 40, None) and read["empty.txt"] == ("", None) and read["odd.pdf"][1]


def test_what_cannot_be_read_is_a_row(spark, tmp_path):
    data = packed("tar")
    (tmp_path / "cut.tar").write_bytes(data[: len(data) // 2])
    (tmp_path / "none.zip").write_bytes(b"nothing of the kind")
    (tmp_path / "good.zip").write_bytes(packed("zip"))
    rows = archives.members(spark, str(tmp_path), ["*.txt"], lot_bytes=2000).collect()
    by = {}
    for r in rows:
        by.setdefault(r["path"].rsplit("/", 1)[1], []).append(r)
    assert len(by["good.zip"]) == 61 and all(r["error"] is None for r in by["good.zip"])
    assert [r["error"] is not None for r in by["none.zip"]] == [True]
    assert sum(r["error"] is None for r in by["cut.tar"]) > 10
    small = archives.members(spark, str(tmp_path), ["*.txt"], "good.*", most_bytes=300).collect()
    assert {r["error"] for r in small if r["size"] > 300} == {"member exceeds its limit"} and {r["error"] for r in small if r["size"] <= 300} == {None}


def test_no_archives(spark, tmp_path):
    (tmp_path / "a.md").write_text("x")
    assert archives.members(spark, str(tmp_path), pattern="*.zip").count() == 0


def test_small_lots_share_tasks_and_texts_tell_sizes(spark, tmp_path):
    (tmp_path / "a.tar").write_bytes(packed("tar"))
    out = archives.members(spark, str(tmp_path), ["d/*.txt"], lot_bytes=1)
    n_lots = archives.lots(spark.createDataFrame([(str(tmp_path / "a.tar"),)], "path string"), ["d/*.txt"], 1).count()
    assert out.rdd.getNumPartitions() <= min(n_lots - 1, 4 * spark.sparkContext.defaultParallelism)
    assert {r["member"]: r["size"] for r in archives.texts(out).collect()} == {name: len(data) for name, data in ROWS if name.startswith("d/")}
