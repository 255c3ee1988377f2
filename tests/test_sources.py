import gzip
import io
import json
import sqlite3
import struct
import tarfile
import zipfile
import zlib

import pytest

from sievework.sources import containers


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def zigzag(n):
    return n << 1 if n >= 0 else (-n << 1) - 1


def packed(values):
    return b"".join(varint(v) for v in values)


def map_file(packing=True):
    strings = field(1, b"") + field(1, b"name") + field(1, "Čaršija".encode()) + field(1, b"shop") + field(1, b"yes")
    deltas = lambda vs: packed(zigzag(v - u) for u, v in zip([0, *vs], vs))
    dense = field(1, deltas([10, 12, 7])) + field(8, deltas([438000000, -5, 3])) + field(9, deltas([184000000, 7, 9])) + field(10, packed([1, 2, 3, 4, 0, 0, 3, 4, 0]))
    plain = field(1, zigzag(99)) + field(2, packed([1])) + field(3, packed([2])) + field(8, zigzag(10)) + field(9, zigzag(-20))
    block = field(1, strings) + field(2, field(2, dense)) + field(2, field(1, plain))
    out = b""
    for kind, content in ((b"OSMHeader", b""), (b"OSMData", block)):
        blob = field(3, zlib.compress(content)) if packing else field(1, content)
        header = field(1, kind) + field(3, len(blob))
        out += struct.pack(">I", len(header)) + header + blob
    return out


@pytest.mark.parametrize("packing", [True, False])
def test_map_nodes(spark, tmp_path, packing):
    (tmp_path / "a.pbf").write_bytes(map_file(packing))
    rows = {r["node"]: r for r in containers.map_nodes(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [7, 10, 99] and all(r["error"] is None for r in rows.values())
    assert rows[10]["tags"] == {"name": "Čaršija", "shop": "yes"} and rows[7]["tags"] == {"shop": "yes"}
    assert (rows[10]["lat"], rows[10]["lon"]) == (43.8, 18.4) and rows[99]["lon"] == pytest.approx(-2e-6)
    assert containers.map_nodes(spark, str(tmp_path), tagged=False).count() == 4


def test_archives(spark, tmp_path):
    text = "prva\ndruga č\n".encode()
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x/bs.txt", text)
        z.writestr("x/skip.xml", b"no")
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("y.txt")
        info.size = len(text)
        t.addfile(info, io.BytesIO(text))
    (tmp_path / "c.bin").write_bytes(b"".join(gzip.compress(part) for part in (text[:5], text[5:])))
    rows = containers.archive_lines(spark, str(tmp_path), r".*\.txt|").collect()
    assert sorted((r["member"], r["line"], r["text"]) for r in rows) == sorted((m, i, t) for m in ("", "x/bs.txt", "y.txt") for i, t in enumerate(["prva", "druga č"]))


def test_broken_file_is_a_row(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(b"not a document")
    row = containers.office_text(spark, str(tmp_path)).first()
    assert row["text"] is None and "BadZipFile" in row["error"]


def test_office_text(spark, tmp_path):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:p><w:r><w:t>Dobar </w:t></w:r><w:r><w:t>dan</w:t></w:r></w:p><w:p><w:t>!</w:t></w:p></w:document>')
    assert tuple(containers.office_text(spark, str(tmp_path)).select("text", "truncated").first()) == ("Dobar dan\n!", False)
    assert tuple(containers.office_text(spark, str(tmp_path), 5).select("text", "truncated").first()) == ("Dobar", True)


def test_sqlite_table(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "a.db")
    con.execute('CREATE TABLE corrections (id INTEGER, "status" TEXT)')
    con.executemany("INSERT INTO corrections VALUES (?, ?)", [(1, "pending"), (2, None)])
    con.commit()
    con.close()
    rows = containers.sqlite_table(spark, str(tmp_path / "a.db"), "corrections", ["id", "status"]).collect()
    assert sorted((r["id"], r["status"]) for r in rows) == [("1", "pending"), ("2", None)]


def test_answers_and_registry(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", "1.tsv", 1), ("a", "y", "2.tsv", 1), ("b", "z", "1.tsv", 2)], "k string, v string, file string, line int")
    assert {r["k"]: (r["v"], r["clash"]) for r in containers.merged_answers(rows, "k", "v").collect()} == {"a": ("y", True), "b": ("z", False)}
    (tmp_path / "fleurs.tsv").write_text("c1\tdobar dan\n")
    known = spark.createDataFrame([("fleurs",)], "source string")
    assert [tuple(r) for r in containers.registered(spark, str(tmp_path), ["clip", "text"], known).collect()] == [("fleurs", "c1", "dobar dan")]
    with pytest.raises(Exception, match="not registered"):
        containers.registered(spark, str(tmp_path), ["clip", "text"], known.where("false")).collect()


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"photos": {"x": {"lines": ["a"]}}}, indent=1))
    row = containers.json_documents(spark, str(tmp_path), "photos map<string, struct<lines: array<string>>>").first()
    assert row["photos"]["x"]["lines"] == ["a"]
