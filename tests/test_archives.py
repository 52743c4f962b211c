"""Archives on disk, admission, path rules and the capped walk."""

import hashlib
import io
import os
import random
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leakloom.functions import catalog
from leakloom.operators import entries as en
from leakloom.plans import archive_scan
from leakloom.sources import archives as src, tables
from registry import scan_queries, views

BAD = "r = eval(x)\n"


def make_zip(members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members:
            z.writestr(zipfile.ZipInfo(name), body if isinstance(body, bytes) else body.encode("utf-8"), zipfile.ZIP_DEFLATED)
    return buffer.getvalue()


def damaged(data):
    """Flip bytes inside the first entry's data: the directory stays readable."""
    at = data.index(b"a.py") + 5
    return data[:at] + bytes(b ^ 0xFF for b in data[at : at + 4]) + data[at + 4 :]


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("zips")
    zips = {
        "good.zip": make_zip([("src/", ""), ("src/a.py", BAD * 3), ("b.txt", BAD), ("c.js", "ok"), ("d/./e.env", "x\r\npwd='abcdefg'")]),
        "climb.zip": make_zip([("a.py", BAD), ("../x.py", BAD)]),
        "absolute.zip": make_zip([("/etc/x.txt", "x")]),
        "drive.zip": make_zip([("C:/x.py", "x")]),
        "backslash.zip": make_zip([("a\\..\\x.py", "x")]),
        "many.zip": make_zip([(f"f{i}.txt", "") for i in range(301)]),
        "full.zip": make_zip([(f"f{i}.txt", "") for i in range(300)]),
        "expanded.zip": make_zip([("big.bin", b"a" * (catalog.MAX_ARCHIVE_EXPANDED + 1))]),
        "not.zip": b"plain text",
        "empty.zip": make_zip([]),
        "large.zip": b"PK" + b"\1" * catalog.MAX_ARCHIVE_BYTES,
        "damaged.zip": damaged(make_zip([("a.py", BAD * 20), ("b.py", BAD)])),
        "binary.zip": make_zip([("a.py", b"x" * 8191 + b"\0" + BAD.encode()), ("b.py", b"x" * 8191 + b"\n\0" + BAD.encode())]),
        "size.zip": make_zip([("a.py", BAD + " " * (catalog.MAX_ENTRY_BYTES - len(BAD))), ("b.py", BAD + " " * (catalog.MAX_ENTRY_BYTES - len(BAD) + 1))]),
        # Five full entries reach the cap exactly; the sixth stops the walk, the bad path is never seen.
        "capped.zip": make_zip([(f"f{i}.py", BAD * 150) for i in range(7)] + [("../x", "")]),
        # Here the bad path comes before the stop.
        "early.zip": make_zip([(f"f{i}.py", BAD * 150) for i in range(5)] + [("../x", ""), ("g.py", BAD)]),
    }
    for name, data in zips.items():
        (folder / name).write_bytes(data)
    files = src.archive_files(spark, str(folder), catalog.MAX_ARCHIVE_BYTES)
    frame = archive_scan.scan_archives(files, per_entry=100, per_archive=500)
    return {r.archive.rsplit("/", 1)[-1]: r for r in frame.collect()}, frame


@pytest.mark.parametrize(
    "name, status, reason",
    [
        ("good.zip", "ok", None), ("climb.zip", "rejected", "unsafe_path"), ("absolute.zip", "rejected", "unsafe_path"),
        ("drive.zip", "rejected", "unsafe_path"), ("backslash.zip", "rejected", "unsafe_path"),
        ("many.zip", "rejected", "too_many_entries"), ("full.zip", "ok", None),
        ("expanded.zip", "rejected", "too_large_expanded"), ("not.zip", "rejected", "not_a_zip"),
        ("empty.zip", "ok", None), ("large.zip", "rejected", "too_large"), ("damaged.zip", "error", None),
        ("binary.zip", "ok", None), ("size.zip", "ok", None), ("capped.zip", "ok", None), ("early.zip", "rejected", "unsafe_path"),
    ],
)
def test_status(results, name, status, reason):
    row = results[0][name]
    assert (row.status, row.reason) == (status, reason)
    assert (row.total is None) == (status != "ok")


def test_good_archive(results):
    row = results[0]["good.zip"]
    assert (row.files_scanned, row.files_with_findings, row.total, row.high) == (3, 2, 4, 4)
    assert [(f.file, f["count"]) for f in row.findings_by_file] == [("src/a.py", 3), ("c.js", 0), ("d/e.env", 1)]
    env = row.findings_by_file[2]
    assert env.findings[0].line == 2 and env.report[0].snippet == "  1: x\r\n> 2: pwd='abcdefg'"


def test_counts(results):
    rows = results[0]
    assert (rows["empty.zip"].files_scanned, rows["empty.zip"].total) == (0, 0)
    assert (rows["binary.zip"].files_scanned, rows["binary.zip"].total) == (1, 1)
    assert rows["size.zip"].files_scanned == 1
    capped = rows["capped.zip"]
    assert (capped.files_scanned, capped.files_with_findings, capped.total) == (6, 5, 500)
    assert len(capped.findings_by_file) == 5


def test_what_the_size_limit_leaves_out_is_counted(spark, results):
    """One byte above the limit of an entry: left out and counted, or scanned where no limit is set."""
    sized = results[0]["size.zip"]
    assert (sized.files_too_large, sized.files_scanned) == (1, 1)
    large = BAD + " " * (catalog.MAX_ENTRY_BYTES + 1)
    data = bytearray(make_zip([("a.py", large), ("b.txt", large), ("c/", "")]))
    archives = spark.createDataFrame([("x.zip", len(data), data)], "archive string, n_bytes long, content binary")
    none = archive_scan.scan_archives(archives, max_entry_bytes=None, max_bytes=None, max_entries=None, max_total=None).first()
    assert (none.status, none.files_scanned, none.files_too_large) == ("ok", 1, 0) and none.total > 0
    few = archive_scan.scan_archives(archives, max_entries=1).first()
    assert (few.status, few.reason) == ("rejected", "too_many_entries")


def test_usage_inputs(results):
    logged = {r.archive.rsplit("/", 1)[-1]: r for r in archive_scan.usage_inputs(results[1]).collect()}
    assert "climb.zip" not in logged and "not.zip" not in logged
    assert (logged["damaged.zip"].status, logged["damaged.zip"].total) == ("error", 0)
    assert logged["good.zip"].total == 4 and logged["good.zip"].size > 0


def walk(entries, per_entry, per_archive):
    total, out = 0, []
    for idx, event, scanned, n in entries:
        if event:
            return out, event
        if not scanned:
            out.append((idx, 0, False))
            continue
        left = per_archive - total
        if left <= 0:
            out.append((idx, 0, False))
            break
        keep = min(n, per_entry, left)
        total += keep
        out.append((idx, keep, True))
    return out, "ok"


def test_capped_walk_equals_a_loop(spark):
    rnd = random.Random(3)
    archives = {
        f"a{i}": [
            (j, rnd.choice([None] * 60 + ["rejected", "error"]), rnd.random() < 0.8, rnd.randint(0, 12))
            for j in range(rnd.randint(1, 40))
        ]
        for i in range(300)
    }
    rows = [(a, *e) for a, es in archives.items() for e in es]
    frame = spark.createDataFrame(rows, "archive string, entry_idx int, event string, scanned boolean, n int")
    frame = frame.withColumn("scanned", F.col("scanned") & F.col("event").isNull())
    got = {}
    for r in en.cap_entries(frame, 7, 40).collect():
        got.setdefault(r.archive, []).append(r)
    statuses = set()
    for name, es in archives.items():
        want, status = walk(es, 7, 40)
        mine = sorted(got[name], key=lambda r: r.entry_idx)
        statuses.add(status)
        assert {r.archive_status for r in mine} == {status}, name
        if status == "ok":
            assert [(r.entry_idx, r.keep, r.emitted) for r in mine] == want, name
    assert statuses == {"ok", "rejected", "error"}


def test_scannable_names(spark):
    cases = {".env": True, "x/.env": True, ".env.local": False, "Dockerfile": True, "a.PY": True, "a.bat": False,
             "a.py.txt": False, ".py": False, "a.": False, "Makefile.am": False, "b/c.svelte": True, "..env": True}
    frame = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r.p: r.s for r in frame.select("p", en.is_scannable(F.col("p")).alias("s")).collect()} == cases


def test_file_tree(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.py").write_bytes(b"x\r\n\xffy\rr = eval(x)\n")
    rows = tables.file_tree(spark, str(tmp_path)).collect()
    assert [(r.filename, r.code) for r in rows] == [("a.py", "x\n\ufffdy\nr = eval(x)\n")]


def test_small_files_share_tasks(spark, tmp_path, monkeypatch):
    """Each file counts as 4 MB for Spark, which would make ten tasks of these."""
    for i in range(300):
        (tmp_path / f"{i}.txt").write_text(f"text {i}")
    cores = spark.sparkContext.defaultParallelism
    files = tables.file_tree(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() == cores
    assert {(r.filename, r.code) for r in files.collect()} == {(f"{i}.txt", f"text {i}") for i in range(300)}
    monkeypatch.setattr(tables, "FILES_PER_TASK", 50)
    assert tables.file_tree(spark, str(tmp_path)).rdd.getNumPartitions() == 6
    monkeypatch.setattr(tables, "BYTES_PER_TASK", 300)
    assert tables.file_tree(spark, str(tmp_path)).rdd.getNumPartitions() == 8  # 2,290 bytes


@pytest.mark.parametrize("store", ["file", "viewfs"])
def test_documents_as_files(spark, tmp_path, monkeypatch, store):
    """One file per document of a task; in the local file system nothing beside it, and no folder of its own."""
    documents = [(1, "a\nb"), (-2, ""), (3, None), (4, "c\r\nd"), (None, "no key"), (5, "twice "), (5, "twice"), (2**40, "\u00e4\ud7ff")]
    # Keys that come twice meet in one task; files of other tasks are other files.
    once = spark.createDataFrame(documents, "doc_id long, text string").coalesce(1)
    again = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string").coalesce(1)
    empty = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(views, "table", lambda *_: once.union(again).union(empty))
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.store.link./in", f"file://{tmp_path}")
    monkeypatch.setattr(views, "work_dir", lambda *_: {"file": f"file://{tmp_path}/tree", "viewfs": "viewfs://store/in/tree"}[store])
    found = scan_queries.file_tree(spark, "")
    if store == "file":
        tree = [names for _, _, names in os.walk(tmp_path / "tree")]
        assert sum(map(len, tree)) == 8 and len(tree) <= 1 + 8
        # What an attempt that did not end has left is no document.
        (tmp_path / "tree" / "_part-00000-99").mkdir()
        (tmp_path / "tree" / "_part-00000-99" / "doc_id=9.txt").write_text("half a te")
        assert tables.file_tree(spark, f"{tmp_path}/tree", "*.txt").count() == 8
    code = {1: "a\nb\n", -2: "\n", 3: "\n", 4: "c\n\nd\n", None: "no key\n", 5: "twice \ntwice\n", 2**40: "\u00e4\ud7ff\n"}
    want = [(k, True, hashlib.md5(c.encode()).hexdigest()) for k, c in [*code.items(), (1, code[1])]]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_saved_findings(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"type": "eval_usage", "severity": "high", "line": 1}]')
    (tmp_path / "b.json").write_text('{"findings": [{"type": "x", "severity": "low", "line": 2, "match": "m"}], "code": "a\\nb"}')
    (tmp_path / "c.json").write_text('{"code": "only"}')
    rows = {r.code: r.findings for r in tables.read_saved_findings(spark, str(tmp_path)).collect()}
    assert [f.type for f in rows[""]] == ["eval_usage"] and rows["a\nb"][0].match == "m" and rows["only"] == []


def test_inflated_bytes_leave_the_worker_in_pieces(spark):
    """Packed archives of one batch can inflate to far more than Python should hold at once."""
    size, n = 3 * 2**20, 12
    zips = [make_zip([("a.py", b"a" * size), ("b.py", b"b" * i)]) for i in range(n)]
    parts = [(pa.array(zips), pa.array([[0, 1]] * n, pa.list_(pa.int32())))]
    pieces = list(src._inflater()(iter(parts)))
    assert sum(map(len, pieces)) == n and max(p.nbytes for p in pieces) < src.INFLATED_BYTES + 2 * size
    frame = spark.createDataFrame([(i, bytearray(z)) for i, z in enumerate(zips)], "i int, content binary").coalesce(1)
    data = F.explode(src.inflate(F.col("content"), F.array(F.lit(0), F.lit(1)))).alias("d")
    got = frame.select("i", data).select("i", "d.entry_idx", F.octet_length("d.content"), "d.failed").collect()
    assert sorted(map(tuple, got)) == [(i, e, (size, i)[e], False) for i in range(n) for e in (0, 1)]
