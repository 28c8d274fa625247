"""The folder source against the rule walked in plain Python, on a tree with odd names, links and a large file."""
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from vistalake.sources import catalog, folders

EXTENSIONS = catalog.IMAGE_EXTENSIONS + catalog.VIDEO_EXTENSIONS
NAMES = ("a.jpg", "B.PNG", ".hidden.jpg", "_under.mp4", ".jpg", "..png", "note.txt", "no_extension", "x.tar.webm", "ü ñ.bmp", "empty.jpeg")


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("media") / ".root"
    for folder in ("", "a", "a/b", "a/b/c/d", "_under", "a/_deep", ".cache", "a/.git/objects", "sorted", "sorted/in", "sorted2", "dots..", "ünïcode"):
        (root / folder).mkdir(parents=True, exist_ok=True)
        for k, name in enumerate(NAMES):
            (root / folder / name).write_bytes(b"" if name.startswith("empty") else bytes([k]) * (k * 3000) + folder.encode())
            os.utime(root / folder / name, (1_700_000_000 + k, 1_700_000_000.25 + k))
    (root / "a" / "to_folder.jpg").symlink_to(root / "sorted", target_is_directory=True)
    (root / "a" / "to_file.jpg").symlink_to(root / "a" / "a.jpg")
    (root / "a" / "broken.jpg").symlink_to(root / "nowhere")
    (root / "a" / "folder.jpg").mkdir()
    with open(root / "a" / "large.mp4", "wb") as f:
        f.write(b"head" * 4096)
        f.truncate(3 << 30)
        f.seek((3 << 30) - 5)
        f.write(b"tail!")
    return str(root)


def walked(folder, exclude):
    """The rule, one folder after another."""
    for e in os.scandir(folder):
        if e.is_dir(follow_symlinks=False):
            if not e.name.startswith(".") and not any(f"{e.path}/".startswith(x + "/") for x in exclude):
                yield from walked(e.path, exclude)
        elif e.is_file() and os.path.splitext(e.name)[1].lower() in EXTENSIONS:
            yield e.path


def fingerprint(path):
    found = os.stat(path)
    with open(path, "rb") as f:
        head = f.read(8192)
        f.seek(max(0, found.st_size - 8192))
        return hashlib.md5(f"{found.st_size}_{found.st_mtime_ns // 1000}_{head.hex()}_{f.read(8192).hex()}".encode()).hexdigest()


@pytest.mark.parametrize("most", [1, 3, 5, 1000])
def test_listing_is_the_rule(spark, tree, most):
    exclude = (f"{tree}/sorted", f"{tree}/missing")
    found = folders.list_folders(spark, tree, exclude, EXTENSIONS, folders=most)
    rows = {r["path"]: r for r in found.drop("head", "tail").collect()}
    assert set(rows) == set(walked(tree, exclude)) and found.count() == len(rows)
    assert any("/sorted2/" in p for p in rows) and any(p.endswith("/a/to_file.jpg") for p in rows) and not any("broken" in p for p in rows)
    for path, r in rows.items():
        s = os.stat(path)
        assert (r["length"], r["modified_us"], r["created_at"]) == (s.st_size, s.st_mtime_ns // 1000, s.st_ctime)
    assert found.rdd.getNumPartitions() >= min(most, 11)


def test_inventory_and_fingerprints_of_all_files(spark, tree):
    """The whole manifest, filtered by inventory, is the same; large, small and empty files have their fingerprints from both ends."""
    manifest = folders.list_folders(spark, tree)
    assert manifest.filter("path like '%note.txt'").count() > 0
    kept = catalog.with_media_type(catalog.with_fingerprint(catalog.inventory(manifest, (f"{tree}/sorted",), root=tree)))
    rows = {r["path"]: r for r in kept.select("path", "file_hash", "media_type").collect()}
    assert {p: r["file_hash"] for p, r in rows.items()} == {p: fingerprint(p) for p in walked(tree, (f"{tree}/sorted",))}
    assert rows[f"{tree}/a/large.mp4"]["media_type"] == "video"
    items = catalog.to_media_items(kept).filter(F.col("created_at").isNull() | (F.col("file_size") < 0))
    assert items.count() == 0


def test_unreadable_and_missing(spark, tree, tmp_path):
    reader = folders.FolderReader({"path": f"file:{tree}/", "extensions": ".JPG , .png"})
    assert reader.root == tree and reader.extensions == {".jpg", ".png"}
    row = reader._row(folders.LocalFolders(), f"{tree}/gone.jpg")
    assert row[0].endswith("gone.jpg") and row[1:] == (None,) * 6
    gone = spark.createDataFrame([row], folders.SCHEMA)
    assert catalog.with_fingerprint(gone).first()["file_hash"] == hashlib.md5(row[0].encode()).hexdigest()
    with pytest.raises(Exception, match="missing"):
        folders.list_folders(spark, f"{tree}/missing").count()
    (tmp_path / "empty").mkdir()
    assert folders.list_folders(spark, str(tmp_path / "empty")).count() == 0
    none = folders.list_folders(spark, tree, ends=0).filter("head is not null or tail is not null")
    assert none.count() == 0


def test_other_stores_by_uri(tree):
    """The store's way of listing and reading gives the same entries and ends."""
    from pyarrow.fs import LocalFileSystem

    store = folders.StoreFolders.__new__(folders.StoreFolders)
    store.fs, store.prefix = LocalFileSystem(), "s3://bucket"
    local, names = folders.LocalFolders(), {}
    for where, prefix in ((local, ""), (store, "s3://bucket")):
        names[prefix] = [(e.path.removeprefix(prefix), e.is_folder) for e in where.entries(f"{prefix}{tree}/_under")]
    assert names[""] == names["s3://bucket"]
    size, modified, created = store.facts(f"s3://bucket{tree}/a/large.mp4")
    assert (size, modified) == local.facts(f"{tree}/a/large.mp4")[:2] and created is None
    assert store.ends(f"s3://bucket{tree}/a/large.mp4", size, 8192) == local.ends(f"{tree}/a/large.mp4", size, 8192)
    assert store.ends(f"s3://bucket{tree}/empty.jpeg", 0, 8192) == (b"", b"")
