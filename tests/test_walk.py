import os
import random

import pytest
from pyspark.sql import functions as F

from skeinworks.sources import listing, walk


def touch(path):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"")


def found(spark, root, data_dir=None, **settings):
    return sorted((r["kind"], r["path"]) for r in walk.discover(spark, str(root), data_dir, **settings).collect())


def plain_walk(root, data_dir=None, max_depth=listing.MAX_DEPTH):
    """One folder after another, in order, the first path to a folder wins."""
    base, seen, files = os.path.realpath(root), set(), []
    inside = lambda p: p == base or p.startswith(base + "/")

    def go(at, depth):
        real = os.path.realpath(os.path.join(base, at)) if at else base
        if depth > max_depth or not inside(real) or (data_dir and (real + "/").startswith(os.path.realpath(data_dir) + "/")) or real in seen:
            return
        seen.add(real)
        names = sorted(os.listdir(real))
        own = [n for n in names if os.path.isfile(os.path.join(real, n))]
        files.extend(os.path.join(at, n) for n in own)
        ext = [n.rsplit(".", 1)[-1].lower() for n in own]
        within = [x for n, x in zip(own, ext, strict=True) if inside(os.path.realpath(os.path.join(real, n)))]
        audio = [x for x in ext if x in listing.AUDIO]
        if depth:
            m4x = [x for x in ext if x in listing.SINGLE]
            if m4x:
                book = any(x in listing.SINGLE for x in within)
            elif ext.count("mp3") == 1:
                book = "mp3" in within
            elif ext.count("mp3") > 1:
                book = True
            else:
                book = len(audio) == 1 and any(x in listing.AUDIO for x in within)
            if book:
                return
        for n in names:
            if os.path.isdir(os.path.join(real, n)) and not (n.startswith(".") or n in listing.IGNORED):
                go(os.path.join(at, n), depth + 1)

    go("", 0)
    return sorted(files)


def test_every_name_arrives(spark, tmp_path):
    root = tmp_path / "we+ird (lib).d"
    names = ["_Author/_x.m4b", "Author (1)/[a]+b/c.m4b", "é 日本/x.m4b", "A/._x.m4b", "A b/.hidden.m4b", "50%20/x.m4b", ".hid/x.m4b", "@eaDir/x.m4b"]
    for n in names:
        touch(root / n)
    assert sorted(r["path"] for r in walk.walk(spark, str(root)).collect()) == sorted(names[:6])
    assert found(spark, root) == sorted(("file", n) for n in names[:6])


def test_links_are_followed_inside_the_root_alone(spark, tmp_path):
    root, outside = tmp_path / "lib", tmp_path / "out"
    touch(root / "Author/Real/real.m4b")
    touch(outside / "Elsewhere/external.m4b")
    touch(outside / "loose.m4b")
    os.symlink(outside / "Elsewhere", root / "linked")
    os.symlink(outside / "loose.m4b", root / "Author/linked.m4b")
    os.symlink(outside / "loose.m4b", root / "top.m4b")
    os.symlink(tmp_path / "nope", root / "dangling.m4b")
    os.symlink(root / "Author", root / "Shelf")
    os.symlink(root, root / "Author/back")
    touch(tmp_path / "library-of-others/x.m4b")
    os.symlink(tmp_path / "library-of-others", root / "lib2")
    assert found(spark, root) == [("file", "Author/Real/real.m4b")]
    (book,) = walk.discover(spark, str(root)).collect()
    assert book["source_path"] == os.path.realpath(root / "Author/Real/real.m4b")


def test_an_earlier_path_of_a_later_round_wins(spark, tmp_path):
    root = tmp_path / "lib"
    touch(root / "Z/deep/deeper/b.m4b")
    touch(root / "A/x.txt")
    os.symlink(root / "Z", root / "A/link")
    touch(root / ".store/kept/c.m4b")
    os.symlink(root / ".store/kept", root / "Shown")
    assert found(spark, root) == [("file", "A/link/deep/deeper/b.m4b"), ("file", "Shown/c.m4b")]


def test_books_end_the_walk_and_links_out_count_for_the_rule(spark, tmp_path):
    root, outside = tmp_path / "lib", tmp_path / "o.mp3"
    touch(outside)
    touch(root / "Book/a.m4b")
    touch(root / "Book/extras/b.m4b")
    touch(root / "Two/1.mp3")
    os.symlink(outside, root / "Two/2.mp3")
    (root / "Lone/below").mkdir(parents=True)
    os.symlink(outside, root / "Lone/1.mp3")
    touch(root / "Lone/below/c.m4b")
    os.symlink(root / "Book/extras", root / "Zed")
    assert found(spark, root) == [("file", "Book/a.m4b"), ("file", "Lone/below/c.m4b"), ("file", "Zed/b.m4b"), ("folder", "Two")]
    files = listing.eligible(walk.walk(spark, str(root)))
    tracks = listing.contained(listing.folder_tracks(files, walk.books_of(files.drop("folder", "ext", "depth"), str(root))), "real_path", os.path.realpath(root))
    assert [r["path"] for r in tracks.collect()] == ["Two/1.mp3"]


def test_depth_data_folder_and_missing_roots(spark, tmp_path):
    root = tmp_path / "lib"
    deep = "/".join(f"level{k}" for k in range(8))
    touch(root / deep / "reached.mp3")
    touch(root / deep / "one/missed.mp3")
    touch(root / "data/books/x/001.m4a")
    touch(root / "database/b.m4b")
    assert found(spark, root, str(root / "data")) == [("file", "database/b.m4b"), ("file", f"{deep}/reached.mp3")]
    assert walk.walk(spark, str(root), max_depth=0).count() == 0 and found(spark, tmp_path / "none") == []


@pytest.mark.parametrize("seed", range(3))
def test_the_walk_matches_a_walk_folder_by_folder(spark, tmp_path, seed):
    rng = random.Random(seed)
    root = tmp_path / "lib"
    folders = [root]
    for k in range(40):
        folder = rng.choice(folders) / f"{rng.choice('abc._')}{k}"
        folder.mkdir(parents=True)
        folders.append(folder)
        for j in range(rng.choice([0, 0, 0, 1, 2])):
            touch(folder / f"{j}.{rng.choice(['mp3', 'm4b', 'txt', 'flac'])}")
    for k in range(6):
        os.symlink(rng.choice(folders), rng.choice(folders) / f"{rng.choice('abc')}l{k}")
    assert sorted(r["path"] for r in walk.walk(spark, str(root), max_depth=30).collect()) == plain_walk(str(root), max_depth=30)


def test_folders_are_listed_once_and_in_tasks(spark, tmp_path):
    for k in range(30):
        touch(tmp_path / f"lib/f{k}/x.txt")
    os.symlink(tmp_path / "lib/f29", tmp_path / "lib/f0/again")
    notes = str(tmp_path / "notes")
    driver = os.getpid()

    def noted(folder):
        with open(notes, "a") as f:
            f.write(f"{os.getpid() == driver} {folder}\n")
        return list(walk.local_entries(folder))

    assert walk.walk(spark, str(tmp_path / "lib"), entries=noted).where(F.col("path") == "f0/again/x.txt").count() == 1
    lines = open(notes).read().splitlines()
    assert len(lines) == len(set(lines)) == 31 and not any(x.startswith("True") for x in lines)


def test_stores_without_links(spark, tmp_path):
    touch(tmp_path / "lib/_a/x.m4b")
    entries = list(walk.store_entries(f"file://{tmp_path}/lib"))
    assert [(e[0], e[1], e[2]) for e in entries] == [("_a", True, f"file://{tmp_path}/lib/_a")]
    assert list(walk.store_entries(f"file://{tmp_path}/none")) == []


def boxes(path, *parts, size=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "wb") as f:
        for name, length in parts:
            f.write((1).to_bytes(4, "big") + name + length.to_bytes(8, "big"))
            f.seek(length - 16, 1)
        f.truncate(size if size is not None else f.tell())


def test_the_header_of_a_large_file_takes_a_few_reads(spark, tmp_path):
    root, five = tmp_path / "lib", 5 << 30
    boxes(root / "A/late.m4b", (b"ftyp", 32), (b"free", five), (b"mdat", 64), (b"moov", 64))
    boxes(root / "B/early.m4b", (b"ftyp", 32), (b"moov", 64), (b"mdat", five))
    boxes(root / "C/cut.m4b", (b"ftyp", 32), (b"free", five), size=100)
    boxes(root / "D/none.m4b", size=0)
    files = walk.walk(spark, str(root))
    got = {r["path"]: (r["needs_faststart"], r["length"] > five) for r in listing.with_faststart_of(files).collect()}
    assert got == {"A/late.m4b": (True, True), "B/early.m4b": (False, True), "C/cut.m4b": (False, False), "D/none.m4b": (False, False)}
    reads = []
    with open(root / "A/late.m4b", "rb") as f:

        def read(at, n):
            reads.append(n)
            f.seek(at)
            return f.read(n)

        assert listing.faststart_of(read, five) and sum(reads) <= 3 * 16
    assert not listing.needs_faststart_at(None) and not listing.needs_faststart_at(str(tmp_path / "missing"))
