"""From a listing of files to books: filters, classification of folders, sidecars."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.functions.text import extension, file_name, file_stem, nested_prefix, parent

#: Extensions, names that are passed over, and the deepest folder.
AUDIO = ("m4b", "m4a", "mp3", "ogg", "oga", "opus", "flac")
PROTECTED = ("aax", "aaxc", "aa", "odm")
SINGLE = ("m4b", "m4a")
IGNORED = ("@eaDir", "lost+found")
MAX_DEPTH = 8
#: Fixed value: boxes of a container looked at before giving up.
MAX_BOXES = 256

LISTING = "path string, length long, mtime long"


def read_listing(spark: SparkSession, root: str) -> DataFrame:
    """Path (relative to ``root``), length and time of every file that a walk reaches, books' folders included,
    whatever its name; contents are not read."""
    from skeinworks.sources.walk import walk

    return walk(spark, root, stop_at_books=False).select("path", "length", "mtime")


def is_ignored(name: Column) -> Column:
    return name.startswith(".") | name.isin(*IGNORED)


def depth(folder: Column) -> Column:
    return F.when(folder == "", 0).otherwise(F.size(F.split(folder, "/")))


def is_inside(path: Column, root: str) -> Column:
    """By whole components: /a/bc is not inside /a/b."""
    base = root.rstrip("/")
    return (path == base) | path.startswith(base + "/")


def contained(listing: DataFrame, real_path: str, root: str) -> DataFrame:
    """Files whose real path is known and inside ``root``, after links are followed."""
    return listing.where(F.col(real_path).isNotNull() & is_inside(F.col(real_path), root))


def one_per_real_path(listing: DataFrame, real_path: str, path: str = "path") -> DataFrame:
    """Of all paths that lead to one real path the first in ``path_order``: a folder is walked once."""
    return listing.groupBy(real_path).agg(F.min_by(path, path_order(F.col(path))).alias(path))


def path_order(path: Column) -> Column:
    """What orders paths by component: arrays compare element by element."""
    return F.split(path, "/")


def eligible(listing: DataFrame, data_dir: str | None = None) -> DataFrame:
    """The audio files that a walk reaches, with ``folder``, ``ext`` and ``depth``.

    Folders whose names are ignored, or deeper than ``MAX_DEPTH``, are not entered; a file's own name
    may start with a dot. Protected files and what lies under ``data_dir`` do not count.
    """
    f = listing.withColumns({"folder": parent(F.col("path")), "ext": extension(F.col("path"))})
    f = f.withColumn("depth", depth(F.col("folder")))
    entered = ~F.exists(F.split("folder", "/"), lambda n: is_ignored(n))
    kept = f.where((F.col("depth") <= MAX_DEPTH) & entered & F.col("ext").isin(*AUDIO))
    return kept if data_dir is None else kept.where(~is_inside(F.col("path"), data_dir))


def folder_rules(files: DataFrame) -> DataFrame:
    """``folder`` and ``rule`` of the folders that have books: each M4B or M4A file (each), the only
    MP3 (mp3), several MP3s together (folder), or the only file of another kind (only).

    ``files``: folder, ext and inside. All files count for the rule; a folder none of whose books is
    ``inside`` the root has none.
    """
    ext, inside = F.col("ext"), F.col("inside")
    kinds = {"m4x": ext.isin(*SINGLE), "mp3": ext == "mp3", "all": F.lit(True)}
    counts = files.groupBy("folder").agg(
        *[F.count_if(c).alias(k) for k, c in kinds.items()], *[F.count_if(c & inside).alias(f"{k}_in") for k, c in kinds.items()]
    )
    rule = (
        F.when(F.col("m4x") > 0, F.when(F.col("m4x_in") > 0, "each"))
        .when(F.col("mp3") == 1, F.when(F.col("mp3_in") > 0, "mp3"))
        .when(F.col("mp3") > 1, "folder")
        .when((F.col("all") == 1) & (F.col("all_in") == 1), "only")
    )
    return counts.select("folder", rule.alias("rule")).where("rule IS NOT NULL")


def classify(files: DataFrame) -> DataFrame:
    """Books (``kind`` file or folder, ``path``, ``folder``) of eligible files.

    Below the root a folder with M4B or M4A files is a book for each; else one MP3 is a book, and
    several are one folder book; else a single file of another kind is a book. Files in the root are
    each a book. A folder that has books hides all folders below it. Where there is a column
    ``inside``, files without it count for the rule of their folder and are no books themselves.
    """
    if "inside" not in files.columns:
        files = files.withColumn("inside", F.lit(True))
    ext = F.col("ext")
    below = files.where("depth > 0")
    ruled = folder_rules(below)
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    ancestors = ruled.where(F.size(parts) > 1).select("folder", F.explode(above).alias("above"))
    hidden = ancestors.join(ruled.select(F.col("folder").alias("above")), "above", "left_semi").select("folder").distinct()
    top = ruled.join(hidden, "folder", "left_anti")
    inside = below.where("inside").join(top, "folder")
    fits = ((F.col("rule") == "each") & ext.isin(*SINGLE)) | ((F.col("rule") == "mp3") & (ext == "mp3")) | (F.col("rule") == "only")
    single = inside.where(fits).select(F.lit("file").alias("kind"), "path", "folder")
    folders = top.where("rule = 'folder'").select(F.lit("folder").alias("kind"), F.col("folder").alias("path"), "folder")
    return files.where("depth = 0 AND inside").select(F.lit("file").alias("kind"), "path", "folder").unionByName(single).unionByName(folders)


def with_names(books: DataFrame) -> DataFrame:
    """``base`` (what the slug is made of) and ``nested_title`` of each book.

    A book in nested folders is named after all of them, a folder book after its own.
    """
    prefix = nested_prefix(F.col("folder"))
    own = F.when(F.col("kind") == "folder", file_name(F.col("path"))).otherwise(file_stem(F.col("path")))
    last = F.when((F.col("kind") == "file") & prefix.isNotNull(), file_name(F.col("folder")))
    return books.withColumns({"base": F.coalesce(prefix, own), "nested_title": last})


def folder_tracks(files: DataFrame, books: DataFrame) -> DataFrame:
    """The MP3 files right inside each folder book."""
    folders = books.where("kind = 'folder'").select(F.col("path").alias("folder"))
    return files.where("ext = 'mp3'").join(folders, "folder", "left_semi")


def with_sidecar(books: DataFrame, listing: DataFrame, extensions: tuple[str, ...], out: str) -> DataFrame:
    """``out``: the first file beside a book with its stem and one of the extensions, lower case
    before upper, no other case; null without one."""
    ranked = [x for e in extensions for x in (e, e.upper())]
    name = file_name(F.col("path"))
    ext = F.regexp_extract(name, "\\.([^.]*)\\z", 1)
    rank = F.array_position(F.lit(ranked), ext)
    stem = F.regexp_replace("path", "\\.[^./]*\\z", "")
    found = listing.withColumns({"_rank": rank, "_stem": stem}).where("_rank > 0").groupBy("_stem").agg(F.min_by("path", "_rank").alias(out))
    return books.withColumn("_stem", stem).join(found, "_stem", "left").drop("_stem")


def with_override_file(books: DataFrame, listing: DataFrame, name: str, suffix: str) -> DataFrame:
    """``override``: inside a folder book ``name``; else the file with the book's stem and ``suffix``,
    else ``name`` in its folder unless that is the root."""
    files = listing.select(F.col("path").alias("_file"))
    in_folder = F.when(F.col("kind") == "folder", F.concat("path", F.lit("/" + name))).otherwise(F.when(F.col("folder") != "", F.concat("folder", F.lit("/" + name))))
    beside = F.when(F.col("kind") == "file", F.concat(F.regexp_replace("path", "\\.[^./]*\\z", ""), F.lit(suffix)))
    b = books.withColumns({"_a": beside, "_b": in_folder})
    b = b.join(files.withColumnRenamed("_file", "_a").withColumn("_a_there", F.lit(True)), "_a", "left")
    b = b.join(files.withColumnRenamed("_file", "_b").withColumn("_b_there", F.lit(True)), "_b", "left")
    override = F.when(F.col("_a_there"), F.col("_a")).when(F.col("_b_there"), F.col("_b"))
    return b.withColumn("override", override).drop("_a", "_b", "_a_there", "_b_there")


def faststart_of(read: Callable[[int, int], bytes], size: int) -> bool:
    """Whether an MP4's media data comes before its index: ``ftyp`` seen, then ``mdat`` before ``moov``.

    ``read`` gives the bytes from a place on; only boxes' heads are read, at most 16 bytes of each. Boxes
    have a 32-bit size and a name; size 1 means a 64-bit size follows, 0 that the box goes on to
    the end. Anything malformed: False.
    """
    at, seen = 0, False
    for _ in range(MAX_BOXES):
        head = read(at, 16)
        if len(head) < 8:
            return False
        length, name = int.from_bytes(head[:4], "big"), head[4:8]
        if length == 1:
            if len(head) < 16:
                return False
            length = int.from_bytes(head[8:16], "big")
        elif length == 0:
            length = size - at
        if length < 8:
            return False
        if name == b"moov" or name == b"mdat":
            return seen and name == b"mdat"
        seen |= name == b"ftyp"
        at += length
    return False


def needs_faststart(header: bytes | None, size: int | None = None) -> bool:
    """``faststart_of`` the bytes that a file begins with."""
    data = header or b""
    return faststart_of(lambda at, n: data[at : at + n], len(data) if size is None else size)


def needs_faststart_at(path: str | None) -> bool:
    """``faststart_of`` a file, read from box to box; one that can't be read: False."""
    from skeinworks.sources import files

    try:
        store, base = files.store_of(path or "")
        with store.open_input_file(base) as f:
            size = f.size()
            return faststart_of(lambda at, n: f.read_at(min(n, size - at), at) if at < size else b"", size)
    except (OSError, ValueError):
        return False


def with_faststart(files: DataFrame, content: str = "content") -> DataFrame:
    """``needs_faststart`` of each row's bytes."""

    @F.pandas_udf("boolean")
    def scanned(s: pd.Series) -> pd.Series:
        return s.map(needs_faststart).astype(bool)

    return files.withColumn("needs_faststart", scanned(content))


def with_faststart_of(files: DataFrame, path: str = "real_path") -> DataFrame:
    """``needs_faststart`` of the file at each row's path: a few small reads, whatever its length."""

    @F.pandas_udf("boolean")
    def scanned(s: pd.Series) -> pd.Series:
        return s.map(needs_faststart_at).astype(bool)

    return files.withColumn("needs_faststart", scanned(path))


def read_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path`` and ``text`` of sidecar files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("content").cast("string").alias("text"))
