"""Files as DataFrames: scan, classify, text segments, and the mirror sink."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that a scan leaves out, extensions that are copied as they are, which adapter reads what, archives, and files of our own runs.
SKIPPED_DIRS = (
    ".git", ".hg", ".svn", "__pycache__", ".venv", "venv", "node_modules", ".idea", ".vscode", ".cache", ".mypy_cache", ".pytest_cache", ".tox", ".ruff_cache", "dist", "build", ".DS_Store", ".anon",
)
COPIED = (
    "png", "jpg", "jpeg", "gif", "webp", "bmp", "tiff", "ico", "svg", "mp3", "wav", "ogg", "mp4", "webm", "avi", "mov", "gguf", "bin", "so", "o", "a", "dll", "dylib", "class",
    "jar", "war", "apk", "aab", "ipa", "dex", "zip", "tar", "gz", "bz2", "xz", "7z", "rar", "pyc", "pyo",
)
ADAPTERS = {"docx": "docx", "xlsx": "xlsx", "pptx": "pptx", "odt": "odt", "rtf": "rtf", "doc": "doc_legacy", "pdf": "pdf"}
ARCHIVES = ("zip", "tar", "gz", "bz2", "xz", "7z", "rar")
# End of fixed values.

#: Files that runs write beside their output; values stand in them on purpose.
OWN_FILES = ("auto_promoted_t0.yml", "auto_promoted_t1.yml", "needs_review.yml", "applied_substitutions.json", "decisions_history.jsonl")
IGNORE_FILES = (".anonignore", ".gitignore")
MOST_BYTES = 50 << 20
SNIFFED = 8192


def glob_regex(pattern: str, anything: str = ".") -> str:
    """A whole-name regex of a shell glob; ``anything`` is what ``*`` and ``?`` stand for, with "." across folders."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += {"*": anything + "*", "?": anything}.get(c, re.escape(c))
        i += 1
    return out


def ignored(rel: Column, patterns: Sequence[str]) -> Column:
    """Does a pattern match the path, or a folder that holds it?

    A pattern stands for whole paths from the root (a leading "/" says the
    same, and nothing else); without "/" inside, for names on any level too.
    """
    hit = F.lit(False)
    for raw in patterns:
        p = raw.strip().rstrip("/")
        if not p or p.startswith("#"):
            continue
        hit = hit | rel.rlike(f"(?s)^(?:{glob_regex(p.removeprefix('/'))})(?:/.*)?$")
        if not p.startswith("/"):
            hit = hit | rel.rlike(f"(?:^|/)(?:{glob_regex(p, '[^/]')})(?:/|$)") if "/" not in p else hit
    return hit


def ignore_patterns(spark: SparkSession, root: str, names: Sequence[str] = IGNORE_FILES) -> list[str]:
    """Lines of the ignore files that lie in the root folder, read by the file system that holds it."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    lines: list[str] = []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(root, name)
        files = path.getFileSystem(conf)
        if files.exists(path):
            stream = files.open(path)
            lines += jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
            stream.close()
    return [line.strip() for line in lines if line.strip() and not line.strip().startswith("#")]


def scan_files(spark: SparkSession, paths: Sequence[str], *, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The same rows as ``scan`` for an explicit list of files, each by its name alone."""
    raw = spark.read.format("binaryFile").load(list(paths))
    return classify(raw.select(F.element_at(F.split("path", "/"), -1).alias("file_rel"), "path", F.col("length").alias("size"), "content"), most_bytes)


def scan(spark: SparkSession, root: str, *, ignore: Sequence[str] = (), most_bytes: int = MOST_BYTES, max_depth: int | None = None, ignore_files: Sequence[str] = IGNORE_FILES) -> DataFrame:
    """files(file_rel, path, ext, adapter, size, is_text_like, skipped, skip_reason, content).

    Content is read only for rows that are not skipped by path or size, since
    those tests are pushed to the reader.  Patterns of the root's ignore files
    are added to ``ignore``.  Spark's reader leaves out files whose names begin
    with "." or "_" and enters no folder twice.
    """
    ignore = [*ignore, *ignore_patterns(spark, root, ignore_files)]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.escape(root.rstrip("/").split(":", 1)[-1].lstrip("/"))
    rel = F.regexp_replace("path", rf"^.*?{base}/?", "")
    files = raw.select(F.when(rel == "", F.element_at(F.split("path", "/"), -1)).otherwise(rel).alias("file_rel"), "path", F.col("length").alias("size"), "content")
    dirs = F.slice(F.split("file_rel", "/"), 1, F.size(F.split("file_rel", "/")) - 1)
    keep = ~F.arrays_overlap(dirs, F.array(*map(F.lit, SKIPPED_DIRS))) & ~ignored(F.col("file_rel"), ignore)
    if max_depth is not None:
        keep = keep & (F.size(dirs) <= max_depth)
    return classify(files.where(keep), most_bytes)


def classify(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Size, then extension, then a look for NUL bytes in the head; a byte order mark excuses them."""
    ext = F.lower(F.regexp_extract("file_rel", r"\.([^./]+)$", 1))
    head = F.hex(F.substring("content", 1, SNIFFED))
    bom = head.startswith("EFBBBF") | head.startswith("FFFE") | head.startswith("FEFF")
    nul = head.rlike("^(?:..)*?00") & ~bom
    office = F.lit(None).cast("string")
    for e, a in ADAPTERS.items():
        office = F.when(ext == e, a).otherwise(office)
    reason = F.when(F.col("size") > most_bytes, "too_large").when(ext.isin(*COPIED), "binary_ext").when(office.isNull() & nul, "binary")
    adapter = F.when(reason.isNotNull(), "null").otherwise(F.coalesce(office, F.lit("text")))
    return files.select("file_rel", "path", ext.alias("ext"), adapter.alias("adapter"), "size", (adapter == "text").alias("is_text_like"), reason.isNotNull().alias("skipped"), reason.alias("skip_reason"), "content")


def breakdown(files: DataFrame, by: str) -> DataFrame:
    return files.groupBy(by).agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))


def text_segments(files: DataFrame) -> DataFrame:
    """Whole text files as segment "0"; bytes that are no UTF-8 become U+FFFD."""
    return files.where("adapter = 'text'").select("file_rel", F.lit(0).alias("seg_ord"), F.lit("0").alias("seg_id"), F.decode("content", "UTF-8").alias("text"))


def unprotected(files: DataFrame) -> DataFrame:
    """Files that no operator reads: what is copied as it is stays readable."""
    return files.where("skipped or adapter in ('rtf', 'doc_legacy', 'pdf')").select("file_rel", "adapter", "skip_reason")


def to_verify(files: DataFrame) -> DataFrame:
    """What a verifier reads of an output folder: (file_rel, inspected); archives stay, marked as not inspected.

    Files of our own runs and what is copied as it is, PDF aside, are left out.
    """
    ext, name = F.lower(F.regexp_extract("file_rel", r"\.([^./]+)$", 1)), F.element_at(F.split("file_rel", "/"), -1)
    own = name.isin(*OWN_FILES) | F.col("file_rel").startswith(".anon/")
    archive = ext.isin(*ARCHIVES)
    return files.where(~own & (archive | ~ext.isin(*COPIED))).select("file_rel", (~archive).alias("inspected"))


def write_mirror(segments: DataFrame, path: str) -> None:
    """Rewritten segments as Parquet by file; the job's commit makes it all or nothing."""
    segments.write.mode("error").parquet(path)


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write (file_rel, content) as files below ``root``, a folder that all executors share, and list them (file_rel, n_bytes).

    Each file appears under its name when it is whole, so a task that runs
    twice does no harm.  Paths that lead out of ``root`` are refused.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for rel, content in zip(*(batch.column(c).to_pylist() for c in ("file_rel", "content")), strict=True):
                path = os.path.normpath(os.path.join(root, rel))
                if os.path.commonpath([os.path.abspath(root), os.path.abspath(path)]) != os.path.abspath(root):
                    raise ValueError(f"{rel} leads out of {root}")
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(f"{path}.{uuid.uuid4().hex}", "wb") as f:
                    f.write(content)
                os.replace(f.name, path)
                sizes.append(len(content))
            yield pa.RecordBatch.from_pydict({"file_rel": batch.column("file_rel"), "n_bytes": pa.array(sizes, pa.int64())})

    return files.select("file_rel", "content").mapInArrow(run, "file_rel string, n_bytes long")
