"""File scans, ignore rules, language detection, listings, object storage and chat history."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.functions import text as t
from lodeline.plans.lineage import cut

# Directories that no scan enters (dot-directories are never entered).
IGNORED = (".git", ".venv", "venv", "__pycache__", "node_modules", ".pytest_cache", "dist", "build", ".mypy_cache", ".ruff_cache")
#: The file that adds more of them, unless a scan is given another name.
IGNORE_FILE = ".engineignore"
#: Languages by extension; `symbols` tells which have functions or classes at all.
LANGUAGES = {
    "python": (("py", "pyi"), True), "javascript": (("js", "jsx", "mjs", "cjs"), True), "typescript": (("ts",), True), "tsx": (("tsx",), True), "java": (("java",), True), "go": (("go",), True),
    "rust": (("rs",), True), "c": (("c", "h"), True), "cpp": (("cpp", "cc", "cxx", "hpp", "hh"), True), "csharp": (("cs",), True), "ruby": (("rb",), True), "php": (("php",), True),
    "kotlin": (("kt", "kts"), True), "swift": (("swift",), True), "scala": (("scala", "sc"), True), "bash": (("sh", "bash"), True), "lua": (("lua",), True), "perl": (("pl", "pm"), True),
    "markdown": (("md", "markdown"), False), "html": (("html", "htm"), False), "css": (("css",), False), "json": (("json",), False), "yaml": (("yaml", "yml"), False), "toml": (("toml",), False),
    "ini": (("ini", "cfg"), False), "xml": (("xml",), False), "sql": (("sql",), False), "text": (("txt",), False),
}


def language_table(spark: SparkSession) -> DataFrame:
    """(extension, language, has_symbols): a fixed dimension."""
    return spark.createDataFrame([(e, name, has) for name, (exts, has) in LANGUAGES.items() for e in exts], "extension string, language string, has_symbols boolean")


def detect_language(files: DataFrame, path: str = "path", sniff: str | None = None) -> DataFrame:
    """files with `language` and `has_symbols` by extension; an unknown language counts as having symbols.

    sniff: a column of texts; files of unknown extension whose text is Python count as that.
    """
    table = language_table(files.sparkSession)
    ext = files.withColumn("extension", F.substr(t.suffix(F.col(path)), F.lit(2)))
    known = ext.join(F.broadcast(table), "extension", "left").withColumn("has_symbols", F.coalesce("has_symbols", F.lit(True))).drop("extension")
    if sniff is None:
        return known
    from lodeline.sources.code import looks_like_python

    plain = known.where("language is null")
    return known.where("language is not null").unionByName(plain.withColumn("language", F.when(looks_like_python(F.col(sniff)), "python")))


#: Bytes of files with hidden names ("_" or "." first) that a scan reads at most; see `hidden_files`.
HIDDEN_BYTES = 64 << 20


def _file_system(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _read(spark: SparkSession, fs, path) -> bytes:
    stream = fs.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def hidden_files(spark: SparkSession, root: str, most: int = HIDDEN_BYTES) -> list[tuple[str, bytes, int, int]]:
    """(path, content, size, mtime_ms) of files whose names start with "_" or ".", which Spark's readers leave out.

    They are read by the driver; more than `most` bytes of them is an error rather than a silent cut. Scans that know how to
    open the store on workers don't come here.
    """
    fs, path = _file_system(spark, root)
    base, found, total = fs.resolvePath(path).toUri().getPath().rstrip("/"), [], 0
    walk = fs.listFiles(path, True)
    while walk.hasNext():
        status = walk.next()
        at = status.getPath().toUri().getPath()[len(base) + 1 :]
        *folders, name = at.split("/")
        if name[0] not in "_." or any(x.startswith(".") or x in IGNORED for x in folders):
            continue
        total += status.getLen()
        if total > most:
            raise ValueError(f"more than {most} bytes of files with hidden names below {root}: give scan a function that opens this store on workers")
        found.append((at, _read(spark, fs, status.getPath()), status.getLen(), status.getModificationTime()))
    return found


def ignore_rules(spark: SparkSession, root: str, ignore_file: str = IGNORE_FILE) -> list[str]:
    """The built-in names and the lines of the project's ignore file, blank and # lines skipped."""
    fs, _ = _file_system(spark, root)
    own = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{ignore_file}")
    lines = _read(spark, fs, own).decode(errors="replace").splitlines() if fs.exists(own) else []
    return sorted({*IGNORED, *(x.strip() for x in lines if x.strip() and not x.strip().startswith("#"))})


def ignored_names(spark: SparkSession, root: str, ignore_file: str = IGNORE_FILE) -> DataFrame:
    """(name): `ignore_rules` as a table."""
    return spark.createDataFrame([(n,) for n in ignore_rules(spark, root, ignore_file)], "name string")


def keep_unignored(files: DataFrame, ignored: DataFrame | None = None, path: str = "path") -> DataFrame:
    """Files none of whose directories is ignored or starts with a dot; dot-files themselves stay. ignored: (name), a short list."""
    folders = F.filter(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda x: x != "")
    plain = files.where(~F.exists(folders, lambda x: F.startswith(x, F.lit(".")) | x.isin(*IGNORED)))
    if ignored is None:
        return plain
    names = ignored.agg(F.collect_set("name").alias("__names"))
    return plain.crossJoin(F.broadcast(names)).where(~F.arrays_overlap(folders, F.col("__names"))).drop("__names")


#: What opens a store on a worker: a pyarrow file system and the folder in it that stands for the root.
Opened = Callable[[], tuple]

#: Entries a batch of a listing, and bytes a batch of contents and a partition of files.
BATCH_ENTRIES, BATCH_BYTES, PARTITION_BYTES = 10_000, 16 << 20, 128 << 20


def _local(spark: SparkSession, root: str) -> Opened | None:
    """What opens a root in a file system that workers see under the same path; None for stores that only Spark reads."""
    fs, path = _file_system(spark, root)
    if fs.getUri().getScheme() != "file":
        return None
    base = fs.resolvePath(path).toUri().getPath()

    def opened():
        from pyarrow.fs import LocalFileSystem

        return LocalFileSystem(), base

    return opened


def walk(spark: SparkSession, opened: Opened, ignored: list[str]) -> DataFrame:
    """(path, size, mtime_us) of all files below a root, hidden names too, listed by the workers, a level of folders a round.

    Folders that are ignored or start with a dot are not entered. A folder that is gone when its turn comes has no files. A
    link counts as what it leads to, so a link to a folder above it ends where the system gives up on it. Each round is a
    written table; the driver sees only whether there is a further level.
    """
    skipped = frozenset(ignored)

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSelector, FileType

        system, base = opened()
        base, rows = base.rstrip("/"), []
        for folder in (x for f in frames for x in f["path"]):
            for e in system.get_file_info(FileSelector(f"{base}/{folder}" if folder else base or "/", allow_not_found=True)):
                at = f"{folder}/{e.base_name}" if folder else e.base_name
                if e.type == FileType.File:
                    rows.append((at, True, e.size, (e.mtime_ns or 0) // 1000))
                elif e.type == FileType.Directory and not e.base_name.startswith(".") and e.base_name not in skipped:
                    rows.append((at, False, 0, 0))
                if len(rows) >= BATCH_ENTRIES:
                    yield pd.DataFrame(rows, columns=["path", "is_file", "size", "mtime_us"])
                    rows = []
        yield pd.DataFrame(rows, columns=["path", "is_file", "size", "mtime_us"])

    folders, found = spark.createDataFrame([("",)], "path string"), None
    while found is None or not folders.isEmpty():
        wide = folders if found is None else folders.repartition(spark.sparkContext.defaultParallelism, "path")
        level = cut(wide.mapInPandas(listed, "path string, is_file boolean, size long, mtime_us long"))
        here = level.where("is_file").drop("is_file")
        found, folders = here if found is None else found.union(here), level.where("not is_file").select("path")
    return found


def write(spark: SparkSession, root: str, files: DataFrame) -> bool:
    """Writes files(path, source) below a root that workers see under the same path; False, and nothing written, for other stores.

    The workers write, a file by one task, without Spark's commit, which moves each file or folder once more; files are dealt by path
    to all tasks, as a file costs far more than its bytes. A task that runs again writes the same again.
    """
    fs, path = _file_system(spark, root)
    if fs.getUri().getScheme() != "file":
        return False
    fs.mkdirs(path)
    opened = _local(spark, root)

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = opened()
        base, n = base.rstrip("/"), 0
        for f in frames:
            for at, source in zip(f["path"], f["source"]):
                system.create_dir(f"{base}/{at}".rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{base}/{at}", compression=None) as stream:
                    stream.write((source or "").encode())
                n += 1
        yield pd.DataFrame({"n": [n]})

    dealt = files.select("path", "source").repartition(spark.sparkContext.defaultParallelism, "path")
    dealt.mapInPandas(put, "n long").agg(F.sum("n")).collect()
    return True


def contents(entries: DataFrame, opened: Opened) -> DataFrame:
    """(path, content, size, mtime) of entries(path, size, mtime_us), read by the workers; a file that is gone by then has no row.

    Files are dealt by path to partitions whose number follows their bytes; batches leave by bytes, so a task holds some
    16 MB, or one larger file.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = opened()
        base, rows, held = base.rstrip("/"), [], 0
        columns = ["path", "content", "size", "mtime_us"]
        for f in frames:
            for path, size, mtime in zip(f["path"], f["size"], f["mtime_us"]):
                try:
                    with system.open_input_stream(f"{base}/{path}") as stream:
                        rows.append((path, stream.read(), size, mtime))
                except FileNotFoundError:
                    continue
                held += len(rows[-1][1])
                if held >= BATCH_BYTES or len(rows) >= BATCH_ENTRIES:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=columns)

    total = entries.agg(F.sum("size")).first()[0] or 0
    parts = max(entries.sparkSession.sparkContext.defaultParallelism, -(-total // PARTITION_BYTES))
    got = entries.repartition(parts, "path").mapInPandas(read, "path string, content binary, size long, mtime_us long")
    return got.select("path", "content", "size", F.timestamp_micros("mtime_us").alias("mtime"))


def scan(spark: SparkSession, root: str, ignore_file: str = IGNORE_FILE, opened: Opened | None = None) -> DataFrame:
    """(path, source, size, mtime, language, has_symbols) of all files below root that are UTF-8; paths are relative to root.

    Folders that workers see under root's own path are listed and read by the workers, and so is any store that `opened` opens
    there. Other stores go through Spark's reader of binary files, and files with hidden names there through `hidden_files`.
    """
    opened, rules = opened or _local(spark, root), ignore_rules(spark, root, ignore_file)
    kept = contents(walk(spark, opened, rules), opened) if opened else _spark_files(spark, root, rules)
    texts = kept.where(F.is_valid_utf8(F.col("content").cast("string")))
    return detect_language(texts.select("path", F.col("content").cast("string").alias("source"), "size", "mtime"))


def _spark_files(spark: SparkSession, root: str, rules: list[str]) -> DataFrame:
    """(path, content, size, mtime) through Spark's reader of binary files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    fs, at = _file_system(spark, root)
    base = len(fs.resolvePath(at).toUri().getPath().rstrip("/")) + 2
    files = raw.select(F.substr(F.regexp_replace("path", r"^[a-z0-9]+:/+[^/]*(?=/)|^[a-z0-9]+:/+(?=/)", "") if "://" in root and not root.startswith("file:") else F.regexp_replace("path", r"^file:/+", "/"), F.lit(base)).alias("path"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    hidden = [(p, bytearray(c), n, t / 1000) for p, c, n, t in hidden_files(spark, root)]
    if hidden:
        files = files.union(spark.createDataFrame(hidden, "path string, content binary, size long, t double").select("path", "content", "size", F.timestamp_seconds("t")))
    return keep_unignored(files, spark.createDataFrame([(n,) for n in rules], "name string"))


def listing(files: DataFrame) -> DataFrame:
    """(parent, name, is_file, depth): every entry of the tree, directories before files and names in any case."""
    parts = F.split("path", "/")
    deep = files.select(parts.alias("p"), F.posexplode(parts).alias("i", "name"))
    entries = deep.select(F.array_join(F.slice("p", 1, F.col("i")), "/").alias("parent"), "name", (F.col("i") == F.size("p") - 1).alias("is_file"), F.col("i").alias("depth")).where(~F.endswith("name", F.lit(".egg-info"))).distinct()
    return entries.orderBy("parent", "is_file", F.lower("name"), "name")


def read_file(files: DataFrame, path: Column) -> DataFrame:
    """(path, status, source): 200, or 404 for an unknown path, 415 for a binary one. files: (path, source); path: a literal."""
    from lodeline.functions.predicates import binary_target

    asked = files.sparkSession.range(1).select(path.alias("asked"))
    met = asked.join(files, F.col("asked") == F.col("path"), "left")
    status = F.when(binary_target(F.col("asked")), 415).when(F.col("path").isNull(), 404).otherwise(200)
    return met.select(F.col("asked").alias("path"), status.alias("status"), F.when(status == 200, F.col("source")).alias("source"))


def chat_history(messages: DataFrame, saves: DataFrame | None = None) -> DataFrame:
    """(conv_id, messages) with the turns of each conversation in order; saves(conv_id, saved_at): only the last save counts."""
    if saves is not None:
        last = saves.groupBy("conv_id").agg(F.max("saved_at").alias("saved_at"))
        messages = messages.join(last, ["conv_id", "saved_at"], "left_semi")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
    return messages.groupBy("conv_id").agg(listed.alias("messages"))


class Store:
    """Keys and bodies below one location that Spark can write: local disk, HDFS or S3 alike."""

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location.rstrip("/")

    def put(self, objects: DataFrame, name: str) -> None:
        """Writes objects(key, body) as one version of the collection `name`; readers see the last write of a key, of one write the greatest body."""
        objects.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(f"{self.location}/{name}")

    def all(self, name: str) -> DataFrame:
        from lodeline.operators.versions import latest

        rows = self.spark.read.parquet(f"{self.location}/{name}").withColumn("order", F.struct("written_at", "body"))
        return latest(rows, "key", "order").select("key", "body")

    def get(self, name: str, key: str) -> DataFrame:
        return self.all(name).where(F.col("key") == key)

    def exists(self, name: str, key: str) -> bool:
        return not self.get(name, key).isEmpty()

    def list(self, name: str, prefix: str = "") -> DataFrame:
        return self.all(name).where(F.startswith("key", F.lit(prefix))).select("key").orderBy("key")


def write_metadata(metadata: DataFrame, location: str) -> None:
    """One JSON directory for each file; only the files at hand are replaced."""
    metadata.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file").json(location)


def delete_metadata(spark: SparkSession, location: str, files: list[str]) -> int:
    """Removes the directories of the named files; returns how many there were."""
    gone = 0
    for name in files:
        escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(name)
        fs, path = _file_system(spark, f"{location.rstrip('/')}/file={escaped}")
        gone += bool(fs.delete(path, True))
    return gone


def write_project_metadata(metadata: DataFrame, prints: DataFrame, location: str) -> bool:
    """Writes metadata(project_id, ...) unless prints(project_id, fingerprint) equal those written before; whether it wrote.

    Only projects whose fingerprint is new are replaced.
    """
    spark, at = metadata.sparkSession, f"{location.rstrip('/')}/prints"
    fs, path = _file_system(spark, at)
    known = spark.read.parquet(at) if fs.exists(path) else prints.limit(0)
    fresh = cut(prints.select("project_id", "fingerprint").join(known.select("project_id", "fingerprint"), ["project_id", "fingerprint"], "left_anti"))
    if fresh.isEmpty():
        return False
    some = metadata.join(fresh.select("project_id"), "project_id", "left_semi")
    some.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").json(f"{location.rstrip('/')}/symbols")
    fresh.select("fingerprint", "project_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(at)
    return True


def cache_key(name: Column, hashed: Column, digits: int = 8) -> Column:
    """A readable name with the first digits of a hash, as a path of a cache."""
    return F.concat(F.regexp_replace(name, r"[^A-Za-z0-9_.-]+", "-"), F.lit("-"), F.substring(F.sha2(hashed, 256), 1, digits))


def graph_cache_key(path: Column, language: Column, fingerprint: Column) -> Column:
    """Where the call graph of a project's files of one language is kept: path hash, language, fingerprint."""
    return F.concat_ws("_", F.substring(F.sha2(path, 256), 1, 16), language, F.substring(fingerprint, 1, 12))


CALL_GRAPH = "caller string, file string, callee string, line int"


def call_graph_from_json(spark: SparkSession, path: str) -> DataFrame:
    """(caller, file, callee, line): call edges that an external analyser has written as JSON lines; no such path: no rows."""
    if not available(spark, path):
        return spark.createDataFrame([], CALL_GRAPH)
    return spark.read.schema(CALL_GRAPH).json(path)


def available(spark: SparkSession, path: str | None) -> bool:
    """Whether an optional input, what an external tool would have written, is there."""
    if not path:
        return False
    fs, at = _file_system(spark, path)
    return bool(fs.exists(at))


def call_graphs(spark: SparkSession, location: str, languages: tuple[str, ...]) -> DataFrame:
    """(language, caller, file, callee, line) of one edge file a language; a language without one has no rows, others keep theirs."""
    out = spark.createDataFrame([], f"language string, {CALL_GRAPH}")
    for language in languages:
        out = out.unionByName(call_graph_from_json(spark, f"{location.rstrip('/')}/{language}.json").withColumn("language", F.lit(language)))
    return out


def decode_binary(body: Column) -> Column:
    return F.unbase64(body)


def encode_binary(body: Column) -> Column:
    return F.base64(body)
