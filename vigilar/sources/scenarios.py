"""Scenario dimension, manifests, and readers of labelled query tables (CSV or Parquet)."""

from __future__ import annotations

import codecs
import hashlib
import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilar.operators.sampling import sample_n, stratified_cap
from vigilar.sources.csv_scan import header_of, read_csv

# The columns of a scenario file. All are text but the label.
SCENARIO_COLUMNS = (
    "full_query", "label", "user_inputs", "attack_stage", "tamper_method", "attack_status",
    "statement_type", "query_template_id", "attack_id", "attack_technique", "split",
)
REQUIRED = ("full_query", "label")
DOMAINS = ("a", "b", "c", "d")


@dataclass(frozen=True)
class Family:
    """A group of scenario files evaluated by one protocol (``suite``, ``drift`` or ``fewshot``)."""

    name: str
    protocol: str
    suites: dict[str, tuple[str, ...]]
    manifest_group: str | None
    file_prefix: str = ""

    def file_name(self, scenario: str) -> str:
        if scenario not in {s for members in self.suites.values() for s in members}:
            raise ValueError(f"unknown scenario {scenario!r} of {self.name}")
        return f"{in_domain(scenario) if self.protocol == 'fewshot' else self.file_prefix + scenario}.csv"


def in_domain(domain: str) -> str:
    """Scenario that trains and tests on ``domain``."""
    return f"{domain}-{domain}"


def lodo(domain: str) -> str:
    """Scenario that tests on ``domain`` and trains on all others."""
    return "".join(d for d in DOMAINS if d != domain) + f"-{domain}"


IN_DOMAIN = tuple(in_domain(d) for d in DOMAINS)
LODO = tuple(lodo(d) for d in DOMAINS)
_MULTI = {"in_domain": IN_DOMAIN, "lodo": LODO, "all": IN_DOMAIN + LODO}

FAMILIES = {
    f.name: f
    for f in (
        Family("multi", "suite", _MULTI, "main"),
        Family("multi-big", "suite", _MULTI, None),
        Family("single", "suite", {"all": ("single",)}, None),
        Family("drift", "drift", {"all": DOMAINS}, "drift"),
        Family("fewshot", "fewshot", {"all": DOMAINS}, "fsl"),
    )
}


def scenario_dimension(spark: SparkSession) -> DataFrame:
    """(family, protocol, suite, scenario, kind, train_domains, test_domain, file)."""
    rows = []
    for fam in FAMILIES.values():
        for suite, members in fam.suites.items():
            for s in members:
                train, _, test = s.partition("-")
                test = test or train
                kind = {"drift": "drift", "fewshot": "few_shot"}.get(fam.protocol, "in_domain" if train == test else "lodo")
                if fam.name == "single":
                    rows.append((fam.name, fam.protocol, suite, s, "in_domain", ["single"], "single", fam.file_name(s)))
                    continue
                rows.append((fam.name, fam.protocol, suite, s, kind, list(train), test, fam.file_name(s)))
    return spark.createDataFrame(
        rows,
        "family string, protocol string, suite string, scenario string, kind string, "
        "train_domains array<string>, test_domain string, file string",
    )


def scenario_roles(spark: SparkSession) -> DataFrame:
    """(scenario, kind, domain, split): which domain's rows feed which scenario (fixed 24 rows)."""
    rows = []
    for d in DOMAINS:
        rows += [(in_domain(d), "in_domain", d, "train"), (in_domain(d), "in_domain", d, "test")]
        rows += [(lodo(d), "lodo", o, "train") for o in DOMAINS if o != d] + [(lodo(d), "lodo", d, "test")]
    return spark.createDataFrame(rows, "scenario string, kind string, domain string, split string")


def build_scenarios(corpus: DataFrame, seed=7, equal_size: bool = True) -> DataFrame:
    """In-domain and leave-one-domain-out scenarios from one corpus with ``domain`` and ``split``.

    With ``equal_size`` every scenario's split is cut, label-stratified, to the smallest one.
    """
    roles = F.broadcast(scenario_roles(corpus.sparkSession))
    rows = corpus.join(roles, ["domain", "split"])
    if not equal_size:
        return rows
    from pyspark.sql import Window

    smallest = F.min("n").over(Window.partitionBy("split"))
    return stratified_cap(rows, None, seed, groups=["scenario", "split"], limit_col=smallest)


# ---- readers --------------------------------------------------------------------


def read_labelled(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, limit: int | None = None, seed=0
) -> DataFrame:
    """Scan a labelled table; keep the required and the chosen columns.

    Rows without text or label are dropped and the label becomes INT. A CSV must name
    its columns in a header; they are read as text, never inferred, and in as many tasks as
    the file has splits. Rows of a CSV without ``row_id`` get one from file and line, which is
    the same on any cluster. Rows of a Parquet table without one get one at the scan; these
    follow its splits, so such a table takes no ``limit``.
    """
    if _is_parquet(spark, path):
        _refuse_unnumbered(spark, path, limit)
        raw = _with_id(spark.read.parquet(path))
    else:
        header = header_of(spark, path)
        raw = read_csv(spark, path, header)
        if "row_id" in header:
            raw = raw.select(F.col("row_id").cast("long").alias("row_id"), *[c for c in header if c != "row_id"])
    keep = list(raw.columns) if columns is None else [c for c in raw.columns if c in {*columns, *REQUIRED, "row_id"}]
    missing = {*(columns or ()), *REQUIRED} - set(raw.columns)
    if missing:
        raise ValueError(f"{path} lacks column(s) {sorted(missing)}")
    rows = clean_required(raw.select(keep))
    if limit is None:
        return rows
    return stratified_cap(rows, limit, seed)


def _refuse_unnumbered(spark: SparkSession, path: str, limit: int | None) -> None:
    if limit is not None and _is_parquet(spark, path) and "row_id" not in spark.read.parquet(path).columns:
        raise ValueError(f"{path} has no row_id: a sample of it would depend on the cluster; write it with convert_csv first")


def _is_parquet(spark: SparkSession, path: str) -> bool:
    """By name, or a folder with Parquet files anywhere below, on any file system."""
    if path.rstrip("/").endswith(".parquet"):
        return True
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        return False
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path) or not fs.getFileStatus(jvm_path).isDirectory():
        return False
    files = fs.listFiles(jvm_path, True)
    while files.hasNext():
        if files.next().getPath().getName().endswith(".parquet"):
            return True
    return False


def convert_csv(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Write a labelled CSV once as Parquet by split, with its row ids; return the new table.

    Reading a CSV takes two passes over its lines, so tables that are used often are converted first.
    """
    read_labelled(spark, path).write.mode("overwrite").partitionBy("split").parquet(out)
    return spark.read.parquet(out)


def clean_required(df: DataFrame) -> DataFrame:
    """Drop rows without text or label; cast the label to INT."""
    label = F.expr("try_cast(label AS INT)")
    return df.withColumn("label", label).dropna(subset=list(REQUIRED))


def read_split(
    spark: SparkSession, path: str, split: str, columns: Sequence[str] = ("full_query", "label", "split"), limit=None, seed=0
) -> DataFrame:
    """Rows whose ``split`` matches; Parquet laid out by split is pruned."""
    _refuse_unnumbered(spark, path, limit)
    rows = read_labelled(spark, path, (*columns, "split")).where(F.col("split") == split)
    return rows if limit is None else stratified_cap(rows, limit, seed)


def read_whole_sample(
    spark: SparkSession, path: str, columns: Sequence[str] = ("full_query", "label", "split"), limit=None, seed=7
) -> DataFrame:
    """A sample of the whole file, drawn before splitting and without strata; ``split`` is kept."""
    _refuse_unnumbered(spark, path, limit)
    rows = read_labelled(spark, path, (*columns, "split"))
    if limit is None:
        return rows
    return sample_n(rows, limit, seed)


def _with_id(rows: DataFrame) -> DataFrame:
    if "row_id" in rows.columns:
        return rows.withColumn("row_id", F.col("row_id").cast("long"))
    return rows.withColumn("row_id", F.monotonically_increasing_id())


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def scenario_path(spark: SparkSession, root: str, family: str, scenario: str) -> str:
    """Where a scenario lies below ``root``: its converted table (the file's name with .parquet), or else its CSV."""
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family!r}; known: {sorted(FAMILIES)}")
    csv = os.path.join(root, FAMILIES[family].file_name(scenario))
    table = f"{csv.removesuffix('.csv')}.parquet"
    return table if _exists(spark, table) else csv


def convert_scenario(spark: SparkSession, root: str, family: str, scenario: str, manifest: DataFrame | None = None) -> DataFrame:
    """Write a scenario's CSV as the Parquet table that ``read_scenario`` then reads, after a check against its manifest entry."""
    csv = os.path.join(root, FAMILIES[family].file_name(scenario))
    if manifest is not None:
        check_file(manifest, csv)
    return convert_csv(spark, csv, f"{csv.removesuffix('.csv')}.parquet")


def check_file(manifest: DataFrame, path: str) -> None:
    """Raise if a file differs from its entry in the manifest; entries without a checksum pass."""
    folder, name = os.path.split(path)
    found = verify_files(manifest.where(F.col("file") == name), folder, name).first()
    if found is None or found["status"] not in ("ok", "unchecked"):
        raise ValueError(f"{path} fails its check: {found['status'] if found else 'no entry'}")


def read_scenario(
    spark: SparkSession, root: str, family: str, scenario: str, split: str | None = None, columns=SCENARIO_COLUMNS, limit=None, seed=0,
    manifest: DataFrame | None = None,
) -> DataFrame:
    """Resolve (family, scenario) below ``root`` and read it, as a converted table or as CSV.

    With a ``manifest`` (``manifest_entries``) a CSV is checked against its entry first; a
    converted table was checked when it was written.
    """
    path = scenario_path(spark, root, family, scenario)
    if manifest is not None and path.endswith(".csv"):
        check_file(manifest, path)
    if split is None:
        return read_labelled(spark, path, columns, limit, seed)
    return read_split(spark, path, split, columns, limit, seed)


def drift_partitions(corpus: DataFrame, limit: int | None = None, seed=0) -> DataFrame:
    """Add ``part``: origin_train, origin_test or shifted_test; other rows are left out.

    One scan for all three; with a limit each part is capped on its own.
    """
    part = (
        F.when((F.col("drift_set") == "origin") & (F.col("split") == "train"), "origin_train")
        .when((F.col("drift_set") == "origin") & (F.col("split") == "test"), "origin_test")
        .when((F.col("drift_set") == "shifted") & (F.col("split") == "test"), "shifted_test")
    )
    rows = corpus.withColumn("part", part).where(F.col("part").isNotNull())
    return rows if limit is None else stratified_cap(rows, limit, seed, groups=["part"])


def fewshot_sets(corpus: DataFrame, target: str, test_limit: int | None = None, seed=0) -> tuple[DataFrame, DataFrame]:
    """Train and (label-stratified, capped) test rows of one target domain."""
    rows = corpus.where(F.col("domain") == target)
    test = rows.where(F.col("split") == "test")
    return rows.where(F.col("split") == "train"), stratified_cap(test, test_limit, seed)


# ---- manifests and file checks -----------------------------------------------------

_ENTRY = "struct<kind:string,test_domain:string,train_domains:array<string>,bytes:bigint,sha256:string,md5:string>"


def manifest_entries(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of a JSON manifest: (group, file, kind, ..., bytes, sha256, md5).

    Both layouts are read: files below named groups, or one flat ``files`` map.
    """
    schema = f"groups map<string, struct<files: map<string, {_ENTRY}>>>, files map<string, {_ENTRY}>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    grouped = doc.select(F.explode("groups").alias("grp", "g")).select("grp", F.explode("g.files").alias("file", "e"))
    flat = doc.select(F.lit("main").alias("grp"), F.explode("files").alias("file", "e"))
    return grouped.unionByName(flat).select("grp", "file", "e.*")


def _by_reader(spark: SparkSession, source: str, folder: str, pattern: str | None, **options) -> DataFrame:
    reader = spark.read.format(source).options(recursiveFileLookup=True, **options)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder)


def files_below(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """(file, path, length): the files below ``folder`` by their path below it, of names that match ``pattern``, if given. No file is read."""
    files = _by_reader(spark, "binaryFile", folder, pattern)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    below = files.select("length", F.col("_metadata.file_path").alias("_whole"), F.regexp_replace("path", "^[a-z0-9]+:/*", "/").alias("_below"))
    return below.select(F.expr("substring(_below, {})".format(len(root) + 2)).alias("file"), F.col("_whole").alias("path"), "length")


PIECE_BYTES = 8 << 20  # of an Arrow batch of lines or pieces
_PIECE = "path string, at long, no long, size long, length long, piece binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each split, put together again batch by batch, and a row without a piece that gives the bytes of the whole split."""

    def row(path: str, at: int, no: int, size: int, length: int, piece: pa.Scalar | None) -> pa.RecordBatch:
        values = [[path], [at], [no], [size], [length]]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        arrays = [pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([piece], pa.binary())], names=["path", "at", "no", "size", "length", "piece"])

    split, no, total = None, 0, 0
    for batch in batches:
        path, at, length, line = (batch.column(c) for c in ("path", "at", "length", "line"))
        other = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(at[1:], at[:-1])).to_numpy(zero_copy_only=False) if len(path) > 1 else np.empty(0, bool)
        ends = [*(np.flatnonzero(other) + 1).tolist(), len(path)] if len(path) else []
        start = 0
        for end in ends:
            this = (path[start].as_py(), at[start].as_py(), length[start].as_py())
            if this != split:
                if split:
                    yield row(split[0], -1, split[1], total, split[2], None)
                split, no, total = this, 0, 0
            piece = b"\n".join([*line[start:end].to_pylist(), b""])
            total += len(piece)
            yield row(split[0], split[1], no, 0, split[2], piece)
            start, no = end, no + 1
    if split:
        yield row(split[0], -1, split[1], total, split[2], None)


def _digests(kind: str):  # noqa: ANN202
    """Task that goes through the pieces of files in their order and hashes them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, whole, length, lines, digest = None, 0, 0, 0, None

        def done() -> pa.RecordBatch:
            if whole != length:
                raise ValueError(f"{path}: {whole} of {length} bytes read")
            return pa.RecordBatch.from_pydict({"path": [path], "digest": [digest.hexdigest()]})

        for batch in batches:
            for p, size, n, piece in zip(*[batch.column(c).to_pylist() for c in ("path", "size", "length", "piece")], strict=True):
                if p != path:
                    if path is not None:
                        yield done()
                    path, whole, length, lines, digest = p, 0, n, 0, hashlib.new(kind)
                if piece is None:  # these come first
                    lines += size
                    continue
                if not whole and length - lines in (2, 3):  # the reader of lines leaves out a byte order mark
                    digest.update(codecs.BOM_UTF8)
                    whole = len(codecs.BOM_UTF8)
                if whole + len(piece) == length + 1:  # the last line has no end
                    piece = piece[:-1]
                digest.update(piece)
                whole += len(piece)
        if path is not None:
            yield done()

    return rows


def _unpacked(spark: SparkSession, paths: list[str]) -> set[str]:
    """Those of ``paths`` that Spark's readers would unpack, by the suffix of their names."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop
    factory = jvm.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration())
    suffixes = {os.path.splitext(p)[1] for p in paths} - {""}
    packed = {s for s in suffixes if factory.getCodec(jvm.fs.Path(f"/x{s}")) is not None}
    return {p for p in paths if os.path.splitext(p)[1] in packed}


def file_digests(spark: SparkSession, folder: str, paths: list[str], kind: str = "sha256", pattern: str | None = None) -> DataFrame:
    """(path, digest): ``sha256`` or ``md5`` in hexadecimal of those files below ``folder`` that ``paths`` names, as ``files_below`` does.

    A file of any size goes through in pieces: it is read by splits as lines of bytes, whatever it holds, and one task hashes its pieces
    in order, as these hashes demand. Memory is bounded by a batch or the longest line. Files with the suffix of a
    compression would be unpacked by that reader; they are hashed whole and may have 2 GiB.
    """
    packed = _unpacked(spark, paths)
    path = F.col("_metadata.file_path")
    digest = F.md5("content") if kind == "md5" else F.sha2("content", 256)
    out = spark.createDataFrame([], "path string, digest string")
    if packed:
        whole = _by_reader(spark, "binaryFile", folder, pattern).where(path.isin(sorted(packed)))
        out = out.unionByName(whole.select(path.alias("path"), digest.alias("digest")))
    plain = sorted(set(paths) - packed)
    if plain:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(PIECE_BYTES))
        mark = len(codecs.BOM_UTF8)  # the reader gives no line of a file that is but this mark
        short = _by_reader(spark, "binaryFile", folder, pattern).where(F.col("length") <= mark).where(path.isin(plain))
        out = out.unionByName(short.select(path.alias("path"), digest.alias("digest")))
        lines = _by_reader(spark, "text", folder, pattern, lineSep="\n").where(path.isin(plain) & (F.col("_metadata.file_size") > mark))
        lines = lines.select(path.alias("path"), F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_size").alias("length"), F.col("value").cast("binary").alias("line"))
        pieces = lines.mapInArrow(_pieces, _PIECE).repartition("path").sortWithinPartitions("path", "at", "no")
        out = out.unionByName(pieces.mapInArrow(_digests(kind), "path string, digest string"))
    return out


def verify_files(entries: DataFrame, folder: str, pattern: str | None = None) -> DataFrame:
    """Compare files below ``folder`` with their manifest rows: add ``status``.

    Files are found by their path below the folder (only names that match ``pattern``, if given). ``ok``, ``bad_size``, ``bad_hash``,
    ``missing``, or ``unchecked`` without a checksum. Files of a wrong size or without a checksum are not hashed; others are by the executors.
    """
    spark = entries.sparkSession
    files = files_below(spark, folder, pattern).withColumnRenamed("length", "actual_bytes")
    wanted = F.coalesce("sha256", "md5")
    kind = F.when(F.col("sha256").isNotNull(), "sha256").otherwise("md5")
    checked = entries.join(files, "file", "left").withColumn("kind", kind)
    right = F.col("actual_bytes").isNotNull() & (F.col("bytes").isNull() | (F.col("bytes") == F.col("actual_bytes")))
    asked = checked.where(right & wanted.isNotNull()).select("path", "kind").distinct().collect()
    digests = spark.createDataFrame([], "path string, digest string, kind string")
    for k in sorted({r["kind"] for r in asked}):
        found = file_digests(spark, folder, [r["path"] for r in asked if r["kind"] == k], k, pattern)
        digests = digests.unionByName(found.withColumn("kind", F.lit(k)))
    checked = checked.join(digests, ["path", "kind"], "left")
    status = (
        F.when(F.col("actual_bytes").isNull(), "missing")
        .when(wanted.isNull(), "unchecked")
        .when(~right, "bad_size")
        .when(wanted != F.coalesce("digest", F.lit("")), "bad_hash")
        .otherwise("ok")
    )
    return checked.select("grp", "file", "bytes", "actual_bytes", status.alias("status"))


def verify_tables(entries: DataFrame, folder: str) -> DataFrame:
    """(file, status) per entry directly below ``folder``: a file's own status, or the worst one of the files of a table stored as a folder.

    A missing file is worse than a wrong size, this than a wrong hash, and this than a file without a checksum.
    """
    order = F.array(*[F.lit(s) for s in ("missing", "bad_size", "bad_hash", "unchecked", "ok")])
    checked = verify_files(entries, folder).withColumn("file", F.split_part("file", F.lit("/"), F.lit(1)))
    return checked.groupBy("file").agg(F.get(order, F.min(F.array_position(order, F.col("status"))).cast("int") - 1).alias("status"))
