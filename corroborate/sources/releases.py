"""Reading releases of tab-separated and FASTA records so that every line is accounted for."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import map_arrow
from ..similarity.common import fresh_path

#: Lines of one range of a file, of which each gives its first headers.
RANGE_LINES = 1 << 20


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the cluster shares (``spark.checkpoint.dir``); a session on several machines must name one."""
    return fresh_path(spark, label)


def numbered_lines(df: DataFrame, order: list[str], first: int = 2) -> DataFrame:
    """Line numbers in the order of ``order`` without a window over all rows.

    Rows are dealt by range and counted by partition; the partitions' running totals, one row each, give the offsets.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    placed = dealt.withColumn("__k", F.monotonically_increasing_id() - F.shiftleft(F.col("__p").cast("long"), 33))
    path = scratch(df.sparkSession, "lines")
    placed.write.parquet(path)
    written = df.sparkSession.read.parquet(path)
    sizes = written.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    return written.join(F.broadcast(before), "__p").withColumn("line_no", F.col("__before") + F.col("__k") + first).drop("__p", "__k", "__n", "__before")


def validate_header(header: list[str], required: list[str]) -> list[str]:
    """The header, or an error that names what is wrong with it."""
    twice = sorted({h for h in header if header.count(h) > 1})
    if twice:
        raise ValueError(f"header names columns twice: {', '.join(twice)}")
    missing = [r for r in required if r not in header]
    if missing:
        raise ValueError(f"header lacks columns: {', '.join(missing)}")
    return header


def write_release(lines: DataFrame, header: list[str], path: str, order: list[str], raw: str = "raw") -> None:
    """A release as files whose names give the order of their lines: the header line alone, then the lines in ranges of ``order``."""
    spark = lines.sparkSession
    spark.createDataFrame([("\t".join(header),)], "value string").coalesce(1).write.text(f"{path}/0-header")
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(raw).cast("string").alias("value")).write.text(f"{path}/1-lines")


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, raw) of all lines of a file, or of a folder's files in the order of their names, split at line feeds only.

    Numbers start at 1 and need no column to sort by: a line is known by its file, the start of the split that it was read in and its
    place there. Splits are counted, and their running totals, one row a split and one a file, are the offsets. The lines are
    written out with their places first, since a second reading may be split otherwise. Files of any split size give the same numbers.
    """
    source = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    placed = source.select(F.col("value").cast("binary").alias("raw"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at"))
    kept = scratch(spark, "numbered")
    placed.write.parquet(kept)
    lines = spark.read.parquet(kept)
    splits = lines.groupBy("__file", "__start").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    in_file = F.sum("__n").over(Window.partitionBy("__file").orderBy("__start").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    files = splits.groupBy("__file").agg(F.sum("__n").alias("__lines"))
    earlier = files.select("__file", (F.sum("__lines").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__lines")).alias("__before"))
    offsets = splits.select("__file", "__start", (in_file - F.col("__first") + 1).alias("__offset")).join(earlier, "__file")
    joined = lines.join(F.broadcast(offsets), ["__file", "__start"])
    return joined.select((F.col("__at") + F.col("__offset") + F.col("__before")).alias("line_no"), "raw")


def read_release(spark: SparkSession, path: str, required: list[str]) -> tuple[list[str], DataFrame]:
    """The header, decoded and checked, of a release, and its other lines as (line_no, raw), numbered from 2."""
    lines = read_numbered(spark, path)
    first = lines.where("line_no = 1").select("raw", F.try_validate_utf8(F.col("raw").cast("string")).alias("text")).first()
    if first is None or not first["raw"]:
        raise ValueError("the release has no header line")
    if first["text"] is None:
        raise ValueError("the header line is not valid UTF-8")
    return validate_header(first["text"].split("\t"), required), lines.where("line_no > 1")


def split_lines(lines: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Lines with as many fields as the header, and those in quarantine with their bytes and the rule they broke.

    ``raw`` holds the bytes of each line; the last field keeps a carriage return.
    """
    text = F.try_validate_utf8(F.col("raw").cast("string"))
    fields = F.size(F.split(F.coalesce(text, F.lit("")), "\t", -1))
    rule = F.when(text.isNull(), "invalid_utf8").when(fields != width, "field_count")
    judged = lines.withColumn("rule", rule).withColumn("text", text)
    good = judged.where("rule is null").select("line_no", "text")
    bad = judged.where("rule is not null").select("line_no", "rule", "raw", F.octet_length("raw").cast("long").alias("byte_length"))
    return good, bad


def to_payload(lines: DataFrame, header: list[str]) -> DataFrame:
    """Sparse maps of the fields that are not empty; blanks are content."""
    names, fields = F.array(*map(F.lit, header)), F.split("text", "\t", -1)
    # the optimizer may read the map before the lines are filtered, so the width is asked again
    whole = F.when(F.size(fields) == len(header), F.map_from_arrays(names, fields))
    return lines.select("line_no", F.map_filter(whole, lambda k, v: v != "").alias("payload"))


def reconstruct(payload: Column, header: list[str]) -> Column:
    """The line that a sparse map came from."""
    return F.concat_ws("\t", *[F.coalesce(payload[h], F.lit("")) for h in header])


def reconciliation(lines: DataFrame, header: list[str]) -> DataFrame:
    """Lines in, rows loaded, rows excluded by rule, mean fields a row, and whether they add up: one pass over the lines.

    What is loaded counts by its rows, and what is excluded by its rules, so a line that is neither, or both, shows.
    """
    text = F.try_validate_utf8(F.col("raw").cast("string"))
    fields = F.split(F.coalesce(text, F.lit("")), "\t", -1)
    judged = lines.select(text.isNull().alias("bad"), (F.size(fields) != len(header)).alias("odd"), F.size(F.filter(fields, lambda x: x != "")).alias("n"))
    loaded = ~F.col("bad") & ~F.col("odd")
    found = judged.agg(
        F.count("*").alias("n_lines"),
        F.count_if(loaded).alias("n_loaded"),
        F.count_if(F.col("bad")).alias("n_invalid_utf8"),
        F.count_if(~F.col("bad") & F.col("odd")).alias("n_field_count"),
        F.avg(F.when(loaded, F.col("n"))).alias("mean_fields"),
    )
    excluded = F.col("n_invalid_utf8") + F.col("n_field_count")
    return found.withColumn("n_excluded", excluded).withColumn("reconciles", F.col("n_lines") == F.col("n_loaded") + F.col("n_excluded"))


def release_state(incoming: DataFrame, registry: DataFrame) -> DataFrame:
    """What to do with each incoming release: load it, resume it, skip it, or refuse it."""
    known = registry.select("release", F.col("digest").alias("known_digest"), "finished")
    state = F.when(F.col("known_digest").isNull(), "absent").when(F.col("known_digest") != F.col("digest"), "conflict").when(F.col("finished"), "ingested").otherwise("unparsed")
    return incoming.join(known, "release", "left").select("release", "digest", state.alias("state"))


def fasta_records(lines: DataFrame, file: str = "file", line: str = "line_no", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Records of a header line and the residue lines after it, within each file; records without residues are apart.

    Lines are dealt by ranges of file and line, so a large file is the work of many tasks: each counts the headers in its
    range, and the counts of the ranges before it, one row a file and range, give the record's number. A record's lines are
    put together in order; a record is small.
    """
    head = F.col(text).startswith(">").cast("int")
    path = scratch(lines.sparkSession, "records")
    lines.select(file, line, text).repartitionByRange(file, line).withColumn("__p", F.spark_partition_id()).write.parquet(path)
    placed = lines.sparkSession.read.parquet(path)
    ranges = placed.groupBy(file, "__p").agg(F.sum(head).alias("__n"))
    earlier = F.sum("__n").over(Window.partitionBy(file).orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    own = F.sum(head).over(Window.partitionBy(file, "__p").orderBy(line).rowsBetween(Window.unboundedPreceding, 0))
    numbered = placed.withColumn("__own", own).join(ranges.select(file, "__p", earlier.alias("__before")), [file, "__p"])
    tagged = numbered.withColumn("ordinal", F.col("__before") + F.col("__own")).where("ordinal > 0")
    records = tagged.groupBy(file, "ordinal").agg(
        F.max(F.when(F.col(text).startswith(">"), F.substr(F.col(text), F.lit(2)))).alias("description"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col(text).startswith(">"), F.struct(line, text)))), lambda x: x[text]), "").alias("sequence"),
    )
    return records.where("sequence <> ''").withColumn("length", F.length("sequence")), records.where("sequence = ''").select(file, "ordinal", "description")


class VersionError(ValueError):
    """A version that must not be used: unknown, superseded, or no longer what was registered."""


def write_version(df: DataFrame, path: str) -> None:
    """Write a named version once; a second write of the same name fails."""
    df.write.mode("errorifexists").parquet(path)


def load_version(registry: DataFrame, name: str, digest, allow_superseded: bool = False) -> DataFrame:
    """The rows of a registered version (name, path, digest, superseded_by), after their content has been checked.

    ``digest`` gives a one-row table with a column ``digest`` of the whole content of a table. A superseded version is
    refused unless it is asked for, and so is one whose rows are not those that were registered.
    """
    known = registry.where(F.col("name") == name).select("path", "digest", "superseded_by").first()
    if known is None:
        raise VersionError(f"no version {name} is registered")
    if known["superseded_by"] is not None and not allow_superseded:
        raise VersionError(f"version {name} was superseded by {known['superseded_by']}")
    rows = registry.sparkSession.read.parquet(known["path"])
    if digest(rows).first()["digest"] != known["digest"]:
        raise VersionError(f"the rows of version {name} are not those that were registered")
    return rows


def identity_key(specification: dict[str, object], population: str) -> str:
    """What a version is made of: a digest of how it was specified and of the digest of the population that it covers."""
    named = json.dumps(specification, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(f"{named}\n{population}".encode()).hexdigest()


class Reusable(NamedTuple):
    """A version that can stand for what would be computed, or why each of the versions of its kind cannot."""

    name: str | None
    rows: DataFrame | None
    refused: dict[str, str]


def find_reusable(registry: DataFrame, identity: str, digest) -> Reusable:
    """The registered version (name, path, digest, superseded_by, identity, complete) that makes the work unneeded, looked up before it begins.

    Only versions with this identity are looked at, so nothing else is read. One that covers a part of its population, that another
    supersedes, or whose rows are no longer those that were registered is not returned; of several the last by name is.
    """
    refused: dict[str, str] = {}
    for row in registry.where(F.col("identity") == identity).orderBy(F.desc("name")).toLocalIterator():
        if not row["complete"]:
            refused[row["name"]] = "partial"
            continue
        try:
            return Reusable(row["name"], load_version(registry, row["name"], digest), refused)
        except VersionError as why:
            refused[row["name"]] = str(why)
    return Reusable(None, None, refused)


def shard_of(key: Column, shards: int) -> Column:
    """A shard by the first 32 bits of the key's MD5, which any engine can repeat."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % shards).cast("int")


def write_sharded(lines: DataFrame, path: str, key: Column, shards: int) -> None:
    """One folder a shard of the key; each line goes through as it is. A shard is dealt over several tasks, so none is bound to one."""
    dealt = lines.select(F.col("value"), shard_of(key, shards).alias("shard"))
    dealt.repartition("shard", F.pmod(F.xxhash64("value"), F.lit(8))).write.partitionBy("shard").text(path)


#: Characters of lines that travel as one row to the task that digests a file.
PIECE_CHARS = 1 << 18


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines sorted by file and number to pieces of consecutive lines of a file, joined by line feeds."""
    rows: list[tuple] = []
    now: list = []
    size = 0
    for batch in batches:
        for file, line, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if now and (now[0] != file or size >= PIECE_CHARS):
                rows.append((now[0], now[1], "\n".join(now[2])))
                now, size = [], 0
            if not now:
                now = [file, line, []]
            now[2].append(text or "")
            size += len(text or "")
        if len(rows) >= 16:
            yield _columns(rows, "file line text")
            rows = []
    if now:
        rows.append((now[0], now[1], "\n".join(now[2])))
    if rows:
        yield _columns(rows, "file line text")


def _columns(rows: list[tuple], names: str) -> pa.RecordBatch:
    kinds = {"file": pa.string(), "line": pa.int64(), "text": pa.string(), "digest": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for c, n in zip(zip(*rows), names.split())], names=names.split())


def _digest_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by file and first line to one SHA-256 a file: the hash runs along, and no file is held."""
    file, state = None, None
    for batch in batches:
        rows = []
        for name, _, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if state is None or name != file:
                if state is not None:
                    rows.append((file, state.hexdigest()))
                file, state = name, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(text.encode())
        if rows:
            yield _columns(rows, "file digest")
    if state is not None:
        yield _columns([(file, state.hexdigest())], "file digest")


def file_digests(lines: DataFrame, file: str = "file", line: str = "line_no", text: str = "text") -> DataFrame:
    """(file, digest): SHA-256 of each file's lines, in order, joined by line feeds. Lines are joined to pieces where they stand; a
    file's pieces then pass through one task, which holds the state of the hash and one piece."""
    slim = lines.select(F.col(file).cast("string").alias("file"), F.col(line).cast("long").alias("line"), F.col(text).alias("text"))
    pieces = map_arrow(slim.repartitionByRange("file", "line").sortWithinPartitions("file", "line"), _pieces, "file string, line long, text string")
    return map_arrow(pieces.repartition("file").sortWithinPartitions("file", "line"), _digest_pieces, "file string, digest string")


def inspect_files(lines: DataFrame, pins: DataFrame, sample: int = 3, file: str = "file", line: str = "line_no", text: str = "text") -> DataFrame:
    """What stands in each file, without loading it: lines, records, the first header, some headers, and whether its content is as pinned.

    ``pins`` holds (file, pin), a SHA-256 of the lines joined by line feeds; a file without a pin matches nothing. The first
    headers come from the least lines of each range of a file, so no file is gathered.
    """
    head = F.col(text).startswith(">")
    found = lines.groupBy(file).agg(F.count("*").alias("n_lines"), F.count_if(head).alias("n_records"))
    heads = lines.where(head).select(file, line, text).withColumn("__k", F.row_number().over(Window.partitionBy(file, F.floor(F.col(line) / RANGE_LINES)).orderBy(line))).where(F.col("__k") <= sample)
    first = heads.withColumn("__k", F.row_number().over(Window.partitionBy(file).orderBy(line))).where(F.col("__k") <= sample)
    shown = first.groupBy(file).agg(F.transform(F.array_sort(F.collect_list(F.struct(line, text))), lambda x: x[text]).alias("h")).select(file, F.get("h", F.lit(0)).alias("first_header"), F.array_join("h", "|").alias("sample"))
    digests = file_digests(lines, file, line, text).withColumnRenamed("file", "__f")
    whole = found.join(shown, file, "left").join(digests, F.col(file).cast("string") == F.col("__f")).drop("__f").join(pins, file, "left")
    return whole.select(file, "n_lines", "n_records", "first_header", F.coalesce("sample", F.lit("")).alias("sample"), "digest", F.coalesce(F.col("pin") == F.col("digest"), F.lit(False)).alias("pin_matches"))


def write_ranking(ranking: DataFrame, path: str, preamble: list[str], columns: list[str], order: str = "rank") -> None:
    """A ranking as CSV in rank order: comment lines, the header, then rows. File names give the order of the lines."""
    spark = ranking.sparkSession
    lead = spark.createDataFrame([(k - len(preamble) - 1, f"# {line}") for k, line in enumerate(preamble)] + [(-1, ",".join(columns))], "place long, value string")
    rows = ranking.select(F.col(order).cast("long").alias("place"), F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value"))
    lead.unionByName(rows).repartitionByRange("place").sortWithinPartitions("place").select("value").write.text(path)


def read_ranking(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The rows of a written ranking as strings; comments and the header are left out."""
    schema = ", ".join(f"{c} string" for c in columns)
    return spark.read.schema(schema).option("comment", "#").csv(path).where(F.col(columns[0]) != columns[0])
