"""Text captures: lines, packets, address headers, folder classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from burstlens.functions import capture_text as ct
from burstlens.functions import labels
from burstlens.operators.scan import TARGET_ROWS, assign_slices, drop_slices, plan_slices, scan

LINE_ORDER = ("block", "row")
# A part file as Spark names it: the number of its task, and of the file where a task writes several.
PART = r"/part-(\d+)-[^/]*?c(\d+)\.[^/]*$"


def local_path(uri: Column) -> Column:
    return F.regexp_replace(uri, r"^file:/+", "/")


def read_lines(
    spark: SparkSession,
    path: str | Sequence[str],
    *,
    glob: str | Sequence[str] = "capture*.txt",
    recursive: bool = False,
    parts: bool = False,
) -> DataFrame:
    """Lines of all matching files: source_file, block, row, value.

    (block, row) orders the lines of a file although Spark reads a large file
    in several splits.  Several globs are read as one union.  With ``parts`` the
    part files of a folder are one capture (``join_parts``).
    """
    globs = [glob] if isinstance(glob, str) else list(glob)
    pattern = globs[0] if len(globs) == 1 else "{" + ",".join(globs) + "}"
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    text = reader.text(path if isinstance(path, str) else list(path))
    if not text.inputFiles():
        raise FileNotFoundError(f"no files matched pattern {pattern!r} in {path}")
    lines = text.select(
        local_path(F.col("_metadata.file_path")).alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.make_valid_utf8("value").alias("value"),
    )
    return join_parts(lines) if parts else lines


def join_parts(rows: DataFrame, *, file: str = "source_file", block: str = "block") -> DataFrame:
    """The part files of one folder as one capture, named ``<folder>/part``.

    A large capture is written as consecutive part files; its header stands in the first one, and its flows go on over all. ``block`` is made
    to grow with the part number (up to 2^19 parts of 2^44 bytes, or 2^10 files of 2^34 bytes a part). Other files stay as they are.
    """
    number = lambda i, bits: F.shiftleft(F.regexp_extract(file, PART, i).try_cast("long"), bits)
    before = F.coalesce(number(1, 44) + number(2, 34), F.lit(0).cast("long"))
    return rows.withColumns({file: F.regexp_replace(file, PART, "/part"), block: before + F.col(block)})


def newest_file(spark: SparkSession, path: str, globs: Sequence[str]) -> DataFrame:
    """The matching file with the latest modification time (one row)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "{" + ",".join(globs) + "}")
    listed = files.load(path).select("path", "modificationTime")
    return listed.agg(
        local_path(F.max_by("path", F.struct("modificationTime", "path"))).alias("file_path")
    )


def pair_lines(
    lines: DataFrame,
    *,
    file: str = "source_file",
    order: Sequence[str] = LINE_ORDER,
    value: str = "value",
    strict: bool = False,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Clock lines that open a packet, with the line after them as ``address``.

    A clock line takes the next line whatever it is.  So in a run of clock
    lines the 1st, 3rd, ... open packets and the others are address lines.
    ``strict`` lets every clock line open a packet and takes only other lines
    as addresses.

    Lines ordered by (block, row) are paired block by block; any other order
    is paired per file by sliced scans.
    """
    tagged = lines.withColumn("_clock", ct.is_clock_line(F.col(value)))
    by = list(order)
    if by[0] == "block":
        paired = _pair_in_blocks(tagged, file, by, value)
    else:
        slicing = plan_slices(lines, [file], by[0], target_rows=target_rows)
        paired = _pair_in_order(assign_slices(tagged, [file], by[0], slicing), file, by, value)
    if strict:
        address = F.when(~ct.is_clock_line(F.col("address")), F.col("address"))
        paired = paired.where("_clock").withColumn("address", address)
    else:
        paired = paired.where(F.col("_clock") & (F.col("_in_run") % 2 == 1))
    return paired.drop("_clock", "_in_run")


def _pair_in_order(tagged: DataFrame, file: str, by: list[str], value: str) -> DataFrame:
    """Next line and place in the run of clock lines, by ordered scans."""
    counted = scan(
        tagged, [file], by, lead={"address": F.col(value)}, running={"_n": F.lit(1).cast("long")}
    )
    runs = scan(counted, [file], by, carry={"_other": F.when(~F.col("_clock"), F.col("_n"))})
    in_run = F.col("_n") - F.coalesce("_other", F.lit(0))
    return drop_slices(runs.withColumn("_in_run", in_run)).drop("_n", "_other")


def _pair_in_blocks(tagged: DataFrame, file: str, by: list[str], value: str) -> DataFrame:
    """The same with one window per file block, the unit Spark reads.

    A block is bounded by spark.sql.files.maxPartitionBytes, so a file of any
    size spreads over many tasks.  Each block hands its first line, its number
    of lines and its last other line to the blocks around it; both uses of the
    lines share one exchange.
    """
    block, *rows = by
    part = [file, block]
    inside = Window.partitionBy(*part).orderBy(*rows)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = tagged.withColumns({
        "_next": F.lead(value).over(inside),
        "_end": F.lead(F.lit(True)).over(inside).isNull(),
        "_n": F.row_number().over(inside),
    })
    seen = seen.withColumn("_other", F.max(F.when(~F.col("_clock"), F.col("_n"))).over(upto))
    edges = seen.groupBy(*part).agg(
        F.max("_n").cast("long").alias("_rows"), F.max("_other").alias("_tail"), F.min_by(value, "_n").alias("_head")
    )
    blocks = Window.partitionBy(file).orderBy(block)
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(
        *part, "_tail", F.lead("_head").over(blocks).alias("_after"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"),
    )
    last_other = F.last(F.col("_base") + F.col("_tail"), ignorenulls=True).over(before)
    edges = edges.withColumn("_open", F.col("_base") - F.coalesce(last_other, F.lit(0))).drop("_tail", "_base")
    joined = seen.join(edges, part, "left")
    run = F.when(F.col("_other").isNotNull(), F.col("_n") - F.col("_other")).otherwise(F.col("_n") + F.col("_open"))
    out = joined.withColumns({
        "address": F.when(F.col("_end"), F.col("_after")).otherwise(F.col("_next")), "_in_run": run,
    })
    return out.drop("_next", "_end", "_n", "_other", "_after", "_open")


def parse_packets(
    lines: DataFrame,
    *,
    file: str = "source_file",
    order: Sequence[str] = LINE_ORDER,
    split_rule: str = "v2",
    strict: bool = False,
    ipv6_compat: bool = False,
    protocol_by_number: bool = False,
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """One row per packet: file, order columns, ts, protocol, ends, length, raw."""
    paired = pair_lines(lines, file=file, order=order, strict=strict, target_rows=target_rows)
    return parse_pairs(
        paired, file=file, order=order, split_rule=split_rule, ipv6_compat=ipv6_compat, protocol_by_number=protocol_by_number)


def parse_pairs(
    paired: DataFrame,
    *,
    file: str = "source_file",
    order: Sequence[str] = LINE_ORDER,
    split_rule: str = "v2",
    ipv6_compat: bool = False,
    protocol_by_number: bool = False,
) -> DataFrame:
    """``parse_packets`` of lines that are paired already (value, address)."""
    ended = ct.address_ends(paired, "address", rule=split_rule, ipv6_compat=ipv6_compat)
    line, address = F.col("value"), F.col("address")
    measured = ended.withColumns({"_la": ct.line_length(address), "_lc": ct.line_length(line)})
    return measured.select(
        file,
        *order,
        ct.clock_seconds(line).alias("ts"),
        ct.protocol(line, by_number=protocol_by_number).alias("protocol"),
        "src_ip", "src_port", "dst_ip", "dst_port",
        # The length of the address line, else of the clock line.
        F.coalesce("_la", "_lc").alias("length"),
        F.when(F.col("_la").isNotNull(), "address").when(F.col("_lc").isNotNull(), "clock").alias("length_source"),
        F.struct(line.alias("line1"), address.alias("line2")).alias("raw"),
    )


def with_event_time(packets: DataFrame, *, file: str = "source_file", ts: str = "ts") -> DataFrame:
    """Add ``event_time`` from the date in a file name like capture_20251217_001115."""
    day = F.to_timestamp(F.regexp_extract(file, r"_(\d{8})_\d{6}", 1), "yyyyMMdd")
    micros = F.unix_micros(day) + F.round(F.col(ts) * 1_000_000).cast("long")
    return packets.withColumn("event_time", F.timestamp_micros(micros))


def read_headers(
    lines: DataFrame, *, file: str = "source_file", order: Sequence[str] = LINE_ORDER
) -> DataFrame:
    """Address map of each file: file, ip, name.

    Only the leading ``LLM_IP name ip`` lines count (blank lines may stand
    between them); trailing dots are cut from the ip and the last line of an
    ip wins.  Both steps combine before their shuffle.
    """
    text = ct.strip(F.col("value"))
    at = F.struct(*order)
    is_header = text.rlike(ct.HEADER)
    marked = lines.select(
        file, at.alias("_at"), text.alias("_t"), is_header.alias("_h"), ((text != "") & ~is_header).alias("_stop")
    )
    ends = marked.groupBy(file).agg(F.min(F.when(F.col("_stop"), F.col("_at"))).alias("_end"))
    heads = marked.where("_h").join(ends, file)
    heads = heads.where(F.col("_end").isNull() | (F.col("_at") < F.col("_end")))
    ip = F.regexp_replace(F.regexp_extract("_t", ct.HEADER, 2), r"\.+$", "")
    named = heads.select(file, "_at", ip.alias("ip"), F.regexp_extract("_t", ct.HEADER, 1).alias("name"))
    return named.groupBy(file, "ip").agg(F.max_by("name", "_at").alias("name"))


def header_map(heads: DataFrame, *, file: str = "source_file", order: Sequence[str] = LINE_ORDER) -> DataFrame:
    """``read_headers`` of lines that are known to be leading header lines: only these are grouped."""
    text = ct.strip(F.col("value"))
    ip = F.regexp_replace(F.regexp_extract(text, ct.HEADER, 2), r"\.+$", "")
    named = heads.select(file, F.struct(*order).alias("_at"), ip.alias("ip"), F.regexp_extract(text, ct.HEADER, 1).alias("name"))
    return named.groupBy(file, "ip").agg(F.max_by("name", "_at").alias("name"))


def with_folder_class(
    df: DataFrame, *, file: str = "source_file", table: Mapping[str, str] = labels.FOLDER_CLASS
) -> DataFrame:
    """Class by the name of the parent folder; rows of other folders are dropped."""
    folder = F.regexp_extract(file, r"([^/]+)/[^/]+$", 1)
    return df.withColumn("traffic_class", labels.folder_class(folder, table)).where(
        F.col("traffic_class").isNotNull()
    )


def with_path_class(df: DataFrame, root: str, *, file: str = "source_file") -> DataFrame:
    """Class by the rule 'a path part below root begins with all'."""
    relative = F.substr(F.col(file), F.lit(len(root.rstrip("/")) + 2))
    return df.withColumn("traffic_class", labels.path_class(relative))


def file_ranks(files: DataFrame, *, file: str = "source_file") -> DataFrame:
    """Rank 1..n of the distinct files in sorted path order.

    Ranked inside each folder and shifted by the files of earlier folders, so
    that only the list of folders is ordered as a whole.
    """
    split = files.select(file).distinct().select(
        file,
        F.regexp_replace(file, r"/?[^/]*$", "").alias("_dir"),
        F.regexp_extract(file, r"([^/]*)$", 1).alias("_name"),
    )
    dirs = split.groupBy("_dir").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(F.split("_dir", "/")).rowsBetween(Window.unboundedPreceding, -1)
    dirs = dirs.select("_dir", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy("_dir").orderBy("_name"))
    ranked = split.withColumn("_r", inside).join(dirs, "_dir")
    return ranked.select(file, (F.col("_r") + F.col("_off")).cast("long").alias("file_rank"))
