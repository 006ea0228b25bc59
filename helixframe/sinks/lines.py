"""Single-file sinks of line formats.

Rows become one string per record by native expressions; tasks write compressed parts side by side into a folder beside the
target, and the commit joins them in partition order behind the header. Gzip members and BGZF blocks may be concatenated, so
no task waits for another. Only overwriting is supported. Compression follows the target's suffix.
"""

from __future__ import annotations

import gzip
import struct
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

BGZF_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def filesystem(path: str):
    """(file system, path in it) of a plain path or a URI."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def bgzf_block(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def compress(data: bytes, kind: str) -> bytes:
    if kind == "gzip":
        return gzip.compress(data, 6, mtime=0)
    if kind == "bgzf":
        return b"".join(bgzf_block(data[a : a + 65_280]) for a in range(0, len(data), 65_280))
    return data


def kind_of(path: str) -> str:
    low = path.lower()
    return "bgzf" if low.endswith((".bgz", ".bgzf", ".bam", ".vcf.gz")) else "gzip" if low.endswith(".gz") else "plain"


def joined(column, end: bytes) -> bytes:
    """The values of an Arrow column of strings or bytes, each followed by ``end``."""
    import pyarrow as pa

    if column.null_count:
        raise ValueError("a line is null")
    return end.join([*column.cast(pa.large_binary()).to_pylist(), b""])


@dataclass
class Part(WriterCommitMessage):
    partition: int
    path: str
    rows: int


class PartsWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("compression") or kind_of(options["path"])
        self.header = bytes.fromhex(options.get("header", ""))
        self.binary = options.get("binary") == "true"
        self.folder = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator) -> Part:
        from pyspark import TaskContext

        fs, folder = filesystem(self.folder)
        fs.create_dir(folder, recursive=True)
        ctx = TaskContext.get()
        name = f"{folder}/{ctx.partitionId():08d}-{ctx.taskAttemptId()}"
        rows, held, size = 0, [], 0
        with fs.open_output_stream(name, compression=None) as out:
            for batch in iterator:
                data = joined(batch.column(0), b"" if self.binary else b"\n")
                held.append(data)
                size += len(data)
                rows += batch.num_rows
                if size >= 1 << 20:
                    data, held, size = b"".join(held), [], 0
                    for a in range(0, len(data), 4 << 20):
                        out.write(compress(data[a : a + (4 << 20)], self.kind))
            if held:
                out.write(compress(b"".join(held), self.kind))
        return Part(ctx.partitionId(), name, rows)

    def commit(self, messages) -> None:
        fs, target = filesystem(self.path)
        with fs.open_output_stream(target, compression=None) as out:
            if self.header:
                out.write(compress(self.header, self.kind))
            for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
                with fs.open_input_stream(m.path, compression=None) as part:
                    while chunk := part.read(8 << 20):
                        out.write(chunk)
            if self.kind == "bgzf":
                out.write(BGZF_END)
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, folder = filesystem(self.folder)
        from pyarrow.fs import FileType

        if fs.get_file_info(folder).type == FileType.Directory:
            fs.delete_dir(folder)


class PartsSink(DataSource):
    """Rows of one string or binary column to one file."""

    @classmethod
    def name(cls) -> str:
        return "helixframe_parts"

    def schema(self) -> str:
        return "value binary" if self.options.get("binary") == "true" else "value string"

    def writer(self, schema, overwrite: bool) -> PartsWriter:
        if not overwrite:
            raise ValueError("this sink only overwrites")
        return PartsWriter(dict(self.options))


def write_parts(rows: DataFrame, path: str, header: str | bytes = "", compression: str | None = None, binary: bool = False) -> None:
    """Write the single column of ``rows`` to ``path``."""
    from helixframe.session import ship

    spark = rows.sparkSession
    ship(spark)
    spark.dataSource.register(PartsSink)
    head = header.encode() if isinstance(header, str) else header
    w = rows.write.format("helixframe_parts").mode("overwrite").option("path", path).option("header", head.hex())
    if binary:
        w = w.option("binary", "true")
    if compression:
        w = w.option("compression", compression)
    w.save()


def general(x: Column) -> Column:
    """A float with six significant digits, like C's %g; NaN and null are '.'."""
    x = x.cast("double")
    text = F.format_string("%.6g", x)
    fixed = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
    return F.when(x.isNull() | F.isnan(x), ".").when(x == 0, "0").otherwise(fixed)


def write_fasta(df: DataFrame, path: str, width: int = 0) -> None:
    body = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n") if width else F.col("sequence")
    head = F.concat(F.lit(">"), F.col("name"), F.when(F.col("description").isNotNull(), F.concat(F.lit(" "), F.col("description"))).otherwise(""))
    write_parts(df.select(F.concat(head, F.lit("\n"), body).alias("value")), path)


def write_fastq(df: DataFrame, path: str) -> None:
    head = F.concat(F.lit("@"), F.col("name"), F.when(F.col("description").isNotNull(), F.concat(F.lit(" "), F.col("description"))).otherwise(""))
    write_parts(df.select(F.concat_ws("\n", head, F.col("sequence"), F.lit("+"), F.col("quality_scores")).alias("value")), path)


def vcf_lines(df: DataFrame, info: dict, formats: dict, samples: list[str], zero_based: bool = True, float_format: str = "compat") -> DataFrame:
    """One VCF line per row. ``info`` and ``formats``: {name: {number, type, description}} of the columns to write."""
    from helixframe.sources.text import free_name

    dot = lambda c: F.when(c.isNull() | (c == ""), ".").otherwise(c)

    def text(c: Column, spec: dict, many: bool) -> Column:
        one = (lambda x: general(x)) if spec["type"] == "Float" else (lambda x: F.coalesce(x.cast("string"), F.lit(".")))
        return F.array_join(F.transform(c, one), ",") if many else one(c)

    parts = []
    for n, spec in info.items():
        if n not in df.columns:
            continue
        c = F.col(f"`{n}`")
        if spec["type"] == "Flag":
            parts.append(F.when(c, n))
        else:
            parts.append(F.when(c.isNotNull(), F.concat(F.lit(f"{n}="), text(c, spec, spec["number"] not in ("0", "1")))))
    joined = F.concat_ws(";", *parts) if parts else F.lit("")
    qual = F.when(F.col("qual").isNull(), ".").otherwise(F.format_string("%.2f", "qual") if float_format == "compat" else general(F.col("qual")))
    pos = F.col("start") + 1 if zero_based else F.col("start")
    columns = [F.col("chrom"), pos.cast("string"), dot(F.col("id")), F.col("ref"), F.replace(dot(F.col("alt")), F.lit("|"), F.lit(",")), qual, dot(F.col("filter")), dot(joined)]
    if formats and samples:
        columns.append(F.lit(":".join(formats)))
        for i, _ in enumerate(samples):
            values = []
            for n, spec in formats.items():
                many = spec["number"] not in ("0", "1")
                c = F.get(F.col("genotypes").getField(n), i) if len(samples) > 1 or "genotypes" in df.columns else F.col(f"`{free_name(n, [x for x in df.columns if x != n])}`")
                values.append(F.when(c.isNull(), "./." if n == "GT" else ".").otherwise(text(c, spec, many) if n != "GT" else c))
            columns.append(F.concat_ws(":", *values))
    return df.select(F.concat_ws("\t", *columns).alias("value"))


def vcf_header_text(info: dict, formats: dict, samples: list[str], contigs: dict | None = None) -> str:
    out = ["##fileformat=VCFv4.3"]
    out += [f"##contig=<ID={c}" + (f",length={n}" if n else "") + ">" for c, n in (contigs or {}).items()]
    out += [f'##INFO=<ID={n},Number={s["number"]},Type={s["type"]},Description="{s["description"]}">' for n, s in info.items()]
    out += [f'##FORMAT=<ID={n},Number={s["number"]},Type={s["type"]},Description="{s["description"]}">' for n, s in formats.items()]
    out.append("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if formats and samples else [])]))
    return "\n".join(out) + "\n"


def write_vcf(df: DataFrame, path: str, info: dict | None = None, formats: dict | None = None, samples: list[str] | None = None, contigs: dict | None = None, zero_based: bool = True, float_format: str = "compat") -> None:
    """VCF text; field descriptions come from column metadata unless given. ``float_format='g'`` keeps QUAL's digits."""
    if path.lower().endswith(".bcf"):
        raise ValueError("BCF is not written")
    meta = {f.name: f.metadata or {} for f in df.schema}
    spec = lambda m: {k: m[f"bio.{k}"] for k in ("number", "type", "description")}
    info = info if info is not None else {n: spec(m) for n, m in meta.items() if m.get("bio.field_type") == "INFO"}
    formats = formats if formats is not None else {m["bio.source"]: spec(m) for m in meta.values() if m.get("bio.field_type") == "FORMAT"}
    samples = samples if samples is not None else meta.get("genotypes", {}).get("bio.samples", ["sample"] if formats else [])
    write_parts(vcf_lines(df, info, formats, samples, zero_based, float_format), path, vcf_header_text(info, formats, samples, contigs))


def sam_lines(df: DataFrame, tags: dict[str, str] | None = None, zero_based: bool = True) -> DataFrame:
    star = lambda c: F.when(c.isNull() | (c == ""), "*").otherwise(c)
    pos = lambda c: F.coalesce(c + 1 if zero_based else c, F.lit(0)).cast("string")
    flags = F.when(F.col("flags") > 65535, F.raise_error(F.lit("flags over 65535")).cast("bigint")).otherwise(F.col("flags"))
    columns = [star(F.col("name")), flags.cast("string"), star(F.col("chrom")), pos(F.col("start")), F.coalesce("mapping_quality", F.lit(255)).cast("string"), star(F.col("cigar")), star(F.col("mate_chrom")), pos(F.col("mate_start")), F.coalesce("template_length", F.lit(0)).cast("string"), star(F.col("sequence")), star(F.col("quality_scores"))]
    for t, kind in (tags or {}).items():
        c = F.col(f"`{t}`")
        value = F.concat(F.lit(f"B:{kind[2:]},"), F.array_join(F.transform(c, lambda x: x.cast("string")), ",")) if kind.startswith("B:") else F.concat(F.lit(f"{kind if kind in 'AifZH' else 'i'}:"), c.cast("string"))
        columns.append(F.when(c.isNotNull(), F.concat(F.lit(f"{t}:"), value)))
    return df.select(F.concat_ws("\t", *columns).alias("value"))


def sam_header(references: dict[str, int], order: str = "unsorted", extra: list[str] | None = None) -> str:
    return "\n".join([f"@HD\tVN:1.6\tSO:{order}", *[f"@SQ\tSN:{n}\tLN:{k}" for n, k in references.items()], *(extra or [])]) + "\n"


def write_sam(df: DataFrame, path: str, references: dict[str, int], tags: dict[str, str] | None = None, zero_based: bool = True, sort: bool = False) -> None:
    """SAM text; ``sort``: by (chrom, start) as strings and numbers, nulls last."""
    if sort:
        df = df.orderBy(F.col("chrom").asc_nulls_last(), F.col("start").asc_nulls_last())
    write_parts(sam_lines(df, tags, zero_based), path, sam_header(references, "coordinate" if sort else "unsorted"))
