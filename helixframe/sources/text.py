"""Line formats as Spark text scans: every column is an expression over the line, so Catalyst prunes what a query does
not use, filters run in generated code right above the scan, files split, and gzip with several members is read whole.

Coordinates: ``zero_based`` tables have 0-based half-open starts, others 1-based; the end is the same number in both. The
flag, the Arrow type of widened columns and header facts are in column metadata under ``bio.*`` keys.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ZERO_BASED = "bio.coordinate_system_zero_based"


def lines(spark: SparkSession, path: str | list[str], comment: str | None = "#") -> DataFrame:
    """The lines of files. One BGZF file is read by ranges of its blocks, which other gzip does not allow."""
    df = _bgzf_lines(spark, path) if isinstance(path, str) and path.endswith((".gz", ".bgz")) else None
    df = (spark.read.text(path) if df is None else df).where(F.trim("value") != "")
    return df.where(~F.startswith("value", F.lit(comment))) if comment else df


def _bgzf_lines(spark: SparkSession, path: str) -> DataFrame | None:
    from . import bgzf
    from .binary import register

    try:
        if bgzf.compression(path) != "bgzf":
            return None
        size = bgzf.size_of(path)
    except (OSError, ValueError):  # a pattern, or a store that only Spark opens
        return None
    register(spark)
    step = min(max(size // (2 * spark.sparkContext.defaultParallelism), 1 << 18), 32 << 20)
    return spark.read.format("bgzf_lines").option("splitBytes", step).load(path)


def indexed_lines(spark: SparkSession, path: str, regions: list[str], partitions: int = 16, kind: str = "vcf", columns: str = "0,1,2") -> DataFrame:
    """The lines of an indexed BGZF file that overlap regions; [] gives none."""
    from .binary import register

    if not regions:
        return lines(spark, path).limit(0)
    register(spark)
    reader = spark.read.format("indexed_lines").option("regions", ";".join(regions)).option("partitions", partitions)
    return reader.option("kind", kind).option("intervalColumns", columns).load(path)


def header_lines(spark: SparkSession, path: str, prefix: str = "#", last: str | None = None) -> list[str]:
    """The lines at the top that begin with ``prefix``, up to one that begins with ``last``; read on the driver alone."""
    n = 256
    while True:
        top = [r[0] for r in spark.read.text(path).take(n)]
        head = []
        for x in top:
            if not x.startswith(prefix):
                return head
            head.append(x)
            if last and x.startswith(last):
                return head
        if len(top) < n:
            return head
        n *= 8


def _start(pos: Column, zero_based: bool) -> Column:
    pos = pos.cast("bigint")
    return pos - 1 if zero_based else pos


def _as(col: Column, name: str, **meta) -> Column:
    return col.alias(name, metadata={f"bio.{k}": v for k, v in meta.items()}) if meta else col.alias(name)


def _uint(col: Column, name: str, zero_based: bool | None = None) -> Column:
    meta = {"bio.arrow_type": "uint32"} | ({ZERO_BASED: zero_based} if zero_based is not None else {})
    return col.cast("bigint").alias(name, metadata=meta)


def _dot(x: Column) -> Column:
    return F.when(~x.isin(".", ""), x)


# --- BED -----------------------------------------------------------------------------------------------------------


def read_bed(spark: SparkSession, path, columns: int = 4, zero_based: bool = True) -> DataFrame:
    """BED3 to BED6: chrom, start, end, name, score, strand; absent columns are null. Starts in the file are 0-based."""
    if not 3 <= columns <= 6:
        raise ValueError("BED of 3 to 6 columns")
    df = lines(spark, path).where(~F.col("value").rlike("^(track|browser)([ \t]|$)"))
    f = F.split("value", "\t")
    start = F.get(f, 1).cast("bigint")
    named = [F.get(f, 0).alias("chrom"), _uint(start if zero_based else start + 1, "start", zero_based), _uint(F.get(f, 2), "end")]
    extra = [_dot(F.get(f, 3)).alias("name"), _dot(F.get(f, 4)).cast("double").alias("score"), _dot(F.get(f, 5)).alias("strand")]
    return df.select(*named, *extra[: max(columns - 3, 0)])


# --- GFF and GTF ---------------------------------------------------------------------------------------------------

#: The escapes that attribute values use, and what they stand for.
ESCAPES = (("%3B", ";"), ("%3D", "="), ("%26", "&"), ("%2C", ","), ("%09", "\t"))


def _gff_attributes(text: Column) -> Column:
    def one(p):
        at = F.instr(p, "=")
        raw = F.substr(p, at + 1, F.length(p))
        plain = raw
        for a, b in ESCAPES:
            plain = F.replace(plain, F.lit(a), F.lit(b))
        value = F.when((F.length(raw) >= 2) & F.startswith(raw, F.lit('"')) & F.endswith(raw, F.lit('"')), F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(plain)
        return F.struct(F.substr(p, F.lit(1), at - 1).alias("tag"), value.alias("value"))

    parts = F.filter(F.split(text, ";"), lambda p: F.instr(p, "=") > 0)
    return F.when(text.isin("", ".") | text.isNull(), F.array().cast("array<struct<tag:string,value:string>>")).otherwise(F.transform(parts, one))


def _gtf_attributes(text: Column) -> Column:
    def one(p):
        at = F.instr(p, " ")
        raw = F.trim(F.substr(p, at + 1, F.length(p)))
        value = F.when((F.length(raw) >= 2) & F.startswith(raw, F.lit('"')) & F.endswith(raw, F.lit('"')), F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
        return F.struct(F.substr(p, F.lit(1), at - 1).alias("tag"), value.alias("value"))

    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.trim(p)), lambda p: F.instr(p, " ") > 0)
    return F.transform(parts, one)


def _features(df: DataFrame, attributes: Column, attr_fields: list[str] | None, zero_based: bool, join: bool) -> DataFrame:
    f = F.split("value", "\t")
    core = [
        F.get(f, 0).alias("chrom"),
        _uint(_start(F.get(f, 3), zero_based), "start", zero_based),
        _uint(F.get(f, 4), "end"),
        F.get(f, 2).alias("type"),
        F.get(f, 1).alias("source"),
        F.get(f, 5).try_cast("float").alias("score"),
        F.get(f, 6).alias("strand"),
        F.get(f, 7).try_cast("bigint").alias("phase", metadata={"bio.arrow_type": "uint32"}),
    ]
    if attr_fields is None:
        return df.select(*core, attributes.alias("attributes"))

    def flat(tag: str) -> Column:
        values = F.transform(F.filter(attributes, lambda x: x["tag"] == tag), lambda x: x["value"])
        return F.when(F.size(values) > 0, F.array_join(values, ",") if join else F.get(values, 0)).alias(tag)

    return df.select(*core, *[attributes.alias("attributes") if a == "attributes" else flat(a) for a in attr_fields])


def read_gff(spark: SparkSession, path, attr_fields: list[str] | None = None, zero_based: bool = True) -> DataFrame:
    """GFF3. ``attr_fields``: None gives ``attributes`` as ordered (tag, value) pairs; a list gives one string column each, the
    name ``attributes`` in it adds the pairs as well. Predicates hold in the table's own coordinates.
    """
    df = lines(spark, path)
    return _features(df, _gff_attributes(F.get(F.split("value", "\t"), 8)), attr_fields, zero_based, join=False)


def read_gtf(spark: SparkSession, path, attr_fields: list[str] | None = None, zero_based: bool = True) -> DataFrame:
    """GTF, like read_gff; repeated keys are joined by commas. Lines of fewer than nine fields are an error."""
    df = lines(spark, path)
    n = F.size(F.split("value", "\t"))
    nine = F.when(n >= 9, F.get(F.split("value", "\t"), 8)).otherwise(F.raise_error(F.concat(F.lit("GTF line of "), n.cast("string"), F.lit(" fields, not 9"))).cast("string"))
    return _features(df, _gtf_attributes(nine), attr_fields, zero_based, join=True)


# --- Pairs ---------------------------------------------------------------------------------------------------------

_PAIRS = ("readID", "chr1", "pos1", "chr2", "pos2", "strand1", "strand2")


def read_pairs(spark: SparkSession, path: str, zero_based: bool = False) -> DataFrame:
    """Hi-C contacts; the ``#columns:`` header names the columns, without it the seven standard ones."""
    names = list(_PAIRS)
    for h in header_lines(spark, path):
        if h.startswith("#columns:"):
            names = h[len("#columns:") :].split()
    f = F.split("value", "[\t ]+")
    out = []
    for k, n in enumerate(names):
        v = F.get(f, k)
        if n in ("pos1", "pos2"):
            v = _uint(v.cast("bigint") - 1 if zero_based else v, n, zero_based)
        elif n in ("frag1", "frag2", "mapq1", "mapq2"):
            v = _uint(_dot(v), n)
        else:
            v = v.alias(n)
        out.append(v)
    return lines(spark, path).select(*out)


# --- VCF -----------------------------------------------------------------------------------------------------------

_TYPES = {"Integer": "int", "Float": "float", "String": "string", "Character": "string", "Flag": "boolean"}
_CORE = ("chrom", "start", "end", "id", "ref", "alt", "qual", "filter")


def vcf_header(spark: SparkSession, path: str) -> dict:
    return parse_vcf_header(header_lines(spark, path, last="#CHROM"))


def parse_vcf_header(lines: list[str]) -> dict:
    """INFO, FORMAT, filters, contigs and samples of a header, in its order."""
    out: dict = {"info": {}, "format": {}, "contigs": {}, "filters": [], "samples": [], "lines": []}
    for h in lines:
        out["lines"].append(h)
        m = re.match(r"##(INFO|FORMAT|FILTER|contig)=<(.*)>\s*$", h)
        if m:
            pairs = {k: v.strip('"') for k, v in re.findall(r'(\w+)=("(?:[^"\\]|\\.)*"|[^,]*)', m[2])}
            if m[1] == "contig":
                out["contigs"][pairs.get("ID")] = int(pairs["length"]) if pairs.get("length", "").isdigit() else None
            elif m[1] == "FILTER":
                out["filters"].append(pairs.get("ID"))
            else:
                out[m[1].lower()][pairs["ID"]] = {"number": pairs.get("Number", "."), "type": pairs.get("Type", "String"), "description": pairs.get("Description", "")}
        elif h.startswith("#CHROM"):
            out["samples"] = h.split("\t")[9:]
    return out


def _let(x: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it stands in ``body``."""
    return F.get(F.transform(F.array(x), body), 0)


def _typed(raw: Column, spec: dict) -> Column:
    kind = _TYPES.get(spec["type"], "string")
    if spec["number"] in ("1", "0"):
        return _let(raw, lambda x: _dot(x).cast(kind))
    return _let(raw, lambda raw: F.when(~raw.isin(".", ""), F.transform(F.split(raw, ","), lambda x: _dot(x).cast(kind))))


def _info(text: Column, name: str, spec: dict) -> Column:
    hit = F.get(F.filter(F.split(text, ";"), lambda p: (p == name) | F.startswith(p, F.lit(f"{name}="))), 0)
    value = lambda hit: F.when(F.instr(hit, "=") > 0, F.substr(hit, F.lit(len(name) + 2), F.length(hit)))
    if spec["type"] == "Flag":
        return _let(hit, lambda hit: F.when(value(hit).isNotNull(), F.raise_error(F.lit(f"INFO flag {name} has a value")).cast("boolean")).otherwise(hit.isNotNull()))
    return _typed(_let(hit, value), spec)


def select_samples(available: list[str], wanted: list[str] | None, missing: str = "error") -> list[str]:
    """Samples in the order asked for, once each; unknown ones are an error or left out."""
    if wanted is None:
        return list(available)
    out = []
    for s in dict.fromkeys(wanted):
        n = available.count(s)
        if n > 1:
            raise ValueError(f"sample name is not unique: {s}")
        if n:
            out.append(s)
        elif missing == "error":
            raise ValueError(f"no such sample: {s}")
    return out


def read_vcf(spark: SparkSession, path: str, info_fields: list[str] | None = None, format_fields: list[str] | None = None, samples: list[str] | None = None, missing_samples: str = "error", zero_based: bool = True, regions: list[str] | None = None, partitions: int = 16) -> DataFrame:
    """VCF text. None means all fields, an empty list none.

    ``regions`` (chrom:start-end, 1-based closed): an indexed BGZF file is read by its index, chunk by chunk.

    Files with one sample have FORMAT fields as columns, with more a ``genotypes`` struct of lists, one element per selected
    sample; which of both depends on the file, not on the selection.
    """
    head = vcf_header(spark, path)
    f = F.col("f")  # the fields of a line, split once for all columns
    pos, ref, alt, info = F.get(f, 1), F.get(f, 3), F.get(f, 4), F.get(f, 7)
    snv = ref.rlike("^[ACGT]$") & alt.rlike("^[ACGT]$")
    ends = F.get(F.filter(F.split(info, ";"), lambda p: F.startswith(p, F.lit("END="))), 0)
    end = F.when(snv, pos.cast("bigint")).when(ends.isNotNull(), F.substr(ends, F.lit(5), F.length(ends)).cast("bigint")).otherwise(pos.cast("bigint") + F.length(ref) - 1)
    empty = lambda x: F.when(x == ".", "").otherwise(x)
    out = [
        F.get(f, 0).alias("chrom"),
        _uint(_start(pos, zero_based), "start", zero_based),
        _uint(end, "end"),
        empty(F.get(f, 2)).alias("id"),
        ref.alias("ref"),
        F.replace(empty(alt), F.lit(","), F.lit("|")).alias("alt"),
        _dot(F.get(f, 5)).cast("float").cast("double").alias("qual"),
        empty(F.get(f, 6)).alias("filter"),
    ]
    taken = list(_CORE)
    for n in head["info"] if info_fields is None else info_fields:
        if n not in head["info"]:
            raise ValueError(f"no such INFO field: {n}")
        spec = head["info"][n]
        out.append(_as(_info(info, n, spec), n, field_type="INFO", **spec))
        taken.append(n)
    formats = list(head["format"]) if format_fields is None else list(format_fields)
    if unknown := [n for n in formats if n not in head["format"]]:
        raise ValueError(f"no such FORMAT field: {unknown[0]}")
    chosen = select_samples(head["samples"], samples, missing_samples)
    if formats and head["samples"]:
        place = lambda n: F.array_position(F.split(F.get(f, 8), ":"), n).cast("int")

        def value(sample: Column, n: str, at: Column) -> Column:
            raw = F.when(at > 0, F.get(F.split(sample, ":"), at - 1))
            return raw if n == "GT" else _typed(raw, head["format"][n])

        if len(head["samples"]) == 1:
            for n in formats:
                name = free_name(n, taken)
                taken.append(name)
                out.append(_as(_let(place(n), lambda at: value(F.get(f, 9), n, at)), name, field_type="FORMAT", source=n, **head["format"][n]))  # noqa: B023
        else:
            columns = F.array(*[F.get(f, 9 + head["samples"].index(s)) for s in chosen])
            each = lambda n: _let(place(n), lambda at: F.transform(columns, lambda s: value(s, n, at))).alias(n)
            struct = F.struct(*[each(n) for n in formats])
            out.append(struct.alias("genotypes", metadata={"bio.samples": chosen}))
    rows = lines(spark, path) if regions is None else indexed_lines(spark, path, regions, partitions)
    return rows.select(F.split("value", "\t").alias("f")).select(*out)


def free_name(name: str, taken: list[str]) -> str:
    """A FORMAT column's name beside INFO and core columns."""
    for n in (name, f"fmt_{name}", f"format_{name}"):
        if n not in taken:
            return n
    k = 2
    while f"format_{name}_{k}" in taken:
        k += 1
    return f"format_{name}_{k}"


def describe_vcf(spark: SparkSession, path: str) -> DataFrame:
    """name, field_type, data_type, description of every INFO and FORMAT field."""
    head = vcf_header(spark, path)
    rows = []
    for kind in ("info", "format"):
        for n, s in head[kind].items():
            t = _TYPES.get(s["type"], "string")
            rows.append((n, kind.upper(), t if s["number"] in ("0", "1") else f"array<{t}>", s["description"]))
    return spark.createDataFrame(rows, "name string, field_type string, data_type string, description string")


# --- SAM -----------------------------------------------------------------------------------------------------------

#: Spark types of SAM tag type letters and of B subtypes.
TAG_TYPES = {"A": "string", "i": "int", "f": "float", "Z": "string", "H": "string", "c": "tinyint", "C": "smallint", "s": "smallint", "S": "int", "I": "bigint"}


def tag_type(letter: str) -> str:
    """Spark type of ``i``, ``Z``, ... or ``B:subtype``."""
    return f"array<{TAG_TYPES[letter[2:]]}>" if letter.startswith("B:") else TAG_TYPES[letter]


def infer_tags(spark: SparkSession, path: str, rows: int = 100) -> dict[str, str]:
    """Tags of the first records, with their type letters, sorted by tag."""
    found: dict[str, str] = {}
    for r in lines(spark, path, comment=None).where(~F.col("value").rlike("^@[A-Z][A-Z]\t")).limit(rows).collect():
        for t in r[0].split("\t")[11:]:
            tag, kind, value = t.split(":", 2)
            found.setdefault(tag, f"B:{value[0]}" if kind == "B" else kind)
    return dict(sorted(found.items()))


def _sam_tag(f: Column, tag: str, kind: str) -> Column:
    hit = F.get(F.filter(F.slice(f, 12, F.greatest(F.size(f) - 11, F.lit(0))), lambda p: F.startswith(p, F.lit(f"{tag}:"))), 0)
    raw = F.substr(hit, F.lit(6), F.length(hit))
    if kind.startswith("B:"):
        return _as(F.transform(F.slice(F.split(raw, ","), 2, 1 << 30), lambda x: x.cast(TAG_TYPES[kind[2:]])), tag, tag_type=kind)
    return _as(raw.cast(TAG_TYPES[kind]), tag, tag_type=kind)


def read_sam(spark: SparkSession, path: str, tags: dict[str, str] | list[str] | None = None, zero_based: bool = True) -> DataFrame:
    """SAM text: the twelve core columns and tags. ``tags``: names, or names with type letters; types not given are inferred."""
    f = F.split("value", "\t")
    star = lambda x: F.when(x != "*", x)
    at = lambda k: F.when(F.get(f, k) != "0", _start(F.get(f, k), zero_based))
    pos, cigar, mate = F.get(f, 3).cast("bigint"), F.get(f, 5), F.get(f, 6)
    span = F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    out = [
        F.get(f, 0).alias("name"),
        star(F.get(f, 2)).alias("chrom"),
        _uint(at(3), "start", zero_based),
        _uint(F.when(pos > 0, pos + F.greatest(span, F.lit(1)) - 1), "end"),
        _uint(F.get(f, 1), "flags"),
        F.when(cigar == "*", "").otherwise(cigar).alias("cigar"),
        _uint(F.get(f, 4), "mapping_quality"),
        F.when(mate == "=", star(F.get(f, 2))).otherwise(star(mate)).alias("mate_chrom"),
        _uint(at(7), "mate_start"),
        F.when(F.get(f, 9) == "*", "").otherwise(F.get(f, 9)).alias("sequence"),
        F.when(F.get(f, 10) == "*", "").otherwise(F.get(f, 10)).alias("quality_scores"),
        F.get(f, 8).cast("int").alias("template_length"),
    ]
    if tags:
        known = {} if isinstance(tags, dict) else infer_tags(spark, path)
        out += [_sam_tag(f, t, tags[t] if isinstance(tags, dict) else known.get(t, "Z")) for t in tags]
    return lines(spark, path, comment=None).where(~F.col("value").rlike("^@[A-Z][A-Z]\t")).select(*out)


def describe_sam(spark: SparkSession, path: str, sample_size: int = 100) -> DataFrame:
    """column_name, data_type, nullable, category, sam_type, description; tags of the first records, sorted."""
    core = [(x.name, x.dataType.simpleString(), x.nullable, "core", None, "") for x in read_sam(spark, path).schema]
    tags = [(t, tag_type(k), True, "tag", k, f"tag {t}") for t, k in infer_tags(spark, path, sample_size).items()]
    return spark.createDataFrame(core + tags, "column_name string, data_type string, nullable boolean, category string, sam_type string, description string")


# --- FASTA and FASTQ -----------------------------------------------------------------------------------------------


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """name, description, sequence. Records are split at a line feed before '>', so files split and sequences of many lines are
    joined in generated code.
    """
    df = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    text = F.regexp_replace("value", r"^>|\r", "")
    head = F.substring_index(text, "\n", 1)
    body = F.when(F.instr(text, "\n") > 0, F.substr(text, F.instr(text, "\n") + 1, F.length(text))).otherwise("")
    rest = F.regexp_extract(head, r"^\S+\s+(.*)$", 1)
    return df.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), F.when(rest != "", rest).alias("description"), F.regexp_replace(body, r"\s", "").alias("sequence"))


def read_fastq(spark: SparkSession, path, split_bytes: int = 64 << 20, columns: list[str] | None = None) -> DataFrame:
    """name, description, sequence, quality_scores, or those of ``columns``. See sources.binary.FastqSource: byte ranges, BGZF block
    ranges, or one stream.
    """
    from .binary import register

    register(spark)
    return spark.read.format("fastq").option("splitBytes", split_bytes).option("columns", ",".join(columns or [])).load(path)
