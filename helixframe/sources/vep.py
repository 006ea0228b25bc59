"""Annotation caches: variation lines as Spark text, serialised entities by a Storable decoder."""

from __future__ import annotations

import gzip
import json
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, InputPartition

from helixframe.plans.regions import fnv1a
from helixframe.sinks.lines import filesystem

from . import bgzf
from .binary import Reader, option, pruned

#: The variation columns of a cache without a list of its own.
VARIATION_COLUMNS = ("variation_name", "failed", "somatic", "start", "end", "allele_string", "strand", "minor_allele", "minor_allele_freq", "clin_sig", "phenotype_or_disease")


def info(root: str) -> dict[str, str]:
    """The key-value pairs of a cache's info.txt."""
    fs, p = filesystem(root)
    with fs.open_input_stream(f"{p}/info.txt") as f:
        lines = f.read().decode().splitlines()
    return dict(x.split("\t", 1) for x in lines if "\t" in x and not x.startswith("#"))


def _rank(chrom: str) -> tuple:
    c = chrom.removeprefix("chr")
    return (0, int(c), "") if c.isdigit() else (1, {"X": 0, "Y": 1, "M": 2, "MT": 2}.get(c, 3), c)


def files(root: str, entity: str) -> list[tuple[str, str]]:
    """(chromosome, file) in karyotype order. Variation: any all_vars files win over region files."""
    from pyarrow.fs import FileSelector, FileType

    fs, p = filesystem(root)
    every = [x.path for x in fs.get_file_info(FileSelector(p, recursive=True)) if x.type == FileType.File]
    name = lambda x: x.rsplit("/", 1)[1]
    region = re.compile(r"^\d+-\d+(_\w+)?\.gz$")
    if entity == "variation":
        found = [x for x in every if name(x).startswith("all_vars") and not name(x).endswith((".csi", ".tbi"))] or [x for x in every if re.match(r"^\d+-\d+_var\.gz$", name(x))]
    elif entity in ("regulatory", "motif"):
        found = [x for x in every if re.match(r"^\d+-\d+_reg\.gz$", name(x))]
    else:
        found = [x for x in every if "transcript" in name(x) and name(x).endswith(".gz")] or [x for x in every if region.match(name(x)) and "_" not in name(x)]
    return sorted(((x.rsplit("/", 2)[1], x) for x in found), key=lambda t: (_rank(t[0]), int(re.match(r"\d+", name(t[1]))[0]) if name(t[1])[0].isdigit() else 0, t[1]))


def chromosomes(root: str, entity: str = "variation") -> list[str] | None:
    found = list(dict.fromkeys(c for c, _ in files(root, entity)))
    return found or None


def read_variation(spark: SparkSession, root: str, zero_based: bool = False, chroms: list[str] | None = None) -> DataFrame:
    """Variation rows: chrom and source_file from the path, the columns that info.txt lists, region_bin.

    Lines without chromosome, start, name or allele are dropped; '.' and '' are null; the end defaults to the start. Files of
    other chromosomes are not listed.
    """
    facts = info(root)
    columns = facts.get("variation_cols", ",".join(VARIATION_COLUMNS)).split(",")
    wanted = [f for c, f in files(root, "variation") if chroms is None or c in chroms]
    if not wanted:
        raise FileNotFoundError(f"no variation files in {bgzf_safe(root)}")
    size = int(facts.get("cache_region_size", "1000000"))
    tabbed = any("all_vars" in f for f in wanted)
    df = spark.read.text(wanted).withColumn("source_file", F.col("_metadata.file_path")).where((F.trim("value") != "") & ~F.startswith("value", F.lit("#")))
    f = F.split("value", "\t" if tabbed else "[\t ]")
    value = lambda k: F.when(~F.get(f, k).isin("", "."), F.get(f, k))
    at = {c: k for k, c in enumerate(columns)}
    chrom = value(at["chr"]) if "chr" in at else F.regexp_extract("source_file", r"/([^/]+)/[^/]+$", 1)
    start = value(at["start"]).try_cast("bigint")
    kinds = {"failed": "int", "somatic": "int", "strand": "tinyint", "minor_allele_freq": "double", "phenotype_or_disease": "int"}
    fixed = {"chr", "start", "end", "variation_name", "allele_string"}
    out = df.select(
        chrom.alias("chrom"),
        (start - 1 if zero_based else start).alias("start"),
        F.coalesce(value(at["end"]).try_cast("bigint"), start).alias("end"),
        value(at["variation_name"]).alias("variation_name"),
        value(at["allele_string"]).alias("allele_string"),
        F.floor((start - 1) / size).cast("bigint").alias("region_bin"),
        *[value(k).try_cast(kinds.get(c, "string")).alias(c) for c, k in at.items() if c not in fixed],
        F.lit(facts.get("species")).alias("species"),
        F.lit(facts.get("assembly")).alias("assembly"),
        F.lit(facts.get("cache_version")).alias("cache_version"),
        "source_file",
    )
    return out.where("chrom is not null and start is not null and variation_name is not null and allele_string is not null")


def bgzf_safe(location: str) -> str:
    """A location for messages: without credentials and query strings."""
    return re.sub(r"\?.*$", "", re.sub(r"//[^/@]*@", "//", location))


# --- predictions ---------------------------------------------------------------------------------------------------

#: Mark of a prediction matrix, amino acids of its columns, cell without a prediction, names of the classes.
_MATRIX = b"VEP"
_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
_NONE = 0xFFFF
_CLASSES = {
    "sift": ("tolerated", "deleterious", "tolerated - low confidence", "deleterious - low confidence"),
    "polyphen": ("probably damaging", "possibly damaging", "benign", "unknown"),
}
_CLASSES["polyphen_humvar"] = _CLASSES["polyphen"]


def prediction_matrix(raw: bytes, analysis: str) -> list[dict] | None:
    """The cells of a prediction matrix, compressed or not: 16 bits each, the class in the top two, 1000 times the score in the
    last ten. None for what is no whole matrix, holds no prediction or is of an analysis not known.
    """
    names = _CLASSES.get(analysis)
    if raw.startswith(b"\x1f\x8b"):
        try:
            raw = gzip.decompress(raw)
        except (OSError, EOFError, zlib.error):
            return None
    if names is None or not raw.startswith(_MATRIX) or len(raw) % 2 == 0 or len(raw) < len(_MATRIX) + 2 * len(_ACIDS):
        return None
    cells = np.frombuffer(raw, "<u2", offset=len(_MATRIX))
    cells = cells[: len(cells) // len(_ACIDS) * len(_ACIDS)]
    at = np.flatnonzero(cells != _NONE)
    found = zip((at // len(_ACIDS) + 1).tolist(), (at % len(_ACIDS)).tolist(), (cells[at] >> 14).tolist(), (cells[at] & 0x3FF).tolist(), strict=True)
    return [{"position": k, "amino_acid": _ACIDS[a], "prediction": names[c], "score": x / 1000} for k, a, c, x in found] or None


def predictions(found, analysis: str) -> list[dict] | None:
    """The predictions of one analysis in a cache object: a matrix, or a list spelt out, whose incomplete entries are left out."""
    if isinstance(found, dict) and isinstance(found.get("matrix"), bytes):
        return prediction_matrix(found["matrix"], found.get("analysis") or analysis)
    out = []
    listed = found.get("predictions") if isinstance(found, dict) else found
    for x in listed if isinstance(listed, list) else []:
        if isinstance(x, dict) and _number(x.get("position")) is not None and x.get("amino_acid") and x.get("prediction"):
            try:
                out.append({"position": _number(x["position"]), "amino_acid": x["amino_acid"], "prediction": x["prediction"], "score": float(x.get("score"))})
            except (TypeError, ValueError):
                continue
    return out or None


# --- Storable ------------------------------------------------------------------------------------------------------


def _scalar(raw: bytes):
    """Text; prediction matrices stay bytes."""
    return raw if raw.startswith((b"\x1f\x8b", _MATRIX)) else raw.decode("utf-8", "replace")


class Storable:
    """A decoder of Perl's ``pst0`` files, in network or native order, into dicts, lists and scalars; references are followed."""

    def __init__(self, data: bytes):
        if data[:4] != b"pst0":
            raise ValueError("not a Storable file")
        self.d = data
        self.at = 6
        self.order = ">"
        if not data[4] & 1:  # native order names its byte order and the sizes of int, long, pointer and double
            named = data[7 : 7 + data[6]]
            if named not in (b"12345678", b"87654321", b"1234", b"4321"):
                raise ValueError(f"Storable byte order {named!r} is not known")
            self.order, self.wide = "<" if named.startswith(b"1") else ">", "q" if len(named) == 8 else "i"
            self.at = 7 + len(named) + 4
        self.slots: list = []
        self.classes: list[str] = []

    def _u8(self) -> int:
        self.at += 1
        return self.d[self.at - 1]

    def _number(self, kind: str):
        (x,) = struct.unpack_from(self.order + kind, self.d, self.at)
        self.at += struct.calcsize(f"={kind}")
        return x

    def _u32(self) -> int:
        return self._number("I")

    def _bytes(self, n: int) -> bytes:
        self.at += n
        return self.d[self.at - n : self.at]

    def _class(self, op: int) -> str:
        n = self._u8()
        if n & 0x80:  # long names and indexes
            n = self._u32()
        if op == 0x12:
            return self.classes[n]
        self.classes.append(self._bytes(n).decode())
        return self.classes[-1]

    def value(self):
        op = self._u8()
        if op == 0x00:
            # object numbers are in network order in every file
            (k,) = struct.unpack_from(">I", self.d, self.at)
            self.at += 4
            return self.slots[k]
        if op in (0x11, 0x12):
            name = self._class(op)
            inner = len(self.slots)  # the blessed value takes this slot, its children the next ones
            v = self.value()
            if isinstance(v, dict):
                v.setdefault("__class", name)
            if inner < len(self.slots):
                self.slots[inner] = v
            return v
        slot = len(self.slots)
        self.slots.append(None)
        if op in (0x04, 0x14, 0x1B, 0x1C):
            v = self.value()
        elif op in (0x05, 0x0E):
            v = None
        elif op in (0x0F, 0x10):
            v = int(op == 0x0F)
        elif op == 0x06 and hasattr(self, "wide"):
            v = self._number(self.wide)
        elif op == 0x07 and hasattr(self, "wide"):
            v = self._number("d")
        elif op == 0x08:
            v = self._u8() - 128
        elif op == 0x09:
            (v,) = struct.unpack_from(">i", self.d, self.at)
            self.at += 4
        elif op in (0x0A, 0x01, 0x17, 0x18):
            v = _scalar(self._bytes(self._u8() if op in (0x0A, 0x17) else self._u32()))
        elif op == 0x02:
            v = self.slots[slot] = []
            v += [self.value() for _ in range(self._u32())]
        elif op in (0x03, 0x19):
            v = self.slots[slot] = {}
            if op == 0x19:
                self.at += 1
            for _ in range(self._u32()):
                x = self.value()
                if op == 0x19:
                    self.at += 1
                v[self._bytes(self._u32()).decode("utf-8", "replace")] = x
        else:
            raise ValueError(f"Storable opcode {op:#x} is not known")
        self.slots[slot] = v
        return v


def decode(data: bytes):
    """A cache file: Storable, or JSON in fixtures."""
    return Storable(data).value() if data[:4] == b"pst0" else json.loads(data)


def canonical(x) -> str:
    """JSON with sorted keys; shared and cyclic parts are written once."""
    seen: set[int] = set()

    def plain(v):
        if isinstance(v, (dict, list)):
            if id(v) in seen:
                return None
            seen.add(id(v))
            out = {k: plain(v[k]) for k in sorted(v) if k != "__class"} if isinstance(v, dict) else [plain(y) for y in v]
            seen.discard(id(v))
            return out
        return v.decode("utf-8", "replace") if isinstance(v, bytes) else v

    return json.dumps(plain(x), separators=(",", ":"), ensure_ascii=False)


@dataclass
class CacheFile(InputPartition):
    chrom: str
    path: str


_INT, _STR = "bigint", "string"
_EXONS = "array<struct<start:bigint,end:bigint,phase:bigint>>"
_PREDICTIONS = "array<struct<position:int,amino_acid:string,prediction:string,score:float>>"
FIELDS = {
    "transcript": [("chrom", _STR), ("start", _INT), ("end", _INT), ("strand", "tinyint"), ("stable_id", _STR), ("version", _INT), ("biotype", _STR), ("source", _STR), ("is_canonical", "boolean"), ("gene_stable_id", _STR), ("gene_symbol", _STR), ("gene_symbol_source", _STR), ("db_id", _INT), ("cdna_coding_start", _INT), ("cdna_coding_end", _INT), ("coding_region_start", _INT), ("coding_region_end", _INT), ("translation_stable_id", _STR), ("exon_count", _INT), ("exons", _EXONS), ("source_file", _STR), ("object_hash", _STR), ("raw_object_json", _STR)],
    "exon": [("chrom", _STR), ("start", _INT), ("end", _INT), ("strand", "tinyint"), ("stable_id", _STR), ("version", _INT), ("transcript_id", _STR), ("exon_number", _INT), ("phase", _INT), ("end_phase", _INT), ("gene_stable_id", _STR), ("source_file", _STR), ("object_hash", _STR)],
    "translation": [("chrom", _STR), ("start", _INT), ("end", _INT), ("transcript_id", _STR), ("stable_id", _STR), ("version", _INT), ("cdna_coding_start", _INT), ("cdna_coding_end", _INT), ("peptide", _STR), ("cds_len", _INT), ("protein_len", _INT), ("sift_predictions", _PREDICTIONS), ("polyphen_predictions", _PREDICTIONS), ("source_file", _STR), ("object_hash", _STR)],
    "regulatory": [("chrom", _STR), ("start", _INT), ("end", _INT), ("strand", "tinyint"), ("stable_id", _STR), ("feature_type", _STR), ("db_id", _INT), ("source_file", _STR), ("object_hash", _STR), ("raw_object_json", _STR)],
    "motif": [("chrom", _STR), ("start", _INT), ("end", _INT), ("strand", "tinyint"), ("motif_id", _STR), ("binding_matrix", _STR), ("score", "double"), ("db_id", _INT), ("source_file", _STR), ("object_hash", _STR), ("raw_object_json", _STR)],
}
#: Rows that a cache holds for bookkeeping only.
_DROPPED_BIOTYPES = frozenset({"aligned_transcript", "pseudogene"})
_ARTEFACT = re.compile(r"^(LOC|compmerge\.)")


def _number(x):
    return int(x) if isinstance(x, (int, float)) or isinstance(x, str) and re.match(r"^-?\d+$", x) else None


def _items(tree, *keys: str):
    """The objects of a cache tree {chromosome: [objects]} or {chromosome: {kind: [objects]}}."""
    for chrom, found in (tree or {}).items():
        if isinstance(found, dict):
            for k in keys:
                for x in found.get(k) or []:
                    yield chrom, x
        elif isinstance(found, list):
            for x in found:
                yield chrom, x


class VepEntityReader(Reader):
    def partitions(self):
        entity = option(self.options, "entity", "transcript")
        chroms = [c for c in option(self.options, "chroms").split(",") if c]
        return [CacheFile(c, f) for c, f in files(self.path, entity) if not chroms or c in chroms]

    def read(self, part):
        entity = option(self.options, "entity", "transcript")
        zero = option(self.options, "zeroBased", "false") == "true"
        tree = decode(bgzf.read_all(part.path))
        rows = []
        keys = {"regulatory": ("RegulatoryFeature",), "motif": ("MotifFeature",)}.get(entity, ("Transcript",))
        for chrom, x in _items(tree, *keys):
            base = {"chrom": chrom, "start": _number(x.get("start")), "end": _number(x.get("end")), "strand": _number(x.get("strand")), "stable_id": x.get("stable_id"), "version": _number(x.get("version")), "db_id": _number(x.get("dbID")), "source_file": part.path, "object_hash": fnv1a(canonical(x).encode()), "raw_object_json": canonical(x)}
            if entity in ("regulatory", "motif"):
                rows.append(base | {"feature_type": x.get("feature_type") if isinstance(x.get("feature_type"), str) else (x.get("feature_type") or {}).get("name"), "motif_id": x.get("stable_id"), "binding_matrix": x.get("binding_matrix") if isinstance(x.get("binding_matrix"), str) else (x.get("binding_matrix") or {}).get("stable_id"), "score": float(x["score"]) if x.get("score") is not None else None})
                continue
            if x.get("biotype") in _DROPPED_BIOTYPES or not x.get("stable_id") or _ARTEFACT.match(x["stable_id"]):
                continue
            exons = x.get("_trans_exon_array") or []
            tr = x.get("translation") or {}
            if entity == "transcript":
                rows.append(base | {"biotype": x.get("biotype"), "source": x.get("source") or x.get("_source_cache"), "is_canonical": bool(x.get("is_canonical")), "gene_stable_id": x.get("_gene_stable_id"), "gene_symbol": x.get("_gene_symbol"), "gene_symbol_source": x.get("_gene_symbol_source"), "cdna_coding_start": _number(x.get("cdna_coding_start")), "cdna_coding_end": _number(x.get("cdna_coding_end")), "coding_region_start": _number(x.get("coding_region_start")), "coding_region_end": _number(x.get("coding_region_end")), "translation_stable_id": tr.get("stable_id"), "exon_count": len(exons), "exons": [{"start": _number(e.get("start")), "end": _number(e.get("end")), "phase": _number(e.get("phase"))} for e in exons]})
            elif entity == "exon":
                rows += [base | {"transcript_id": x["stable_id"], "start": _number(e.get("start")), "end": _number(e.get("end")), "stable_id": e.get("stable_id"), "version": _number(e.get("version")), "exon_number": k + 1, "phase": _number(e.get("phase")), "end_phase": _number(e.get("end_phase")), "gene_stable_id": x.get("_gene_stable_id"), "object_hash": fnv1a(canonical(e).encode())} for k, e in enumerate(exons)]
            elif tr:
                a, b = _number(x.get("cdna_coding_start")), _number(x.get("cdna_coding_end"))
                cached = x.get("_variation_effect_feature_cache") or {}
                peptide = cached.get("peptide")
                scored = cached.get("protein_function_predictions") or {}
                called = {f"{k}_predictions": predictions(scored.get(key), k) for k, key in (("sift", "sift"), ("polyphen", "polyphen_humvar")) if f"{k}_predictions" in self.names}
                rows.append(base | {"transcript_id": x["stable_id"], "stable_id": tr.get("stable_id"), "version": _number(tr.get("version")), "cdna_coding_start": a, "cdna_coding_end": b, "peptide": peptide, "cds_len": b - a + 1 if a and b else None, "protein_len": len(peptide) if peptide else None, "object_hash": fnv1a(canonical(tr).encode())} | called)
        kinds = {"bigint": pa.int64(), "string": pa.string(), "tinyint": pa.int8(), "boolean": pa.bool_(), "double": pa.float64()}
        kinds[_EXONS] = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("phase", pa.int64())]))
        kinds[_PREDICTIONS] = pa.list_(pa.struct([("position", pa.int32()), ("amino_acid", pa.string()), ("prediction", pa.string()), ("score", pa.float32())]))
        columns = {}
        for n, t in FIELDS[entity]:
            kind = kinds[t]
            values = [r.get(n) for r in rows]
            columns[n] = pa.array([v - 1 if n == "start" and zero and v is not None else v for v in values], kind)
        if rows:
            yield self.batch(columns)


class VepEntitySource(DataSource):
    """``entity``: transcript, exon, translation, regulatory or motif; ``path``: the cache root; ``chroms``: names, by comma."""

    @classmethod
    def name(cls):
        return "vep_cache"

    def schema(self):
        return pruned(FIELDS[option(self.options, "entity", "transcript")], self.options)

    def reader(self, schema):
        return VepEntityReader(self.options, schema)


#: Fixed value: the standard genetic code, bases in the order TCAG.
_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def translate(cds: str) -> str:
    at = {b: k for k, b in enumerate("TCAG")}
    s = cds.upper().replace("U", "T")
    return "".join(_CODE[at[c[0]] * 16 + at[c[1]] * 4 + at[c[2]]] if all(b in at for b in c) else "X" for c in (s[k : k + 3] for k in range(0, len(s) - 2, 3)))
