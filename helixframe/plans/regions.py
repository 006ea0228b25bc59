"""From pushed filters to genomic regions, and from regions to balanced partitions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import datasource as ds


@dataclass(frozen=True)
class Region:
    """1-based closed; an open end is None."""

    chrom: str
    start: int = 1
    end: int | None = None


def extract_regions(filters: list, zero_based: bool, chrom: str = "chrom", start: str = "start", end: str = "end") -> list[Region] | None:
    """Regions that hold every row the conjuncts let through: None if no chromosome is named, [] on a contradiction.

    Equality and membership of the chromosome; all comparisons of the start; =, <, <= of the end, as an upper bound. What is
    not understood stays to be evaluated above the scan, so the regions may be too wide, never too narrow.
    """
    chroms: set[str] = set()
    low, high = 1, None
    shift = 1 if zero_based else 0
    for f in filters:
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        value = getattr(f, "value", None)
        if column == chrom and isinstance(f, ds.EqualTo):
            chroms.add(value)
        elif column == chrom and isinstance(f, ds.In):
            chroms |= {v for v in f.value if v is not None}
        elif column == start and isinstance(value, int):
            v = value + shift
            if isinstance(f, (ds.EqualTo, ds.GreaterThanOrEqual)):
                low = max(low, v)
            if isinstance(f, ds.GreaterThan):
                low = max(low, v + 1)
            if isinstance(f, (ds.EqualTo, ds.LessThanOrEqual)):
                high = v if high is None else min(high, v)
            if isinstance(f, ds.LessThan):
                high = v - 1 if high is None else min(high, v - 1)
        elif column == end and isinstance(value, int):
            if isinstance(f, (ds.EqualTo, ds.LessThanOrEqual)):
                high = value if high is None else min(high, value)
            if isinstance(f, ds.LessThan):
                high = value - 1 if high is None else min(high, value - 1)
    if high is not None and high < low:
        return []
    return [Region(c, low, high) for c in sorted(chroms)] if chroms else None


@dataclass(frozen=True)
class Sized:
    """A region with an estimate of its bytes, and its contig's length where known."""

    region: Region
    size: int
    length: int | None = None


def balance(regions: list[Sized], partitions: int) -> list[list[Region]]:
    """At most ``partitions`` lists of regions of about equal bytes, in order; large regions are cut by base pairs.

    The last piece of a cut region stays as open as the region was; regions without bytes go to the emptiest list.
    """
    partitions = max(1, partitions)
    total = sum(s.size for s in regions)
    budget = max(1, -(-total // partitions))
    out: list[list[Region]] = [[]]
    sizes = [0]
    for s in (s for s in regions if s.size > 0):
        r, left = s.region, s.size
        end = r.end if r.end is not None else s.length
        at = r.start
        while True:
            room = budget - sizes[-1]
            if left <= room or end is None or end - at < 1 or len(out) == partitions:
                out[-1].append(Region(r.chrom, at, r.end))
                sizes[-1] += left
                break
            if room > 0:
                cut = at + max(1, (end - at + 1) * room // left) - 1
                if cut >= end:
                    out[-1].append(Region(r.chrom, at, r.end))
                    sizes[-1] += left
                    break
                out[-1].append(Region(r.chrom, at, cut))
                sizes[-1] += room
                left, at = left - room, cut + 1
            out.append([])
            sizes.append(0)
    for s in (s for s in regions if s.size <= 0):
        k = sizes.index(min(sizes))
        out[k].append(s.region)
        sizes[k] += 1
    return [p for p in out if p]


def coalesce(ranges: list[tuple[int, int]], gap: int = 64 << 10, most: int = 8 << 20) -> list[tuple[int, int]]:
    """Sorted half-open byte ranges, joined over small gaps up to a size."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a - out[-1][1] <= gap and max(b, out[-1][1]) - out[-1][0] <= most:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def fnv1a(data: bytes) -> str:
    """64-bit FNV-1a in hex."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return f"{h:016x}"
