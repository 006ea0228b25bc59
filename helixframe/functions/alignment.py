"""CIGAR, NM and MD over alignment columns."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: CIGAR operation codes 0-8 in order.
OPERATIONS = "MIDNSHP=X"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _let(x: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it stands in ``body``."""
    return F.get(F.transform(F.array(x), body), 0)


def cigar_to_binary(cigar: Column | str) -> Column:
    """Little-endian 32-bit ``length << 4 | code`` per operation; '*' and '' give no bytes; zero lengths are an error."""

    def word(p):
        n = F.substr(p, F.lit(1), F.length(p) - 1).cast("int")
        v = _let(n, lambda n: F.when(n > 0, F.shiftleft(n, 4).bitwiseOR(F.instr(F.lit(OPERATIONS), F.right(p, F.lit(1))) - 1)).otherwise(F.raise_error(F.lit("CIGAR length of zero")).cast("int")))
        return _let(F.lpad(F.hex(v), 8, "0"), lambda h: F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)))

    def whole(c):
        words = lambda p: F.when(F.array_join(p, "") == c, F.unhex(F.array_join(F.transform(p, word), ""))).otherwise(F.raise_error(F.concat(F.lit("not a CIGAR: "), c)).cast("binary"))
        return F.when(c.isNull(), None).when(c.isin("*", ""), F.unhex(F.lit(""))).otherwise(_let(F.regexp_extract_all(c, F.lit(r"\d+[MIDNSHP=X]"), F.lit(0)), words))

    return _let(_c(cigar), whole)


def binary_to_cigar(raw: Column | str) -> Column:
    """The text form; no bytes give '*'; a size that is no multiple of four is an error."""

    def whole(h):
        def op(k):
            p = k * 8 + 1
            le = F.concat(F.substr(h, p + 6, F.lit(2)), F.substr(h, p + 4, F.lit(2)), F.substr(h, p + 2, F.lit(2)), F.substr(h, p, F.lit(2)))
            return _let(F.conv(le, 16, 10).cast("bigint"), lambda v: F.concat(F.shiftright(v, 4).cast("string"), F.substr(F.lit(OPERATIONS), v.bitwiseAND(F.lit(15)).cast("int") + 1, F.lit(1))))

        n = (F.length(h) / 8).cast("int")
        text = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), op), "")
        return F.when(h.isNull(), None).when(F.length(h) == 0, "*").when(F.length(h) % 8 == 0, text).otherwise(F.raise_error(F.lit("binary CIGAR of a size that is no multiple of four")).cast("string"))

    return _let(F.hex(_c(raw)), whole)


def reference_span(cigar: Column | str) -> Column:
    """Reference bases that an alignment covers."""
    lengths = F.regexp_extract_all(_c(cigar), F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    return F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))


_OP = re.compile(r"(\d+)([MIDNSHP=X])")
_KNOWN = np.zeros(256, bool)
_KNOWN[list(b"ACGTU")] = True


def nm_md(cigar: str | None, sequence: str | None, reference: str | None) -> tuple[int | None, str | None]:
    """Edit distance and mismatch string of one alignment. ``reference``: bases from the alignment's start on.

    Without a reference NM counts inserted and deleted bases and X operations, and MD is None.
    """
    if not cigar or cigar == "*":
        return None, None
    ops = [(int(n), op) for n, op in _OP.findall(cigar)]
    if reference is None or not sequence or sequence == "*":
        return sum(n for n, op in ops if op in "IDX"), None
    read, ref = sequence.upper(), reference.upper()
    nm, q, r, same, md = 0, 0, 0, 0, []
    for n, op in ops:
        if op in "M=X":
            if q + n > len(read):
                raise IndexError("a CIGAR that is longer than its sequence")
            over = ref[r : r + n].ljust(n, "N")  # beyond the reference: N
            a, b = np.frombuffer(read[q : q + n].encode("latin-1", "replace"), np.uint8), np.frombuffer(over.encode("latin-1", "replace"), np.uint8)
            wrong = np.flatnonzero((a != b) | ~_KNOWN[a])
            nm += len(wrong)
            gaps = np.diff(wrong, prepend=-1) - 1
            if len(wrong):
                gaps[0] += same
                md += [f"{g}{over[k]}" for g, k in zip(gaps.tolist(), wrong.tolist(), strict=True)]
                same = n - 1 - int(wrong[-1])
            else:
                same += n
            q, r = q + n, r + n
        elif op == "I":
            nm, q = nm + n, q + n
        elif op == "D":
            nm += n
            md.append(f"{same}^{ref[r : r + n]}")
            same, r = 0, r + n
        elif op == "N":
            r += n
        elif op == "S":
            q += n
    md.append(str(same))
    return nm, "".join(md)


def nm_and_md(cigar: Column | str, sequence: Column | str, reference: Column | str) -> Column:
    """Struct (nm, md); walking an alignment is sequential, so this one is a pandas UDF; the bases of an operation are compared as arrays."""

    def run(cigar: pd.Series, sequence: pd.Series, reference: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([nm_md(*x) for x in zip(cigar, sequence, reference, strict=True)], columns=["nm", "md"]).astype({"nm": "Int32"})

    return F.pandas_udf(run, "nm int, md string")(_c(cigar), _c(sequence), _c(reference))
