"""License scans by canonical digests.

A text's canonical form is lower case; lines that state a copyright and nothing but rights reserved are dropped; all but
letters and digits become single spaces; equivalent spellings are levelled. Its SHA-256 is joined to the digests of known
licences in canonical form, with and without their title line. Each line's canonical form is looked up likewise among
known one-line notices. The built-in list is fixed and short, so its join is broadcast and no document is shuffled; a list given
as ``known`` joins as its size demands.

Defined cases: null or empty text has the digest of the empty text, which no licence has; equal texts get equal results; an
empty table gives an empty result; other columns are untouched.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .licences import DIGESTS, NOTICES, SPELLINGS, TEXTS

#: A line that only states a copyright, or that rights are reserved; Java and RE2 read both patterns alike. The word alone does
#: not make one: where a licence is wrapped, its lines may begin with "copyright notice" or with an item "(c)".
COPYRIGHT = r"(?m)^[^\na-z0-9]*(copyright([^\na-z]*(\(c\)|©|<|\[)|[^\n]*(19|20)[0-9][0-9])|\(c\)[^\na-z]*[0-9]|©)[^\n]*$"
RESERVED = r"(?m)^[^\na-z0-9]*all rights reserved[^\na-z0-9]*$"
OTHER = r"[^\na-z0-9\x{80}-\x{10FFFF}]+"


def canonical(text: Column) -> Column:
    """The canonical lines, joined by line feeds."""
    t = F.lower(text)
    for pattern in (COPYRIGHT, RESERVED):
        t = F.regexp_replace(t, pattern, "")
    t = F.regexp_replace(t, OTHER, " ")
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \n]+", " "))


def licence_scan(docs: DataFrame, known: DataFrame | None = None, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text in struct ``row``; digest, licence_id (null: none), notices (sorted ids).

    ``known``: (licence_id, text) in place of the built-in texts.
    """
    if known is None:
        known = F.broadcast(docs.sparkSession.createDataFrame([(d, k) for d, k in built_in().items()], "digest string, licence_id string"))
    else:
        digest = F.sha2(squeeze(canonical(F.col("text"))), 256)
        known = known.select(digest.alias("digest"), "licence_id").groupBy("digest").agg(F.min("licence_id").alias("licence_id"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    form = docs.select(row.alias("row"), canonical(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("form"))
    notices = {squeezed(v): k for k, v in NOTICES.items()}
    # one-line notices are few and short: a line is compared only if it is as long as one of them
    lines = F.filter(F.split("form", "\n"), lambda x: F.length(x).between(min(map(len, notices)), max(map(len, notices)) + 8))
    names = F.create_map(*[F.lit(x) for kv in notices.items() for x in kv])
    found = F.array_distinct(F.array_sort(F.filter(F.transform(lines, lambda x: names[squeeze(x)]), lambda x: x.isNotNull())))
    out = form.select("row", F.sha2(squeeze(F.col("form")), 256).alias("digest"), found.alias("notices"))
    return out.join(known, "digest", "left").select("row", "digest", "licence_id", "notices")


def squeezed(text: str) -> str:
    """The canonical form of a plain ASCII text, in Python."""
    import re

    t = text.lower()
    for pattern in (COPYRIGHT, RESERVED):
        t = re.sub(pattern, "", t)
    t = re.sub(r"[^\na-z0-9\x80-\U0010FFFF]+", " ", t)
    for a, b in SPELLINGS:
        t = t.replace(a, b)
    return re.sub(r"[ \n]+", " ", t).strip(" ")


def built_in() -> dict[str, str]:
    """Digest to licence id: whole texts with and without their title line, notices, and the digests of the long licences."""
    out: dict[str, str] = {}
    for k, v in [*TEXTS.items(), *((k, v.partition("\n")[2]) for k, v in TEXTS.items()), *NOTICES.items()]:
        d = hashlib.sha256(squeezed(v).encode()).hexdigest()
        out[d] = min(k, out.get(d, k))
    return out | {d: k for k, ds in DIGESTS.items() for d in ds}


def op6_licence_scan(spark, sf_dir: str) -> DataFrame:
    out = licence_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "digest", "licence_id", F.array_join("notices", ",").alias("notices"))


def _sql() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    form = "lower(coalesce(text, ''))"
    for pattern in (COPYRIGHT, RESERVED):
        form = f"regexp_replace({form}, {quoted(pattern.replace(chr(92) + 'n', chr(92) + 'n'))}, '', 'g')"
    form = f"regexp_replace({form}, {quoted(OTHER)}, ' ', 'g')"
    for a, b in SPELLINGS:
        form = f"replace({form}, {quoted(a)}, {quoted(b)})"
    return f"""
WITH known(digest, licence_id) AS (VALUES {", ".join(f"({quoted(d)}, {quoted(k)})" for d, k in built_in().items())}),
notice(line, id) AS (VALUES {", ".join(f"({quoted(squeezed(v))}, {quoted(k)})" for k, v in NOTICES.items())}),
form AS (SELECT doc_id, {form} AS form FROM documents),
lines AS (SELECT DISTINCT doc_id, trim(regexp_replace(line, '[ \\n]+', ' ', 'g'), ' ') AS line FROM (SELECT doc_id, unnest(string_split(form, chr(10))) AS line FROM form)),
found AS (SELECT doc_id, string_agg(DISTINCT id, ',' ORDER BY id) AS notices FROM lines JOIN notice USING (line) GROUP BY doc_id),
digests AS (SELECT doc_id, sha256(trim(regexp_replace(form, '[ \\n]+', ' ', 'g'), ' ')) AS digest FROM form)
SELECT doc_id, digest, licence_id, coalesce(notices, '') AS notices
FROM digests LEFT JOIN known USING (digest) LEFT JOIN found USING (doc_id)
"""


ORACLE_SQL = _sql()
