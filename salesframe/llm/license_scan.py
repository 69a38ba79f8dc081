"""Licence scan by canonical digest lookup.

Whole texts, runs of their paragraphs (between blank lines; runs as long as any known text) and
their lines are brought to a canonical form and hash-joined, by SHA-256, to the digests of known
licence texts in the same form. Long licences are known by digests (``license_digests``): as whole
texts, and as runs of their own number of paragraphs.
Canonical: lower case; copyright lines (a copyright mark and a year) removed; every run of
characters that are neither letters nor digits is one space; equivalent spellings are
written one way. All steps are DataFrame functions; texts are read once.

Defined cases: a null text counts as empty; empty units match nothing, also when a known text
is empty; a unit that occurs several times in a document counts each time; a digest listed for
several licences has the first by name; repeated rows each have their result; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import staged
from ..session import settle
from .common import text_or_empty
from .license_digests import FULL
from .license_texts import KNOWN

#: A line that states a copyright.
COPYRIGHT_LINE = (r"(?m)^[^\p{L}\p{N}\n]*(copyright[ \t]*)?(copyright|\(c\)|©)[^\p{L}\p{N}\n]*"
                  r"([0-9]{4}|<year>|\[year\]|\[yyyy\])[^\n]*$")
BETWEEN = r"[^\p{L}\p{N}\n]+"
BLANK = r"\n( *\n)+"

# Spellings and words that count as the same; \1 and \2 stand for what the groups hold.
SPELLINGS = [
    (r"licenc(e|ing|or)", r"licens\1"),
    (r"\b(sub|non|per) ?(licens|infring|cent\b)", r"\1\2"),
    (r"\bcopyright c\b", r"copyright"),
    (r"\bcopyright owner", r"copyright holder"),
    (r"\b(author|organ|recogn|util|real|initial|minim|custom|categor|general|summar)is(e|ing|ation)", r"\1iz\2"),
    (r"\b(fav|hon|lab|behavi|col|endeav)our", r"\1or"),
    (r"(acknowledg|judg|fulfil)e?l?ment", r"\1ment"),
    (r"\bhttps\b", r"http"),
]


def canonical_lines(text: Column, spellings: list[tuple[str, str]] = SPELLINGS) -> Column:
    """The canonical form of a text, line ends kept."""
    form = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    form = F.regexp_replace(form, BETWEEN, " ")
    for pattern, same in spellings:
        form = F.regexp_replace(form, pattern, same.replace("\\", "$"))
    return form


def _flat(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"[ \n]+", " "))


def with_units(rows: DataFrame, run: int = 1, full: list[tuple] = ()) -> DataFrame:
    """``rows`` with ``units``, kind and digest of each unit of the canonical text ``form``; the whole text comes first.

    ``run``: paragraphs that a unit may take together. ``full``: long known texts, as in ``license_digests``; runs of
    as many paragraphs are units where they begin with the first paragraph of such a text.
    """
    def digest(kind: str, x: Column) -> Column:
        flat = _flat(x)
        return F.when(flat != "", F.struct(F.lit(kind).alias("kind"), F.unhex(F.sha2(flat, 256)).alias("digest")))

    paragraphs, lines = F.col("_paragraphs"), F.col("_lines")

    def runs(n: int) -> Column:
        return F.when(F.size(paragraphs) > n, F.transform(
            F.sequence(F.lit(1), F.size(paragraphs) - n + 1),
            lambda i: digest("paragraphs", F.array_join(F.slice(paragraphs, i, n), " ")))).otherwise(F.array())

    starts: dict[int, set[str]] = {}
    for _, n, first, _ in full:
        if n > run:
            starts.setdefault(n, set()).add(first)

    def long_runs() -> list[Column]:
        at = F.col("_heads")

        def runs_of(n: int) -> Column:
            fits = F.filter(at, lambda p: p["head"].isin(sorted(starts[n])) & (p["i"] + n - 1 <= F.size(paragraphs)))
            return F.when(F.size(paragraphs) > n, F.transform(
                fits, lambda p: digest("paragraphs", F.array_join(F.slice(paragraphs, p["i"], n), " ")))).otherwise(F.array())
        return [runs_of(n) for n in sorted(starts)]

    rows = staged(rows, {"_paragraphs": f"split(form, r'{BLANK}')", "_lines": "split(form, '\n')"})
    if starts:
        # where such a text may begin: few places, found once, so the long runs cost next to nothing
        known = ", ".join(sorted({f"'{h}'" for hs in starts.values() for h in hs}))
        rows = staged(rows, {"_heads": f"""IF(size(_paragraphs) > {min(starts)}, filter(transform(_paragraphs,
            (x, i) -> named_struct('i', i + 1, 'head', trim(regexp_replace(x, '[ \n]+', ' ')))), p -> p.head IN ({known})), array())"""})
    return rows.withColumn("units", F.filter(F.concat(
        F.array(digest("text", F.col("form"))), *[runs(n) for n in range(1, run + 1)], *long_runs(),
        F.when(F.size(lines) > 1, F.transform(lines, lambda x: digest("line", x))).otherwise(F.array()),
    ), lambda u: u.isNotNull())).drop("_paragraphs", "_lines", "_heads", "form")


def _forms(rows: DataFrame, text: str) -> DataFrame:
    """Canonical texts worked out once, as ``form`` in place of the text."""
    return staged(rows.withColumn("form", canonical_lines(text_or_empty(text))).drop(text), {"form": "form"})


def known_digests(known: DataFrame) -> DataFrame:
    """``digest`` and ``license`` of known texts (``license``, ``text``)."""
    whole = with_units(_forms(known.select("license", "text"), "text")).select("license", F.get("units", F.lit(0)).alias("unit"))
    return whole.where("unit IS NOT NULL").groupBy("unit.digest").agg(F.min("license").alias("license"))


def license_scan(docs: DataFrame, known: DataFrame | None = None, id_column: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``text_digest`` (null if nothing is left of the text),
    ``text_license`` of the whole text, ``licenses`` found (by name) and ``notices``, their number.
    """
    spark = docs.sparkSession
    full = FULL if known is None else []
    if known is None:
        known = spark.createDataFrame(KNOWN, "license string, text string")
    run = _forms(known.select("text"), "text").agg(F.max(F.size(F.split("form", BLANK)))).first()[0] or 1
    forms = _forms(docs.select(F.col(id_column).alias("id"), F.monotonically_increasing_id().alias("row"),
                               F.col(text).alias("body")), "body")
    rows = settle(with_units(forms, run, full), "units")
    digests = known_digests(known)
    if full:
        more = spark.createDataFrame([(bytes.fromhex(d), n) for n, _, _, d in full], "digest binary, license string")
        digests = digests.union(more).groupBy("digest").agg(F.min("license").alias("license"))
    hits = (rows.select("row", F.explode("units").alias("unit")).select("row", "unit.*")
            .join(digests, "digest").groupBy("row")
            .agg(F.max(F.when(F.col("kind") == "text", F.col("license"))).alias("text_license"),
                 F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licenses"),
                 F.count("*").alias("notices")))
    first = F.get("units", F.lit(0))
    return rows.select("id", "row", F.lower(F.hex(F.when(first["kind"] == "text", first["digest"]))).alias("text_digest")
                       ).join(hits, "row", "left").select(
        F.col("id").alias(id_column), "text_digest", "text_license", F.coalesce("licenses", F.lit("")).alias("licenses"),
        F.coalesce("notices", F.lit(0)).cast("long").alias("notices"))


def oracle() -> str:
    """The scan of ``documents`` in DuckDB's SQL."""
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    form = f"regexp_replace(lower(coalesce(text, '')), {quoted(COPYRIGHT_LINE)}, '', 'g')"
    form = f"regexp_replace({form}, {quoted(BETWEEN)}, ' ', 'g')"
    for pattern, same in SPELLINGS:
        form = f"regexp_replace({form}, {quoted(pattern)}, {quoted(same)}, 'g')"
    known = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in KNOWN)
    run = max(len(re.split(BLANK, t.replace("\t", " "))) for _, t in KNOWN)
    flat = "trim(regexp_replace(x, '[ \\n]+', ' ', 'g'))"
    return f"""
WITH known_forms AS (SELECT license, {form} AS x FROM (VALUES {known}) AS k(license, text)),
known AS (SELECT sha256({flat}) AS digest, min(license) AS license FROM known_forms GROUP BY 1),
forms AS (SELECT doc_id, row_number() OVER () AS n, {form} AS form FROM documents),
parts AS (
  SELECT n, 'text' AS kind, form AS x FROM forms
  UNION ALL
  SELECT n, 'paragraphs', array_to_string(p[i : i + r - 1], ' ') FROM (
    SELECT n, p, r, unnest(range(1, len(p) - r + 2)) AS i FROM (
      SELECT n, regexp_split_to_array(form, {quoted(BLANK)}) AS p FROM forms) CROSS JOIN range(1, {run + 1}) AS k(r)
    WHERE len(p) > r)
  UNION ALL
  SELECT n, 'line', unnest(p) FROM (SELECT n, string_split(form, chr(10)) AS p FROM forms) WHERE len(p) > 1),
units AS (SELECT n, kind, sha256({flat}) AS digest FROM parts WHERE {flat} <> ''),
hits AS (
  SELECT n, max(license) FILTER (WHERE kind = 'text') AS text_license,
    array_to_string(list_sort(list(DISTINCT license)), ',') AS licenses, count(*) AS notices
  FROM units JOIN known USING (digest) GROUP BY n)
SELECT doc_id, u.digest AS text_digest, text_license, coalesce(licenses, '') AS licenses, coalesce(notices, 0) AS notices
FROM forms LEFT JOIN (SELECT n, digest FROM units WHERE kind = 'text') u USING (n) LEFT JOIN hits USING (n)"""
