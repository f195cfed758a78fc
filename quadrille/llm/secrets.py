"""Secret scans with corpus-wide ownership frequency.

One regular expression finds candidates in the whole text, whatever their length: keys as issuers write them, PEM
blocks with or without headers (16 lines at most), and what is assigned to a telling name, in quotes or, where it
has a digit and a letter, bare.  It runs on the texts that hold one of its fixed words, without which it can't match.
Only a hash of each candidate leaves the scan.  Hashes are
counted over the whole corpus by distinct repositories and owners.  A candidate that many owners hold is an
example that was copied about; one held by few owners looks like a live credential of theirs.  Values that
say they are placeholders, or have too few different characters to be keys, are set apart.

The expressions use the syntax that Java and RE2 share, so plain SQL gives the same rows.

Cases.  Null and empty texts have no candidates.  Null repositories and owners aren't counted as one.  Null
ids: their rows are reported under a null id, and counted as no document.  Repeated rows add occurrences,
not documents.  An empty table gives an empty result.  Only the named columns are read, so other columns may
have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, fresh

#: An example is held by at least this many owners; a key has at least this many different characters.
WIDE_OWNERS, MIN_DISTINCT = 3, 6
REDACTED = "[REDACTED]"
KEYS = r"(?i:token|secret|passw(?:or)?d|passwd|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth)"
ASSIGNED = KEYS + r"""["']?\s*(?:=>|=|:)\s*["']([^"'\s]{8,})["']"""
BARE = KEYS + r"""["']?[ \t]*(?:=>|=|:)[ \t]*([0-9A-Za-z_+/.~=-]{12,})"""
ISSUED = r"(?:AKIA|ASIA)[0-9A-Z]{16,}|gh[opsru]_[0-9A-Za-z]{36,}|github_pat_[0-9A-Za-z_]{40,}|glpat-[0-9A-Za-z_-]{20,}|xox[abprs]-[0-9A-Za-z-]{10,}|AIza[0-9A-Za-z_-]{35,}|sk-[0-9A-Za-z_-]{20,}|sk_live_[0-9A-Za-z]{16,}|eyJ[0-9A-Za-z_-]{8,}[.]eyJ[0-9A-Za-z_-]{8,}[.][0-9A-Za-z_-]{8,}"
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----\s*(?:[A-Za-z0-9-]+:[^\n]*\n\s*){0,16}[^-]{16,}-----END [A-Z ]*PRIVATE KEY-----"
CANDIDATE = f"{ASSIGNED}|{BARE}|{ISSUED}|{PEM}"
#: Without one of these, in any case or in this case, CANDIDATE can't match.
NAMES = ("token", "secret", "passw", "api", "access", "private", "credential", "auth")
HEADS = ("AKIA", "ASIA", "gho_", "ghp_", "ghs_", "ghr_", "ghu_", "github_pat_", "glpat-", "xox", "AIza", "sk-", "sk_live_", "eyJ", "-----BEGIN")
PLACEHOLDER = r"(?i)example|placeholder|change_?me|your[_-]|xxxx|dummy|sample|[<>]|[$][{]|[*]{3}|[.]{3}|(?:0123|1234)567"


def _value(match: Column) -> Column:
    """The secret itself: what is assigned, or the whole match; null for a bare word that has no digit or no letter."""
    quoted, bare = (F.regexp_extract(match, f"^(?:{form})$", 1) for form in (ASSIGNED, BARE))
    key = bare.rlike(ISSUED) | (bare.rlike("[0-9]") & bare.rlike("[A-Za-z]"))
    return F.when(quoted != "", quoted).when((bare != "") & key, bare).when(bare == "", match)


def _kind(match: Column, value: Column) -> Column:
    return F.when(match.startswith("-----BEGIN"), "private_key").when(value.rlike(f"^(?:{ISSUED})$"), "issued_key").otherwise("assigned")


def found_in(text: Column) -> Column:
    """Every match of CANDIDATE in a text."""
    low = F.lower(text)
    signs = [F.contains(low, F.lit(n)) for n in NAMES] + [F.contains(text, F.lit(h)) for h in HEADS]
    return F.when(reduce(Column.__or__, signs), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)))


def candidates(docs: DataFrame, id_col: str, text_col: str, repository: Column, owner: Column) -> DataFrame:
    """One row for each occurrence: (doc_id, repository, owner, secret_hash, kind, placeholder)."""
    found = docs.select(F.col(id_col).alias("doc_id"), repository.cast("string").alias("repository"), owner.cast("string").alias("owner"), F.explode(found_in(F.col(text_col).cast("string"))).alias("match"))
    found = found.withColumn("value", _value(F.col("match"))).where("value is not null")
    value = F.col("value")
    distinct = F.size(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")))
    return found.select("doc_id", "repository", "owner", F.sha2(value, 256).alias("secret_hash"), _kind(F.col("match"), value).alias("kind"), (value.rlike(PLACEHOLDER) | (distinct < MIN_DISTINCT)).alias("placeholder"))


def ownership(found: DataFrame, wide_owners: int = WIDE_OWNERS) -> DataFrame:
    """One row for each hash: counts over the corpus and the verdict live, example or placeholder."""
    counted = found.groupBy("secret_hash").agg(
        F.min("kind").alias("kind"),
        F.count("*").alias("n_occurrences"),
        F.countDistinct("doc_id").alias("n_docs"),
        F.countDistinct("repository").alias("n_repositories"),
        F.countDistinct("owner").alias("n_owners"),
        F.bool_or("placeholder").alias("placeholder"),
    )
    verdict = F.when(F.col("placeholder"), "placeholder").when(F.col("n_owners") >= wide_owners, "example").otherwise("live")
    return counted.withColumn("verdict", verdict).drop("placeholder")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None, owner: Column | None = None, wide_owners: int = WIDE_OWNERS, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, secret_hash, n_here, kind, n_occurrences, n_docs, n_repositories, n_owners, verdict) for each secret of each document.

    By default the owner is the column ``source``, and a repository is an owner's texts in one language.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    owner = F.col("source") if owner is None else owner
    repository = F.concat("source", F.lit("/"), "lang") if repository is None else repository
    found = scratch.table(candidates(docs, id_col, text_col, repository, owner))
    here = found.groupBy("doc_id", "secret_hash").agg(F.count("*").alias("n_here"))
    return here.join(ownership(found, wide_owners), "secret_hash").select("doc_id", "secret_hash", "n_here", "kind", "n_occurrences", "n_docs", "n_repositories", "n_owners", "verdict")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", scratch: Scratch | None = None, **options) -> DataFrame:
    """docs, every row, with the live-looking secrets blotted out and ``length_col``, if given, set to the new length."""
    scratch = scratch or Scratch(docs.sparkSession)
    live_id, held, clean = (fresh(docs, c) for c in ("live_id", "live_hashes", "clean_text"))
    live = scan(docs, id_col, text_col, scratch=scratch, **options).where("verdict = 'live'")
    live = scratch.table(live.groupBy("doc_id").agg(F.collect_set("secret_hash").alias(held)).withColumnRenamed("doc_id", live_id))
    joined = docs.join(broadcast_if_small(live), F.col(id_col).eqNullSafe(F.col(live_id)), "left")
    values = F.filter(F.transform(found_in(F.col(text_col)), _value), lambda v: F.array_contains(held, F.sha2(v, 256)))
    longest = F.array_sort(F.array_distinct(values), lambda a, b: F.length(b) - F.length(a))
    blotted = F.aggregate(longest, F.col(text_col), lambda text, v: F.replace(text, v, F.lit(REDACTED)))
    joined = joined.withColumn(clean, F.when(F.col(held).isNull(), F.col(text_col)).otherwise(blotted))
    out = {text_col: F.col(clean)}
    if length_col and length_col in docs.columns:
        out[length_col] = F.when(F.col(held).isNull(), F.col(length_col)).otherwise(F.length(clean).cast(docs.schema[length_col].dataType))
    return joined.select(*(out.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


def oracle_sql() -> str:
    """The rows of ``scan`` over documents in DuckDB's SQL."""

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    return f"""
WITH found AS (
  SELECT doc_id, source AS owner, source || '/' || lang AS repository, unnest(regexp_extract_all(text, {quoted(CANDIDATE)}, 0)) AS m FROM documents
), split AS (
  SELECT *, regexp_extract(m, {quoted(f'^(?:{ASSIGNED})$')}, 1) AS q, regexp_extract(m, {quoted(f'^(?:{BARE})$')}, 1) AS b FROM found
), valued AS (
  SELECT doc_id, owner, repository, m, CASE WHEN q <> '' THEN q WHEN b <> '' THEN b ELSE m END AS v
  FROM split WHERE q <> '' OR b = '' OR regexp_matches(b, {quoted(ISSUED)}) OR (regexp_matches(b, '[0-9]') AND regexp_matches(b, '[A-Za-z]'))
), marked AS (
  SELECT doc_id, owner, repository, sha256(v) AS secret_hash,
         CASE WHEN starts_with(m, '-----BEGIN') THEN 'private_key' WHEN regexp_matches(v, {quoted(f'^(?:{ISSUED})$')}) THEN 'issued_key' ELSE 'assigned' END AS kind,
         regexp_matches(v, {quoted(PLACEHOLDER)}) OR len(list_distinct(string_split(v, ''))) < {MIN_DISTINCT} AS placeholder
  FROM valued
), counted AS (
  SELECT secret_hash, min(kind) AS kind, count(*) AS n_occurrences, count(DISTINCT doc_id) AS n_docs, count(DISTINCT repository) AS n_repositories,
         count(DISTINCT owner) AS n_owners, bool_or(placeholder) AS placeholder FROM marked GROUP BY secret_hash
)
SELECT h.doc_id, h.secret_hash, h.n_here, c.kind, c.n_occurrences, c.n_docs, c.n_repositories, c.n_owners,
       CASE WHEN c.placeholder THEN 'placeholder' WHEN c.n_owners >= {WIDE_OWNERS} THEN 'example' ELSE 'live' END AS verdict
FROM (SELECT doc_id, secret_hash, count(*) AS n_here FROM marked GROUP BY ALL) h JOIN counted c USING (secret_hash)
"""
