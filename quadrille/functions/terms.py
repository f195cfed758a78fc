"""Functions on terms: IRIs, CURIEs, labels and generated names, all as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
OWL = "http://www.w3.org/2002/07/owl#"
DCTERMS = "http://purl.org/dc/terms/"
VOID = "http://rdfs.org/ns/void#"
VOID_EXT = "http://ldf.fi/void-ext#"
TYPE = RDF + "type"
#: Properties that carry labels, best first; inside one rank the smallest text wins.
LABEL_PROPERTIES = (RDFS + "label", "http://purl.org/dc/elements/1.1/title", DCTERMS + "title", "http://purl.obolibrary.org/obo/IAO_0000118", SKOS + "prefLabel", SKOS + "altLabel")
SENTINELS = ("Literal", "Resource")
_SERVICE_DESCRIPTION = "http://www.w3.org/ns/sparql-service-description"
#: Patterns in these namespaces describe the store, not the data.
SERVICE_NAMESPACES = (RDF, RDFS, _SERVICE_DESCRIPTION, _SERVICE_DESCRIPTION + "#", "urn:virtuoso:", "http://localhost:8890/", "http://www.openlinksw.com/")


def is_iri(uri: Column) -> Column:
    """Whether the text has a scheme that names a class or property."""
    return uri.rlike("^(https?://|urn:)")


def namespace(uri: Column) -> Column:
    """Up to and with the last ``#``, else the last ``/``, else nothing."""
    return F.when(uri.contains("#"), F.regexp_extract(uri, "^(.*#)", 1)).when(uri.contains("/"), F.regexp_extract(uri, "^(.*/)", 1)).otherwise("")


def local_name(uri: Column) -> Column:
    """What follows the last ``#`` or ``/``; the whole text if nothing does."""
    tail = F.regexp_extract(uri, "([^/#]+)$", 1)
    return F.when(tail == "", uri).otherwise(tail)


def short_name(uri: Column) -> Column:
    """The last non-empty piece after ``#``, else after ``/``."""
    after = F.substring_index(uri, "#", -1)
    slash = F.substring_index(F.regexp_replace(uri, "/+$", ""), "/", -1)
    return F.when(uri.contains("#") & (after != ""), after).when(slash != "", slash).otherwise(uri)


def prefix_of(ns: Column) -> Column:
    """A short prefix made from a namespace: its last path segment or first host label."""
    bare = F.regexp_replace(F.regexp_replace(ns, "https?://|www\\.", ""), "^[/#]+|[/#]+$", "")
    slug = F.when(bare.contains("/"), F.substring_index(bare, "/", -1)).otherwise(F.substring_index(bare, ".", 1))
    return F.substring(F.regexp_replace(slug, "[^a-zA-Z0-9_]", ""), 1, 10)


def structural_curie(uri: Column) -> Column:
    """prefix:local from the IRI's own shape; the IRI when either would be empty."""
    ns = namespace(uri)
    prefix, local = prefix_of(ns), F.substr(uri, F.length(ns) + 1)
    return F.when((prefix != "") & (local != ""), F.concat(prefix, F.lit(":"), local)).otherwise(uri)


def expand(curie: Column, context: Column) -> Column:
    """IRI of a CURIE by a map of prefixes; IRIs and unknown prefixes pass through."""
    pieces = F.split(curie, ":", 2)
    ns = F.try_element_at(context, pieces[0])
    return F.when(is_iri(curie) | ~curie.contains(":") | ns.isNull(), curie).otherwise(F.concat(ns, pieces[1]))


def slug(name: Column) -> Column:
    """A local name made of a dataset's name or URL."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "^https?://", ""), "[^A-Za-z0-9._-]", "_"), "_+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(clean, "^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def _linkml_local(local: Column) -> Column:
    out = F.regexp_replace(F.replace(local, F.lit("."), F.lit("_")), "([a-zA-Z])([0-9])", "$1_$2")
    return F.regexp_replace(F.regexp_replace(out, "([a-z])([A-Z])", "$1_$2"), "[^a-zA-Z0-9_]", "_")


def linkml_name(curie: Column) -> Column:
    """A LinkML identifier: words cut at digits and capitals, a letter first."""
    pieces = F.split(curie, ":", 2)
    raw = F.when(curie.contains(":"), F.concat(F.regexp_replace(pieces[0], "[^a-zA-Z0-9_]", "_"), F.lit("_"), _linkml_local(F.get(pieces, 1)))).otherwise(_linkml_local(curie))
    name = F.regexp_replace(F.regexp_replace(raw, "_+", "_"), "^_|_$", "")
    return F.when(name == "", "unknown_item").when(~name.rlike("^[a-zA-Z]"), F.concat(F.lit("item_"), name)).otherwise(name)


def _local_part(curie: Column) -> Column:
    return F.when(curie.contains(":"), F.get(F.split(curie, ":", 2), 1)).when(curie.contains("/"), F.substring_index(curie, "/", -1)).otherwise(F.substring_index(curie, "#", -1))


def class_name(curie: Column) -> Column:
    """A CamelCase name for RDF-config."""
    local = F.regexp_replace(_local_part(curie), "[^a-zA-Z0-9]", "")
    local = F.when(local.rlike("^[0-9]"), F.concat(F.lit("C"), local)).otherwise(local)
    return F.when(local == "", "Class").otherwise(F.concat(F.upper(F.substring(local, 1, 1)), F.substr(local, F.lit(2))))


def variable_name(curie: Column) -> Column:
    """A snake_case name for RDF-config."""
    out = F.regexp_replace(F.regexp_replace(_local_part(curie), "[^a-zA-Z0-9_]", "_"), "([a-z])([A-Z])", "$1_$2")
    return F.regexp_replace(F.regexp_replace(F.lower(out), "_+", "_"), "^_|_$", "")


def partition_id(*parts: Column) -> Column:
    """Twelve hexadecimal digits that name a property partition; null parts count as empty."""
    return F.substring(F.md5(F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts))), 1, 12)


def confidence(n: Column) -> Column:
    """How far a class pair is trusted after n instance pairs: min(1, log2(1 + n) / 10)."""
    return F.least(F.lit(1.0), F.log2(n + 1) / 10)


def graph_folder(uri: Column) -> Column:
    return F.replace(F.regexp_replace(uri, "^https?://", ""), F.lit("/"), F.lit("_"))


def void_base(override: Column, declared: Column, name: Column, template: str = "https://example.org/void/") -> Column:
    """The base for VoID nodes, always with one closing slash."""
    base = F.coalesce(F.nullif(override, F.lit("")), F.nullif(declared, F.lit("")), F.concat(F.lit(template), name))
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"))


def config_label(label: Column) -> dict[str, Column]:
    """Fields of a run's label: ``one_shot`` or ``chunkN_batchM`` with an optional ``_ccK``."""
    number = lambda pattern: F.regexp_extract(label, pattern, 1).try_cast("int")
    return {
        "is_one_shot": label == "one_shot",
        "chunk_size": number("^chunk([0-9]+)_batch"),
        "class_batch": number("_batch([0-9]+)"),
        "class_chunk": number("_cc([0-9]+)$"),
    }


FORMATS = (("nq", "nquads|nq"), ("trig", "trig"), ("nt", "ntriples|nt"), ("ttl", "turtle|ttl"), ("n3", "n3"), ("rdfxml", "rdf|owl|xml"), ("obo", "obo"), ("jsonld", "jsonld"))


def data_format(url: Column) -> Column:
    """The RDF format that a download's name announces, or null; compression and query are ignored."""
    path = F.regexp_replace(F.regexp_replace(F.lower(url), "[?#].*$", ""), "\\.(gz|xz|bz2|zip)$", "")
    out = F.lit(None).cast("string")
    for name, endings in reversed(FORMATS):
        out = F.when(path.rlike(f"\\.({endings})$"), name).otherwise(out)
    return out


def source_mode(endpoint: Column, downloads: Column) -> Column:
    """remote, local, both or unknown, from an endpoint and an array of download URLs."""
    local = F.coalesce(F.exists(downloads, lambda u: data_format(u).isNotNull()), F.lit(False))
    remote = F.coalesce(endpoint != "", F.lit(False))
    return F.when(local & remote, "both").when(remote, "remote").when(local, "local").otherwise("unknown")
