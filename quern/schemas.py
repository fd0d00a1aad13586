"""Table schemas, closed vocabularies, and conforming rows to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Provenance labels, and the ones whose rows are the author's own.
PROVENANCES = ("authored-solo", "authored-dialogue", "curated", "interpreted", "derived-stratum", "observed", "code")
MIRROR = ("authored-solo", "authored-dialogue")
# Defaults of columns that older rows lack.
CHUNK_DEFAULTS = {"layer": "prose", "qualname": "", "line_start": 0, "line_end": 0, "current": True}


def ddl(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


CHUNKS = (
    "id STRING, digest STRING, title STRING, source_path STRING, chunk_index INT, provenance STRING, text STRING, "
    "layer STRING, qualname STRING, line_start INT, line_end INT, current BOOLEAN, vector ARRAY<FLOAT>"
)
CATALOG = "source_path STRING, digest STRING, title STRING, provenance STRING, active BOOLEAN, updated_at STRING, doc_id STRING"
VERSIONS = "doc_id STRING, version_seq INT, digest STRING, at STRING"
EDGES = "edge_id STRING, u STRING, v STRING, w DOUBLE, sign INT, rel_type STRING, created_at STRING, provenance STRING"
HYPEREDGE_NODES = "edge_id STRING, node_id STRING, role STRING"
READINGS = (
    "spec_hash STRING, corpus_ref STRING, config_fingerprint STRING, seed INT, metric_name STRING, value DOUBLE, "
    "type_tag STRING, interval_lo DOUBLE, interval_hi DOUBLE, evidence_ref STRING"
)
READING_KEY = ["spec_hash", "corpus_ref", "config_fingerprint", "seed", "metric_name"]
VITALS = "ts TIMESTAMP_NTZ, metric STRING, value DOUBLE, unit STRING, source STRING, labels STRING"
STAGED = "row_id STRING, subspace_id STRING, generation INT, payload STRING, ttl_wall STRING, tombstoned_at_gen INT"
CLAIMS = "method STRING, statement STRING, support ARRAY<STRING>, data MAP<STRING,STRING>"
UTTERANCES = "session_id STRING, turn_index INT, speaker STRING, text STRING"
CHAT_EVENTS = "session_id STRING, ord INT, actor STRING, kind STRING, ref STRING, turn_index INT"


def conform(df: DataFrame, schema: str | T.StructType, defaults: dict | None = None) -> DataFrame:
    """df with exactly the schema's columns, in order and type: missing ones
    and nulls take their default, columns beyond the schema go."""
    schema = ddl(schema) if isinstance(schema, str) else schema
    defaults = defaults or {}
    out = []
    for f in schema:
        col: Column = F.col(f.name) if f.name in df.columns else F.lit(None)
        if f.name in defaults:
            col = F.coalesce(col, F.lit(defaults[f.name]))
        out.append(col.cast(f.dataType).alias(f.name))
    return df.select(*out)


def in_vocabulary(col: str, allowed: tuple[str, ...]) -> Column:
    return F.coalesce(F.col(col).isin(*allowed), F.lit(False))


def refuse(df: DataFrame, bad: Column, what: str) -> None:
    """Raise if any row is bad; looks at one such row only."""
    row = df.where(F.coalesce(bad, F.lit(True))).limit(1).collect()
    if row:
        raise ValueError(f"{what}: {row[0].asDict()}")
