"""Fingerprints and stable keys. Parts are joined with concat, so a missing part can't shift the others."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from millrace.functions import text, urls

UNIT = "\x1f"


def stable_hash(*parts: Column) -> Column:
    """sha256 of the parts joined by U+001F; null counts as empty."""
    return F.sha2(F.array_join(F.array(*[p.cast("string") for p in parts]), UNIT, ""), 256)


def event_key(*parts: Column) -> Column:
    return F.concat(F.lit("pipeline:v1:"), stable_hash(*parts))


def fingerprint(title: Column, company: Column, location: Column | None = None, version: int = 4) -> Column:
    """v4: full sha256 of company, title and place; v2: its first 32 digits; v3: 32 digits without the place."""
    place = text.location(location) if location is not None and version != 3 else F.lit("")
    raw = F.sha2(F.concat(text.company(company), F.lit("|"), text.title(title), F.lit("|"), place), 256)
    return F.concat(F.lit(f"v{version}:"), raw if version == 4 else F.substring(raw, 1, 32))


def posting_identity(url: Column, source: Column, source_id: Column) -> Column:
    """A key from the posting's address, else from its source and id there, else null."""
    named = F.concat(F.lit("requisition|"), urls.requisition_key(url))
    own = F.when((F.trim(source) != "") & (F.trim(source_id) != ""), F.concat(F.lit("source|"), text.words(source), F.lit("|"), F.lower(F.trim(source_id))))
    return F.concat(F.lit("posting:v1:"), F.sha2(F.coalesce(named, own), 256))


def description_signature(words: Column, shortest: int = 250) -> Column:
    """sha256 of normal words; null for short texts, which prove nothing."""
    return F.when(F.length(words) >= shortest, F.sha2(words, 256))


def jitter_millis(key: Column, most: int) -> Column:
    """A number from 0 to most, the same for a key every time."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 12), 16, 10).cast("long"), F.lit(most + 1))


def canonical_text(value) -> str:
    """Canonical JSON: sorted keys (by UTF-16 units), no spaces, no escapes beyond the needed."""

    def ordered(v):
        if isinstance(v, dict):
            return {k: ordered(v[k]) for k in sorted(v, key=lambda k: k.encode("utf-16-be", "surrogatepass"))}
        return [ordered(x) for x in v] if isinstance(v, list) else v

    return json.dumps(ordered(value), separators=(",", ":"), ensure_ascii=False)


@pandas_udf(StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """JSON text to canonical JSON; null for what is no JSON."""

    def one(x):
        try:
            return canonical_text(json.loads(x))
        except (TypeError, ValueError):
            return None

    return s.map(one)


#: Kinds of identities and the fields that each one hashes.
IDENTITIES = {
    "aim_trusted_metadata_v1": ("company", "title", "location"),
    "aim_source_identity_v1": ("sourceJdHash", "trustedMetadataHash"),
    "aim_extraction_identity_v1": ("sourceIdentity", "questionRegistryVersion", "questionRegistryHash", "promptContractVersion", "promptContractHash", "responseContractVersion", "responseContractHash", "packetStrategyVersion", "packetStrategyHash", "canonicalizationVersion", "anonymizationPolicyVersion", "anonymizationPolicyHash", "extractorSemanticVersion"),
    "aim_model_metadata_projection_v1": ("fields",),
    "aim_base_membership_v1": ("packetStrategyHash", "baseOrdinal", "sortedQuestionIds"),
    "aim_packet_manifest_v1": ("baseOrdinal", "physicalOrdinal", "orderedQuestionIds", "modelVisibleMetadataProjectionHash"),
    "aim_packet_plan_v1": ("orderedPacketManifestHashes",),
    "aim_packet_checkpoint_v1": ("extractionIdentity", "packetPlanHash", "packetManifestHash"),
    "aim_evidence_v1": ("source", "field", "exactQuote", "orderedOccurrences"),
    "aim_factual_vector_v1": ("scope", "sourceIdentity", "trustedMetadataHash", "questionRegistryHash", "promptContractHash", "responseContractHash", "packetStrategyHash", "canonicalizationVersion", "anonymizationPolicyVersion", "anonymizationPolicyHash", "extractorSemanticVersion", "orderedAnswers", "sourceOrderedEvidenceCatalog"),
    "aim_local_policy_facts_v1": ("sourceIdentity", "trustedMetadataHash", "orderedLocalTriggerCodes"),
    "aim_local_policy_scoring_identity_v1": ("localPolicyFactsHash", "scoringPolicyVersion", "scoringPolicyHash", "resultBuilderSemanticVersion"),
    "aim_scoring_identity_v1": ("factualVectorHash", "trustedMetadataHash", "scoringPolicyVersion", "scoringPolicyHash", "resultBuilderSemanticVersion"),
    "aim_semantic_result_v1": ("resultVariant", "extractionIdentity", "scoringIdentity", "deterministicResult"),
    "aim_batch_item_input_v2": ("stage", "protocolVersion", "exportSchemaVersion", "sourceIdentity", "extractionIdentity", "scoringPolicyHash", "runnerProtocolHash"),
    "aim_result_item_v2": ("itemWithoutResultHash",),
    "aim_result_envelope_v2": ("envelopeWithoutResultHash",),
    "aim_extraction_failure_resolution_v1": ("inputHash", "extractionIdentity", "runnerProtocolHash"),
    "aim_builder_failure_resolution_v1": ("inputHash", "extractionIdentity", "scoringPolicyHash", "resultBuilderSemanticVersion", "runnerProtocolHash"),
    "aim_failure_retry_series_v1": ("jobId", "failureResolutionIdentity", "failureCode"),
    "aim_safe_failure_suppression_v1": ("retrySeriesKey", "permanence"),
}


def identity(kind: str, **fields: Column) -> Column:
    """sha256 over the canonical JSON of a kind's fields and its name; nulls are written. fields: exactly those of the kind."""
    if set(fields) != set(IDENTITIES[kind]):
        raise ValueError(f"{kind} takes {', '.join(IDENTITIES[kind])}")
    row = F.struct(F.lit(kind).alias("kind"), *[v.alias(k) for k, v in sorted(fields.items())])
    return F.sha2(canonical_json(F.to_json(row, {"ignoreNullFields": "false"})), 256)


def ordered_occurrences(occurrences: Column) -> Column:
    """Occurrences by their start and end, once each."""
    return F.array_sort(F.array_distinct(occurrences))


def criterion_id(input_hash: Column, classification: Column, start: Column, end: Column) -> Column:
    """An id for a criterion by where it stands; null without a proper hash and span."""
    good = input_hash.rlike("^[a-f0-9]{64}$") & (start >= 0) & (end > start)
    raw = F.concat(input_hash, F.lit("\x00"), classification, F.lit("\x00"), start.cast("string"), F.lit("\x00"), end.cast("string"))
    return F.when(good, F.concat(F.lit("criterion-"), F.substring(F.sha2(raw, 256), 1, 32)))


def requirement_id(requirement: Column, classification: Column) -> Column:
    """An id for a requirement by its words, whatever their case, spacing and closing marks."""
    plain = F.lower(F.regexp_replace(F.trim(F.regexp_replace(text.compatible(requirement), r"\s+", " ")), "[.;:,]+$", ""))
    return F.concat(F.lit("req-"), F.substring(F.sha2(F.concat(classification, F.lit("\x00"), plain), 256), 1, 24))
