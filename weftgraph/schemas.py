"""The fixed schemas of events, relationships, nodes and key-value logs. All times are epoch milliseconds."""

RELATIONSHIP = (
    "entity_id string, related_id string, rel_type string, inference_type string, confidence double, created_at long, "
    "expires_at long, frequency long, source string, attributes map<string,string>"
)
EVENT = f"event_id string, entity_id string, event_type string, ts_ms long, payload string, features map<string,string>, explicit array<struct<{RELATIONSHIP.replace(' ', ':').replace(',:', ',')}>>"
NODE = "node_id string, node_type string, attributes map<string,string>, ts_ms long, payload string"
KV_LOG = "seq long, op string, key string, value string"

#: Names by code.
RELATIONSHIP_TYPES = ("INTERACTS_WITH", "DEPENDS_ON", "CHILD_OF", "VERSION_MUTATION", "TEMPORAL_SELF", "CAUSES", "PRECEDES", "CONTAINS", "REFERENCES")
INFERENCE_TYPES = ("EXPLICIT", "TEMPORAL", "SEMANTIC", "FREQUENCY_BASED", "CONTEXTUAL")
ERROR_CODES = ("UNKNOWN", "INVALID_REQUEST", "SHARD_UNAVAILABLE", "RATE_LIMITED", "SYSTEM_OVERLOADED", "TIMEOUT", "AUTHENTICATION_FAILED", "AUTHORIZATION_FAILED")
